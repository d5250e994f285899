"""Seeded random graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: Parameters of the out-degree law and the width of the per-source extra weight.
MU, SIGMA, EXTRA = 4.0, 1.3, 100.0 / 9.0


def log_normal_graph(spark: SparkSession, n: int, seed: int = 42, mu: float = MU, sigma: float = SIGMA) -> Graph:
    """``n`` vertices whose out-degrees are log-normal (below ``n``), targets uniform, and edge weight
    1 plus one uniform draw in [0, 100/9) per source. The random columns hash the seed with the ids, so a
    lost partition is computed again alike; 48 bits of an md5, so that other engines can repeat them."""
    def uniform(*cols):
        digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[c if isinstance(c, str) else c.cast("string") for c in cols]))
        return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))

    normal = F.sqrt(-2.0 * F.log(uniform(F.lit("r"), "src"))) * F.cos(2.0 * F.pi() * uniform(F.lit("t"), "src"))
    degree = F.least(F.floor(F.exp(F.lit(mu) + F.lit(sigma) * normal)), F.lit(max(n - 1, 0))).cast("int")
    src = spark.range(n).select(F.col("id").alias("src")).withColumns({"deg": degree, "w": 1.0 + EXTRA * uniform(F.lit("w"), "src")})
    edges = src.where("deg > 0").select("src", "w", F.explode(F.sequence(F.lit(1), "deg")).alias("k"))
    dst = F.floor(uniform(F.lit("d"), "src", "k") * n).cast("long")
    edges = edges.select("src", dst.alias("dst"), "w")
    return Graph(spark.range(n).select("id", F.col("id").alias("attr")), edges)
