"""The registry of named graphs: how the star-schema tables become edge lists, and which landmarks they use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import stage


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


def _lineitem(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("w"))


def _events(spark, d):
    """Consecutive users of the whole stream. ``lead`` needs one total order, so a plain window would put
    all rows in one task; instead each row gets its rank by range partition and joins its successor. The edges are
    written once, as an algorithm scans them several times."""
    e = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id", "user_id", "value")
    r = total_rank(e, ["ts", "event_id"]).select("rank", "user_id", "value")
    nxt = r.select((F.col("rank") - 1).alias("rank"), F.col("user_id").alias("dst"))
    return stage(r.join(nxt, "rank").select(F.col("user_id").alias("src"), "dst", F.col("value").alias("w")), "successors")


def total_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Global 0-based ``rank`` without a single-task sort: a staged range partition, then local row numbers
    plus the row counts of the partitions before (one row per partition)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_r", local).join(F.broadcast(starts), "_p").withColumn("rank", F.col("_r") + F.col("_s")).drop("_p", "_n", "_s", "_r")


def _reversed(spark, d):
    return _lineitem(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def _sparse(spark, d):
    return _orders(spark, d).where("src % 5 = 0")


FIXTURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ord": _orders, "li": _lineitem, "ev": _events, "rev": _reversed, "sparse": _sparse,
}

#: The graphs that leave out no row of their table.
WHOLE = ("ev", "li", "ord", "rev")


def fixture(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if name not in FIXTURES:
        raise ValueError(f"unknown graph {name!r}; one of {sorted(FIXTURES)}")
    return FIXTURES[name](spark, sf_dir)


def default_landmarks(n_vertices: int) -> list[int]:
    """Four landmarks a quarter of the id range apart, the first of them 1."""
    q = n_vertices // 4
    return [1 + i * q for i in range(4)]
