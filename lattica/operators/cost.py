"""What an edge placement costs: sizes, out-degree-complete vertices and un-cut edges per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_sizes(placed: DataFrame) -> DataFrame:
    """``placed(src, dst, pid)`` to ``(pid, n_vertices, n_edges)``; vertices are distinct endpoints."""
    ends = placed.select("pid", F.explode(F.array("src", "dst")).alias("id")).distinct()
    v = ends.groupBy("pid").agg(F.count("*").alias("n_vertices"))
    return v.join(placed.groupBy("pid").agg(F.count("*").alias("n_edges")), "pid")


def filtered_vertices(placed: DataFrame) -> DataFrame:
    """``(pid, id)``: endpoints all of whose out-edges lie in the partition; 0 of 0 counts."""
    local = placed.select("pid", F.col("src").alias("id"), F.lit(1).alias("o")).unionAll(placed.select("pid", F.col("dst").alias("id"), F.lit(0).alias("o")))
    local = local.groupBy("pid", "id").agg(F.sum("o").alias("local_degree"))
    total = placed.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return local.join(total, "id", "left").where(F.col("local_degree") == F.coalesce("degree", F.lit(0))).select("pid", "id")


def uncut_edges(placed: DataFrame) -> DataFrame:
    """``(pid, n_uncut)``: edges whose target is complete in their own partition; a vertex that is complete in
    several belongs to the smallest."""
    owner = filtered_vertices(placed).groupBy(F.col("id").alias("dst")).agg(F.min("pid").alias("owner"))
    return placed.join(owner, "dst", "left").groupBy("pid").agg(F.count_if(F.col("owner") == F.col("pid")).alias("n_uncut"))


def partition_report(placed: DataFrame) -> DataFrame:
    """``(pid, n_vertices, n_edges, n_filtered, n_uncut)``."""
    f = filtered_vertices(placed).groupBy("pid").agg(F.count("*").alias("n_filtered"))
    out = partition_sizes(placed).join(f, "pid", "left").join(uncut_edges(placed), "pid", "left")
    return out.select("pid", "n_vertices", "n_edges", F.coalesce("n_filtered", F.lit(0)).alias("n_filtered"), F.coalesce("n_uncut", F.lit(0)).alias("n_uncut"))
