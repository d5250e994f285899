"""Whitespace-separated edge lists from any Hadoop URI."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def parse_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """``src dst [weight]`` per line to ``(src, dst, w)``. Blank lines and lines that start with # are skipped,
    leading space is allowed, a missing weight is 1.0. A line of one field raises, as its edge would be lost."""
    line = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    parts = lines.select(line.alias("_l")).where("_l <> '' and not startswith(_l, '#')").select(F.split("_l", " ").alias("_p"))
    at = lambda i: F.try_element_at("_p", F.lit(i))
    return parts.select(
        F.when(F.size("_p") < 2, F.raise_error(F.concat(F.lit("not an edge: "), at(1))).cast("long")).otherwise(at(1).cast("long")).alias("src"), at(2).cast("long").alias("dst"),
        F.coalesce(at(3).cast("double"), F.lit(1.0)).alias("w"),
    )


def read_edge_list(spark: SparkSession, path: str, partitions: int = 4, partitioner=None) -> Graph:
    """Load a text edge list; ``partitioner(src, dst, n)`` optionally places the edges."""
    edges = parse_edges(spark.read.text(path))
    if partitioner is not None:
        edges = edges.withColumn("pid", partitioner(F.col("src"), F.col("dst"), partitions)).repartitionById(partitions, "pid").drop("pid")
        return Graph.from_edges(edges)
    return Graph.from_edges(edges, partitions)
