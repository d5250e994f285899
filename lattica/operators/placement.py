"""Edge placement by a partitioner, including the topology-aware one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pids import reverse_1d_pid
from ..graph import Graph
from ..plans.components import connected
from ..plans.khop import k_hop


def place(edges: DataFrame, partitioner, n: int) -> DataFrame:
    """Add ``pid``."""
    return edges.withColumn("pid", partitioner(F.col("src"), F.col("dst"), n))


def materialise(placed: DataFrame, n: int) -> DataFrame:
    """Put each row in the Spark partition that its ``pid`` names."""
    return placed.repartitionById(n, "pid")


def per_partition(placed: DataFrame, procedure, schema: str) -> DataFrame:
    """``procedure``, a function of one Arrow table, over the rows of each ``pid``; a pid must fit a task's memory."""
    return placed.groupBy("pid").applyInArrow(procedure, schema)


def landmark_groups(neighbours: DataFrame, landmarks: DataFrame, n: int) -> DataFrame:
    """``(landmark, pid)``: landmarks whose neighbourhoods meet share a group, transitively; groups are numbered
    by their smallest landmark and dealt round robin."""
    near = neighbours.select("id", "landmark")
    first = near.groupBy("id").agg(F.min("landmark").alias("root"))
    links = near.join(first, "id").where("landmark <> root").select(F.col("landmark").alias("src"), F.col("root").alias("dst")).distinct()
    comp = connected(links)
    root = landmarks.join(comp, F.col("landmark") == F.col("id"), "left").select("landmark", F.coalesce("component", "landmark").alias("root"))
    # one row per landmark: a parameter list, not data
    rank = sorted({r["root"] for r in root.collect()})
    lookup = F.array_position(F.array(*[F.lit(x) for x in rank]), F.col("root")) - 1
    return root.select("landmark", (lookup % n).cast("int").alias("pid"))


def pre_search(graph: Graph, landmarks: list[int], n: int, hops: int = 2) -> DataFrame:
    """Edges with ``pid``: the group of the source if it is a landmark, else of the target, else of the smallest
    landmark that both ends are near, else of the smallest that either end is near, else by hash of the target."""
    spark = graph.edges.sparkSession
    marks = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in landmarks])).alias("landmark"))
    near = k_hop(graph, landmarks, hops)
    groups = landmark_groups(near, marks, n)
    sets = near.groupBy("id").agg(F.sort_array(F.collect_set("landmark")).alias("ls"))
    known = {r["landmark"]: r["pid"] for r in groups.collect()}
    pid_of = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    s = sets.select(F.col("id").alias("src"), F.col("ls").alias("sl"))
    d = sets.select(F.col("id").alias("dst"), F.col("ls").alias("dl"))
    e = graph.edges.join(s, "src", "left").join(d, "dst", "left")
    none = F.array().cast("array<bigint>")
    both = F.array_min(F.array_intersect(F.coalesce("sl", none), F.coalesce("dl", none)))
    either = F.array_min(F.array_union(F.coalesce("sl", none), F.coalesce("dl", none)))
    own = lambda c: F.when(F.col(c).isin(landmarks), F.col(c))
    mark = F.coalesce(own("src"), own("dst"), both, either)
    pid = F.coalesce(F.element_at(pid_of, mark), reverse_1d_pid(F.col("src"), F.col("dst"), n))
    return e.select("src", "dst", "w", pid.alias("pid"))
