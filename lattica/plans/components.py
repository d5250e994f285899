"""Connected components over the undirected view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.pregel import PregelSpec, Send, pregel
from ..shared import drop, stage


def connected_capped(graph: Graph, max_iter: int = 20, on_step=None) -> DataFrame:
    """``max_iter`` synchronous rounds of the smallest label; long chains stay unfinished, by contract."""
    if max_iter is None or max_iter <= 0:
        raise ValueError("max_iter must be positive")
    label = F.col("label")
    spec = PregelSpec(
        send=[Send({"m": label}), Send({"m": label}, to="src")],
        combine={"m": F.min("m")}, update={"label": F.least("label", "m")},
        changed=F.col("m") < label, max_iter=max_iter, on_step=on_step, merge={"n": F.count("*")},
    )
    state = graph.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("active"))
    return pregel(state, graph.edges.where("src <> dst"), spec).select("id", F.col("label").alias("component"))


def connected(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` to ``(id, component)`` for every id on an edge; the component is its smallest id.

    Alternating star contraction: O(log^2 n) rounds whatever the diameter. Each round links every larger
    neighbour, then every smaller one, to the smallest; rows never exceed the edges. Hot vertices only meet
    in combinable minima and in joins that adaptive execution can split.
    """
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    state, was = _stage_counted(e)
    while was[0]:
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, _ = _stage_counted(large)
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        small = small.select("x.u", "x.v").where("u <> v").distinct()
        new, now = _stage_counted(small)
        drop(large)
        drop(state)
        state = new
        if now == was:  # a fixed point
            break
        was = now
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def _stage_counted(df: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """The staged rows, their number and two sums over hashes of them, seen by the job that writes: equal sets of rows have
    equal ones, and different sets do not but by a chance of about 2^-90."""
    seen = Observation()
    small = F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))
    out = stage(df.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(small).alias("s")), "stars")
    return out, (seen.get["n"] or 0, seen.get["x"] or 0, seen.get["s"] or 0)


def connected_components(graph: Graph) -> DataFrame:
    """Converged components for every vertex; isolated ones keep their own id."""
    found = connected(graph.edges.select("src", "dst"))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
