"""Delta PageRank until no change exceeds the tolerance, global or personalised."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.pregel import PregelSpec, Send, pregel


def pagerank(graph: Graph, tol: float = 0.001, reset: float = 0.15, source: int | None = None, max_iter: int | None = None, on_step=None) -> DataFrame:
    """``(id, rank, delta)``, not normalised. Senders are vertices that received last round with delta above
    ``tol``; others keep a stale delta but are silent. Dangling mass is not redistributed."""
    if tol < 0:
        raise ValueError("tol must not be negative")
    if not 0 <= reset <= 1:
        raise ValueError("reset must lie in [0, 1]")
    start = F.lit(float(reset)) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    state = graph.vertices.select("id", start.alias("rank"), start.alias("delta"), F.lit(True).alias("active"))
    keep = F.lit(1.0 - reset)
    spec = PregelSpec(
        send=[Send({"m": F.col("delta") * F.col("w")})], sends_if=F.col("delta") > F.lit(float(tol)),
        combine={"m": F.sum("m")},
        update={"rank": F.col("rank") + keep * F.col("m"), "delta": keep * F.col("m")},
        max_iter=max_iter, on_step=on_step,
        finish=lambda edges, state: _finish(edges, state, float(tol), 1.0 - reset),
    )
    return pregel(state, _shares(graph.edges), spec).select("id", "rank", "delta")


def _shares(edges: DataFrame) -> DataFrame:
    """Parallel edges as one that has their share of the source's edges; only the ends are exchanged, once, by source."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = edges.select("src", "dst").repartition(n, "src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return merged.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("w"))


def _finish(edges: pa.Table, state: pa.Table, tol: float, keep: float) -> pa.Table:
    """The rounds that are left, in one task."""
    src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
    ids, rank, delta, active = (state.column(c).to_numpy().copy() for c in ("id", "rank", "delta", "active"))
    order = np.argsort(ids)
    s, t = (order[np.searchsorted(ids, x, sorter=order)] for x in (src, dst))
    while (sends := active & (delta > tol)).any():
        on = np.flatnonzero(sends[s])
        at = t[on]
        m = keep * np.bincount(at, delta[s[on]] * w[on], len(ids))
        active = np.zeros(len(ids), bool)
        active[at] = True
        rank[active] += m[active]
        delta[active] = m[active]
    return pa.table({"id": ids, "rank": rank, "delta": delta})


def normalise(ranks: DataFrame, personalised: bool = False) -> DataFrame:
    """Scale so that the ranks sum to the number of vertices, or to 1 if personalised."""
    total = ranks.agg(F.sum("rank").alias("_s"), F.count("*").alias("_n"))
    scale = F.lit(1.0) if personalised else F.col("_n").cast("double")
    return ranks.join(F.broadcast(total)).select("id", (F.col("rank") * scale / F.col("_s")).alias("rank"))
