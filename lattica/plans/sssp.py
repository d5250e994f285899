"""Weighted shortest paths from several landmarks at once, in long form ``(id, landmark, dist)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.pregel import PregelSpec, Send, pregel


def shortest_paths(graph: Graph, landmarks: list[int], max_iter: int | None = None, on_step=None) -> DataFrame:
    """Reachable pairs only. A message is sent where ``dist + w`` would improve the target, so the loop ends for
    any non-negative weights, fractional ones included. Negative weights raise."""
    if graph.edges.where("w < 0").limit(1).count():
        raise ValueError("negative edge weight")
    marks = sorted(set(landmarks))
    seeds = graph.vertices.where(F.col("id").isin(marks)).select("id", F.col("id").alias("landmark"), F.lit(0.0).alias("dist"), F.lit(True).alias("active"))
    spec = PregelSpec(
        merge={"w": F.min("w")},  # of parallel edges only the cheapest can matter
        keys=("id", "landmark"), grow=True, max_iter=max_iter, on_step=on_step,
        send=[Send({"m": F.col("dist") + F.col("w")})],
        combine={"m": F.min("m")},
        update={"dist": F.least("dist", "m")},
        changed=F.col("dist").isNull() | (F.col("m") < F.col("dist")),
        finish=_finish,
    )
    return pregel(seeds, graph.edges, spec).select("id", "landmark", "dist")


def _finish(edges: pa.Table, state: pa.Table) -> pa.Table:
    """The supersteps that are left, in one task: only the edges of vertices that have just improved are looked at.
    As in SQL, NaN is above all numbers, and a vertex at an infinite distance is reached."""
    src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    order = np.argsort(ends[: len(src)], kind="stable")
    t, w = ends[len(src) :][order], w[order]
    first = np.searchsorted(ends[: len(src)][order], np.arange(len(ids) + 1))
    at, mark, dist, active = (state.column(c).to_numpy() for c in ("id", "landmark", "dist", "active"))
    out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
    for landmark in np.unique(mark):
        own = np.flatnonzero(mark == landmark)
        now, seen = np.full(len(ids), np.nan), np.zeros(len(ids), bool)
        now[np.searchsorted(ids, at[own])] = dist[own]
        seen[np.searchsorted(ids, at[own])] = True
        front = np.searchsorted(ids, at[own[active[own]]])
        while len(front):
            n = first[front + 1] - first[front]
            e = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
            m, to = np.repeat(now[front], n) + w[e], t[e]
            better = ~seen[to] | (m < now[to]) | (np.isnan(now[to]) & ~np.isnan(m))
            np.fmin.at(now, to[better], m[better])
            front = np.unique(to[better])
            seen[front] = True
        reached = np.flatnonzero(seen)
        out.append([ids[reached], np.full(len(reached), landmark), now[reached]])
    return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], names=["id", "landmark", "dist"])


def pack(paths: DataFrame, landmarks: list[int]) -> DataFrame:
    """One row per reached vertex, one ``d1, d2, ...`` column per landmark in the given order; null: unreachable."""
    cols = [F.min(F.when(F.col("landmark") == m, F.col("dist"))).alias(f"d{i + 1}") for i, m in enumerate(landmarks)]
    return paths.groupBy("id").agg(*cols)


def as_map(paths: DataFrame) -> DataFrame:
    """``(id, paths map<landmark, dist>)``."""
    return paths.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("landmark", "dist")))).alias("paths"))
