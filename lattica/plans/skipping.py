"""Superstep skipping for monotone algorithms: between two exchanges every edge partition sends along its own edges by
itself, so long chains inside a partition cost one superstep instead of many.

After its local steps each partition reports the vertices whose value has fallen, with two flags: ``sync``, another
partition holds edges of the vertex and must hear of it, and ``open``, its own edges may still carry it further. The
exchange is skipped if no report asks for sync and at least one is open; the loop ends if none is open or asks for sync.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.pids import reverse_1d_pid
from ..graph import Graph
from ..shared import drop, stage

#: Edges of a partition where the caller names no number of partitions: what one task holds.
TASK_EDGES = 1_000_000
STATE = "id long, tag long, value double"


@dataclass(frozen=True)
class Monotone:
    """A value per (id, tag) that only falls. ``send`` gives the message from the senders' values and the weights;
    ``both``: against the edges, too. Messages merge by their minimum, which may be repeated and reordered."""

    send: Callable[[np.ndarray, np.ndarray], np.ndarray]
    both: bool = False


def _local(edges: pa.Table, state: pa.Table, rule: Monotone, steps: int | None) -> pa.Table:
    """Fallen ``(id, tag, value)`` rows of one partition after ``steps`` local steps (None: until nothing falls)."""
    names = ["home", "id", "tag", "value", "open"]
    src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
    if rule.both:
        src, dst, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, t = flat[: len(src)], flat[len(src) :]
    at, tag, value = (state.column(c).to_numpy() for c in ("id", "tag", "value"))
    out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)]]
    for mark in np.unique(tag) if len(ids) else []:
        own = tag == mark
        now = np.full(len(ids), np.inf)
        now[np.searchsorted(ids, at[own])] = value[own]
        first, active, step = now.copy(), np.isfinite(now), 0
        while active.any() and (steps is None or step < steps):
            new, live = now.copy(), active[s]
            np.minimum.at(new, t[live], rule.send(now[s[live]], w[live]))
            active, now, step = new < now, new, step + 1
        fell = np.flatnonzero(now < first)
        out.append([ids[fell], np.full(len(fell), mark), now[fell], active[fell]])
    home = edges.column("pid")[0].as_py() if edges.num_rows else 0
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.table([np.full(len(columns[0]), home, np.int32), *columns], names=names)


def skipping(graph: Graph, start: DataFrame, rule: Monotone, partitions: int | None = None, partitioner=reverse_1d_pid, local_steps: int | None = None, on_step=None) -> DataFrame:
    """Run ``rule`` from ``start(id, tag, value)`` until nothing falls. ``partitioner`` places the edges, and the loop
    works in that layout; a partition must fit a task, so without ``partitions`` there is one for each TASK_EDGES."""
    n = partitions or max(int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-graph.edges.count() // TASK_EDGES))
    placed = graph.edges.select("src", "dst", "w", partitioner(F.col("src"), F.col("dst"), n).alias("pid")).repartition(n, "pid").persist()
    ends = placed.select(F.explode(F.array("src", "dst")).alias("id"), F.col("pid").alias("home")).distinct()
    homes = ends.join(ends.groupBy("id").agg((F.count("*") > 1).alias("shared")), "id").persist()
    state, step = stage(start, "skip"), 0
    copies = stage(state.join(homes, "id").select("home", "id", "tag", "value"), "copies")  # what the partitions have not heard
    while True:
        local = placed.groupBy("pid").cogroup(copies.groupBy("home")).applyInArrow(lambda e, s: _local(e, s, rule, local_steps), f"home int, {STATE}, open boolean")
        seen = Observation()
        # a partition does not hold every value, so some of what fell there is no news
        news = local.join(state.withColumnRenamed("value", "had"), ["id", "tag"], "left").where("had is null or value < had").drop("had")
        fell = news.join(homes, ["id", "home"]).observe(seen, F.count_if("shared").alias("sync"), F.count_if("open").alias("open"), F.count("*").alias("n"))
        fell = stage(fell, "fell")
        votes = {k: seen.get[k] or 0 for k in ("n", "sync", "open")}
        best = fell.groupBy("id", "tag").agg(F.min("value").alias("m"))
        merged = stage(state.join(best, ["id", "tag"], "full").select("id", "tag", F.least("value", "m").alias("value")), "skip")
        step += 1
        skip = votes["sync"] == 0 and votes["open"] > 0
        if on_step:
            on_step({"step": step, **votes, "skipped": skip})
        if not votes["sync"] and not votes["open"]:
            for x in (state, copies, fell):
                drop(x)
            placed.unpersist()
            homes.unpersist()
            return merged
        if skip:  # nothing to tell the other partitions: every change goes on where it was made
            new = fell.select("home", "id", "tag", "value")
        else:  # all that fell anywhere goes to every home of its vertex
            new = merged.join(best.select("id", "tag"), ["id", "tag"], "left_semi").join(homes, "id").select("home", "id", "tag", "value")
        new = stage(new, "copies")
        for x in (state, copies, fell):
            drop(x)
        state, copies = merged, new


def shortest_paths_skipping(graph: Graph, landmarks: list[int], partitions: int | None = None, partitioner=reverse_1d_pid, local_steps: int | None = None, on_step=None) -> DataFrame:
    """The same ``(id, landmark, dist)`` as ``shortest_paths``, with fewer exchanges."""
    if graph.edges.where("w < 0").limit(1).count():
        raise ValueError("negative edge weight")
    start = graph.vertices.where(F.col("id").isin(sorted(set(landmarks)))).select("id", F.col("id").alias("tag"), F.lit(0.0).alias("value"))
    out = skipping(graph, start, Monotone(lambda value, w: value + w), partitions, partitioner, local_steps, on_step)
    return out.select("id", F.col("tag").alias("landmark"), F.col("value").alias("dist"))


def connected_skipping(graph: Graph, partitions: int | None = None, partitioner=reverse_1d_pid, local_steps: int | None = None, on_step=None) -> DataFrame:
    """The same ``(id, component)`` as ``connected_components`` (ids below 2^53), by the smallest id that reaches a vertex."""
    start = graph.vertices.select("id", F.lit(0).cast("long").alias("tag"), F.col("id").cast("double").alias("value"))
    out = skipping(graph, start, Monotone(lambda value, w: value, both=True), partitions, partitioner, local_steps, on_step)
    return out.select("id", F.col("value").cast("long").alias("component"))
