"""The core operator: bulk-synchronous message passing where each superstep is one Catalyst query.

A superstep joins the edges with the active part of the state, groups the messages by their key (hash
aggregation combines map-side) and joins the merged messages back. Algorithms are column expressions; no
Python code runs per record. The new state is written to the shared folder each step, with the number of
active rows observed by the same job, so a step costs one action and the plan never grows.

A step costs a job however few rows are active, so long chains are dear. An algorithm may therefore name a ``finish``:
once the edges that can still carry a message fit one task, that task runs the supersteps that are left.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..shared import drop, stage

#: Activity rules: which end of an edge must have changed in the last step for the edge to be scanned. "out": the end
#: that a rule sends from; "either": one of both; "all": none.
DIRECTIONS = ("out", "either", "all")
#: Edges that one task takes to finish: 24 bytes a row; with its indexes several times that (not measured). More stay distributed.
FINISH_EDGES = 1 << 21


def active_edges(edges: DataFrame, active: DataFrame, direction: str = "out", origin: str = "src") -> DataFrame:
    """The rows of ``edges`` that a superstep scans, given the distinct ids in ``active(id)``."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}; one of {DIRECTIONS}")
    if direction == "all":
        return edges
    other = "dst" if origin == "src" else "src"
    here, there = (active.select(F.col("id").alias(c)) for c in (origin, other))
    out = edges.join(here, origin, "left_semi")
    if direction == "out":
        return out
    return out.unionByName(edges.join(here, origin, "left_anti").join(there, other, "left_semi"))


@dataclass(frozen=True)
class Send:
    """One message rule. ``to`` names the receiving endpoint; ``where`` and ``values`` use the edge columns and
    the sender's state columns under their own names. A rule with ``to="src"`` sends against the edge.
    ``kernel``, a ``mapInArrow`` function and its schema, may turn the scanned rows into others before ``values``."""

    values: dict[str, Column]
    to: str = "dst"
    where: Column | None = None
    kernel: tuple[Callable, str] | None = None


@dataclass(frozen=True)
class PregelSpec:
    """``keys``: the key of the state, vertex id first; further keys travel with the messages.
    ``combine``: aggregates per ``keys + combine_keys``; ``choose``: optional second aggregates per ``keys``.
    ``update``: new state columns from the old ones and the merged message columns (null: no message).
    ``changed``: activity after the step (default: a message came). ``grow``: messages may create state rows.
    ``direction``: one of DIRECTIONS. ``merge``: aggregates that make parallel edges one. ``stage_every``: steps from
    one written state to the next; those between are cached. ``trace``: ``on_step`` also gets each state, and none is
    deleted. ``finish``: the supersteps that are left as a function of two Arrow tables, live edges and the state of
    their ends, that returns that state without ``active``. It needs one rule that sends along the edges, and it is left
    out where ``max_iter``, ``on_step`` or ``trace`` ask for single steps."""

    send: list[Send]
    combine: dict[str, Column]
    update: dict[str, Column]
    keys: tuple[str, ...] = ("id",)
    combine_keys: tuple[str, ...] = ()
    choose: dict[str, Column] = field(default_factory=dict)
    changed: Column | None = None
    sends_if: Column | None = None
    grow: bool = False
    max_iter: int | None = None
    on_step: Callable[[dict], None] | None = None
    direction: str = "out"
    merge: dict[str, Column] = field(default_factory=dict)
    stage_every: int = 1
    trace: bool = False
    finish: Callable[[pa.Table, pa.Table], pa.Table] | None = None


def lay(edges: DataFrame, origin: str, merge: dict[str, Column] | None = None) -> DataFrame:
    """Edges cached in the layout of their joins with senders, so that supersteps exchange only state and messages."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.repartition(n, origin)
    return (edges.groupBy("src", "dst").agg(*[c.alias(k) for k, c in merge.items()]) if merge else edges).persist()


def pregel(state: DataFrame, edges: DataFrame, spec: PregelSpec) -> DataFrame:
    """Run supersteps until no sender is active or ``max_iter`` steps were applied.

    ``state`` has ``spec.keys``, the state columns and a boolean ``active``. ``max_iter`` counts message
    applications after the initial one.
    """
    if spec.max_iter is not None and spec.max_iter <= 0:
        raise ValueError("max_iter must be positive")
    if spec.direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {spec.direction!r}; one of {DIRECTIONS}")
    columns, step = state.columns, 0
    sends_if = spec.sends_if if spec.sends_if is not None else F.lit(True)
    laid = {o: lay(edges, o, spec.merge) for o in {"src" if r.to == "dst" else "dst" for r in spec.send}}
    state, active = _staged(state, sends_if)
    olds: list[DataFrame] = []
    live = None
    # seeds reach few edges from the start; where every vertex may send, edges fall out after the first step
    ready = None if not spec.finish or spec.max_iter or spec.on_step or spec.trace else 0 if spec.grow else 1
    while active and (spec.max_iter is None or step < spec.max_iter):
        if step == ready:
            live, n = _live(laid["src"] if step else edges, state, spec, sends_if)
            if n <= FINISH_EDGES:
                olds, state = [*olds, state], _finished(state, live, spec)
                for old in olds:
                    old.unpersist() if old.is_cached else drop(old)
                break
            laid["src"].unpersist()
            laid["src"] = lay(live, "src", spec.merge)
        began = time.monotonic()
        new = _apply(state, _messages(state, laid, spec, sends_if), spec).select(*columns)
        step += 1
        keep = bool(step % spec.stage_every) and step != spec.max_iter
        last, (state, active) = state, _staged(new, sends_if, cached=keep)
        olds = [*olds, last]
        if not keep:  # what a written state came from is not needed any more
            for old in [] if spec.trace else olds:
                old.unpersist() if old.is_cached else drop(old)
            olds = []
        if spec.on_step:
            spec.on_step({"step": step, "n_active": active, "secs": time.monotonic() - began} | ({"state": state} if spec.trace else {}))
    for e in laid.values():
        e.unpersist()
    if live is not None:
        drop(live)
    return state


def _live(edges: DataFrame, state: DataFrame, spec: PregelSpec, sends_if: Column) -> tuple[DataFrame, int]:
    """The edges that can still carry a message, and their number: their source sends now, or is the target of an edge
    that can. Seen one hop back at a time, until they fit one task or hardly any falls out."""
    senders = state.where(F.col("active") & sends_if).select(F.col(spec.keys[0]).alias("src"))
    live, n, was = edges, 0, float("inf")
    while True:
        ends, seen = live.select(F.col("dst").alias("src")).union(senders).distinct(), Observation()
        new = stage(live.join(ends, "src", "left_semi").observe(seen, F.count("*").alias("n")), "live")
        if was < float("inf"):
            drop(live)
        live, n = new, seen.get["n"] or 0
        if n <= FINISH_EDGES or n > 0.9 * was:
            return live, n
        was = n


def _finished(state: DataFrame, live: DataFrame, spec: PregelSpec) -> DataFrame:
    keys, columns = list(spec.keys), [c for c in state.columns if c != "active"]
    ends = live.select(F.col("src").alias(keys[0])).union(live.select("dst")).distinct()
    one = F.lit(0).alias("_one")
    left, right = live.select(one, "*"), state.join(ends, keys[0], "left_semi").select(one, *state.columns)
    out = left.groupBy("_one").cogroup(right.groupBy("_one")).applyInArrow(spec.finish, state.select(*columns).schema)
    out = out.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns if c not in keys])
    joined = state.join(out, keys, "full" if spec.grow else "left")
    cols = [F.col(c) if c in keys else F.coalesce(f"_{c}", c).alias(c) for c in columns]
    return stage(joined.select(*cols, F.lit(False).alias("active")).select(*state.columns), "superstep")


def _staged(state: DataFrame, sends_if: Column, cached: bool = False) -> tuple[DataFrame, int]:
    if cached:
        out = state.persist()
        return out, out.where(F.col("active") & sends_if).count()
    seen = Observation()
    out = stage(state.observe(seen, F.count_if(F.col("active") & sends_if).alias("n")), "superstep")
    return out, seen.get["n"] or 0


def _messages(state: DataFrame, laid: dict[str, DataFrame], spec: PregelSpec, sends_if: Column) -> DataFrame:
    senders = state.where(F.col("active") & sends_if if spec.direction == "out" else sends_if).drop("active")
    active = state.where("active").select(F.col(spec.keys[0]).alias("id")).distinct() if spec.direction == "either" else None
    parts = []
    for rule in spec.send:
        origin = "src" if rule.to == "dst" else "dst"
        edges = laid[origin] if active is None else active_edges(laid[origin], active, "either", origin)
        hop = edges.join(senders.withColumnRenamed(spec.keys[0], origin), origin)
        hop = hop.where(rule.where) if rule.where is not None else hop
        hop = hop.mapInArrow(*rule.kernel) if rule.kernel else hop
        extra = [F.col(k) for k in spec.keys[1:]]
        parts.append(hop.select(F.col(rule.to).alias(spec.keys[0]), *extra, *[v.alias(c) for c, v in rule.values.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy(*spec.keys, *spec.combine_keys).agg(*[c.alias(n) for n, c in spec.combine.items()])
    if spec.choose:
        out = out.groupBy(*spec.keys).agg(*[c.alias(n) for n, c in spec.choose.items()])
    return out


def _apply(state: DataFrame, messages: DataFrame, spec: PregelSpec) -> DataFrame:
    joined = state.join(messages.withColumn("_hit", F.lit(True)), list(spec.keys), "full" if spec.grow else "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    active = hit if spec.changed is None else hit & F.coalesce(spec.changed, F.lit(False))
    cols = [F.when(hit, spec.update[c]).otherwise(F.col(c)).alias(c) if c in spec.update else F.col(c) for c in state.columns if c != "active"]
    return joined.select(*cols, active.alias("active"))
