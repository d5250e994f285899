"""Label propagation: votes flow along the edges, the most frequent label wins, ties go to the smallest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.pregel import PregelSpec, Send, pregel


def _spec(max_iter: int, history: bool, on_step=None) -> PregelSpec:
    if max_iter is None or max_iter <= 0:
        raise ValueError("max_iter must be positive")
    choose = {"best": F.max(F.struct(F.col("c"), (-F.col("lab")).alias("n"))), "heard": F.count("*")}
    update = {"label": -F.col("best.n"), "votes": F.col("best.c")}
    if history:
        entry = F.struct(F.size("history").alias("step"), F.col("heard").alias("n_labels"))
        update["history"] = F.concat("history", F.array(entry))
    return PregelSpec(
        send=[Send({"lab": F.col("label"), "n": F.col("n")})], combine_keys=("lab",), combine={"c": F.sum("n")},
        choose=choose, update=update, max_iter=max_iter, on_step=on_step,
        merge={"n": F.count("*")},  # parallel edges vote separately; their number travels once
    )


def label_propagation(graph: Graph, max_iter: int = 15, on_step=None) -> DataFrame:
    """``(id, label, votes)``. Only vertices that received votes in the last round vote; all vote in round one."""
    state = graph.vertices.select("id", F.col("id").alias("label"), F.lit(0).cast("long").alias("votes"))
    return label_resume(graph, state, max_iter, on_step)


def label_resume(graph: Graph, state: DataFrame, max_iter: int, on_step=None) -> DataFrame:
    """Go on from ``state(id, label, votes)``. Every vertex is active again, so a + b rounds are not a + b resumed."""
    return pregel(state.withColumn("active", F.lit(True)), graph.edges, _spec(max_iter, False, on_step)).drop("active")


def label_history(graph: Graph, max_iter: int = 15, start: DataFrame | None = None) -> DataFrame:
    """``(id, step, n_labels)``: entries 0 and 1 are the seed and the initial empty message, then one entry per
    message received, with the number of distinct labels heard. ``start(id, label, votes)`` resumes from there."""
    first = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(0).cast("long").alias("n_labels")) for i in (0, 1)])
    state = graph.vertices.select("id", F.col("id").alias("label"), F.lit(0).cast("long").alias("votes")) if start is None else start
    state = state.select("id", "label", "votes", first.alias("history"), F.lit(True).alias("active"))
    return pregel(state, graph.edges, _spec(max_iter, True)).select("id", F.explode("history").alias("h")).select("id", "h.step", "h.n_labels")


def history_rollup(history: DataFrame, steps: int = 15) -> DataFrame:
    """``(step, n_labels)``: labels heard per entry over all vertices; a missing entry counts 0."""
    return history.where(F.col("step") < steps).groupBy("step").agg(F.sum("n_labels").alias("n_labels"))
