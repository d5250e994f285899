"""Undirected breadth-first neighbourhoods of landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.pregel import PregelSpec, Send, pregel


def k_hop(graph: Graph, landmarks: list[int], hops: int) -> DataFrame:
    """``(id, landmark, budget)`` with budget = hops left, for vertices within ``hops`` of a landmark."""
    marks = sorted(set(landmarks))
    state = graph.vertices.where(F.col("id").isin(marks)).select("id", F.col("id").alias("landmark"), F.lit(hops).alias("budget"), F.lit(True).alias("active"))
    if hops <= 0:
        return state.drop("active")
    left = {"m": F.col("budget") - 1}
    spec = PregelSpec(
        merge={"n": F.count("*")}, keys=("id", "landmark"), grow=True, max_iter=hops, send=[Send(left), Send(left, to="src")],
        combine={"m": F.min("m")}, update={"budget": F.coalesce("budget", "m")}, changed=F.col("budget").isNull(),
    )
    return pregel(state, graph.edges, spec).drop("active")
