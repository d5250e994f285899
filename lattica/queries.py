"""The named queries of the graph engine: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, plans
from .functions.pids import block_pid, random_cut_pid, reverse_1d_pid
from .graph import Graph, max_id
from .operators import PregelSpec, Send, active_edges, cost, pregel
from .operators.placement import materialise, per_partition, place, pre_search
from .plans.labels import history_rollup
from .shared import new_path, stage
from .sources import FIXTURES, fixture, log_normal_graph, parse_edges, read_edge_list
from .sources.fixtures import WHOLE, default_landmarks

#: Parameters shared with the SQL: partitions, ids per block, vertices of the random graph, supersteps of the trace.
PARTS, BLOCK, LOG_NORMAL, TRACED = 4, 500, 500, 3
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def graph(name: str, spark: SparkSession, d: str) -> Graph:
    return Graph.from_edges(fixture(name, spark, d))


def landmarks(g: Graph) -> list[int]:
    return default_landmarks(g.vertices.count())


# -- sources ---------------------------------------------------------------------------------------
@query
def edge_scan(spark, d):
    return graph("li", spark, d).edges


@query
def default_weight(spark, d):
    return graph("ord", spark, d).edges


@query
def edge_text_parse(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat_ws("\t  ", F.col("l_partkey"), F.col("l_suppkey"), F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("value"))
    return parse_edges(lines)


def universe(g: Graph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("on_edge", F.lit(True))
    return g.vertices.join(ends, "id", "left").select("id", "attr", F.col("on_edge").isNull().alias("isolated"))


def _edge_file(name, spark, d):
    """The URI of a graph written as a text edge list."""
    path, edges = new_path(spark, "edges"), fixture(name, spark, d)
    edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in edges.columns])).write.text(path)
    return path


@query
def edge_list_file(spark, d):
    """A text edge list read from its URI, its edges placed by a partitioner."""
    return read_edge_list(spark, _edge_file("li", spark, d), PARTS, random_cut_pid).edges


@query
def edges_repartitioned(spark, d):
    """Edges in a given number of partitions: in how many each source is found."""
    edges = Graph.from_edges(fixture("li", spark, d), PARTS).edges.withColumn("at", F.spark_partition_id())
    return edges.groupBy("src").agg(F.count("*").alias("n_edges"), F.countDistinct("at").alias("n_partitions"))


@query
def persisted_cardinalities(spark, d):
    """Both tables computed and cached at once, used, and released."""
    g = graph("ord", spark, d).persist(eager=True)
    out = stage(g.cardinalities(), "counts")
    g.close()
    return out


@query
def cli_components(spark, d):
    return cli.run(spark, "cc", _edge_file("ord", spark, d), PARTS)


@query
def cli_paths(spark, d):
    return cli.run(spark, "sssp", _edge_file("li", spark, d), PARTS).select("id", "landmark", F.round("dist", 6).alias("dist"))


@query
def cli_cost(spark, d):
    return cli.run(spark, "cost", _edge_file("li", spark, d), PARTS)


@query
def vertex_universe(spark, d):
    return universe(graph("sparse", spark, d))


def _whole(spark, d, f):
    """``f`` of every graph that is a whole projection of its table, with the graph's name."""
    parts = [f(graph(n, spark, d)).select(F.lit(n).alias("name"), "*") for n in WHOLE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query
def vertex_universe_whole(spark, d):
    return _whole(spark, d, universe)


@query
def cardinalities_whole(spark, d):
    return _whole(spark, d, Graph.cardinalities)


@query
def max_id_all(spark, d):
    parts = [max_id(fixture(n, spark, d)).select(F.lit(n).alias("name"), "max_id") for n in sorted(FIXTURES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query
def cardinalities(spark, d):
    return graph("sparse", spark, d).cardinalities()


# -- graph algebra ---------------------------------------------------------------------------------
@query
def out_degree(spark, d):
    return graph("li", spark, d).out_degrees()


@query
def in_degree(spark, d):
    return graph("li", spark, d).in_degrees()


@query
def zero_fill_degree(spark, d):
    g = graph("li", spark, d)
    return g.outer_join_vertices(g.out_degrees(), {"degree": 0}).select("id", "degree")


@query
def triplets(spark, d):
    g = graph("li", spark, d).map_vertices(attr=F.col("id") * 2)
    return g.triplets()


@query
def map_vertices(spark, d):
    return graph("li", spark, d).map_vertices(attr=F.col("attr") * 2 + 1).vertices


@query
def map_edges(spark, d):
    return graph("li", spark, d).map_edges(w=F.col("w") + 0.5).edges


@query
def join_vertices(spark, d):
    g = graph("li", spark, d)
    return g.join_vertices(g.out_degrees(), attr=F.col("attr") + F.col("degree")).vertices


@query
def pr_edge_weight(spark, d):
    g = graph("li", spark, d)
    degrees = g.outer_join_vertices(g.out_degrees(), {"degree": 0}).select("id", F.col("degree").alias("attr"))
    out = Graph(degrees, g.edges).map_triplets(w=F.lit(1.0) / F.col("src_attr")).edges
    return out.select("src", "dst", F.round("w", 9).alias("w"))


@query
def edge_wash(spark, d):
    return graph("li", spark, d).wash().edges


@query
def reverse_edges(spark, d):
    return graph("li", spark, d).reverse().edges.select("src", "dst", "w")


@query
def vertex_filter(spark, d):
    g = graph("li", spark, d)
    return g.outer_join_vertices(g.out_degrees(), {"degree": 0}).where("degree > 0").select("id", "degree")


@query
def active_scan(spark, d):
    """The activity restriction of a superstep: edges whose source (out) or either end (either) is active."""
    g = graph("li", spark, d)
    active = g.vertices.where("id % 7 = 0").select("id")  # the feature: some vertices are active, others not
    tag = lambda t: active_edges(g.edges, active, t).select(F.lit(t).alias("direction"), "src", "dst", "w")
    return tag("out").unionAll(tag("either"))


def _heard(direction, spark, d):
    """One superstep from the same active vertices: the smallest sender and the number of messages that each vertex hears."""
    g = graph("li", spark, d)
    state = g.vertices.select("id", F.lit(-1).cast("long").alias("least"), F.lit(0).cast("long").alias("heard"), (F.col("id") % 7 == 0).alias("active"))
    spec = PregelSpec(
        send=[Send({"m": F.col("src")})], combine={"m": F.min("m"), "k": F.count("*")}, direction=direction, max_iter=1,
        update={"least": F.col("m"), "heard": F.col("k")},
    )
    return pregel(state, g.edges, spec).select("id", "least", "heard")


@query
def superstep_out(spark, d):
    return _heard("out", spark, d)


@query
def superstep_either(spark, d):
    return _heard("either", spark, d)


@query
def superstep_all(spark, d):
    return _heard("all", spark, d)


@query
def superstep_trace(spark, d):
    """Every state of the first supersteps of the smallest label, two steps from one written state to the next."""
    g, seen = graph("ord", spark, d), []
    state = g.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("active"))
    label = {"m": F.col("label")}
    pregel(state, g.edges, PregelSpec(
        send=[Send(label), Send(label, to="src")], combine={"m": F.min("m")}, update={"label": F.least("label", "m")},
        changed=F.col("m") < F.col("label"), max_iter=TRACED, stage_every=2, trace=True, on_step=seen.append,
    ))
    parts = [m["state"].select(F.lit(m["step"]).alias("step"), "id", "label") for m in seen]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _doubled(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("dst"), pc.multiply(b.column("w"), 2.0)], names=["dst", "m"])


@query
def superstep_kernel(spark, d):
    """A superstep whose messages come from an Arrow kernel over the scanned edges."""
    g = graph("li", spark, d)
    state = g.vertices.select("id", F.lit(0.0).alias("total"), F.lit(True).alias("active"))
    spec = PregelSpec(send=[Send({"m": F.col("m")}, kernel=(_doubled, "dst long, m double"))], combine={"m": F.sum("m")}, update={"total": F.col("m")}, max_iter=1)
    return pregel(state, g.edges, spec).select("id", F.round("total", 6).alias("total"))


# -- shortest paths --------------------------------------------------------------------------------
def _sssp(name, spark, d):
    g = graph(name, spark, d)
    return plans.shortest_paths(g, landmarks(g)).select("id", "landmark", F.round("dist", 6).alias("dist"))


@query
def sssp(spark, d):
    return _sssp("li", spark, d)


@query
def sssp_orders(spark, d):
    return _sssp("ord", spark, d)


@query
def sssp_events(spark, d):
    return _sssp("ev", spark, d)


@query
def sssp_map_packed(spark, d):
    g = graph("li", spark, d)
    marks = landmarks(g)
    return plans.pack(plans.shortest_paths(g, marks), marks)


@query
def sssp_skipping(spark, d):
    """Superstep skipping: local fixed points inside each edge partition between exchanges; same distances."""
    g = graph("li", spark, d)
    return plans.shortest_paths_skipping(g, landmarks(g), PARTS).select("id", "landmark", F.round("dist", 6).alias("dist"))


@query
def sssp_skipping_blocks(spark, d):
    """The same in the layout of another partitioner, two local steps at a time."""
    g = graph("li", spark, d)
    out = plans.shortest_paths_skipping(g, landmarks(g), PARTS, block_pid(BLOCK), local_steps=2)
    return out.select("id", "landmark", F.round("dist", 6).alias("dist"))


@query
def cc_skipping(spark, d):
    """The same driver with another algorithm, one local step at a time and the vote on what may be skipped."""
    return plans.connected_skipping(graph("li", spark, d), PARTS, local_steps=1)


# -- components ------------------------------------------------------------------------------------
@query
def cc_cap20(spark, d):
    return plans.connected_capped(graph("ord", spark, d), 20)


@query
def cc_full(spark, d):
    return plans.connected_components(graph("ord", spark, d))


@query
def cc_sparse(spark, d):
    return plans.connected_components(graph("sparse", spark, d))


@query
def cc_sizes(spark, d):
    return cc_full(spark, d).groupBy("component").agg(F.count("*").alias("size"))


# -- label propagation -----------------------------------------------------------------------------
@query
def lpa_15(spark, d):
    return plans.label_propagation(graph("li", spark, d), 15)


@query
def lpa_events(spark, d):
    return plans.label_propagation(graph("ev", spark, d), 15)


@query
def lpa_resume(spark, d):
    g = graph("li", spark, d)
    return plans.label_resume(g, plans.label_propagation(g, 3), 2)


@query
def lpa_history(spark, d):
    return plans.label_history(graph("ev", spark, d), 15)


@query
def lpa_history_resume(spark, d):
    g = graph("ev", spark, d)
    return plans.label_history(g, 2, plans.label_propagation(g, 3))


@query
def lpa_history_rollup(spark, d):
    return history_rollup(plans.label_history(graph("ev", spark, d), 15))


@query
def lpa_label_sizes(spark, d):
    return lpa_15(spark, d).groupBy("label").agg(F.count("*").alias("size"))


# -- PageRank --------------------------------------------------------------------------------------
def _rounded(df):
    return df.select("id", *[F.round(c, 6).alias(c) for c in df.columns if c != "id"])


@query
def pagerank(spark, d):
    return _rounded(plans.normalise(plans.pagerank(graph("li", spark, d))))


@query
def pagerank_events(spark, d):
    return _rounded(plans.normalise(plans.pagerank(graph("ev", spark, d))))


@query
def pagerank_sinks(spark, d):
    return _rounded(plans.normalise(plans.pagerank(graph("rev", spark, d))))


@query
def pagerank_raw(spark, d):
    return _rounded(plans.pagerank(graph("li", spark, d)))


@query
def pagerank_personalized(spark, d):
    return _rounded(plans.normalise(plans.pagerank(graph("li", spark, d), source=1), personalised=True))


@query
def rank_sum(spark, d):
    return plans.pagerank(graph("li", spark, d)).agg(F.round(F.sum("rank"), 4).alias("rank_sum"), F.count("*").alias("n_vertices"))


# -- neighbourhoods and partitions -----------------------------------------------------------------
@query
def khop_2(spark, d):
    g = graph("li", spark, d)
    return plans.k_hop(g, landmarks(g), 2)


def _placed(partitioner, spark, d):
    return place(graph("li", spark, d).edges, partitioner, PARTS)


@query
def part_1d_reverse(spark, d):
    return _placed(reverse_1d_pid, spark, d)


@query
def part_block(spark, d):
    return _placed(block_pid(BLOCK), spark, d)


@query
def part_random_cut(spark, d):
    return _placed(random_cut_pid, spark, d)


@query
def part_presearch(spark, d):
    g = graph("ord", spark, d)
    return pre_search(g, landmarks(g), PARTS)


@query
def edges_at_pid(spark, d):
    """Edges moved to the Spark partition that their pid names, and where they are found."""
    return materialise(_placed(block_pid(BLOCK), spark, d), PARTS).select("src", "dst", "w", "pid", F.spark_partition_id().alias("found"))


def _described(t):
    weights = t.column("w").to_numpy()
    return pa.table([t.column("pid")[:1], pa.array([t.num_rows], pa.int64()), pa.array([pc.count_distinct(t.column("src")).as_py()], pa.int64()), pa.array([weights.max()])], names=["pid", "n_edges", "n_sources", "top_weight"])


@query
def per_partition_procedure(spark, d):
    """A procedure of one Arrow table for each placed partition."""
    return per_partition(_placed(reverse_1d_pid, spark, d), _described, "pid int, n_edges long, n_sources long, top_weight double")


@query
def partition_sizes(spark, d):
    return cost.partition_sizes(_placed(reverse_1d_pid, spark, d))


@query
def partition_filtered(spark, d):
    return cost.filtered_vertices(_placed(block_pid(BLOCK), spark, d))


@query
def partition_uncut(spark, d):
    return cost.uncut_edges(_placed(reverse_1d_pid, spark, d))


@query
def partition_report(spark, d):
    return cost.partition_report(_placed(block_pid(BLOCK), spark, d))


@query
def lognormal_graph(spark, d):
    return log_normal_graph(spark, LOG_NORMAL).edges.select("src", "dst", F.round("w", 6).alias("w"))
