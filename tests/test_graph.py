"""Hand-made graphs with answers worked out by hand, invariants and edge cases."""

import math
import os
import sys
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica import Graph, cli
from lattica.functions import block_pid, random_cut_pid, reverse_1d_pid
from lattica.operators import PregelSpec, Send, pregel
from lattica.operators.cost import partition_report
from lattica.operators.placement import materialise, per_partition, place
from lattica.operators.pregel import lay
from lattica.plans import connected, connected_capped, connected_components, k_hop, label_history, label_propagation, normalise, pagerank, shortest_paths
from lattica.plans.skipping import connected_skipping, shortest_paths_skipping
from lattica.plans.sssp import as_map
from lattica.queries import REGISTRY
from lattica.shared import scratch, shared_root, stage
from lattica.sources import parse_edges, read_edge_list


def graph(spark, rows):
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, w double"))


def table(df):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r[-1] for r in df.collect()}


def test_paths(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.5), (0, 3, 10.0)])
    want = {(0, 0): 0, (1, 0): 1, (2, 0): 3, (3, 0): 4.5, (1, 1): 0, (2, 1): 2, (3, 1): 3.5}
    assert table(shortest_paths(g, [0, 1])) == want
    assert table(shortest_paths_skipping(g, [0, 1], 2)) == want
    assert {r.id: r.paths for r in as_map(shortest_paths(g, [0, 1])).collect()}[3] == {0: 4.5, 1: 3.5}


def test_paths_end_with_fractional_weights(spark):
    assert table(shortest_paths(graph(spark, [(0, 1, 0.01), (1, 2, 0.03)]), [0])) == {(0, 0): 0.0, (1, 0): 0.01, (2, 0): 0.04}


def test_negative_weight_raises(spark):
    with pytest.raises(ValueError):
        shortest_paths(graph(spark, [(0, 1, -1.0)]), [0])


def test_components(spark):
    g = graph(spark, [(1, 2, 1.0), (2, 1, 1.0), (4, 5, 1.0), (6, 6, 1.0)])
    want = {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert table(connected_components(g)) == want and table(connected_capped(g)) == want


def test_long_chain_needs_the_uncapped_form(spark):
    g = graph(spark, [(i, i + 1, 1.0) for i in range(60)])
    assert set(table(connected_components(g)).values()) == {0}
    assert table(connected_capped(g, 20))[60] == 40


def test_labels(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)])
    assert sorted(map(tuple, label_propagation(g, 15).collect())) == [(0, 0, 0), (1, 0, 1), (2, 1, 1)]
    assert {r.id: r.label for r in label_propagation(g, 14).collect()}[1] == 1
    h = label_history(g, 3).where("id = 0").orderBy("step").collect()
    assert [(r.step, r.n_labels) for r in h] == [(0, 0), (1, 0)]


def test_pagerank_with_a_sink(spark):
    g = graph(spark, [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)])
    raw = {r.id: r["rank"] for r in pagerank(g).collect()}
    assert all(math.isclose(raw[i], x) for i, x in enumerate([0.15, 0.21375, 0.3954375]))
    assert math.isclose(sum(table(normalise(pagerank(g))).values()), 3)


def test_degrees_count_parallel_edges(spark):
    g = graph(spark, [(0, 1, 1.0), (0, 1, 1.0), (0, 0, 1.0)])
    assert table(g.out_degrees()) == {0: 3}
    assert all(math.isclose(r.w, 1 / 3) for r in g.degree_weights().edges.collect())


def test_k_hop(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    assert sorted(map(tuple, k_hop(g, [0], 2).collect())) == [(0, 0, 2), (1, 0, 1), (2, 0, 0)]


def test_partition_ids(spark):
    ids = spark.createDataFrame([(x, x) for x in [0, 1, 2, 3, 5, 99, 8191, 8193, 14999]], "src long, dst long")
    assert [r[0] for r in ids.select(reverse_1d_pid(F.col("src"), F.col("dst"), 4)).collect()] == [0, 1, 2, 3, 1, 3, 3, 3, 1]
    ids = spark.createDataFrame([(x, 0) for x in [0, 499, 500, 1000, 1999]], "src long, dst long")
    assert [r[0] for r in ids.select(block_pid(500)(F.col("src"), F.col("dst"), 4)).collect()] == [0, 0, 1, 2, 3]


def test_placement_and_report(spark):
    placed = place(graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0)]).edges, reverse_1d_pid, 4)
    held = materialise(placed, 4).withColumn("at", F.spark_partition_id())
    assert all(r.pid == r["at"] for r in held.collect())
    assert partition_report(placed).agg(F.sum("n_edges")).first()[0] == 4


def test_parser(spark):
    lines = spark.createDataFrame([("0 1",), ("1\t2  2.5",), ("",), ("# no",), ("  3 4",)], "value string")
    assert sorted(map(tuple, parse_edges(lines).collect())) == [(0, 1, 1.0), (1, 2, 2.5), (3, 4, 1.0)]


def test_a_line_of_one_field_raises(spark):
    with pytest.raises(Exception, match="not an edge: 7"):
        parse_edges(spark.createDataFrame([("0 1",), ("7",)], "value string")).collect()


def test_partition_ids_of_large_ids(spark):
    ids = spark.createDataFrame([((1 << 53) + 1, 0), ((1 << 62) + 5, (1 << 62) + 9)], "src long, dst long")
    s, d = F.col("src"), F.col("dst")
    got = ids.select(block_pid(1)(s, d, 1009).alias("b"), reverse_1d_pid(d, s, 1009).alias("r"), random_cut_pid(s, d, 7).alias("c")).collect()
    assert all(r.b == r.r for r in got)
    mixed = [(a * 31 + b) % (1 << 31) * 1000003 % 7 for a, b in [((1 << 53) + 1, 0), ((1 << 62) + 5, (1 << 62) + 9)]]
    assert [r.c for r in got] == mixed


def test_skipping_votes(spark):
    """A chain inside one partition needs no exchange; one over two partitions does."""
    g = graph(spark, [(i, i + 1, 1.0) for i in range(6)])
    one, two = [], []
    want = {(i, 0): float(i) for i in range(7)}
    assert table(shortest_paths_skipping(g, [0], 1, local_steps=1, on_step=one.append)) == want
    assert [m["skipped"] for m in one] == [True] * 6 + [False] and not any(m["sync"] for m in one)
    halves = lambda src, dst, n: (src >= 3).cast("int")
    assert table(shortest_paths_skipping(g, [0], 2, halves, on_step=two.append)) == want
    assert sum(m["sync"] for m in two) == 1 and len(two) == 2
    assert table(connected_skipping(g, 2, halves, local_steps=2)) == {i: 0 for i in range(7)}


@pytest.mark.parametrize("direction, want", [("out", {1: 1}), ("either", {1: 1, 0: 1}), ("all", {1: 1, 0: 1, 3: 1})])
def test_directions(spark, direction, want):
    """Messages run 0 -> 1, 2 -> 0 and 2 -> 3; only vertex 0 is active."""
    g = graph(spark, [(0, 1, 1.0), (2, 0, 1.0), (2, 3, 1.0)])
    state = g.vertices.select("id", F.lit(0).cast("long").alias("n"), (F.col("id") == 0).alias("active"))
    spec = PregelSpec(send=[Send({"m": F.col("src")})], combine={"k": F.count("*")}, update={"n": F.col("k")}, direction=direction, max_iter=1)
    assert {r.id: r.n for r in pregel(state, g.edges, spec).where("n > 0").collect()} == want


def test_trace_interval_and_kernel(spark):
    def double(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("dst"), pa.array(2 * b.column("dist").to_numpy())], names=["dst", "dist"])

    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    state = g.vertices.select("id", F.when(F.col("id") == 0, 1.0).alias("dist"), (F.col("id") == 0).alias("active"))
    seen = []
    spec = PregelSpec(
        send=[Send({"m": F.col("dist")}, kernel=(double, "dst long, dist double"))], combine={"m": F.min("m")},
        update={"dist": F.col("m")}, stage_every=2, trace=True, on_step=seen.append,
    )
    assert table(pregel(state, g.edges, spec).select("id", "dist")) == {0: 1.0, 1: 2.0, 2: 4.0, 3: 8.0}
    assert [m["state"].where("dist is not null").count() for m in seen] == [2, 3, 4, 4]


def test_cached_edges_are_not_exchanged_again(spark):
    """Above the cached edges of a superstep there is no exchange, even without broadcast joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = lay(graph(spark, [(0, 1, 1.0), (1, 2, 1.0)]).edges, "src", {"w": F.min("w")})
        edges.count()
        plan = edges.join(spark.range(3).withColumnRenamed("id", "src").repartition(2), "src")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        side = plan[: plan.index("InMemoryTableScan")]
        assert "Exchange" not in side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edge_lists_and_the_command_line(spark, tmp_path, capsys):
    path = tmp_path / "edges.txt"
    path.write_text("# a graph\n0 1 2.5\n1\t2\n\n2 0 1\n")
    g = read_edge_list(spark, f"file://{path}", 2, reverse_1d_pid)
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 2.5), (1, 2, 1.0), (2, 0, 1.0)]
    assert read_edge_list(spark, f"file://{path}", 3).edges.rdd.getNumPartitions() == 3
    for algorithm, lines in [("sssp", 3), ("lp", 3), ("pr", 3), ("cc", 3), ("cost", 3)]:
        cli.main(["--graphfile", f"file://{path}", "--algorithm", algorithm, "--landmarks", "0", "--partitions", "3", "--metrics"])
        shown = [x for x in capsys.readouterr().out.splitlines() if not x.startswith("{")]
        assert 0 < len(shown) <= lines
    cli.main(["--graphfile", f"file://{path}", "--algorithm", "cc", "--out", f"{tmp_path}/out"])
    assert table(spark.read.parquet(f"{tmp_path}/out")) == {0: 0, 1: 0, 2: 0}
    with pytest.raises(ValueError):
        cli.run(spark, "none", f"file://{path}")


def test_per_partition_and_eager_persist(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]).persist(eager=True)
    count = lambda t: pa.table({"pid": t.column("pid")[:1], "n": pa.array([t.num_rows], pa.int64())})
    got = per_partition(place(g.edges, reverse_1d_pid, 2), count, "pid int, n long").collect()
    assert sum(r.n for r in got) == 3 and len({r.pid for r in got}) == len(got)
    g.close()


def test_scratch_deletes_what_is_not_kept(spark):
    root = shared_root(spark).removeprefix("file://")
    was = set(os.listdir(root))
    with scratch(spark):
        out = stage(stage(spark.range(3), "middle").where("id > 0"), "kept", keep=True)
        assert len(set(os.listdir(root)) - was) == 2
    assert [x.partition("-")[0] for x in set(os.listdir(root)) - was] == ["kept"] and out.count() == 2
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stage(spark.range(1), "lost")
        raise ZeroDivisionError
    assert not [x for x in os.listdir(root) if x.startswith("lost-")]


def test_empty_graph(spark):
    g = graph(spark, [])
    assert g.vertices.count() == 0 and connected(g.edges).count() == 0
    assert label_propagation(g, 2).count() == 0 and shortest_paths(g, [1]).count() == 0


@pytest.mark.parametrize("run", [lambda g: connected_capped(g, 0), lambda g: label_propagation(g, 0), lambda g: pagerank(g, tol=-1), lambda g: pagerank(g, reset=2)])
def test_bad_arguments(spark, run):
    with pytest.raises(ValueError):
        run(graph(spark, [(0, 1, 1.0)]))


def _jobs(spark, run, name):
    """How many Spark jobs ``run`` takes."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_pagerank_rounds_after_the_first_need_no_job_each(spark):
    """some fifty rounds on a cycle; only its ids are targets, so the other edges fall out after the first round."""
    rows = [(i, (i + 1) % 10, 1.0) for i in range(10)] + [(i, i % 7, 1.0) for i in range(10, 200)]
    assert _jobs(spark, lambda: pagerank(graph(spark, rows)).collect(), "F1") < 60


@pytest.mark.parametrize("bound", [0, 12, 1 << 21])
def test_pagerank_is_the_same_with_rounds_of_jobs(spark, monkeypatch, bound):
    """single steps, as ``on_step`` asks for, against live edges in one task and live edges that are too many for one."""
    rows = [(i, (i * 3 + 1) % 10, 1.0) for i in range(10)] + [(0, 3, 1.0), (3, 0, 1.0), (3, 3, 1.0)] + [(i, i % 7, 1.0) for i in range(10, 60)]
    g, steps = graph(spark, rows), []
    want = {r.id: (r["rank"], r.delta) for r in pagerank(g, tol=0.05, on_step=steps.append).collect()}
    assert len(steps) > 3
    monkeypatch.setattr(sys.modules["lattica.operators.pregel"], "FINISH_EDGES", bound)
    got = {r.id: (r["rank"], r.delta) for r in pagerank(g, tol=0.05).collect()}
    assert got.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-12) for i in got for a, b in zip(got[i], want[i], strict=True))


def test_a_long_path_needs_no_job_a_step(spark):
    """orders point to customers, whose ids are orders again: hundreds of steps with a row or two each."""
    rows = [(i, i + 1, 1.0) for i in range(80)] + [(i, i % 80, 1.0) for i in range(81, 300)]
    got = []
    assert _jobs(spark, lambda: got.extend(shortest_paths(graph(spark, rows), [1, 40]).collect()), "F4") < 60
    assert {(r.id, r.landmark): r.dist for r in got} == {(i, m): i - m for m in (1, 40) for i in range(m, 81)}


@pytest.mark.parametrize("bound", [0, 30, 1 << 21])
def test_paths_are_the_same_with_steps_of_jobs(spark, monkeypatch, bound):
    """parallel edges, loops, an infinite and a NaN weight; a landmark off the graph, one without edges out."""
    inf, nan = math.inf, math.nan
    rows = [(i, (i * 7 + 3) % 40, 1.0 + i % 3) for i in range(40)] + [(i, (i * 5 + 1) % 40, 9.5) for i in range(0, 40, 2)]
    rows += [(5, 5, 0.0), (5, 38, 0.5), (5, 38, 0.25), (1, 50, inf), (50, 51, 1.0), (2, 52, nan), (52, 53, 1.0), (3, 52, inf), (60, 1, 1.0)]
    g = graph(spark, rows)
    show = lambda df: sorted((r.landmark, r.id, str(r.dist)) for r in df.collect())
    want = show(shortest_paths(g, [1, 5, 53, 60, 99], on_step=lambda _: None))
    monkeypatch.setattr(sys.modules["lattica.operators.pregel"], "FINISH_EDGES", bound)
    assert show(shortest_paths(g, [1, 5, 53, 60, 99])) == want
    assert ("1" in {str(m) for m, _, _ in want}) and {d for _, _, d in want} >= {"inf"}


@pytest.mark.parametrize("number, name", [("F2", "pagerank_raw"), ("F3", "rank_sum")])
def test_rank_queries_need_no_job_a_round(spark, sf_dir, number, name):
    assert _jobs(spark, lambda: REGISTRY[name](spark, sf_dir).collect(), number) < 60


def test_rank_edges_are_scanned_and_exchanged_once(spark, sf_dir, monkeypatch):
    """the out-degrees come from the rows that the exchange by source brings together, not from a second scan and a join."""
    laid = []
    monkeypatch.setattr(sys.modules["lattica.plans.pagerank"], "pregel", lambda state, edges, spec: laid.append(lay(edges, "src", spec.merge)) or state)
    REGISTRY["pagerank_raw"](spark, sf_dir)
    plan = laid[0]._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    pairs, sources = Counter(map(tuple, rows)), Counter(r[0] for r in rows)
    try:
        assert plan.count("Scan parquet") == plan.count("Exchange hashpartitioning") == 1
        got = [tuple(r) for r in laid[0].select("src", "dst", "w").collect()]
        assert len(got) == len(pairs) < len(rows) and all(math.isclose(w, pairs[s, t] / sources[s]) for s, t, w in got)
    finally:
        laid[0].unpersist()
