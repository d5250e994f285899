"""Every registered graph query that has SQL against DuckDB."""

import pytest
from oracle import duck, rows

from lattica.graph import Graph
from lattica.oracles import oracles
from lattica.queries import REGISTRY, universe


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_matches_sql(spark, sf_dir, name):
    got, want = REGISTRY[name](spark, sf_dir).toPandas(), duck(sf_dir, oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_whole_graphs_hold_every_row(spark, sf_dir):
    n = {r.name: r.n_edges for r in REGISTRY["cardinalities_whole"](spark, sf_dir).collect()}
    for name, table in [("li", "lineitem"), ("rev", "lineitem"), ("ord", "orders")]:
        assert n[name] == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert n["ev"] == spark.read.parquet(f"{sf_dir}/events.parquet").count() - 1


def test_isolated_vertices(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 4), (4, 2), (6, 6)], "src long, dst long"))
    assert sorted(map(tuple, universe(g).collect())) == [(i, i, i in (0, 3, 5)) for i in range(7)]


def test_generated_graph_is_seeded(spark, sf_dir):
    a, b = (REGISTRY["lognormal_graph"](spark, sf_dir) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and a.count() > 500
    w = a.selectExpr("min(w) lo", "max(w) hi", "max(dst) d").first()
    assert 1 <= w.lo and w.hi < 1 + 100 / 9 and w.d < 500
