"""``python -m lattica.cli --graphfile URI --algorithm sssp|lp|pr|cc|cost``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .functions.pids import random_cut_pid
from .operators.cost import partition_report
from .operators.placement import place
from .plans import connected_capped, label_propagation, pagerank, shortest_paths
from .session import local_session
from .sources.edge_list import read_edge_list
from .sources.fixtures import default_landmarks

ALGORITHMS = ("sssp", "lp", "pr", "cc", "cost")


def run(spark: SparkSession, algorithm: str, path: str, partitions: int = 4, landmarks: list[int] | None = None, on_step=None) -> DataFrame:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {ALGORITHMS}")
    g = read_edge_list(spark, path, partitions, random_cut_pid)
    if algorithm == "sssp":
        return shortest_paths(g, landmarks or default_landmarks(g.vertices.count()), on_step=on_step)
    if algorithm == "lp":
        return label_propagation(g, on_step=on_step)
    if algorithm == "pr":
        return pagerank(g, on_step=on_step)
    if algorithm == "cc":
        return connected_capped(g, on_step=on_step)
    return partition_report(place(g.edges, random_cut_pid, partitions))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lattica")
    p.add_argument("--graphfile", required=True, help="edge list: src dst [weight] per line, any Hadoop URI")
    p.add_argument("--algorithm", required=True, choices=ALGORITHMS)
    p.add_argument("--partitions", type=int, default=4)
    p.add_argument("--landmarks", type=int, nargs="*")
    p.add_argument("--out", help="write Parquet here instead of printing")
    p.add_argument("--limit", type=int, default=100_000, help="rows printed")
    p.add_argument("--metrics", action="store_true", help="print active rows and seconds of each superstep")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    df = run(spark, a.algorithm, a.graphfile, a.partitions, a.landmarks, (lambda m: print(m, flush=True)) if a.metrics else None)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        for row in df.orderBy(df.columns[0]).limit(a.limit).toLocalIterator():
            print(*row)


if __name__ == "__main__":
    main()
