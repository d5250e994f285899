"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits its nodes by a random direction near the mean projection; vectors within a margin of the cut go to
both sides (spill overlap). Nodes that are too large for a task are split by the cluster, level by level: projections
in Arrow batches, their mean and spread by aggregation, then an exchange. The rest of each tree is grown inside
one task down to small leaves, where all pairs are compared in double precision. Verified pairs of all trees are
united; components of the links give the groups. Equal vectors of one label are one point with a weight.

Splits of a tight group cut its links. So a sample of every node that is to be split shows whether a point of it has
links to half a leaf of vectors or more; then the ball around that point leaves the forest, and its vectors are
compared exactly, in pairs of blocks, with all vectors that may link to them. Those links are counted, not written: only
the counts and a spanning forest leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected
from ..shared import stage
from .arrow import components, forest, mix, runs

#: Cosine of a link; trees; vectors of a leaf and of a node that one task finishes; margin as a share of the spread of the
#: projections; how far the cut may lie from their mean.
THRESHOLD, TREES, LEAF, TASK, MARGIN, JITTER = 0.93, 12, 128, 2048, 0.2, 0.25
#: Vectors of a node that are looked at for a tight group, and the least links of one there; least and most vectors of a block.
SAMPLE, SEEN, BLOCK, MOST = 256, 8, 2048, 16_384


def direction(tree: int, node: int, size: int) -> np.ndarray:
    seed = int(mix(np.array([node], np.int64).view(np.uint64), tree + 1)[0])
    r = np.random.default_rng(seed).standard_normal(size)
    return r / np.sqrt(r @ r)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centres(x: np.ndarray, n: int, threshold: float) -> list[tuple[int, bytes]]:
    """Tight groups that ``x``, a sample of ``n`` vectors, shows: the index of a member and the mean of those it links to."""
    near, free, out = x @ x.T >= threshold, np.ones(len(x), bool), []
    while len(x):
        links = np.where(free, (near & free).sum(axis=1) - 1, -1)
        k = int(links.argmax())
        if links[k] < SEEN or links[k] * n < LEAF / 2 * len(x):
            break
        c = x[near[k]].mean(axis=0)
        out.append((k, (c / np.sqrt(c @ c)).tobytes()))
        free &= ~near[k]
    return out


def _leaves(x: np.ndarray, tree: int, node: int, threshold: float):
    """Index arrays of the leaves below a node that one task holds, each with no centres; or no leaf, but the centres of
    tight groups."""
    todo = [(np.arange(len(x)), node)]
    while todo:
        own, node = todo.pop()
        if len(own) <= LEAF:
            yield own, []
            continue
        some = own[np.argsort(mix(own, node))[:SAMPLE]]
        if tight := _centres(x[some], len(own), threshold):
            yield own[:0], [(some[k], c) for k, c in tight]
            continue
        p = x[own] @ direction(tree, node, x.shape[1])
        spread = p.std()
        cut = p.mean() + spread * JITTER * (2 * (hash((tree, node)) % 1001) / 1000 - 1)
        left, right = own[p <= cut + MARGIN * spread], own[p >= cut - MARGIN * spread]
        if spread < 1e-12 or len(left) == len(own) or len(right) == len(own):
            yield own, []  # nothing to split: compared in blocks
            continue
        todo += [(left, 2 * node % (1 << 61) + 1), (right, 2 * node % (1 << 61) + 2)]


def _pairs(batches, threshold: float, kind: str):
    for t in runs(batches, ["tree", "node"]):
        ids, tree, node = t.column("id").to_numpy(), t.column("tree")[0].as_py(), t.column("node")[0].as_py()
        x = _unit(t.column("vector").to_pylist(), kind)
        found, tight = [np.zeros(0, np.int64)], []
        for own, centres in _leaves(x, tree, node, threshold):
            tight += centres
            for lo in range(0, len(own), 1024):
                a = own[lo : lo + 1024]
                for hi in range(lo, len(own), 1024):
                    b = own[hi : hi + 1024]
                    i, j = np.nonzero(x[a] @ x[b].T >= threshold - 1e-9)
                    i, j = a[i], b[j]
                    ok = ids[i] != ids[j]
                    i, j = i[ok], j[ok]
                    ok = (x[i] * x[j]).sum(axis=1) >= threshold
                    found.append(np.minimum(i, j)[ok] * len(x) + np.maximum(i, j)[ok])
        every = np.unique(np.concatenate(found))
        i, j = every // max(1, len(x)), every % max(1, len(x))
        u, v = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        for lo in range(0, len(u), 50_000):
            a, b = pa.array(u[lo : lo + 50_000]), pa.array(v[lo : lo + 50_000])
            yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.binary())], names=["src", "dst", "centre"])
        if tight:
            yield _tight(ids, tight)


def _tight(ids: np.ndarray, centres: list[tuple[int, bytes]]) -> pa.RecordBatch:
    src = pa.array([int(ids[k]) for k, _ in centres], pa.int64())
    return pa.RecordBatch.from_arrays([src, pa.nulls(len(src), pa.int64()), pa.array([c for _, c in centres], pa.binary())], names=["src", "dst", "centre"])


def _scout(batches, threshold: float, kind: str):
    """Centres in samples of nodes ``(tree, node, n, id, vector)``."""
    for t in runs(batches, ["tree", "node"]):
        x = _unit(t.column("vector").to_pylist(), kind)
        if tight := _centres(x, t.column("n")[0].as_py(), threshold):
            yield _tight(t.column("id").to_numpy(), tight)


def _reach(batches, centres: dict[str, list[tuple[int, np.ndarray]]], threshold: float, kind: str):
    """For each vector the ball that owns it (-1: none) and, row by row, the balls in which it is compared: its own, and
    those before it whose members may link to it."""
    for whole in batches:
        for b in (whole.slice(lo, 2048) for lo in range(0, whole.num_rows, 2048)):
            spaces, raw, at, ball, own = b.column("space").to_pylist(), b.column("vector").to_pylist(), [], [], []
            for space in {*spaces} & {*centres}:
                rows = np.array([i for i, s in enumerate(spaces) if s == space])
                names, c = np.array([k for k, _ in centres[space]]), np.stack([c for _, c in centres[space]])
                cosine = _unit([raw[i] for i in rows], kind) @ c.T
                best = cosine.argmax(axis=1)
                mine = np.where(cosine.max(axis=1) >= threshold, names[best], -1)
                near = cosine >= 2 * threshold * threshold - 1 - 1e-9  # a member's angle and a link's
                i, j = np.nonzero(near & ((mine < 0)[:, None] | (names <= mine[:, None])))
                at, ball, own = [*at, rows[i]], [*ball, names[j]], [*own, mine[i]]
            if at and len(i := np.concatenate(at)):
                columns = [pa.array(np.concatenate(k).astype(np.int32)) for k in (ball, own)]
                yield pa.RecordBatch.from_arrays([*columns, *(b.column(k).take(pa.array(i)) for k in ("id", "vector", "size"))], names=["ball", "own", "id", "vector", "size"])


def _blocks(batches, threshold: float, kind: str):
    """All pairs of two blocks: ``(src, null, n)``, the weight that src links to, and ``(src, dst, 0)``, a spanning forest."""
    for t in runs(batches, ["ball", "l", "r"]):
        ids, size, block = (t.column(k).to_numpy() for k in ("id", "size", "block"))
        x, l, r = _unit(t.column("vector").to_pylist(), kind), t.column("l")[0].as_py(), t.column("r")[0].as_py()
        left, right = np.flatnonzero(block == l), np.flatnonzero(block == r)
        n, ties = np.zeros(len(x)), [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(left), 1024):
            a = left[lo : lo + 1024]
            for hi in range(lo if l == r else 0, len(right), 1024):
                b = right[hi : hi + 1024]
                cosine = x[a] @ x[b].T
                hit = cosine >= threshold
                i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
                hit[i, j] = (x[a[i]] * x[b[j]]).sum(axis=1) >= threshold
                same = l == r and lo == hi
                if same:
                    np.fill_diagonal(hit, False)
                n[a] += hit.astype(float) @ size[b]
                if not same:
                    n[b] += hit.T.astype(float) @ size[a]
                i, j = forest(hit)
                ties.append(np.stack([a[i], b[j]]))
        some = np.flatnonzero(n)
        least = components(len(x), *np.concatenate(ties, axis=1))
        tied = np.flatnonzero(least < np.arange(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some].astype(np.int64))], names=["src", "dst", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[least[tied]]), pa.array(np.zeros(len(tied), np.int64))], names=["src", "dst", "n"])


def _balls(points: DataFrame, centres: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Ids of ``points`` within ``threshold`` of a centre, and every link with such an end, once, as ``_blocks`` returns them."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen: dict[str, list[tuple[int, np.ndarray]]] = {}
    found = centres.join(points.select(F.col("id").alias("src"), "space"), "src").select("space", "centre", "src").distinct().collect()
    for name, row in enumerate(sorted(found, key=lambda r: (r.space, r.src, r.centre))):
        c = np.frombuffer(row.centre)
        if all(c @ other < threshold for _, other in chosen.get(row.space, [])):
            chosen.setdefault(row.space, []).append((name, c))
    reach = stage(points.mapInArrow(lambda b: _reach(b, chosen, threshold, kind), "ball int, own int, id long, vector binary, size long"), "reach")
    member = F.col("ball") == F.col("own")
    sizes = reach.groupBy("ball").agg(F.count_if(member).alias("own_n"), F.count_if(~member).alias("other_n"))
    per = F.least(F.greatest(F.col("own_n") / 16, F.lit(BLOCK)), F.lit(MOST))
    sizes = sizes.where("own_n > 0").select("ball", F.ceil(F.col("own_n") / per).cast("int").alias("h"), F.ceil(F.col("other_n") / per).cast("int").alias("o"))
    spread = F.xxhash64("id", F.lit("block"))
    block = F.when(member, F.pmod(spread, "h")).otherwise(F.col("h") + F.pmod(spread, F.greatest("o", F.lit(1)))).cast("int")
    last = F.when(member, F.col("h") + F.col("o")).otherwise(F.col("h")) - 1
    tasks = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least("block", j).alias("l"), F.greatest("block", j).alias("r")))
    rows = reach.join(sizes, "ball").withColumn("block", block).withColumn("t", F.explode(tasks))
    rows = rows.select("ball", "t.l", "t.r", "block", "id", "vector", "size").repartition(parts, "ball", "l", "r").sortWithinPartitions("ball", "l", "r")
    exact = stage(rows.mapInArrow(lambda b: _blocks(b, threshold, kind), "src long, dst long, n long"), "exact")
    return reach.where(member).select("id"), exact


def forest_links(points: DataFrame, kind: str, threshold: float = THRESHOLD, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Verified links of ``points(id, space, vector, size)``; only points of one space are compared. First the distinct
    links ``(src, dst)``, src < dst, outside tight groups; then the links of tight groups as ``_blocks`` returns them."""
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = points.withColumn("tree", tree).select("tree", F.abs(F.xxhash64("tree", "space") % (1 << 60)).alias("node"), "id", "vector")
    done, rest, exact = [], points, spark.createDataFrame([], "src long, dst long, n long")
    tight = "src long, dst long, centre binary"
    while True:
        sizes = stage(rows.groupBy("tree", "node").agg(F.count("*").alias("n")).where(F.col("n") > TASK), "nodes")
        if not sizes.limit(1).count():
            done.append(rows)
            break
        some = rows.join(sizes, ["tree", "node"]).where(F.pmod(F.xxhash64("id", "node"), "n") < SAMPLE).select("tree", "node", "n", "id", "vector")
        some = some.repartition(n, "tree", "node").sortWithinPartitions("tree", "node")
        centres = stage(some.mapInArrow(lambda b: _scout(b, threshold, kind), tight), "centres")
        if centres.limit(1).count():
            hot, more = _balls(rest, centres, kind, threshold)
            rest, rows, *done = (x.join(hot, "id", "left_anti") for x in (rest, rows, *done))
            exact = exact.unionAll(more)
            continue
        done.append(rows.join(sizes, ["tree", "node"], "left_anti"))

        def project(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                t, k = b.column("tree").to_numpy(), b.column("node").to_numpy()
                raw, out = b.column("vector").to_pylist(), np.zeros(b.num_rows)
                for key in {*zip(t.tolist(), k.tolist(), strict=True)}:
                    at = np.flatnonzero((t == key[0]) & (k == key[1]))
                    x = _unit([raw[i] for i in at], kind)
                    out[at] = x @ direction(*key, x.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "p"])

        large = rows.join(sizes.drop("n"), ["tree", "node"]).select("tree", "node", "id", "vector")
        placed = stage(large.mapInArrow(project, "tree int, node long, id long, vector binary, p double"), "projected")
        stats = placed.groupBy("tree", "node").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("spread"))
        part = (F.pmod(F.xxhash64("tree", "node", F.lit("cut")), F.lit(1001)) / 500.0) - 1.0
        cut, margin = F.col("mean") + F.col("spread") * JITTER * part, F.col("spread") * MARGIN
        child = lambda side: F.abs(F.xxhash64("node", F.lit(side)) % (1 << 60))
        both = F.array_compact(F.array(F.when(F.col("p") <= cut + margin, child(0)), F.when(F.col("p") >= cut - margin, child(1))))
        rows = stage(placed.join(stats, ["tree", "node"]).select("tree", F.explode(both).alias("node"), "id", "vector"), "split")
    every = done[0]
    for x in done[1:]:
        every = every.unionAll(x)
    while True:
        dealt = every.repartition(n, "tree", "node").sortWithinPartitions("tree", "node")
        found = stage(dealt.mapInArrow(lambda b: _pairs(b, threshold, kind), tight).distinct(), "links")
        centres = found.where("centre is not null")
        if not centres.limit(1).count():
            return found.select("src", "dst"), exact
        hot, more = _balls(rest, centres, kind, threshold)
        rest, every, exact = rest.join(hot, "id", "left_anti"), every.join(hot, "id", "left_anti"), exact.unionAll(more)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold``; vectors that are
    null, zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Repeated ids are separate vectors of that id; a component's id is its smallest vec_id. Multiples of one vector link
    like equal ones; links are decided in double precision, so a tie with the threshold links. An empty table gives an
    empty result. Further columns, whatever their names, are not read.
    """
    double = "double" in vectors.schema[vector].dataType.simpleString()
    kind = "<f8" if double else "<f4"
    ok = F.col("e").isNotNull() & F.col("g").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    src = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{'double' if double else 'float'}>").alias("e"), F.col(label).cast("string").alias("g"))
    src = src.withColumn("ok", F.coalesce(ok, F.lit(False)))
    plus = F.transform("e", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # one zero
    src = src.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("g", plus)), "h2": F.when(F.col("ok"), F.xxhash64(F.lit("second"), plus, "g"))})
    held = stage(src, "vectors")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("z"), F.col("vec_id").alias("v"), F.col("uid").alias("u")))
    classes = stage(held.where("ok").groupBy("h1", "h2").agg(first.alias("m"), F.count("*").alias("size")).select("h1", "h2", F.col("m.v").alias("least"), F.col("m.u").alias("id"), "size"), "points")

    def encode(batches):
        for b in batches:
            raw = [np.array(x, kind).tobytes() for x in b.column("e").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("space"), pa.array(raw, pa.binary()), b.column("size")], names=["id", "space", "vector", "size"])

    points = held.join(classes.select(F.col("id").alias("uid"), "size"), "uid").select(F.col("uid").alias("id"), F.concat_ws("/", F.size("e"), "g").alias("space"), "e", "size")
    links, exact = forest_links(stage(points.mapInArrow(encode, "id long, space string, vector binary, size long"), "encoded"), kind, threshold)
    ends = links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    linked = ends.join(classes.select(F.col("id").alias("dst"), "size"), "dst").select(F.col("src").alias("id"), "size")
    linked = linked.unionAll(exact.where("dst is null").select("src", "n"))
    counts = linked.groupBy("id").agg(F.sum("size").alias("linked"))
    joined = connected(links.unionAll(exact.where("dst is not null").select("src", "dst")))
    per = classes.join(counts, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = per.groupBy("component").agg(F.min("least").alias("component_id"))
    per = per.join(least, "component").select("h1", "h2", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    linked = held.where("ok").join(per, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = held.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle() -> str:
    """DuckDB SQL of ``near_duplicates`` over ``embeddings`` (ids unique): all pairs of a label, so for small tables. Scaling
    by the largest component keeps squares in range."""
    return f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM a),
p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= {THRESHOLD} ELSE false END),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
l AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN l USING (vec_id)"""
