"""N-gram Jaccard join by MinHash banding.

1. Each document becomes a sketch: a 128-bit signature of its set of word n-grams, band hashes and one byte per MinHash.
2. Documents with equal sets are one class. Only class representatives go on.
3. Representatives that share a band hash are candidates. A bucket is compared on the sketch bytes in one task; a large
   one is dealt in chunks, where documents close to a chunk's leader are tied to it and only leaders meet again, level
   by level, so no bucket is ever expanded into pairs. Within a chunk the radii add up by the triangle inequality of the
   Jaccard distance, so pairs at the threshold stay in one candidate family. Across chunks they add up beyond it, so there
   it is a rule of thumb, helped by the other bands that a linked pair shares: with groups of thousands every link
   was found (see the README). Families are connected components.
4. Every pair of a family is verified on the full n-gram sets; large families are dealt in blocks against blocks.
   Links are counted where they are found, never written out, and verified stars give the final components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.components import connected
from ..shared import stage
from .arrow import WINDOW, Words, components, flat, forest, mix, odd, runs, slices

#: Words of an n-gram, least similarity of a link, and the recall that the bands are chosen for at that similarity.
WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: Bucket rows that one comparison takes; documents of a block; sketch similarity that makes a candidate pair, that ties a
#: document to a leader, and that ties leaders. A sketch byte misjudges a similarity by about 0.04.
BUCKET, BLOCK, MOST_BLOCKS = 64, 64, 32
#: n-grams of a block, about: a family of long documents gets smaller blocks.
BLOCK_GRAMS = 1 << 20
CANDIDATE, LEADER, LEADERS = 0.6, 0.7, 0.12


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` MinHashes so that a pair at the threshold collides with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


#: Grams worked on at once, and text bytes of a slice: what a worker holds beside its longest text.
PART, SLICE = 1 << 15, 1 << 20


class Shingler:
    """64-bit hashes of the n-grams of words (runs of bytes that are not white space, case kept). Needs eight bytes for
    each word and each n-gram of a slice, and otherwise the same memory for a text of any length."""

    def __init__(self, n: int = WORDS):
        self.n, self.words, self.weights = n, Words(), odd(n, 12)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams in order and where each text begins (n + 1). A text of fewer than n words has one n-gram
        of all of them; one without words has none."""
        words, at = self.words(*flat(texts))
        n, count = self.n, np.diff(at)
        bounds = np.concatenate([[0], np.cumsum(np.where(count >= n, count - n + 1, count > 0))])
        out, whole = np.zeros(bounds[-1], np.uint64), np.ones(bounds[-1], bool)
        few = np.flatnonzero((count > 0) & (count < n))
        total = np.zeros(len(few), np.uint64)
        for k in range(n):
            total += np.where(k < count[few], words[np.minimum(at[:-1][few] + k, len(words) - 1)] * self.weights[k], np.uint64(0))
        out[bounds[:-1][few]] = mix(total + count[few].astype(np.uint64), 15)
        whole[bounds[:-1][few]] = False
        left = (np.repeat(at[1:], count) - np.arange(len(words))) >= n  # an n-gram begins here
        parts = [np.zeros(0, np.uint64)]
        for lo in range(0, len(words) - n + 1, WINDOW):
            hi = min(lo + WINDOW, len(words) - n + 1)
            total = np.zeros(hi - lo, np.uint64)
            for k in range(n):
                total += words[lo + k : hi + k] * self.weights[k]
            parts.append(mix(total[left[lo:hi]] + np.uint64(n), 15))
        out[whole] = np.concatenate(parts)
        return out, bounds


def min_hashes(h: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The MinHashes of each text, folded over parts of its n-grams."""
    low = np.full((len(at) - 1, len(factors)), np.uint64(2**64 - 1))
    full = np.flatnonzero(np.diff(at))
    first = at[:-1][full]
    for lo in range(0, len(h), PART):
        part = h[lo : lo + PART]
        a, b = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, lo + len(part))
        starts, rows = np.maximum(first[a:b] - lo, 0), full[a:b]
        for k, f in enumerate(factors):
            low[rows, k] = np.minimum(low[rows, k], np.minimum.reduceat(mix_fast(part, f), starts))
    return low


SKETCH = "uid long, doc_id long, th long, n_grams long, s1 long, s2 long, bands array<long>, bytes binary"


def sketches(docs: DataFrame, n_bands: int, rows: int = ROWS, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``SKETCH`` per document. ``uid`` numbers the rows, ``th`` hashes the whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))

    def run(batches):
        shingle, factors = Shingler(words), odd(n_bands * rows, 16)
        for b in slices(batches, budget=SLICE):
            h, at = shingle(b.column("text"))
            n, low = b.num_rows, min_hashes(h, at, factors)
            distinct = [np.unique(h[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            total = lambda seed: np.array([mix(x, seed).sum(dtype=np.uint64) for x in distinct], np.uint64).view(np.int64)
            band = np.zeros((n, n_bands), np.uint64)
            for k in range(rows):
                band = mix(band + low[:, k::rows][:, :n_bands] + np.arange(n_bands, dtype=np.uint64), 17)
            small = (mix(low, 18) & np.uint64(255)).astype(np.uint8)
            offsets = pa.array(np.arange(n + 1) * n_bands, pa.int32())
            yield pa.RecordBatch.from_arrays([
                b.column("uid"), b.column("doc_id"), b.column("th"), pa.array([len(x) for x in distinct], pa.int64()), pa.array(total(1)), pa.array(total(2)),
                pa.ListArray.from_arrays(offsets, pa.array(band.reshape(-1).view(np.int64))), pa.array([x.tobytes() for x in small], pa.binary()),
            ], names=["uid", "doc_id", "th", "n_grams", "s1", "s2", "bands", "bytes"])

    return src.mapInArrow(run, SKETCH)


def mix_fast(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    """One permutation-like hash of already mixed values."""
    x = h * factor
    return x ^ (x >> np.uint64(32))


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch similarities of all rows of ``a`` with all of ``b``, chance agreement of bytes taken out."""
    same = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        same[i] = (b == row).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _bucket_links(batches, level: int):
    """Stars (u, v) of candidate families inside buckets, and the leaders of chunks of large buckets."""
    for t in runs(batches, ["bh", "chunk"]):
        uid = t.column("uid").to_numpy()
        data = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(len(uid), -1)
        parted = bool(t.column("chunks")[0].as_py() > 1)
        if not parted and level == 0:
            i, j = np.nonzero(np.triu(_similar(data, data) >= CANDIDATE, 1))
            root, leaders = components(len(uid), i, j), np.zeros(0, np.int64)
        else:
            owner, chosen = np.full(len(uid), -1), []
            for k in np.argsort(uid):
                if owner[k] < 0:
                    near = (owner < 0) & (_similar(data[k : k + 1], data)[0] >= LEADER)
                    near[k] = True
                    owner[near] = k
                    chosen.append(k)
            leaders = np.array(chosen)
            i, j = np.nonzero(np.triu(_similar(data[leaders], data[leaders]) >= LEADERS, 1))
            root = components(len(uid), np.concatenate([np.arange(len(uid)), leaders[i]]), np.concatenate([owner, leaders[j]]))
        u, v = uid, uid[root]
        lead = np.zeros(len(uid), bool)
        lead[leaders] = parted
        some = (u != v) | lead
        rows = np.flatnonzero(some)
        if len(rows):
            yield pa.RecordBatch.from_arrays([t.column("bh").combine_chunks().take(pa.array(rows)), pa.array(u[rows]), pa.array(v[rows]), pa.array(lead[rows])], names=["bh", "u", "v", "lead"])


def candidate_families(reps: DataFrame) -> DataFrame:
    """``reps(uid, bands, bytes)`` to ``(id, component)`` for representatives that may link with another."""
    marked = reps.select("uid", F.explode("bands").alias("bh"))
    shared = marked.groupBy("bh").agg(F.count("*").alias("m")).where("m > 1")
    rows = stage(marked.join(shared, "bh"), "buckets")
    level, links = 0, []
    while True:
        cap = BUCKET << level
        chunks = F.ceil(F.col("m") / cap).cast("int")
        dealt = rows.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("uid", F.lit(level)), chunks).cast("int")})
        dealt = dealt.join(reps.select("uid", "bytes"), "uid").select("bh", "chunk", "chunks", "uid", "bytes")
        n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(n, "bh", "chunk").sortWithinPartitions("bh", "chunk")
        seen = Observation()
        now = level
        found = dealt.mapInArrow(lambda b: _bucket_links(b, now), "bh long, u long, v long, lead boolean")
        found = stage(found.observe(seen, F.count_if("lead").alias("n")), "links")
        links.append(found.where("u <> v").select(F.col("u").alias("src"), F.col("v").alias("dst")))
        if not seen.get["n"]:
            break
        left = found.where("lead").select("bh", F.col("u").alias("uid"))
        rows = left.join(left.groupBy("bh").agg(F.count("*").alias("m")), "bh").where("m > 1")
        level += 1
    out = links[0]
    for x in links[1:]:
        out = out.unionAll(x)
    return connected(out)


def _verify(batches, threshold: float):
    """Per unit and representative: documents linked with, and the smallest linked representative in the unit."""
    for t in runs(batches, ["component", "a", "b"]):
        uid, first = np.unique(t.column("uid").to_numpy(), return_index=True)  # a repeated row counts once
        sets = [np.frombuffer(t.column("grams")[int(i)].as_py(), np.uint64) for i in first]
        size, chunk = np.array([len(x) for x in sets]), t.column("chunk").to_numpy()[first]
        weight = t.column("size").to_numpy()[first]
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        n = len(uid)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        often = np.bincount(code) > 1
        keep = often[code]
        code, row = (np.cumsum(often) - 1)[code[keep]], row[keep]
        both = np.zeros((n, n), np.float32)
        for lo in range(0, int(often.sum()), 4096):
            part = (code >= lo) & (code < lo + 4096)
            m = np.zeros((n, 4096), np.float32)
            m[row[part], code[part] - lo] = 1
            both += m @ m.T
        linked = np.zeros((n, n), bool)
        for lo in range(0, n, 256):
            rows = slice(lo, lo + 256)
            linked[rows] = both[rows] >= threshold * (size[rows, None] + size[None, :] - both[rows]) - 1e-9
            if a != b:
                linked[rows] &= chunk[rows, None] != chunk[None, :]
        del both
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(axis=1))
        if len(some):
            total = np.concatenate([linked[lo : lo + 256].astype(float) @ weight for lo in range(0, n, 256)])
            root = components(n, *forest(linked))
            yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(total[some].astype(np.int64)), pa.array(uid[root[some]])], names=["uid", "linked", "peer"])


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, class_id, n_links, component_id, kept, n_grams, th)``, one row per document; ``th`` hashes its text.

    ``class_id`` is the smallest id with the same n-gram set, ``n_links`` the number of other documents with Jaccard
    similarity of at least ``threshold``, ``component_id`` the smallest id reachable by links; of each component the
    document with that id stays (of repeated ids the first row; null ids come last). Documents without words, null texts
    among them, link with nothing and stay. Texts of any length are hashed whole, in windows. A tie with the threshold
    links. An empty table gives an empty result. Further columns, whatever their names, are not read (``keep`` returns
    them as they are).
    """
    n_bands = bands(threshold, recall)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_ = stage(sketches(docs, n_bands, ROWS, words, key, text), "sketch")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    filled = all_.where("n_grams > 0")
    # the representative is the row that would stay
    classes = stage(filled.groupBy("s1", "s2").agg(F.min(F.struct(order.alias("o"), F.col("th").alias("th"))).alias("m"), F.count("*").alias("size"), F.max("n_grams").alias("grams")).select("s1", "s2", "grams", F.col("m.o.u").alias("cuid"), F.col("m.o.d").alias("class_id"), F.col("m.th").alias("th"), "size"), "classes")
    reps = stage(all_.join(classes.select(F.col("cuid").alias("uid")), "uid", "left_semi").select("uid", "bands", "bytes"), "reps")
    families = candidate_families(reps)
    members = stage(families.join(classes, families["id"] == classes["cuid"]).select(F.col("cuid").alias("uid"), "component", "size", "grams", F.col("class_id").alias("_id"), F.col("th").alias("_th")), "members")
    sized = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("grams").alias("g"))
    block = F.least(F.greatest(F.ceil(F.col("m") / MOST_BLOCKS), F.lit(BLOCK)), F.lit(32 * BLOCK), F.greatest(F.ceil(F.lit(float(BLOCK_GRAMS)) * F.col("m") / F.col("g")), F.lit(1)))
    wanted = members.join(sized, "component").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    wanted = wanted.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).drop("m", "g", "grams")
    wanted = stage(wanted, "wanted")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("_k"), F.xxhash64(t).alias("_th"), t.alias("text"))
    texts = texts.join(wanted.withColumn("_k", F.coalesce("_id", F.lit(-1))).drop("_id").hint("shuffle_hash"), ["_k", "_th"])

    def grams(batches):
        shingle = Shingler(words)
        for b in slices(batches, budget=SLICE):
            h, at = shingle(b.column("text"))
            raw = [np.unique(h[lo:hi]).tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("uid", "component", "blocks", "chunk", "size")], pa.array(raw, pa.binary())], names=["uid", "component", "blocks", "chunk", "size", "grams"])

    sets = texts.select("uid", "component", "blocks", "chunk", "size", "text").mapInArrow(grams, "uid long, component long, blocks int, chunk int, size long, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = sets.withColumn("o", other).withColumns({"a": F.least("chunk", "o"), "b": F.greatest("chunk", "o")}).drop("o", "blocks")
    units = units.repartition(n, "component", "a", "b").sortWithinPartitions("component", "a", "b")
    found = stage(units.mapInArrow(lambda b: _verify(b, threshold), "uid long, linked long, peer long"), "verified")
    counts = found.groupBy("uid").agg(F.sum("linked").alias("linked"))
    comp = connected(found.where("uid <> peer").select(F.col("uid").alias("src"), F.col("peer").alias("dst")))
    per_class = classes.select("s1", "s2", "cuid", "class_id", "size").join(counts.withColumnRenamed("uid", "cuid"), "cuid", "left").join(comp.withColumnRenamed("id", "cuid"), "cuid", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "cuid"))
    heads = per_class.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("z"), F.col("class_id").alias("d"), F.col("cuid").alias("u"))).alias("head"))
    per_class = per_class.join(heads, "component").select("s1", "s2", "class_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.col("head.d").alias("component_id"), F.col("head.u").alias("stays"))
    known = filled.select("uid", "doc_id", "n_grams", "s1", "s2", "th").join(per_class, ["s1", "s2"]).select("doc_id", "class_id", "n_links", "component_id", (F.col("uid") == F.col("stays")).alias("kept"), "n_grams", "th")
    empty = all_.where("n_grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "n_grams", "th")
    return known.unionAll(empty)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component, all columns; rows without words all stay. Only the ids that go are joined."""
    verdicts = stage(jaccard_join(docs, key=key, text=text), "verdicts")
    pair = [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_k"), F.col("th").alias("_th")]
    gone = verdicts.groupBy(*pair).agg(F.count_if("kept").alias("stay"), F.count("*").alias("n")).where("stay < n")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("_k"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_th"))
    gone = stage(gone, "gone")
    out = rows.join(gone.select("_k", "_th").hint("shuffle_hash"), ["_k", "_th"], "left_anti").select("row.*")
    again = gone.where("stay > 0")  # one id with the same text several times: one of them stays
    if not again.limit(1).count():
        return out
    return out.unionByName(rows.join(again.select("_k", "_th"), ["_k", "_th"]).dropDuplicates(["_k", "_th"]).select("row.*"))


def oracle() -> str:
    """DuckDB SQL of ``jaccard_join`` over ``documents`` (ids unique), without ``th``: all pairs by a join on n-grams, so for
    small tables."""
    ws, n = r"[ \t\n\x0b\f\r]+", WORDS
    return rf"""
WITH RECURSIVE a AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END AS s FROM a),
c AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS h, s FROM (SELECT doc_id, list_sort(list_distinct(s)) AS s FROM b)),
k AS MATERIALIZED (SELECT h, min(doc_id) AS id, count(*) AS size, any_value(n) AS n, any_value(s) AS s FROM c WHERE n > 0 GROUP BY h),
g AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM k),
p AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id
  HAVING count(*) >= {THRESHOLD}::DOUBLE * (any_value(x.n) + any_value(y.n) - count(*)) - 1e-9),
r AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
m AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY 1),
l AS (SELECT a AS id, sum(size) AS linked FROM p JOIN k ON k.id = p.b GROUP BY 1),
v AS (SELECT k.h, k.id, size - 1 + coalesce(linked, 0) AS n_links, component_id FROM k JOIN m USING (id) LEFT JOIN l USING (id))
SELECT doc_id, coalesce(v.id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept, c.n::BIGINT AS n_grams FROM c LEFT JOIN v ON v.h = c.h AND c.n > 0"""
