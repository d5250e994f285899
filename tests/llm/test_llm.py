"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import bisect
import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from oracle import duck, rows
from pyspark.sql import functions as F

from lattica.llm import context_tree, html_text, packing, prefix_bpe, quality, sharding, shingle_join, token_store, toxicity, vector_forest
from lattica.llm.arrow import components
from lattica.llm.queries import ORACLES, QUERIES
from lattica.llm.units import load
from lattica.shared import shared_root

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, length long, bytes string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    words = ["".join(r.choices("abcdéfgh", k=r.randint(1, 9))) for _ in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(30)]
    near = [" ".join(w if k != 60 else "zzz" for k, w in enumerate(" ".join(r.choices(words, k=150)).split())) for _ in range(1)]
    near += [near[0].replace("zzz", x) for x in ("yyy", "xxx", "www")]
    odd = ["", None, " ", "\n\t", "a", "x  <|endoftext|>  y", "Don't 'S ÀÉ\xa0 c d\n\n", "hahahahahahaha $$$$ 111", "w " * 20_000, base[0], base[0]]
    return base + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    data = [(i, x, None if i % 5 == 0 else "en", "s", None, 1, 2, 3, "b") for i, x in enumerate(t)] + [(None, "null id here", "en", None, 1, 1, 1, 1, "b"), (3, t[3], "en", "s", 1, 1, 1, 1, "b")]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 7 else int(i % 3 > 0), None if i == 8 else 0) for i in range(40)] + [(None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


def encode(name, x):
    return load(P.path(name)).encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_quality_base(docs, labels, none):
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count()
    for r, x in ((r, x) for r in got for x in [{d.doc_id: d.text for d in docs.collect()}[r.doc_id]]):
        w = WORDS.findall(x or "")
        win = collections.defaultdict(list)
        for i in range(len(w) - 7):
            win[tuple(w[i : i + 8])].append(i)
        rep = len({i + k for v in win.values() if len(v) > 1 for i in v for k in range(8)})
        lines = [y for y in (x or "").split("\n") if WORDS.search(y)]
        want = (len(w), sum(map(len, w)), sum((x or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(none, labels).count() == 0 and quality.keep(none, labels).columns == none.columns


def test_certified_rules_match_sql(spark, tmp_path):
    """Enough labels for certified cutoffs: rules beyond the base rules reject, and the SQL agrees."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    data, marks = [], []
    for i in range(6000):
        good = i % 10 > 0
        w = [word() for _ in range(22)] if good else [word() + r.choice(["", "##$", "!!"]) for _ in range(22)]
        if i == 1:
            w[3] += "#" * 40  # a good document that the rule rejects
        data.append((i, " ".join(w).capitalize(), "fr" if i % 7 == 0 else "en", "s"))
        marks.append((i, int(good), 0))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op1_quality_rules"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(duck(str(tmp_path), ORACLES["op1_quality_rules"]))
    by_rule = got[~got.base_failed & ~got.kept]
    assert len(by_rule) > 400 and ((by_rule.doc_id % 10) > 0).sum() <= 0.01 * 5400


def test_binomial_bound(spark):
    from math import comb

    df = spark.createDataFrame([(100, 0), (500, 1), (900, 4), (100, 50)], "n long, k long")
    got = [r[0] for r in df.select(quality.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect()]
    want = [sum(comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1)) for n, k in [(100, 0), (500, 1), (900, 4)]]
    assert np.allclose(got[:3], want) and got[3] == 1.0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_links_match_sql_on_odd_rows(spark, tmp_path):
    """Copies, near copies, chains, and rows that link with nothing."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    data, w = [], [word() for _ in range(60)]
    for i in range(60):  # a chain: each differs from the one before by a word
        w = [*w[:-1], word()] if i % 3 else [*w[1:], word()]
        data.append((i, " ".join(w)))
    data += [(60 + i, data[i][1]) for i in range(20)] + [(80, None), (81, ""), (82, " \n"), (83, "a b"), (84, "a  b"), (85, "a b c d e")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    g = np.random.default_rng(4)
    x = np.repeat(g.normal(size=(12, 16)), 6, axis=0)
    x += 0.2 * g.normal(size=x.shape)
    vec = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    vec += [(72, None, 0), (73, [0.0] * 16, 0), (74, [float("nan")] * 16, 0), (75, [None] * 16, 0), (76, vec[0][1], None), (77, [1.0], 0), (78, [], 0), (79, [3 * y for y in vec[2][1]], 0)]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op3_projection_forest", "op4_ngram_jaccard"):
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert rows(got) == rows(duck(str(tmp_path), ORACLES[name]))
        assert got.n_links.max() > 1 and not got.kept.all()


def brute_tree(train, query, depth):
    """Context-tree weighting by recursion over one bit string per decision node."""
    nodes = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    for t in train:
        line = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(line)):
            h = 1
            for k in range(8):
                bit = line[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    c = line[i - d : i][::-1]
                    nodes[c, h][bit] += 1
                    if d < depth:
                        children[c, h].add(line[i - d - 1 : i][::-1])
                h = 2 * h + bit

    def kt(c, h):
        a, b = nodes[c, h]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, h):
        return kt(c, h) if len(c) == depth else np.logaddexp(kt(c, h), sum(weighted(x, h) for x in children[c, h])) - math.log(2)

    def p_one(line, i, h):
        p = None
        for d in range(depth, -1, -1):
            c = line[i - d : i][::-1]
            a, b = nodes.get((c, h), (0, 0))
            if a + b:
                own = (b + 0.5) / (a + b + 1)
                w = 1.0 if d == depth else math.exp(kt(c, h) - math.log(2) - weighted(c, h))
                p = own if p is None else w * own + (1 - w) * p
        return 0.5 if p is None else p

    line, total = b"\xff" * depth + query + b"\xff", 0.0
    for i in range(depth, len(line)):
        h = 1
        for k in range(8):
            bit, p = line[i] >> (7 - k) & 1, p_one(line, i, h)
            total += math.log10(p if bit else 1 - p)
            h = 2 * h + bit
    return total


def test_context_tree(spark, none):
    data = [(i, x) for i, x in enumerate(["Abab cab", "abba é", "", None, "cabba abba", "ab", "bab cab", "acab baca", "b"])]
    got = {r.doc_id: r for r in context_tree.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    held = {i for i, _ in data if zlib.crc32(str(i).encode()) % 7 == 2}
    low = {i: re.sub("[A-Z]+", lambda m: m[0].lower(), x or "").encode() for i, x in data}
    assert len(got) == len(data) and {i for i in got if got[i].held_out} == held
    for i, _ in data:
        assert np.isclose(got[i].score, brute_tree([low[j] for j in low if j not in held], low[i], context_tree.DEPTH))
        assert got[i].n_tokens == len(low[i].split()) + 1
    assert context_tree.score(none).count() == 0


def test_context_tree_accepts_odd_rows(docs):
    got = context_tree.score(docs).collect()
    assert len(got) == docs.count() and all(r.score < 0 for r in got)


def test_forest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 8))
    x[20:40] = x[:20] + 0.1 * r.normal(size=(20, 8))
    x[40] = x[0]
    vec = [(i, [float(y) for y in x[i]], i % 2 if i < 20 else (i - 20) % 2 if i < 40 else 0) for i in range(60)]
    vec += [(60, None, 0), (61, [0.0] * 8, 0), (62, [float("nan")] * 8, 0), (63, [None] * 8, 0), (64, vec[0][1], None), (65, [1.0], 0), (66, [], 0), (1, vec[1][1], 1)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>, label int")
    n, up = collections.Counter(), list(range(len(vec)))
    ok = [k for k, (i, e, l) in enumerate(vec) if l is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    find = lambda k: k if up[k] == k else find(up[k])
    for a, b in itertools.combinations(ok, 2):
        p, q = np.array(vec[a][1]), np.array(vec[b][1])
        if vec[a][2] == vec[b][2] and len(p) == len(q) and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
            n.update([a, b])
            up[find(b)] = find(a)
    least = collections.defaultdict(lambda: 1 << 60)
    for k, v in enumerate(vec):
        least[find(k)] = min(least[find(k)], v[0])
    want = sorted((v[0], n[k], least[find(k)]) for k, v in enumerate(vec))
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in vector_forest.near_duplicates(df).collect())
    assert got == want
    assert vector_forest.near_duplicates(df.limit(0)).count() == 0


def brute_links(x, label, threshold=0.93):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = (u @ u.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    return near.sum(axis=1), components(len(x), *np.nonzero(near))


@pytest.mark.parametrize("kind", ["scaled", "one component", "clusters"])
def test_forest_against_brute_force(spark, kind):
    """More vectors than a task's node: multiples of one vector, vectors of one component, and many small clusters, which
    take several splits. Columns of the operator's own names are in the way."""
    r = np.random.default_rng(5)
    if kind == "scaled":
        x = np.concatenate([np.outer(np.arange(1, 2401), r.normal(size=16)), r.normal(size=(200, 16))])
    elif kind == "one component":
        x = np.where(np.arange(2600) % 3 > 0, 1.0, -1.0)[:, None] * np.arange(1, 2601)[:, None]
    else:
        x = np.repeat(r.normal(size=(900, 32)), 5, axis=0)
        x += 0.22 * r.normal(size=x.shape)
    x = x[r.permutation(len(x))]
    n, least = brute_links(x, np.zeros(len(x)))
    rows = [(i, v.tolist(), 1, 2, 3, "s") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int, tree int, space string").repartition(4)
    got = {v.vec_id: (v.n_links, v.component_id) for v in vector_forest.near_duplicates(df).collect()}
    want = {i: (int(n[i]), int(least[i])) for i in range(len(x))}
    if kind == "clusters":
        found, all_ = sum(k for k, _ in got.values()), int(n.sum())
        assert all_ > 3000 and all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * all_
    else:
        assert got == want


def test_forest_of_a_group_of_near_copies(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(6500, 64))
    x[:5000] = r.normal(size=64) + 0.27 * x[:5000]  # cosines around the threshold
    x[6499] = x[0]
    x = x[r.permutation(len(x))].astype(np.float32)
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    least = components(len(x), *np.nonzero(near))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted((v.vec_id, v.n_links, v.component_id) for v in vector_forest.near_duplicates(df).collect())
    assert near.sum() > 1_000_000
    assert got == [(i, int(near[i].sum()), int(least[i])) for i in range(len(x))]


def test_jaccard(docs, none):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, x in data:
        w = WORDS.findall(x or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = collections.Counter()
    for a, b in itertools.combinations(range(len(data)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            n.update([a, b])
    got = shingle_join.jaccard_join(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_links) for r in got), key=key) == sorted(((d[0], n[k]) for k, d in enumerate(data)), key=key)
    kept = shingle_join.keep(docs)
    assert kept.count() == sum(r.kept for r in got) and kept.columns == docs.columns
    assert shingle_join.jaccard_join(none).count() == 0


def test_jaccard_of_thousands(spark):
    """Buckets of thousands: a family whose members drift apart, a second one, and texts that share a passage with it."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [word() for _ in range(160)]
    data = []
    for i in range(2500):
        w = list(base)
        for k in r.sample(range(160), r.choice([0, 1, 1, 2, 3, 4])):
            w[k] = word()
        data.append((i, " ".join(w)))
    data += [(5000 + i, " ".join([word() for _ in range(100)] + base[:60])) for i in range(500)]
    grams = [{tuple(t.split()[k : k + 5]) for k in range(156)} for _, t in data]
    number = {}
    sets = np.zeros((len(data), 0))
    cols = [[number.setdefault(g, len(number)) for g in s] for s in grams]
    sets = np.zeros((len(data), len(number)), np.float32)
    for i, c in enumerate(cols):
        sets[i, c] = 1
    both, size = sets @ sets.T, sets.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-3
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in data], "doc_id long, text string, uid int, component int, bands string").repartition(4)
    got = {x.doc_id: x.n_links for x in shingle_join.jaccard_join(df).collect()}
    assert near.sum() > 100_000 and [got[i] for i, _ in data] == near.sum(axis=1).tolist()


def test_long_texts_are_hashed_in_windows(monkeypatch):
    """Windows smaller than words and texts give the hashes of one window."""
    from lattica.llm import arrow

    texts_ = pa.array([*texts(), "one " * 5000 + "x" * 3000, "y" * 5000, "", "z"])
    want = shingle_join.Shingler()(texts_)
    for window in (64, 1000):
        monkeypatch.setattr(arrow, "WINDOW", window)
        monkeypatch.setattr(shingle_join, "WINDOW", window)
        got = shingle_join.Shingler()(texts_)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
    low = shingle_join.min_hashes(*want, arrow.odd(8, 1))
    monkeypatch.setattr(shingle_join, "PART", 100)
    assert (shingle_join.min_hashes(*want, arrow.odd(8, 1)) == low).all()


def test_a_text_of_fifty_megabytes(spark):
    """It passes through shingling, tagging and sharding whole, in bounded memory."""
    base = " ".join(f"word{i % 9973}x{i % 89}" for i in range(60_000))
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit(base + " "), 56).alias("text"))
    docs = docs.unionAll(spark.createDataFrame([(2, base), (3, "short one")], "doc_id long, text string"))
    got = {x.doc_id: (x.n_grams, x.n_links) for x in shingle_join.jaccard_join(docs).collect()}
    assert got[2][0] == 59_996 and got[1][0] >= 59_996 and got[3] == (1, 0) and got[1][1] == got[2][1] == 1
    size = {x.doc_id: x.size for x in sharding.histogram_shards(docs, 2).collect()}
    assert size[1] == 56 * (len(base) + 1) + 16 > 30e6


def test_packing(docs, none):
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 64, 2).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d in docs.collect():
        ids = [*encode("byte_bpe_50k.json", d.text), 2]
        if d.doc_id != 3:
            own = sorted(by[d.doc_id], key=lambda r: r.piece)
            assert [crc(ids[r.start : r.start + r.length]) for r in own] == [r.ids_crc32 for r in own]
            assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for o, k in sorted(s):
            assert o == end
            end += k
        assert end <= 64
    gaps = []  # plain best fit, longest first
    for k in sorted((r.length for r in got), reverse=True):
        fit = min((g for g in gaps if g >= k), default=None)
        if fit is None:
            gaps.append(64 - k)
        else:
            gaps.remove(fit)
            gaps.append(fit - k)
    assert len(seqs) <= len(gaps)
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0


def best_fit(lengths, capacity):
    """Plain best fit, longest first: the number of sequences."""
    gaps, opened = [], 0
    for k in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, k)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += at == len(gaps) and gap == capacity
        if gap > k:
            bisect.insort(gaps, gap - k)
    return opened


LENGTHS = {
    "uniform": lambda r: r.integers(1, 1025, 4000),
    "a third alike": lambda r: np.concatenate([r.integers(1, 1025, 2000), np.full(1000, 340)]),
    "long tail": lambda r: np.clip(r.lognormal(5, 1, 4000), 1, 1024).astype(int),
    "short": lambda r: r.integers(1, 60, 4000),
    "ones": lambda r: np.ones(3000, int),
    "ones and gaps": lambda r: np.concatenate([np.full(300, 700), np.full(3000, 10), np.ones(500, int)]),
    "halves": lambda r: np.full(1001, 512),
    "full": lambda r: np.full(500, 1024),
    "one": lambda r: np.array([3]),
}


@pytest.mark.parametrize("kind", sorted(LENGTHS))
@pytest.mark.parametrize("range_rows", [1 << 16, 300])
def test_rounds_of_best_fit(spark, kind, range_rows):
    """One range is plain best fit; many ranges over several rounds lose one part in a hundred and one sequence a range at
    most, place every piece once and leave no hole. Columns of the operator's own names are carried."""
    lengths = LENGTHS[kind](np.random.default_rng(6)).tolist()
    rows = [(k, i, "x", None, i % 3, 1.5) for i, k in enumerate(lengths)]
    df = spark.createDataFrame(rows, "length int, id long, kind string, seq string, part int, `a.b` double").repartition(5)
    out = packing.pack(df, 1024, range_rows)
    assert out.columns == [*df.columns, "sequence_id", "offset"]
    got = out.collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(rows)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for o, k in sorted(s):
            assert o == end
            end += k
        assert end <= 1024
    plain = best_fit(lengths, 1024)
    assert len(sequences) <= (plain if range_rows > len(lengths) else plain * 1.01 + len(lengths) / range_rows)


def test_ranks_of_ranges_meet():
    left = [{"part": 0, "kind": "gap", "n": 3, "least": 50, "most": 60}, {"part": 1, "kind": "gap", "n": 2, "least": 30, "most": 31}, {"part": 2, "kind": "doc", "n": 9, "least": 8, "most": 14}, {"part": 2, "kind": "gap", "n": 1, "least": 8, "most": 8}, {"part": 3, "kind": "doc", "n": 1, "least": 2, "most": 2}]
    assert packing._match_ranks(left) == [(2, 0, 4, 1, 2, 2), (2, 4, 9, 0, 3, 3), (3, 0, 1, 2, 1, 4)]


def test_toxicity(spark, none, labels):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    data, marks = [], []
    for i in range(400):
        w, bad = r.choices(words, k=40), int(i % 4 == 0)
        if bad:
            w[r.randrange(40)] = "vilex" + r.choice("abc")
            w[r.randrange(40)] = "vilex" + r.choice("abc")
        data.append((i, " ".join(w)))
        marks.append((i, 1, bad))
    data += [(1000, None), (1001, ""), (None, "vilexa"), (0, data[0][1])]
    got = toxicity.tag(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(data)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert held and all(x.predicted == (x.doc_id % 4 == 0) for x in held)
    some = next(x for x in held if x.predicted)
    assert all(data[some.doc_id][1][s.start : s.end].startswith("vilex") for s in some.spans)
    assert toxicity.tag(none, labels).count() == 0


def test_copies_are_evidence_once():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=8))
    copied = " ".join(word() for _ in range(20))
    toxic = [copied + " vilex"] * 30 + [f"{word()} vilex {word()} {word()}" for _ in range(30)]
    texts = toxic + [" ".join(word() for _ in range(20)) for _ in range(60)]
    units, codes, at, _, _ = toxicity.tokens(pa.array(texts))
    words = [toxicity.normal(u) for u in toxicity.as_bytes(units)]
    marked = toxicity.seeds(words, codes, at, np.arange(120) < 60)
    assert {w for w, m in zip(words, marked, strict=True) if m} == {"vilex"}


def test_marginals_by_enumeration():
    r = np.random.default_rng(1)
    e, m = r.normal(size=7), r.normal(size=(2, 2))
    p, _ = toxicity.marginals(e, np.array([0, 0, 7]), m)
    total, ones = 0.0, np.zeros(7)
    for s in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(m[a, b] for a, b in zip((0, *s), s, strict=False)) + np.dot(s, e))
        total, ones = total + w, ones + w * np.array(s)
    assert np.allclose(p, ones / total)


def test_sharding(docs, none):
    got = sharding.histogram_shards(docs, 5).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(5))
    t = {d.doc_id: (d.text or "").encode() for d in docs.collect()}
    assert all(r.size == len(t[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(t[r.doc_id]) for r in got)
    assert sharding.histogram_shards(none, 5).count() == 0


def test_equal_texts_that_fit_are_not_cut(spark):
    data = [(i, f"text {i // 10 if i < 200 else 99:03d} " + "x" * 90) for i in range(260)]  # 20 groups of 10 and one of 60
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    where = collections.defaultdict(set)
    for r in sharding.histogram_shards(df, 7).collect():
        where[r.text_crc32].add(r.shard)
    assert len(where) == 21 and len({s for x in where.values() for s in x}) == 7
    assert all(len(s) == 1 for k, s in where.items() if k != zlib.crc32(data[-1][1].encode()))
    assert len(where[zlib.crc32(data[-1][1].encode())]) > 1


def test_shards_against_brute_force(spark):
    """More partitions than shards and a text longer than a shard's share: slots follow key order, sums are near equal."""
    r = random.Random(9)
    data = [(i, "x" * r.randint(0, 400)) for i in range(900)] + [(2000 + i, "same " * 30) for i in range(40)] + [(5, None), (None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("part", F.lit(1)).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sharding.histogram_shards(df, 6).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((x.doc_id or -1, x.size) for x in got) == sorted((i or -1, len(t or "") + 16) for i, t in data)
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    size = {k: sum(x.size for x in v) for k, v in by.items()}
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    assert max(size.values()) - min(size.values()) <= 40 * 166 + 500  # the largest group of equal texts is not cut
    for v in by.values():  # equal texts of a shard stand together
        crcs = [x.text_crc32 for x in sorted(v, key=lambda x: x.slot)]
        assert len(list(itertools.groupby(crcs))) == len(set(crcs))


def test_sharding_is_even(spark, sf_dir):
    got = sharding.histogram_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4).groupBy("shard").sum("size").collect()
    size = [r[1] for r in got]
    assert max(size) - min(size) < 80_000


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<html><body><nav><a href=x>menu</a></nav><article><h1>T</h1><p><b>One<br>two</b>x<p>Three  four</article><footer>f</footer>", "T One twox Three four"),
    ("<div class='ad'>buy</div><article><p>Body text here.</p><aside>s</aside><form>q</form><script>var a='</p>'</script></article><div id=comments><p>I hate it all and more</p></div>", "Body text here."),
    ("<body><div><section><p>Alpha beta.</p><p>Gamma.</p></section><section><p>Tail one.</p></section></div></body>", "Alpha beta. Gamma. Tail one."),
    ("<article><p>unclosed <a href='x>quote</article>", "unclosed quote"),  # such a tag ends at its first >
])
def test_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    ('<body><div class="layout has-sidebar"><article><p>Body text here.</p></article><div class="sidebar"><p>Side.</p></div></div></body>', "Body text here."),
    ('<body><div id="no-sidebar"><main><p>Body text here.</p></main></div></body>', "Body text here."),
    ('<body><div class="no-sidebar"><p>Body text here.</p><p>And more of it.</p><div class="ad">buy</div></div><div class="footer">f</div></body>', "Body text here. And more of it."),
    ('<body><main><div class="content-with-nav"><article><p>Body text here.</p></article></div></main></body>', "Body text here."),
    ('<body><main><p>Body text here, all of it.</p><div class="related"><article><p>Teaser.</p></article></div></main></body>', "Body text here, all of it."),
    ('<body><article><p>Body text here.</p></article><div class="comments"><article><p>I like it.</p></article></div></body>', "Body text here."),
    ('<body><article><p>Body.</p><div id="comments"><p>I hate it all and more</p></div></article></body>', "Body."),
    ('<body><div hidden class="has-sidebar"><article><p>Not shown.</p></article></div><p>Shown.</p></body>', "Shown."),
])
def test_class_words_spare_the_article(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<body><div class='social-science'><p>The whole of the article stands here.</p><p>And here is some more of it.</p></div><p>x</p></body>", "The whole of the article stands here. And here is some more of it. x"),
    ("<body><div id='ad-story'><p>The whole of the article stands here.</p></div></body>", "The whole of the article stands here."),
    ("<article><header><h1>Title</h1></header><p>Body text of it.</p></article>", "Title Body text of it."),
    ("<body><header><h1>Site</h1></header><article><p>Body text of it.</p></article></body>", "Body text of it."),
    ("<body><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></body>", ""),
])
def test_density_decides_over_class_words(page, want):
    assert html_text.main_text(page) == want


def test_pages_need_their_densities(sf_dir, monkeypatch):
    """With every density at zero, nothing would be extracted."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()
    assert all(html_text.main_text(x) for x in pages)
    monkeypatch.setattr(html_text.math, "log", lambda x: 0.0 if x != math.e else 1.0)
    assert not any(html_text.main_text(x) for x in pages)


def brute_density(page):
    """Densities by whole walks below every node of a DOM that the standard library's parser builds; best subtree's text."""
    from html.parser import HTMLParser

    class Node:
        def __init__(self, tag, up):
            self.tag, self.up, self.items = tag, up, []

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.at = Node("#", None)

        def handle_starttag(self, tag, attrs):
            new = Node(tag, self.at)
            self.at.items.append(new)
            self.at = new

        def handle_endtag(self, tag):
            self.at = self.at.up

        def handle_data(self, data):
            self.at.items.append(data)

    def walk(x):
        yield x
        for y in x.items:
            if not isinstance(y, str):
                yield from walk(y)

    def text(x, linked=False):
        own = linked or x.tag == "a"
        return [(y, own) for y in x.items if isinstance(y, str)] + [z for y in x.items if not isinstance(y, str) for z in text(y, own)]

    b = Builder()
    b.feed(page)
    size = lambda x, only=False: sum(len("".join(s.split())) for s, a in text(x) if a or not only)
    share = size(b.root, True) / size(b.root)

    def density(x):
        c, lc, t, lt = size(x), size(x, True), sum(1 for _ in walk(x)) - 1, sum(y.tag == "a" for y in walk(x) if y is not x)
        if not c or lc >= c:
            return 0.0
        return max(0.0, c / (t or 1) * math.log(c / (lc or 1) * (t or 1) / (lt or 1)) / math.log(c / (c - lc) * lc + share * c + math.e))

    best = max(walk(b.root), key=lambda x: (sum(density(y) for y in x.items if not isinstance(y, str)), size(x)))
    order = lambda x: " ".join(y if isinstance(y, str) else order(y) for y in x.items)
    return " ".join(order(best).split())


def test_best_subtree_against_brute_force():
    r = random.Random(12)
    line = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n))
    for _ in range(60):
        story = "".join(f"<p>{line(r.randint(25, 60))}</p>" for _ in range(r.randint(2, 6)))
        menu = "<ul>" + "".join(f"<li><a>{line(1)}</a></li>" for _ in range(r.randint(4, 12))) + "</ul>"
        page = f"<body><div>{menu}</div><div><div>{story}</div>{menu}</div><div>{menu}</div></body>"
        assert html_text.main_text(page) == brute_density(page)


def test_article_grows_to_the_body():
    r = random.Random(6)
    para = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60 - k)) for k in range(6)]
    part = ["<div>" + "".join(f"<p>{x}</p>" for x in para[k : k + 3]) + "</div>" for k in (0, 3)]
    links = "<div>" + "<a href=x>some link</a> " * 20 + "</div>"
    title, short, half = "<h1>The title of it</h1>", "<p>Short one.</p>", " ".join(para[:3])
    for page, want in [
        (f"<body>{''.join(part)}</body>", " ".join(para)),
        (f"<body>{title}{part[0]}</body>", "The title of it " + half),
        (f"<html>{title}{part[0]}{short}</html>", f"The title of it {half} Short one."),
        (f"<body><div><div>{title}</div>{part[0]}{short}</div></body>", f"The title of it {half} Short one."),
        (f"<body>{links}<h1><a href=x>The title of it</a></h1>{part[0]}{short}{links}<div class=ad>buy</div></body>", f"The title of it {half} Short one."),
        (f"<body>Loose <b>text</b>{part[0]}</body>", "Loose text " + half),
        (f"{part[0]}{short}", half + " Short one."),
    ]:
        assert html_text.main_text(page) == want


def test_pages_table(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x y</p>"), (1, "u", "")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract(df).collect()) == [0, 0, 3]
    assert html_text.extract(df.limit(0)).count() == 0


def test_prefix_bpe(docs, none):
    path, name = P.path("word_bpe_49k.json"), "word_bpe_49k.json"
    t = {d.doc_id: d.text for d in docs.collect()}
    for r in prefix_bpe.encode_decode(docs, path).collect():
        ids = encode(name, t[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(load(path).decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert prefix_bpe.encode_decode(none, path).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).choice(1 << 40, 5000, replace=False)
    assert sorted(token_store.PerfectHash.build(keys).slots(keys)) == list(range(5000))
    assert len(token_store.PerfectHash.build(keys[:0]).slots(keys)) == 5000


def test_token_store(spark, docs, none):
    from lattica.shared import new_path

    path, uri = P.path("word_bpe_49k.json"), new_path(spark, "t")
    manifest = token_store.write_store(docs, path, 2, uri, shards=3)
    got = token_store.read_store(spark, uri, manifest, path).collect()
    t = {d.doc_id: [*encode("word_bpe_49k.json", d.text), 2] for d in docs.collect()}
    assert len(got) == docs.count() and all(r.n_tokens == len(t[r.doc_id]) and r.ids_crc32 == crc(t[r.doc_id]) for r in got)
    run = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == run
        run += r.n_tokens
    found = token_store.lookup(uri, manifest, [0, 3, 999_999], path)
    assert [x.tolist() for x in found[0]] == [t[0]] and len(found[3]) == 2 and not found[999_999]
    assert token_store.encode_and_store(none, path).count() == 0


def test_keyed_reads_take_a_few_bytes_of_the_index(tmp_path):
    from pyarrow import fs

    keys = np.sort(np.random.default_rng(1).choice(1 << 40, 30_000, replace=False))
    keys[7] = keys[6]
    ids = np.arange(60_000, dtype="<u2")
    (tmp_path / "s.idx").write_bytes(token_store.build_index(keys, np.zeros(len(keys), bool), np.full(len(keys), 2)))
    (tmp_path / "s.ids").write_bytes(ids.tobytes())
    with token_store.Shard(fs.LocalFileSystem(), f"{tmp_path}/s", 2) as s:
        taken, read = [], s._read
        s._read = lambda kind, at, n, first=0: taken.append(n * np.dtype(kind).itemsize) or read(kind, at, n, first)
        for i in range(100, 30_000, 997):
            assert [x.tolist() for x in s.get(int(keys[i]))] == [[2 * i, 2 * i + 1]]
        assert len(s.get(int(keys[6]))) == 2 and max(taken) <= 64 and sum(taken) / 31 < 300
        assert all(s.get(k) == [] for k in range(500) if k not in keys)
        s._read = read
        row, n = s.find(keys)
        assert (row[8:] == np.arange(8, 30_000)).all() and (n[8:] == 1).all() and row[7] == 6 and n[7] == 2


def test_store_rows_come_through_the_index(spark, docs):
    from lattica.shared import new_path

    path, uri = P.path("word_bpe_49k.json"), new_path(spark, "t")
    manifest = token_store.write_store(docs, path, 2, uri, shards=2)
    fs, root = token_store._filesystem(uri)
    file = f"{root}/shard-00001.idx"
    with token_store.Shard(fs, file[:-4], 2) as s:
        raw, lo, hi, n = bytearray(s.index.read_at(s.index.size(), 0)), s.slots_at, s.rows_at, s.n_rows
    slots = np.frombuffer(bytes(raw[lo:hi]), token_store.SLOT).copy()
    slots["row"], slots["rows"] = 0, n  # every row lies in the range, no row is the right one
    raw[lo:hi] = slots.tobytes()
    token_store._put(fs, file, [bytes(raw)])
    with pytest.raises(Exception, match="the index does not lead to every document"):
        token_store.read_store(spark, uri, manifest, path).collect()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in C.STAGES[:-1]:
        kept = C.stage(f(spark, docs, sf_dir), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    last = C.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline as C

    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    data, toxic = [], set()
    for i in range(400):
        w = r.choices(words, k=40)
        if i % 4 == 0:
            toxic.add(i)
            for _ in range(2):
                w[r.randrange(40)] = "vilex" + r.choice("abc")
        data.append((i, " ".join(w)))
    long = r.choices(words, k=150)
    data += [(500 + k, " ".join([*long[: 10 * k], "other", *long[10 * k + 1 :]])) for k in range(6)]  # near copies
    data += [(510, data[1][1]), (511, data[2][1]), (520, " ".join(r.choices(words, k=1500)))]  # copies, and a long text
    data += [(530, None), (531, ""), (532, "too short"), (533, "again and " * 60), (534, " ".join(words[:19]))]
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def passes(x):
        w = WORDS.findall(x or "")
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        repeated = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
        return len(w) >= 20 and 100 * len(repeated) <= 30 * len(w)

    grams, stay = {}, {}
    for i, x in data:
        if passes(x) and i not in toxic:
            w = x.split()
            grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            stay[i] = x
    linked = [(a, b) for a, b in itertools.combinations(grams, 2) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    ids = sorted(grams)
    first = components(len(ids), *(np.array([ids.index(p[k]) for p in linked]) for k in (0, 1)))
    stay = {i: stay[i] for k, i in enumerate(ids) if first[k] == k}
    assert len(linked) == 17 and len(stay) == 302
    want = []
    for i, x in stay.items():
        tokens = [*encode(C.BYTE_BPE, x), C.END_ID]
        ends = list(range(len(tokens), 0, -C.SEQUENCE))[::-1]
        for piece, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)):
            want.append((i, piece, lo, hi - lo, crc(tokens[lo:hi])))
    root = shared_root(spark).removeprefix("file://")
    was = set(os.listdir(root))
    got = C.run(spark, str(tmp_path)).collect()
    assert [x.partition("-")[0] for x in set(os.listdir(root)) - was] == ["packing"]
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    gaps, seqs = [], collections.defaultdict(list)
    for k in sorted((x[3] for x in want), reverse=True):
        fit = min((g for g in gaps if g >= k), default=C.SEQUENCE)
        if fit in gaps:
            gaps.remove(fit)
        gaps.append(fit - k)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    assert len(seqs) <= len(gaps)
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(k for _, k in s[:n]) for n in range(len(s))] and sum(k for _, k in s) <= C.SEQUENCE


def test_slices_of_null_columns():
    from lattica.llm.units import cut

    units, codes, at = cut(pa.array([None, ""], pa.string()))
    assert len(units) == len(codes) == 0 and at.tolist() == [0, 0, 0]


def test_packing_encodes_small_slices_and_remembers_few_units(monkeypatch):
    """The pipeline's last stage shares an executor's memory with what the earlier ones left there."""
    made, seen = [], []

    class Spy(packing.UnitEncoder):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

        def encode(self, texts, end_id=None):
            seen.append((sum(map(len, texts.to_pylist())), len(self.units) + len(self.units.old)))
            return super().encode(texts, end_id)

    monkeypatch.setattr(packing, "UnitEncoder", Spy)
    texts = [" ".join(f"w{j}" for j in range(i, i + 10_000)) for i in range(0, 700_000, 10_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = pa.Table.from_batches(packing._pieces(iter([batch]), P.path("byte_bpe_50k.json"), 1024, 2))
    assert set(out.column("doc_id").to_pylist()) == set(range(len(texts)))
    assert max(x for x, _ in seen) < 1.2 * (1 << 20) and max(n for _, n in seen) < 600_000 and made[0].units.size <= 200_000
