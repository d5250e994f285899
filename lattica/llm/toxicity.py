"""Toxic spans by a linear-chain conditional random field.

Token labels come from document labels: among the training documents, word and prefix features that occur in toxic
ones far beyond chance (Bonferroni over all frequent features) mark the toxic tokens of toxic documents; all others are
clean. The field has two states, emission weights for hashed word, prefix and suffix features of the token, and
transition weights, fitted by gradient ascent on the conditional likelihood. Forward-backward marginals then tag every
token of a text; the number of toxic tokens, weighted by their cubed marginals, becomes a document score through a logistic curve fitted on the
training documents, and runs of likely tokens become spans of code points.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import flat, mix, slices, strings
from .units import Memory, as_bytes

#: The training sample: documents of each label, by hash of the id, none longer than MAX_CHARS code points.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 800, 1600, 20_000
#: Hashed features; steps and rate of the fit; weight of the squared norm; chance that any seed feature is false.
DIM, STEPS, RATE, L2, SEED_ERROR = 1 << 18, 40, 0.5, 1e-6, 0.01
#: Tokens per column of the blocked scan; bytes of text scored at once and words whose emissions a worker remembers, which
#: bound its memory and change no result.
BLOCK, SLICE, CACHE = 64, 1 << 20, 150_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_EDGE = re.compile(r"^\W+|\W+$")


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (with their trailing white space), codes, where texts begin among them, byte starts, bytes."""
    data, offsets = flat(texts)
    n = len(data)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] |= word[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), starts, data
    coded = strings(data[starts[0]:], starts - starts[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, offsets), starts, data


def normal(raw: bytes) -> str:
    return _EDGE.sub("", raw.decode(errors="replace").strip().lower())


def feature_names(word: str) -> list[str]:
    return ["w:" + word, *[f"p:{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k], "s:" + word[-3:]] if word else ["w:"]


def hashed(word: str) -> list[int]:
    return [0, *[1 + zlib.crc32(f.encode()) % (DIM - 1) for f in feature_names(word)]]


def marginals(emission: np.ndarray, at: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every token and the expected transition counts (2 x 2). Texts begin in state 0. The chain is cut
    in blocks whose 2 x 2 products are formed side by side, then chained per text."""
    total = len(emission)
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    size = np.diff(at)
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    text = np.repeat(np.arange(len(size)), size)
    inside = np.arange(total) - np.repeat(at[:-1], size)
    row, col = first[text] + inside // BLOCK, inside % BLOCK
    e, live = np.ones((BLOCK, nb)), np.zeros((BLOCK, nb), bool)
    e[col, row] = np.exp(np.clip(emission, -30, 30))
    live[col, row] = True
    t = np.exp(moves - moves.max())
    p00, p01, p10, p11 = np.ones(nb), np.zeros(nb), np.zeros(nb), np.ones(nb)
    for j in range(BLOCK):
        m = live[j]
        a, b = p00 * t[0, 0] + p01 * t[1, 0], (p00 * t[0, 1] + p01 * t[1, 1]) * e[j]
        c, d = p10 * t[0, 0] + p11 * t[1, 0], (p10 * t[0, 1] + p11 * t[1, 1]) * e[j]
        s = a + b + c + d
        p00, p01, p10, p11 = np.where(m, a / s, p00), np.where(m, b / s, p01), np.where(m, c / s, p10), np.where(m, d / s, p11)
    f0, f1, b0, b1 = np.ones(nb), np.zeros(nb), np.full(nb, 0.5), np.full(nb, 0.5)
    order = np.argsort(-blocks, kind="stable")
    many = blocks[order]
    for k in range(int(blocks.max()) - 1):
        docs = order[: np.searchsorted(-many, -(k + 1))]  # with more than k + 1 blocks
        i = first[docs] + k
        x, y = f0[i] * p00[i] + f1[i] * p10[i], f0[i] * p01[i] + f1[i] * p11[i]
        f0[i + 1], f1[i + 1] = x / (x + y), y / (x + y)
        i = first[docs] + blocks[docs] - 1 - k
        x, y = p00[i] * b0[i] + p01[i] * b1[i], p10[i] * b0[i] + p11[i] * b1[i]
        b0[i - 1], b1[i - 1] = x / (x + y), y / (x + y)
    fwd = np.empty((BLOCK + 1, nb))
    fwd[0] = f1
    for j in range(BLOCK):
        q = fwd[j]
        x, y = (1 - q) * t[0, 0] + q * t[1, 0], ((1 - q) * t[0, 1] + q * t[1, 1]) * e[j]
        fwd[j + 1] = np.where(live[j], y / (x + y), q)
    out, edges = np.empty((BLOCK, nb)), np.zeros((2, 2))
    back = b1
    for j in reversed(range(BLOCK)):
        m, q = live[j], fwd[j]
        x, y = 1 - back, back * e[j]
        w = np.array([[(1 - q) * t[0, 0] * x, (1 - q) * t[0, 1] * y], [q * t[1, 0] * x, q * t[1, 1] * y]])
        w /= w.sum(axis=(0, 1))
        edges += np.where(m, w, 0).sum(axis=2)
        out[j] = w[0, 1] + w[1, 1]
        x, y = t[0, 0] * x + t[0, 1] * y, t[1, 0] * x + t[1, 1] * y
        back = np.where(m, y / (x + y), back)
    return out[col, row], edges


@dataclass
class Field:
    """A fitted model: emission weights, transitions, and the curve from toxic tokens to a score."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]

    def emission(self, word: str) -> float:
        return float(self.weights[hashed(word)].sum())


def _mass(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text, the log of its sharpened toxic tokens: cubes, so that many faint marginals of a long text do not add
    up to a clear one."""
    return np.log(np.diff(np.concatenate([[0.0], np.cumsum(p**3)])[at]) + 1e-4)


def _fresh(word: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether a token is the first of its label between its two neighbours."""
    before, after = np.concatenate([[0], word[:-1] + 1]), np.concatenate([word[1:] + 1, [0]])
    full = np.diff(at) > 0
    before[at[:-1][full]] = after[at[1:][full] - 1] = 0
    label = np.repeat(toxic.astype(np.int64), np.diff(at))
    places = mix(mix(mix(2 * before + label, 1) + word.astype(np.uint64), 2) + after.astype(np.uint64), 3)
    out = np.zeros(len(word), bool)
    out[np.unique(places, return_index=True)[1]] = True
    return out


def seeds(words: list[str], codes: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each distinct word has a feature tied to toxic documents. A passage that copies repeat is evidence once:
    else any rare word of a toxic text with copies would seem tied."""
    number: dict[str, int] = {}
    fresh = _fresh(np.array([number.setdefault(w, len(number)) for w in words], np.int64)[codes], at, toxic)
    df = [Counter(), Counter()]
    names = [frozenset(feature_names(w)) if w else frozenset() for w in words]
    for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        df[int(toxic[k])].update(frozenset().union(*[names[c] for c in set(codes[lo:hi][fresh[lo:hi]].tolist())]))
    share = toxic.mean() if len(toxic) else 0.0
    if not 0 < share < 1:
        return np.zeros(len(words), bool)
    common = [f for f in df[1] if df[1][f] + df[0][f] >= 4]
    need, chosen = math.log(max(1, len(common)) / SEED_ERROR), set()
    for f in common:
        k, n = df[1][f], df[1][f] + df[0][f]
        q = k / n
        if q >= 0.95 and n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0)) >= need:
            chosen.add(f)
    return np.array([not chosen.isdisjoint(x) for x in names])


def fit(texts: list[str], toxic: np.ndarray) -> Field:
    """Fit on a sample. Without both labels, or without any tied feature, every score is the share of toxic ones."""
    units, codes, at, _, _ = tokens(pa.array(texts, pa.string()))
    words = [normal(u) for u in as_bytes(units)]
    share = float(toxic.mean()) if len(toxic) else 0.0
    flat_curve = (0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    marked = seeds(words, codes, at, toxic) if len(words) else np.zeros(0, bool)
    weights, moves = np.zeros(DIM), np.zeros((2, 2))
    if not marked.any():
        return Field(weights, moves, flat_curve)
    target = (marked[codes] & np.repeat(toxic.astype(bool), np.diff(at))).astype(float)
    was = np.where(np.isin(np.arange(len(codes)), at[:-1]), 0, np.concatenate([[0], target[:-1]])).astype(int)
    seen = np.bincount(was * 2 + target.astype(int), minlength=4).reshape(2, 2).astype(float)
    moves = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    listed = [hashed(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(x) for x in listed])
    feature = np.concatenate([np.array(x) for x in listed])
    grow, grow_moves, n = np.full(DIM, 1e-8), np.full((2, 2), 1e-8), len(codes)
    for _ in range(STEPS):  # adaptive steps per weight
        emission = np.bincount(owner, weights[feature], len(words))
        p, edges = marginals(emission[codes], at, moves)
        slope = np.bincount(feature, np.bincount(codes, target - p, len(words))[owner], DIM) - L2 * n * weights
        grow += slope**2
        weights += RATE * slope / np.sqrt(grow)
        slope = seen - edges
        grow_moves += slope**2
        moves = moves + 0.1 * RATE * slope / np.sqrt(grow_moves)
    emission = np.bincount(owner, weights[feature], len(words))
    x, y = _mass(marginals(emission[codes], at, moves)[0], at), toxic.astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a slightly damped logistic fit
        s = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, v = np.array([((y - s) * x).sum() - 0.1 * a, (y - s).sum() - 0.1 * b]), s * (1 - s) + 1e-9
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
    return Field(weights.astype(np.float32), moves, (float(a), float(b)))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    """Learn from labelled documents outside the held-out fifth. At most MAX_TOXIC + MAX_CLEAN texts of at most
    MAX_CHARS code points each reach the driver. They are chosen by id first, without their texts; a second scan then
    fetches the texts of the chosen. Rows that repeat an id and its text count once."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.where(~held_out(key) & F.col(key).isNotNull() & (F.length(body) <= MAX_CHARS)).select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("th"))
    known = rows.join(marks, "doc_id").groupBy("doc_id", "th").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("th")]
    some = [known.where(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    kind = rows.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(some[0].unionAll(some[1]).collect(), f"doc_id {kind}, th long, toxic int")
    texts = docs.select(F.col(key).alias("doc_id"), body.alias("body")).withColumn("th", F.xxhash64("body"))
    got = texts.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).orderBy(*order).select("body", "toxic").collect()
    return fit([r[0] for r in got], np.array([r[1] for r in got], np.int64))


class Scorer:
    """Marginals and scores of Arrow string columns; remembers emissions of words."""

    def __init__(self, field: Field):
        self.field, self.known = field, Memory(CACHE)

    def __call__(self, texts: pa.Array):
        self.known.turn()
        found = tokens(texts)
        units, codes, at = found[:3]
        values = []
        for u in as_bytes(units):
            v = self.known[u]
            if v is None:
                v = self.known[u] = self.field.emission(normal(u))
            values.append(v)
        p, _ = marginals(np.array(values, float)[codes], at, self.field.moves)
        a, b = self.field.curve
        return p, 1 / (1 + np.exp(-np.clip(a * _mass(p, at) + b, -30, 30))), found


RESULT = "held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,prob:double>>"


def score(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` for every row; spans are code points. Null and empty texts have
    no tokens and the lowest score."""
    rows = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches):
        scorer = Scorer(sent.value)
        for b in slices(batches, budget=SLICE):
            p, s, (units, codes, at, starts, data) = scorer(b.column("text"))
            spans = [[] for _ in range(b.num_rows)]
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                chars = np.cumsum((data & 0xC0) != 0x80)
                _, offsets = flat(b.column("text"))
                doc = np.searchsorted(at, hot, side="right") - 1
                before = lambda x: int(chars[x - 1]) if x else 0
                raw = as_bytes(units)
                for t, d in zip(hot.tolist(), doc.tolist(), strict=True):
                    zero, lo = before(int(offsets[d])), int(starts[t])
                    hi = lo + len(raw[codes[t]].rstrip(b" \t\n\x0b\f\r"))
                    spans[d].append({"start": before(lo) - zero, "end": before(hi) - zero, "prob": float(p[t])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def tag(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` with a field trained on ``labels(doc_id, toxic)``: toxic is 0 or 1, a document labelled both ways counts as
    toxic, null ids and null labels do not count. Labels of one kind only, or no labels, give every row one score.
    Ties, repeated rows and ids are scored row by row; further columns of either table, whatever their names, are not
    read. An empty table gives an empty result."""
    return score(docs, train(docs, labels, key, text), key, text)


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns, without an exchange."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text))

    def run(batches):
        scorer = Scorer(sent.value)
        for b in slices(batches, text, SLICE):
            yield b.filter(pa.array(scorer(b.column(text))[1] < 0.5))

    return docs.mapInArrow(run, docs.schema)
