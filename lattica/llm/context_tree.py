"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision node has its own tree over the preceding bytes, most recent first, down
to DEPTH. Every tree node holds a Krichevsky-Trofimov estimate of the training bits seen there, and the weight of
stopping there against going deeper follows from the estimates' block probabilities, so the prediction mixes all
depths. A context that training never saw adds nothing: its parent's mixture ends there. Texts begin after DEPTH
boundary bytes and end with one, so a score is the log-probability of a whole text.

Distributed in blocks and buckets. Documents are packed into blocks (compressed, once). A block's distinct grams (the
context and the byte after it) go, as one sorted array per bucket, to the bucket that owns their three-byte contexts;
buckets add up the training counts of all blocks, build their subtrees and send back one number per distinct gram of
each block; blocks then sum over positions. The levels above three bytes hold at most 65,793 contexts whatever the
corpus, are added up over buckets and weighted on the driver. Words of the base model travel the same way.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stage
from .arrow import Words, flat, mix, slices

#: Bytes of context; text bytes of a block; distinct grams and words that a bucket receives, about.
DEPTH, BLOCK_BYTES, BUCKET_KEYS = 6, 12 << 20, 4_000_000
SHALLOW = 3
#: Log probabilities travel as fixed-point numbers: steps of 2^-36, which squeeze to five bytes.
STEP = float(1 << 36)
BOUNDARY = 0xFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])
_LOG_HALF = np.concatenate([[0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(np.arange(4095) + 0.5))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of ``a`` zeros and ``b`` ones."""
    half = lambda n: np.where(n < 4096, _LOG_HALF[np.minimum(n, 4095)], _stirling(np.maximum(n, 4096) + 0.5))
    whole = lambda n: np.where(n < 4096, _LOG_FACTORIAL[np.minimum(n, 4095)], _stirling(np.maximum(n, 4096) + 1.0))
    return half(a) + half(b) - whole(a + b) - math.log(math.pi)


# -- grams and words of a block --------------------------------------------------------------------
def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position, boundary byte included: (last byte .. DEPTH-th last byte, byte); and where texts begin (n + 1)."""
    n = len(offsets) - 1
    pad = DEPTH + 1  # DEPTH before a text, one after it
    inner = np.ones(len(data) + n * pad, bool)
    starts = offsets[:-1] + np.arange(n) * pad
    for k in range(DEPTH):
        inner[starts + k] = False
    ends = offsets[1:] + np.arange(n) * pad + DEPTH
    spot = inner.copy()  # a text's bytes and the boundary after them
    inner[ends] = False
    line = np.full(len(inner), BOUNDARY, np.uint8)
    line[inner] = data
    keys = np.zeros(max(0, len(line) - DEPTH), np.uint64)
    for k in range(1, DEPTH + 1):
        keys <<= np.uint64(8)
        keys |= line[DEPTH - k : len(line) - k]
    keys <<= np.uint64(8)
    keys |= line[DEPTH:]
    return keys[spot[DEPTH:]], offsets + np.arange(n + 1)


@lru_cache(maxsize=1)
def _words() -> Words:
    return Words()


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one end token after each text's; and where texts begin (n + 1)."""
    h, at = _words()(data, offsets)
    return np.insert(h, at[1:], np.uint64(0)), at + np.arange(len(offsets))


def _chunks(offsets: np.ndarray, budget: int = 2 << 20):
    """Ranges of texts of about ``budget`` bytes: what is held per position at once."""
    part = offsets[1:] // budget
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield lo, hi, slice(int(offsets[lo]), int(offsets[hi])), offsets[lo : hi + 1] - offsets[lo]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, where the groups of equal ones begin in it, and the distinct keys."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, first, keys[first]


def _dealt(keys: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys`` by bucket, and where each bucket begins in it (buckets + 1)."""
    owner = _bucket(keys, kind, buckets)
    order = np.argsort(owner.astype(np.uint16) if buckets <= 1 << 16 else owner, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=buckets))])


def _bucket(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    own = keys >> np.uint64(8 * (DEPTH - SHALLOW + 1)) if kind == 0 else keys
    return (mix(own, 24) % np.uint64(buckets)).astype(np.int64)


def _squeeze(x: np.ndarray) -> bytes:
    """Compressed by byte planes: equal high bytes of neighbouring numbers stand together."""
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 3) if len(x) else b""


def _widen(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _key_blob(sorted_keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(sorted_keys, prepend=np.uint64(0)))


def _keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(_widen(blob, np.uint64), dtype=np.uint64)


# -- blocks ----------------------------------------------------------------------------------------
BLOCKS = "block long, ids array<long>, held array<boolean>, sizes array<long>, body binary, n_train long, n_keys long"


def make_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("id"), held.alias("held"), F.col(text).cast("string").alias("text"))

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, held, sizes, body, room = [], [], [], [], 0

        def block():
            nonlocal made
            size = np.concatenate(sizes)
            data, offsets = np.concatenate(body), np.concatenate([[0], np.cumsum(size)])
            words, at = word_keys(data, offsets)
            train = ~np.concatenate([h.to_numpy(zero_copy_only=False) for h in held])
            n_train, n_keys = int(np.diff(at)[train].sum()), len(np.unique(words)) + min(len(data), 1 << 20) // 4
            list_of = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(t))
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + made]), list_of(pa.concat_arrays(ids), pa.int64()), list_of(pa.concat_arrays(held), pa.bool_()), list_of(pa.array(size), pa.int64()),
                pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary()), pa.array([n_train]), pa.array([n_keys]),
            ], names=["block", "ids", "held", "sizes", "body", "n_train", "n_keys"])

        for b in slices(batches, budget=BLOCK_BYTES // 4):
            data, offsets = flat(b.column("text"))
            if room and room + len(data) > BLOCK_BYTES:
                yield block()
                ids, held, sizes, body, room = [], [], [], [], 0
            ids.append(b.column("id"))
            held.append(b.column("held"))
            sizes.append(np.diff(offsets))
            body.append(_LOWER[data])
            room += len(data)
        if ids:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


def _open(t) -> tuple[np.ndarray, np.ndarray]:
    size = t.column("sizes")[0].values.to_numpy()
    return np.frombuffer(zstandard.decompress(t.column("body")[0].as_py()), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


PARTS = "bucket int, block long, kind int, keys binary, counts binary"


def gather(blocks: DataFrame, buckets: int) -> DataFrame:
    """``PARTS``: per block, bucket and kind (0 gram, 1 word) the distinct keys and their training counts."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                t = b.slice(r, 1)
                data, offsets = _open(t)
                held = t.column("held")[0].values.to_numpy(zero_copy_only=False)
                for kind, keys_of in ((0, gram_keys), (1, word_keys)):
                    found, uses = [], []
                    for lo, hi, span, own in _chunks(offsets):
                        keys, at = keys_of(data[span], own)
                        train = np.repeat(~held[lo:hi], np.diff(at))
                        order, first, distinct = _grouped(keys)
                        found.append(distinct)
                        uses.append(np.add.reduceat(train[order], first, dtype=np.int64))
                    every, n = _sum_by(np.concatenate(found), np.concatenate(uses))
                    n = n.astype(np.uint32)
                    order, cuts = _dealt(every, kind, buckets)
                    full = np.flatnonzero(np.diff(cuts))
                    mine = [order[cuts[p] : cuts[p + 1]] for p in full]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(full, pa.int32()), pa.array(np.full(len(full), t.column("block")[0].as_py())), pa.array(np.full(len(full), kind), pa.int32()),
                        pa.array([_key_blob(every[m]) for m in mine], pa.binary()), pa.array([_squeeze(n[m]) for m in mine], pa.binary()),
                    ], names=["bucket", "block", "kind", "keys", "counts"])

    return blocks.select("block", "held", "sizes", "body").mapInArrow(run, PARTS)


# -- trees -----------------------------------------------------------------------------------------
def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sums of each value array."""
    if not len(keys):
        return (keys, *values)
    order, first, distinct = _grouped(keys)
    return (distinct, *[np.add.reduceat(v[order], first) for v in values])


def _heap(sym: np.ndarray, bit: int) -> np.ndarray:
    """The decision node before ``bit`` (0 first) of a byte."""
    return np.uint64(1 << bit) | sym >> np.uint64(8 - bit)


def _level(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one context depth: key (context << 8 | decision), zeros, ones."""
    sym = grams & np.uint64(255)
    own, n = _sum_by(grams >> np.uint64(8 * (DEPTH - depth + 1)) << np.uint64(8) | sym, counts)
    context, sym = own & ~np.uint64(255), own & np.uint64(255)
    keys, zeros, ones = [], [], []
    for bit in range(8):
        one = (sym >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64) * n
        k, a, b = _sum_by(context | _heap(sym, bit), n - one, one)
        keys, zeros, ones = [*keys, k], [*zeros, a], [*ones, b]
    return _sum_by(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def _parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decision one context byte shorter."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255) if depth else keys


class Level:
    """Nodes of one depth with their prediction and the weight of stopping there."""

    def __init__(self, keys, zeros, ones, below=None):
        kt = log_kt(zeros, ones)
        self.keys, self.one = keys, (ones + 0.5) / (zeros + ones + 1.0)
        if below is None:
            self.log, self.stop = kt, np.ones(len(keys))
        else:
            self.log = np.logaddexp(kt, below) - math.log(2)
            self.stop = np.exp(kt - math.log(2) - self.log)

    def mixed(self, at: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """P(1) at the nodes ``at`` given the deeper predictions (nan: none)."""
        if not len(self.keys):
            return deeper
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        own, w = self.one[i], self.stop[i]
        p = np.where(np.isnan(deeper), own, w * own + (1 - w) * deeper)
        return np.where(self.keys[i] == at, p, deeper)


def _sum_children(parent: np.ndarray, child_parents: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parent))
    if len(parent):
        np.add.at(out, np.searchsorted(parent, child_parents), value)
    return out


def deep_levels(grams: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    levels: dict[int, Level] = {}
    for depth in range(DEPTH, SHALLOW - 1, -1):
        nodes = _level(grams, counts, depth)
        below = None if depth == DEPTH else _sum_children(nodes[0], _parents(levels[depth + 1].keys, depth + 1), levels[depth + 1].log)
        levels[depth] = Level(*nodes, below)
    return levels


def shallow_levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> dict[int, Level]:
    """Levels under SHALLOW bytes from their deepest one: summed counts and summed logs of the children."""
    levels = {}
    for depth in range(SHALLOW - 1, -1, -1):
        levels[depth] = Level(keys, zeros, ones, below)
        if depth:
            up = _parents(keys, depth)
            value = levels[depth].log
            keys, zeros, ones, below = _sum_by(up, zeros, ones, value)
    return levels


def predict(grams: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 P(byte | context) of each gram."""
    sym, out = grams & np.uint64(255), np.zeros(len(grams))
    for bit in range(8):
        p = np.full(len(grams), np.nan)
        for depth in range(DEPTH, -1, -1):
            at = grams >> np.uint64(8 * (DEPTH - depth + 1)) << np.uint64(8) | _heap(sym, bit)
            p = levels[depth].mixed(at, p)
        p = np.where(np.isnan(p), 0.5, p)
        one = (sym >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(one, p, 1 - p))
    return out


def _total(t: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of one kind over a bucket's blocks and their summed counts."""
    keys, counts, held = [], [], 0
    for k, a, b in zip(t.column("kind").to_pylist(), t.column("keys"), t.column("counts"), strict=True):
        if k == kind:
            keys.append(_keys_of(a.as_py()))
            counts.append(_widen(b.as_py(), np.uint32).astype(np.int64))
            held += len(keys[-1])
            if held > BUCKET_KEYS:
                keys, counts = ([x] for x in _sum_by(np.concatenate(keys), np.concatenate(counts)))
                held = 0
    return _sum_by(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


# -- the operator ----------------------------------------------------------------------------------
def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for every row.

    Learns from rows whose crc32 of the id as text is not 2 modulo 7; a null id is not held out. Null text is empty: it
    has the end token and the end byte only. A long text is a block of its own, worked on in chunks of whole texts.
    Repeated rows and ids are learned from and scored row by row. Further columns, whatever their names, are not read. With nothing to learn from, every bit has probability one half.
    """
    spark = docs.sparkSession
    blocks = stage(make_blocks(docs, key, text), "blocks")
    size = blocks.agg(F.sum("n_train").alias("n"), F.sum("n_keys").alias("k")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["k"] or 0) // BUCKET_KEYS))
    n_train = size["n"] or 0
    parts = stage(gather(blocks, buckets), "parts")
    grams_of, words_of = (parts.where(F.col("kind") == k).groupBy("bucket") for k in (0, 1))

    def upper(t: pa.Table) -> pa.Table:
        grams, counts = _total(t, 0)
        seen = counts > 0
        grams, counts = grams[seen], counts[seen]
        keys, zeros, ones = _level(grams, counts, SHALLOW - 1)
        low = deep_levels(grams, counts)[SHALLOW]
        below = _sum_children(keys, _parents(low.keys, SHALLOW), low.log)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(below)], names=["node", "zeros", "ones", "below"])

    top = grams_of.applyInArrow(upper, "node long, zeros long, ones long, below double")
    top = top.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    node = top.column("node").to_numpy()
    order = np.argsort(node)
    # at most 65,536 contexts of 255 decisions, whatever the corpus
    sent = spark.sparkContext.broadcast(shallow_levels(node[order].astype(np.uint64), *[top.column(c).to_numpy()[order] for c in ("zeros", "ones", "below")]))

    def answered(t: pa.Table, values: list[bytes], types: int) -> pa.Table:
        counted = pa.array([types, *[0] * (t.num_rows - 1)], pa.int64())
        return pa.table([t.column("block"), t.column("bucket"), t.column("kind"), pa.array(values, pa.binary()), counted], names=["block", "bucket", "kind", "values", "types"])

    def gram_answers(t: pa.Table) -> pa.Table:
        grams, counts = _total(t, 0)
        seen = counts > 0
        logs = predict(grams, deep_levels(grams[seen], counts[seen]) | sent.value)
        logs = np.rint(logs * STEP).astype(np.int64)
        return answered(t, [_squeeze(logs[np.searchsorted(grams, _keys_of(x.as_py()))]) for x in t.column("keys")], 0)

    def word_answers(t: pa.Table) -> pa.Table:
        words, uses = _total(t, 1)
        return answered(t, [_squeeze(uses[np.searchsorted(words, _keys_of(x.as_py()))]) for x in t.column("keys")], int((uses > 0).sum()))

    schema = "block long, bucket int, kind int, values binary, types long"
    word_rows = stage(words_of.applyInArrow(word_answers, schema), "words")
    n_types = word_rows.agg(F.sum("types")).first()[0] or 0
    answers = grams_of.applyInArrow(gram_answers, schema).unionAll(word_rows).drop("types")

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        data, offsets = _open(block)
        out = {}
        for kind, keys_of in ((0, gram_keys), (1, word_keys)):
            chunks = []  # distinct keys, the code of each position, where texts begin
            for _, _, span, own in _chunks(offsets):
                keys, at = keys_of(data[span], own)
                order, first, distinct = _grouped(keys)
                codes = np.empty(len(keys), np.int32)
                codes[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(keys)))
                chunks.append((distinct, codes, at))
            every = _grouped(np.concatenate([c[0] for c in chunks]))[2]
            order, cuts = _dealt(every, kind, buckets)
            value = np.zeros(len(every))
            for k, p, v in zip(got.column("kind").to_pylist(), got.column("bucket").to_pylist(), got.column("values"), strict=True):
                if k == kind:
                    value[order[cuts[p] : cuts[p + 1]]] = _widen(v.as_py(), np.int64)
            known = value > 0
            if kind == 0:
                value /= STEP
            else:
                value = np.log10((value + 1) / (n_train + n_types + 1))
            parts = []
            for distinct, codes, at in chunks:
                place = np.searchsorted(every, distinct)
                parts.append((np.add.reduceat(value[place][codes], at[:-1]), np.diff(at), np.add.reduceat(known[place][codes].astype(np.int64), at[:-1])))
            out[kind] = [np.concatenate(x) for x in zip(*parts, strict=True)]
        (logs, n_bytes, _), (base, n_tokens, n_known) = out[0], out[1]
        return pa.table([
            block.column("ids")[0].values, block.column("held")[0].values, pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(logs), n_train)),
            pa.array(base), pa.array(logs), pa.array(-logs / math.log10(2) / n_bytes),
        ], names=names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
