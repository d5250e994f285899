"""Token ids as raw binary shards with a minimal perfect hash index per shard.

A shard is ``shard-NNNNN.ids`` (little-endian unsigned ids, documents in ascending key order, 2 bytes each where the
vocabulary allows, else 4) and ``shard-NNNNN.idx``: the index. The index hashes each distinct key through levels of
bit arrays; a key's slot is the rank of its bit. Slots hold a fingerprint of the key and the row of its first
document, rows hold key, offset and length. All parts have fixed places, so a keyed read of a shard of any size costs a
few ranged reads of the index, of 64 bytes or less, and one of the ids.

Shards are written by executors through ``pyarrow.fs`` under the shared folder, to a temporary name and then
renamed: a task that runs again writes the same bytes, and a lost executor leaves no half shard.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from .arrow import mix, slices
from .units import UnitEncoder, load

#: Bits per key of a level; and levels before the remaining keys are kept in a sorted list.
GAMMA, LEVELS = 2, 40


@dataclass
class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own slot in [0, n). Foreign keys get any slot or -1."""

    bits: list[np.ndarray]  # of each level
    rest: np.ndarray

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys, np.int64), []
        for level in range(LEVELS):
            if not len(left):
                break
            m = max(64, GAMMA * len(left))
            at = (mix(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return PerfectHash(levels, np.sort(left))

    def __post_init__(self):
        self._rank, total = [], 0
        for b in self.bits:
            self._rank.append(total + np.cumsum(b) - b)
            total += int(b.sum())
        self._total = total

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.bits, self._rank, strict=True)):
            at = (mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self._total + at[hit]
        return out


#: The index file, all little-endian: HEAD numbers of 8 bytes (levels, leftover keys, slots, rows; then bits and place of each
#: level), the levels, the leftover keys in order, the slots, the rows. A level is blocks of 64 bytes: the set bits before the
#: block, in all levels, then BITS bits. Rows are in file order; ``at`` counts the ids before a row.
HEAD, BITS = 4 + 2 * LEVELS, 448
BLOCK = np.dtype([("rank", "<i8"), ("bits", "u1", 56)])
SLOT = np.dtype([("print", "<u4"), ("rows", "<u4"), ("row", "<i8")])
ROW = np.dtype([("key", "<i8"), ("at", "<i8"), ("length", "<i8"), ("null", "<i8")])


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(keys, np.int64), 1000) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index of one shard; rows in file order. Repeated keys share a slot that names the first row and their number;
    rows with a null key are stored but not indexed."""
    real = np.flatnonzero(~null)
    distinct, first, count = np.unique(keys[real], return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    slots = np.zeros(len(distinct), SLOT)
    slots["print"][slot], slots["row"][slot], slots["rows"][slot] = _print(distinct), real[first], count
    rows = np.zeros(len(keys), ROW)
    rows["key"], rows["length"], rows["null"], rows["at"] = keys, lengths, null, np.cumsum(lengths) - lengths
    head, levels, at, total = np.zeros(HEAD, "<i8"), [], 8 * HEAD, 0
    head[:4] = len(mph.bits), len(mph.rest), len(slots), len(rows)
    for i, bits in enumerate(mph.bits):
        padded = np.zeros(-(-len(bits) // BITS) * BITS, bool)
        padded[: len(bits)] = bits
        blocks, each = np.zeros(len(padded) // BITS, BLOCK), padded.reshape(-1, BITS)
        blocks["bits"] = np.packbits(each, axis=1, bitorder="little")
        blocks["rank"] = total + np.cumsum(each.sum(axis=1)) - each.sum(axis=1)
        head[4 + 2 * i : 6 + 2 * i] = len(bits), at
        levels.append(blocks.tobytes())
        at, total = at + blocks.nbytes, total + int(bits.sum())
    return b"".join([head.tobytes(), *levels, mph.rest.astype("<i8").tobytes(), slots.tobytes(), rows.tobytes()])


class Shard:
    """Reader of one shard. Opening it reads the head of the index. A keyed read then takes one 64-byte block of a level or
    two, on average, one slot, its rows and their ids, whatever the shard's size."""

    def __init__(self, fs, path: str, width: int):
        self.width, self.index, self.ids = width, fs.open_input_file(path + ".idx"), fs.open_input_file(path + ".ids")
        head = np.frombuffer(self.index.read_at(8 * HEAD, 0), "<i8")
        n, self.n_rest, self.n_slots, self.n_rows = head[:4].tolist()
        self.levels = head[4 : 4 + 2 * n].reshape(-1, 2).tolist()
        self.rest_at = self.levels[-1][1] + -(-self.levels[-1][0] // BITS) * BLOCK.itemsize if n else 8 * HEAD
        self.slots_at = self.rest_at + 8 * self.n_rest
        self.rows_at = self.slots_at + SLOT.itemsize * self.n_slots

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.index.close()
        self.ids.close()

    def _read(self, kind, at: int, n: int, first: int = 0) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self.index.read_at(n * kind.itemsize, at + first * kind.itemsize), kind)

    def slot(self, key: int) -> int:
        """The slot of a key, by ranged reads; -1 or any other slot for a key that is not here."""
        one = np.array([key], np.int64)
        for level, (size, at) in enumerate(self.levels):
            place = int(mix(one, level)[0]) % size
            block = self._read(BLOCK, at, 1, place // BITS)[0]
            bits, k = int.from_bytes(block["bits"].tobytes(), "little"), place % BITS
            if bits >> k & 1:
                return int(block["rank"]) + (bits & ((1 << k) - 1)).bit_count()
        lo, hi = 0, self.n_rest
        while lo < hi:
            middle = (lo + hi) // 2
            lo, hi = (middle + 1, hi) if int(self._read("<i8", self.rest_at, 1, middle)[0]) < key else (lo, middle)
        same = lo < self.n_rest and int(self._read("<i8", self.rest_at, 1, lo)[0]) == key
        return self.n_slots - self.n_rest + lo if same else -1

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key; none if the fingerprint, or the key itself, is another."""
        slot = self.slot(key)
        found = self._read(SLOT, self.slots_at, 1, slot)[0] if slot >= 0 else None
        if found is None or found["print"] != _print(np.array([key]))[0]:
            return []
        rows = self.rows(int(found["row"]), int(found["rows"]))
        return [self.payload(r) for r in rows if r["key"] == key and not r["null"]]

    def rows(self, first: int, n: int) -> np.ndarray:
        return self._read(ROW, self.rows_at, n, first)

    def payload(self, row) -> np.ndarray:
        return np.frombuffer(self.ids.read_at(int(row["length"]) * self.width, int(row["at"]) * self.width), f"<u{self.width}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of many keys at once; number 0 where the fingerprint says that the key is not
        here. Holds the levels and the slots of the shard: about 17 bytes a key."""
        keys, slot = np.asarray(keys, np.int64), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, at) in enumerate(self.levels):
            blocks = self._read(BLOCK, at, -(-size // BITS))
            for lo in range(0, len(left), 8192):
                some = left[lo : lo + 8192]
                place = (mix(keys[some], level) % np.uint64(size)).astype(np.int64)
                bits = np.unpackbits(blocks["bits"][place // BITS], axis=1, bitorder="little")
                k = place % BITS
                hit = np.flatnonzero(bits[np.arange(len(some)), k])
                before = (bits[hit] * (np.arange(BITS) < k[hit, None])).sum(axis=1, dtype=np.int64)
                slot[some[hit]] = blocks["rank"][place[hit] // BITS] + before
            left = left[slot[left] < 0]
        if self.n_rest and len(left):
            rest = self._read("<i8", self.rest_at, self.n_rest)
            at = np.minimum(np.searchsorted(rest, keys[left]), len(rest) - 1)
            hit = rest[at] == keys[left]
            slot[left[hit]] = self.n_slots - self.n_rest + at[hit]
        if not self.n_slots:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slots = self._read(SLOT, self.slots_at, self.n_slots)[slot]
        ok = (slot >= 0) & (slots["print"] == _print(keys))
        return np.where(ok, slots["row"], 0), np.where(ok, slots["rows"], 0).astype(np.int64)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(fs, path: str, chunks) -> None:
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        for c in chunks:
            f.write(c)
    fs.move(temp, path)


MANIFEST = "shard int, lo long, hi long, n_docs long, n_tokens long"


def write_store(docs: DataFrame, tokenizer: str, end_id: int | None, uri: str, key: str = "doc_id", text: str = "text", shards: int | None = None) -> list:
    """Encode and write; one manifest row per shard comes back, in shard order. Null text is empty. The range
    exchange orders by key and then by a hash of the text, so rows that share one key can go to several shards."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if load(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, F.col("key"), F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))

    def write(batches):
        fs, root = _filesystem(uri)
        fs.create_dir(root, recursive=True)
        encoder, shard = UnitEncoder(tokenizer), TaskContext.get().partitionId()
        path, keys, nulls, lengths = f"{root}/shard-{shard:05d}", [], [], []

        def chunks():
            for b in slices(batches):
                ids, at = encoder.encode(b.column("text"), end_id)
                k = b.column("key")
                keys.append(k.fill_null(0).to_numpy())
                nulls.append(k.is_null().to_numpy(zero_copy_only=False))
                lengths.append(np.diff(at))
                yield ids.astype(f"<u{width}").tobytes()

        _put(fs, path + ".ids", chunks())
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        k, null, size = cat(keys, np.int64), cat(nulls, bool), cat(lengths, np.int64)
        _put(fs, path + ".idx", [build_index(k, null, size)])
        real = k[~null]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "lo": pa.array([int(real.min()) if len(real) else None], pa.int64()), "hi": pa.array([int(real.max()) if len(real) else None], pa.int64()), "n_docs": pa.array([len(k)], pa.int64()), "n_tokens": pa.array([int(size.sum())], pa.int64())})

    return sorted(rows.mapInArrow(write, MANIFEST).collect())  # one small row per shard


def _ordinals(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many rows with the same key, null or not, come before each row."""
    order = np.lexsort((np.arange(len(keys)), keys, null))
    k, z = keys[order], null[order]
    new = np.ones(len(keys), bool)
    new[1:] = (k[1:] != k[:-1]) | (z[1:] != z[:-1])
    at = np.arange(len(keys))
    out = np.empty(len(keys), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def read_store(spark: SparkSession, uri: str, manifest: list, tokenizer: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, from the files alone: each key is looked up in the index
    and its payload read from the offset of the row found there; the k-th document of a repeated key is k rows further.
    Rows with a null key are read by position."""
    width = 2 if load(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    start, todo = 0, []
    for m in manifest:
        todo.append((m["shard"], start))
        start += m["n_tokens"]
    plan = spark.createDataFrame(todo or [(-1, 0)], "shard int, start long").where("shard >= 0").repartition(max(1, len(todo)), "shard")

    def read(batches):
        fs, root = _filesystem(uri)
        for b in batches:
            for shard, first in zip(b.column("shard").to_pylist(), b.column("start").to_pylist(), strict=True):
                with Shard(fs, f"{root}/shard-{shard:05d}", width) as s:
                    rows = s.rows(0, s.n_rows)
                    keys, null = rows["key"].astype(np.int64), rows["null"] != 0
                    row, n = s.find(keys)
                    ordinal = _ordinals(keys, null)
                    found = np.where(null, np.arange(len(keys)), row + ordinal)
                    led = null | ((ordinal < n) & (found < len(keys)))
                    if not led.all() or (keys[found] != keys).any() or (null[found] != null).any():
                        raise ValueError(f"shard {shard}: the index does not lead to every document")
                    for lo in range(0, len(keys), 20_000):
                        some = rows[found[lo : lo + 20_000]]
                        crc = [zlib.crc32(s.payload(r).astype("<u4").tobytes()) for r in some]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(keys[lo : lo + 20_000], mask=null[lo : lo + 20_000]), "start": pa.array(first + some["at"].astype(np.int64)),
                            "n_tokens": pa.array(some["length"].astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()),
                        })

    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(uri: str, manifest: list, keys: list[int], tokenizer: str) -> dict[int, list[np.ndarray]]:
    """Keyed access from any process that sees the folder: the ids of every document with each key."""
    width = 2 if load(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    fs, root = _filesystem(uri)
    out: dict[int, list[np.ndarray]] = {k: [] for k in keys}
    for m in manifest:
        mine = [k for k in out if m["lo"] is not None and m["lo"] <= k <= m["hi"]]
        if mine:
            with Shard(fs, f"{root}/shard-{m['shard']:05d}", width) as s:
                for k in mine:
                    out[k] += s.get(k)
    return out


def encode_and_store(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write a store in the shared folder and return what its files say, ``read_store``'s columns, a row per document.
    Null text is empty (the end id alone), texts of any length are encoded whole; rows that repeat an id are documents of
    their own, ties go by a hash of the text; null ids come first. An empty table gives an empty result. Further
    columns, whatever their names, are not read."""
    uri = new_path(docs.sparkSession, "tokens")
    return read_store(docs.sparkSession, uri, write_store(docs, tokenizer, end_id, uri), tokenizer)
