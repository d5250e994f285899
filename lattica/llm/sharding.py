"""Histogram sort: order documents by key and cut the order into shards of near-equal bytes.

The key is (64-bit hash of the text, doc_id, a row number), so equal texts stand together and a group is only cut
where one shard cannot hold it. Candidate boundaries (probes) between each splitter's known lower and upper bound
are laid out by interpolation; one pass counts the exact bytes and rows below all probes, and the bounds close in
until every splitter is within tolerance. A pass counts in Arrow batches, each partition by itself; the driver holds a
few probes for each of the shards' splitters, whatever the data's size. Then the rows move once, by range of shard and
key, so that many tasks rank one shard: a row's slot is its place in its partition plus the rows of the shard in the
partitions before, one number per partition and shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stage

#: Bytes counted for each document besides its text.
OVERHEAD = 16
#: Allowed error of a splitter, as a share of a shard.
TOLERANCE = 0.002
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int, int]


@dataclass
class _Splitter:
    """One boundary: the bounds of its key, and the bytes and rows below each bound."""

    target: float
    lo: Key
    hi: Key
    below_lo: tuple[int, int]
    below_hi: tuple[int, int]
    best: Key = (_LOW, _LOW, _LOW)
    error: float = float("inf")

    def offer(self, key: Key, size: int, rows: int) -> None:
        if abs(size - self.target) < self.error:
            self.best, self.error = key, abs(size - self.target)
        if size <= self.target and key >= self.lo:
            self.lo, self.below_lo = key, (size, rows)
        if size >= self.target and key <= self.hi:
            self.hi, self.below_hi = key, (size, rows)

    def probes(self, least: Key, most: Key, shard: float) -> list[Key]:
        """Keys between the bounds; none if only one row, or equal texts that one ``shard`` can hold, stand between them."""
        if self.below_hi[1] - self.below_lo[1] <= 1:
            return []
        at = next(i for i in range(3) if self.hi[i] != self.lo[i])
        lo, hi, head = self.lo[at], self.hi[at], self.lo[:at]
        edges = self.lo[1:] == self.hi[1:] == (_LOW, _LOW)
        if edges and hi - lo <= 1 and self.below_hi[0] - self.below_lo[0] <= shard:
            return []
        while hi - lo <= 1:  # the rows between share this component: go on to the next
            head, at = (*head, lo), at + 1
            if at == 3:
                return []
            lo, hi = max(self.lo[at], least[at]), most[at] + 1
        share = (self.target - self.below_lo[0]) / max(1, self.below_hi[0] - self.below_lo[0])
        guess, width = lo + int((hi - lo) * min(1.0, max(0.0, share))), hi - lo
        steps = [guess + s * (width >> k) for k in (3, 5, 8, 12) for s in (-1, 1)] + [guess] + [lo + width * j // 6 for j in range(1, 6)]
        return [(*head, k, *([_LOW] * (2 - at))) for k in sorted({min(max(x, lo + 1), hi - 1) for x in steps})]


def _below(probes: list[Key], h: np.ndarray, i: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the sorted ``probes`` are at or below each key."""
    first = np.array([k[0] for k in probes], np.int64)
    lo, hi = np.searchsorted(first, h, "left"), np.searchsorted(first, h, "right")
    for at in np.flatnonzero(lo != hi):  # rows whose hash is a probe's: compare whole keys
        hi[at] = bisect_right(probes, (int(h[at]), int(i[at]), int(r[at])))
    return hi


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(c).to_numpy() for c in "hir"]


def _count(keys: DataFrame, probes: list[Key]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows between neighbouring probes; partitions add up their own rows first."""

    def run(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = _below(probes, *_columns(b))
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], names=["b", "n", "k"])

    parts = keys.select("h", "i", "r", "size").mapInArrow(run, "b long, n long, k long")
    return {x["b"]: (x["n"], x["k"]) for x in parts.groupBy("b").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()}


def _place(keys: DataFrame, splitters: list[Key]) -> DataFrame:
    """Add ``part``."""

    def run(batches):
        for b in batches:
            at = _below(splitters, *_columns(b)) if splitters else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "part"])

    return keys.mapInArrow(run, T.StructType([*keys.schema, T.StructField("part", T.IntegerType())]))


def _search(keys: DataFrame, total: dict, parts: int, tolerance: float, shard: float) -> list[Key]:
    """Splitters that cut ``keys(h, i, r, size)`` into ``parts`` of near-equal bytes; a group of equal texts only if it
    has more bytes than a ``shard``."""
    low, most = (_LOW, total["i0"] - 1, -1), (_HIGH, total["i1"], total["r1"])
    ends = {"lo": low, "hi": most, "below_lo": (0, 0), "below_hi": (total["size"], total["rows"])}
    todo = [_Splitter(total["size"] * (p + 1) / parts, **ends) for p in range(parts - 1)]
    while True:
        asked = sorted({k for s in todo if s.error > tolerance for k in s.probes(low, most, shard)})
        if not asked:
            return sorted(s.best for s in todo)
        found = _count(keys, asked)  # one row per probe at most
        below = list(accumulate((found.get(at, (0, 0)) for at in range(len(asked))), lambda a, b: (a[0] + b[0], a[1] + b[1])))
        sizes = [x[0] for x in below]
        for s in todo:  # the nearest probes on either side of its target
            for at in {bisect_left(sizes, s.target), bisect_right(sizes, s.target) - 1} & {*range(len(asked))}:
                s.offer(asked[at], *below[at])


def histogram_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: slots are gapless from 0 in each shard, in key order.

    Size is the UTF-8 bytes of the text (null: none) plus 16; the crc of a null text is that of no bytes. Null ids
    and repeated rows are ordinary rows; ties of text and id go by row number. Equal texts share a shard unless they
    have more bytes than one. An empty table gives an empty result. Further columns, whatever their names, are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    keys = stage(
        docs.select(
            F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("r"),
        ).withColumn("i", F.coalesce("doc_id", F.lit(0).cast("long"))),
        "keys",
    )
    total = keys.agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.max("r").alias("r1")).first().asDict()
    shard = (total["size"] or 0) / shards
    splitters = _search(keys, total, shards, tolerance * shard, shard) if total["rows"] else []
    order = ["part", "h", "i", "r"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the high bits of the id number the partition, the low ones the row in it
    ranged = _place(keys, splitters).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = stage(ranged.select("doc_id", "size", "text_crc32", "part", "at"), "ranged")
    partition = F.shiftright("at", 33).alias("p")
    runs = ranged.groupBy("part", partition).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # partitions + shards rows
    before = F.sum("n").over(Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "p", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    out = ranged.withColumn("p", partition).join(F.broadcast(runs), ["part", "p"])
    return out.select("doc_id", "size", "text_crc32", F.col("part").alias("shard"), (F.col("at") + F.col("shift")).cast("long").alias("slot"))
