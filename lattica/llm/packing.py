"""Best-fit packing of documents into fixed-length sequences, in bulk-synchronous rounds over documents and gaps.

A piece longer than half a sequence opens one of its own. The other documents and the gaps are range-sorted together by
size, longest first, into ranges of about ``RANGE`` rows, and every round matches them:

1. Each range is swept by a task of its own: a document takes its successor gap, the smallest that holds it, and what
   remains of that gap joins the sweep again where its size comes up.
2. What a range leaves over, documents without a gap and gaps without a document, is matched across ranges. Any gap that
   is left over holds any document left over in a later range; conflicts go by rank: from the counts of each range the
   driver lays out which ranks of one range meet which ranks of another, and a join on range and rank pairs the rows.
3. Gaps shrink, and the next round sorts what remains. Documents for which gaps are too few open sequences in the sweep of
   their range, the class of the longest first, so that the shorter ones find the gaps of these. A range fills what it
   opens before it opens more, so it leaves one sequence half empty at most.

Once all that remains fits one range, its sweep is exact best-fit decreasing and the last round. The driver sees
sizes and ranges only, never documents or gaps.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import stage
from .arrow import release, slices
from .units import UnitEncoder

#: Rows of a range; ids for which gaps must have room for one, or else documents open sequences; and classes: documents of
#: which two, three, ... fill a sequence, those of which SMALL or more do being one.
RANGE, SUPPLY, SMALL = 1 << 16, 8, 8
#: Bytes of text that a worker encodes at once, and distinct units that it remembers; results do not depend on them.
SLICE, REMEMBER = 1 << 20, 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches, tokenizer: str, capacity: int, end_id: int):
    release()  # what an earlier stage left in this worker
    encoder = UnitEncoder(tokenizer, REMEMBER)
    for b in slices(batches, budget=SLICE):
        ids, at = encoder.encode(b.column("text"), end_id)
        raw, size = memoryview(ids.astype("<u4").tobytes()), np.diff(at)
        count = -(-size // capacity)
        doc = np.repeat(np.arange(len(size)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        short = size - (count - 1) * capacity  # the first piece
        start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
        length = np.where(piece == 0, short[doc], capacity)
        lo = 4 * (at[doc] + start)
        crc = [zlib.crc32(raw[i : i + n]) for i, n in zip(lo.tolist(), (4 * length).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    del encoder
    release()


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, close each with ``end_id`` and cut only those longer than ``capacity``, so that all pieces
    but the first are full."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    return rows.mapInArrow(lambda batches: _pieces(batches, tokenizer, capacity, end_id), PIECES)


def _open_from(docs: dict[int, int], gaps: dict[int, int]) -> float:
    """The least length of which documents may open sequences: all gaps from there on have room for less than one in
    ``SUPPLY`` of the ids."""
    least, wanted, room = float("inf"), 0, sum(size * n for size, n in gaps.items() if size > max(docs))
    for size in range(max(docs), 0, -1):
        wanted, room = wanted + size * docs.get(size, 0), room + size * gaps.get(size, 0)
        if SUPPLY * room > wanted:
            break
        least = size
    return least


def _match_ranks(left: list) -> list[tuple[int, int, int, int, int, int]]:
    """Which documents that ranges leave over meet which gaps: ``(range, first rank, end rank, range of gaps, its gaps still
    free, documents a gap)``. The gaps nearest in size go first, from the smallest of their range; two rows a range at most."""
    ranges: dict[int, dict] = defaultdict(dict)
    for r in left:
        ranges[r["part"]][r["kind"]] = r
    plan, free = [], []
    for part in sorted(ranges):
        docs, gaps, at = ranges[part].get("doc"), ranges[part].get("gap"), 0
        while docs and at < docs["n"] and free:
            there, n, smallest = free.pop()
            each = max(1, smallest // docs["most"])
            end = min(docs["n"], at + n * each)
            plan.append((part, at, end, there, n, each))
            n -= -(-(end - at) // each)
            at = end
            if n:
                free.append((there, n, smallest))
        if gaps:
            free.append((part, gaps["n"], gaps["least"]))
    return plan


def _sweep(capacity: int, may_open, last: bool, schema: T.StructType):
    """Sweep a range, sorted longest first with gaps before documents of their size. Sequences carry the id of the document
    that opened them. Every gap in ``free`` holds the document at hand, so its successor gap is the last of them."""

    def run(batches):
        part = TaskContext.get().partitionId()
        free: list[tuple[int, int]] = []  # (-gap, sequence), the smallest gap at the end
        later: list[tuple[int, int]] = []  # a heap of gaps smaller than the document at hand
        left = 0
        for b in batches:
            at, kind, seq, off, idx = [], [], [], [], []
            for i, (size, doc, uid) in enumerate(zip(*[b.column(c).to_pylist() for c in ("size", "doc", "id")], strict=True)):
                while later and -later[0][0] >= size:
                    insort(free, heappop(later))
                if not doc:
                    insort(free, (-size, uid))
                    continue
                at.append(i)
                if not free and not may_open(size):
                    kind.append("doc"), seq.append(uid), off.append(0), idx.append(left)
                    left += 1
                    continue
                gap, sequence = free.pop() if free else (-capacity, uid)
                kind.append("placed"), seq.append(sequence), off.append(capacity + gap), idx.append(0)
                gap += size
                if -gap >= size:
                    insort(free, (gap, sequence))
                elif gap:
                    heappush(later, (gap, sequence))
            rows = b.select(["row", "size"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(kind, pa.string()), *[pa.array(x, pa.int64()) for x in (seq, off, idx)], pa.array([part] * len(at), pa.int32())], names=schema.names)
        gaps = [] if last else [("gap", -g, q, i) for i, (g, q) in enumerate(free)] + [("rest", -g, q, 0) for g, q in later]
        if gaps:
            kind, size, seq, idx = zip(*gaps, strict=True)
            zero = np.zeros(len(gaps), np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(gaps), to_arrow_type(schema["row"].dataType)), pa.array(size, pa.int64()), pa.array(kind, pa.string()), pa.array(seq, pa.int64()), pa.array(zero), pa.array(idx, pa.int64()), pa.array(zero.astype(np.int32) + part)], names=schema.names)

    return run


def pack(pieces: DataFrame, capacity: int, range_rows: int = RANGE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (which has a ``length`` in 1..capacity)."""
    spark = pieces.sparkSession
    columns = pieces.columns
    held = stage(pieces.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("length").cast("long").alias("size"), F.monotonically_increasing_id().alias("id")), "pieces")
    row = held.schema["row"].dataType
    no_row = F.lit(None).cast(row).alias("row")
    schema = T.StructType.fromDDL("size long, kind string, seq long, off long, idx long, part int")
    schema = T.StructType([T.StructField("row", row), *schema])
    alone = F.col("size") * 2 > capacity
    done = [held.where(alone).select("row", F.col("id").alias("seq"), F.lit(0).cast("long").alias("off"))]
    state = held.where(~alone).select("row", "size", "id", F.lit(True).alias("doc"))
    state = state.unionAll(held.where(alone & (F.col("size") < capacity)).select(no_row, capacity - F.col("size"), "id", F.lit(False)))
    order = [F.col("size").desc(), "doc", "id"]
    while True:
        count = state.groupBy("doc", "size").count().collect()  # two rows for each size below the capacity
        docs, gaps = ({r["size"]: r["count"] for r in count if r["doc"] == x} for x in (True, False))
        if not docs:
            break
        live = state.where(F.col("doc") | (F.col("size") >= min(docs)))
        ranges = -(-(sum(docs.values()) + sum(n for size, n in gaps.items() if size >= min(docs))) // range_rows)
        last, least, longest = ranges == 1, _open_from(docs, gaps), min(capacity // max(docs), SMALL)
        may_open = (lambda size: True) if last else lambda size, least=least, longest=longest: size >= least and min(capacity // size, SMALL) == longest
        live = live.repartition(1) if last else live.repartitionByRange(ranges, *order)
        swept = stage(live.sortWithinPartitions(*order).mapInArrow(_sweep(capacity, may_open, last, schema), schema), "swept")
        done.append(swept.where("kind = 'placed'").select("row", "seq", "off"))
        if last:
            break
        left = swept.where("kind in ('doc', 'gap')")
        plan = _match_ranks(left.groupBy("part", "kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect())
        plan = F.broadcast(spark.createDataFrame(plan, "at int, lo long, hi long, there int, free long, each long"))  # two rows a range at most
        met = left.where("kind = 'doc'").join(plan, F.expr("part = at and idx >= lo and idx < hi"), "left").withColumn("rank", F.expr("free - 1 - (idx - lo) div each"))
        free = left.where("kind = 'gap'").select(F.col("part").alias("there"), F.col("idx").alias("rank"), F.col("size").alias("gap"), F.col("seq").alias("sequence"))
        before = F.sum("size").over(Window.partitionBy("there", "rank").orderBy("idx"))  # documents of one gap
        paired = met.where("at is not null").join(free, ["there", "rank"]).select("row", "size", "gap", F.col("sequence").alias("seq"), (capacity - F.col("gap") + before - F.col("size")).alias("off"))
        paired = stage(paired, "paired")
        done.append(paired.select("row", "seq", "off"))
        unmet = met.where("at is null").select("row", "size", F.col("seq").alias("id"), F.lit(True).alias("doc"))
        shrunk = paired.groupBy("seq").agg((F.first("gap") - F.sum("size")).alias("size")).where("size > 0")
        open_ = swept.where("kind in ('gap', 'rest')").select("size", "seq").join(paired.select("seq"), "seq", "left_anti").select("size", "seq")
        # a gap too small for every document is never looked at again
        open_ = open_.unionAll(shrunk.select("size", "seq")).where(F.col("size") >= min(docs))
        state = stage(unmet.unionAll(open_.select(no_row, "size", F.col("seq").alias("id"), F.lit(False).alias("doc"))), "state")
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.select(*[F.col("row")[c].alias(c) for c in columns], F.col("seq").alias("sequence_id"), F.col("off").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``PIECES`` plus ``sequence_id`` and ``offset``; offsets in a sequence are gapless from 0.
    Null text is empty (the end id alone); repeated and null keys are packed like any other row. Texts of any length are
    encoded whole; pieces of equal length are interchangeable, and ties go by row number. An empty table gives an empty
    result. Further columns, whatever their names, are not read."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    return pack(token_pieces(docs, tokenizer, capacity, end_id, key, text), capacity)
