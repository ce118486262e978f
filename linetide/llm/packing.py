"""Best-two-fit packing of token sequences.

Bins are filled with the largest document that still fits, again and again; then a
bin's smallest document gives way to two unpacked documents if those fill the gap it
leaves more tightly.  The choice depends only on which lengths are left, so the plan is
made over the histogram of lengths: a bin's pattern is repeated until one of its lengths
runs short.  The histogram has at most ``capacity`` entries and the plan a few patterns for each of
them, whatever the number of documents; the plan alone is broadcast.

Every piece is numbered within its length: by a counter in its own partition, plus a
prefix sum over the partitions' counts.  These grow with the input, so they meet the pieces by a shuffle at every size; a
partition has no more pieces of a length than rows, so no key is hot.  The number picks the bin and the place.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ROWS, kept_memo, tokenizer, vocabulary_file
from .frames import arrow_map, two_columns, written

CAPACITY = 2048
#: The id that ends every document.
END_ID = 0


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``(times, lengths in a bin)`` patterns that use up a histogram of lengths from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] = n
    out = []
    while left.any():
        free = left.copy()
        lengths = np.flatnonzero(free)
        content, gap = [], capacity
        while len(fits := lengths[lengths <= gap]):
            top = int(fits[-1])
            n = min(int(free[top]), gap // top)
            content += [top] * n
            gap -= n * top
            free[top] -= n
            if not free[top]:
                lengths = lengths[lengths != top]
        if gap and len(content) > 1:
            pair = _tighter(free, lengths, gap + content[-1], content[-1])
            if pair:
                content[-1:] = pair
        used = np.bincount(content, minlength=capacity + 1)
        kinds = np.flatnonzero(used)
        times = int((left[kinds] // used[kinds]).min())
        left -= times * used
        out.append((times, sorted(content, reverse=True)))
    return out


def _tighter(free: np.ndarray, lengths: np.ndarray, room: int, instead_of: int) -> list[int]:
    """The two free lengths with the largest sum within ``room``, if that is over ``instead_of``."""
    first = lengths[lengths < room]
    if not len(first):
        return []
    at = np.searchsorted(lengths, room - first, side="right") - 1
    same = (at >= 0) & (lengths[at] == first) & (free[first] < 2)
    at = np.where(same, at - 1, at)
    sums = np.where(at >= 0, first + lengths[at], 0)
    best = int(sums.argmax())
    return [int(first[best]), int(lengths[at[best]])] if sums[best] > instead_of else []


class Places:
    """Bin and offset of the i-th piece of a length, from a list of patterns."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        rows: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        ends: dict[int, int] = {}
        first = 0
        for times, content in patterns:
            offset, places = 0, {}
            for length in content:
                places.setdefault(length, []).append(offset)
                offset += length
            for length, offsets in places.items():
                at = ends.get(length, 0)
                rows.setdefault(length, []).append((at, first, len(offsets), offsets))
                ends[length] = at + times * len(offsets)
            first += times
        self.bins = first
        self.rows = {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v]), np.array([o for x in v for o in x[3]]), np.cumsum([0] + [len(x[3]) for x in v])[:-1]) for k, v in rows.items()}

    def find(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins and offsets of the pieces of one length with these numbers."""
        at, first, copies, offsets, begins = self.rows[length]
        p = np.searchsorted(at, number, side="right") - 1
        turn = number - at[p]
        return first[p] + turn // copies[p], offsets[begins[p] + turn % copies[p]]


def cut_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32, part, number (within part and length)[, ids]."""
    source = two_columns(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_file())
    end = np.array([END_ID], dtype="<u4").tobytes()

    def make():
        words = tokenizer(shared)
        memo = kept_memo("id-bytes", words, lambda keys: [struct.pack(f"<{len(ids)}I", *ids) for ids in words.encode_words(keys)])
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        step_bytes = 4 * capacity

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc, number, ids = [], [], [], [], [], [], []
            keys, codes = words.split_documents(batch.column(1).to_pylist())
            of = memo.values(keys)
            for at, own in enumerate(codes):
                whole = b"".join(map(of.__getitem__, own.tolist())) + end
                for k, begin in enumerate(range(0, len(whole), step_bytes)):
                    cut = whole[begin : begin + step_bytes]
                    n = len(cut) // 4
                    row.append(at)
                    piece.append(k)
                    start.append(begin // 4)
                    length.append(n)
                    crc.append(zlib.crc32(cut))
                    number.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(cut, dtype="<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(number, pa.int64())]
            return pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), schema.fieldNames())

        return step

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32")), T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType())])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return arrow_map(source, make, schema, ROWS)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A document is the ids of its text and then id 0, so a null or empty text is one piece of
    length 1.  Longer documents are cut every ``capacity`` tokens.  Rows with null ids and repeated
    rows are packed like any other.  Sequences are numbered from 0 and have no gaps.
    An empty table gives no rows; other columns are not kept.
    """
    pieces = written(cut_pieces(df, id_col, text_col, capacity, vocabulary, with_ids), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = df.sparkSession.sparkContext.broadcast(Places(best_two_fit(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases.hint("shuffle_hash"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number"), *(["ids"] if with_ids else []))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, number = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "number"))
            bins, offsets = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                bins[own], offsets[own] = places.value.find(int(n), number[own])
            columns = [batch.column(i) for i in range(5)] + [pa.array(bins), pa.array(offsets)] + ([batch.column(6)] if with_ids else [])
            return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        return step

    schema = T.StructType([f for f in numbered.schema.fields if f.name not in ("number", "ids")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())] + [f for f in numbered.schema.fields if f.name == "ids"])
    return arrow_map(numbered, make, schema, 10_000).withColumnRenamed("id", id_col)
