"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are quantised to integers.  The index is built in blocks of rows.  In a block, the
postings (row, dimension, value) are laid out in segments by descending impact: the number
of bits of the value's magnitude.  Queries go through the segments from the largest impact
down and add up scores for the rows of the block: posting by posting where a segment is sparse, by one product where it holds so
many postings that this is less work.  After a segment, what is left of a row can change
its score by no more than a bound from the largest values left in each dimension and from the norm of the remaining
components.  A query stops only when that bound proves that all but a few rows are
outside its top k; those few are rescored exactly from the block's rows.  A query that finds no
proof reads all segments, and its scores are exact as they are.

The queries are sent to the blocks in batches of bounded size, one after the other, so no block is moved or copied.
Of each task at most k rows for each query are returned, whatever the number of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, written
from .vectors import rows_of

#: Rows of an index block, queries that go through its segments together, and bytes of queries sent at a time.
ROWS, GROUP, BATCH = 4096, 1024, 16 << 20
#: Rows of a block that may be left to rescore when a query stops before the last segment.
RESCORE = 256
#: Squared length from which a vector is refused.
MOST = 2.0**62
#: A segment's share of all postings below which it is read posting by posting, and the share of a block's squares that may be left
#: where a proof is looked for.
SPARSE, LEFT = 1 / 32, 0.05


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``id``, ``dims`` and ``vector`` (floor of ``scale`` times each component, as 64-bit integers' bytes) of the vectors that take part.

    Vectors so long that an inner product might not fit in 64 bits are refused.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = rows_of(batch.column(1))
            keep = [k for k, v in enumerate(found) if v is not None]
            whole = [np.floor(found[k] * scale) for k in keep]
            for k, v in zip(keep, whole, strict=True):
                if not (v * v).sum() < MOST:
                    raise ValueError(f"the vector of id {batch.column(0)[k]} is too long for scores of 64 bits")
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([len(x) for x in whole], pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in whole], pa.binary())], ["id", "dims", "vector"])

        return step

    return arrow_map(source, make, T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("dims", T.IntegerType()), T.StructField("vector", T.BinaryType())]), 4096)


class ImpactIndex:
    """Impact-ordered segments of one block of integer vectors: numbers and ids of its rows."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.numbers, self.ids, self.rows = numbers, ids, rows
        size = np.abs(rows)
        impact = np.where(rows != 0, np.frexp(size.astype(np.float64))[1], 0)
        self.segments, self.left, self.rest = [], [], []
        for level in [int(x) for x in np.unique(impact)[::-1] if x]:
            row, dim = np.nonzero(impact == level)
            self.segments.append((row, dim, rows[row, dim]))
            below = np.where(impact < level, size, 0).astype(np.float64)
            #: What is left after the segment: the largest value of each dimension, and each row's norm.
            self.left.append(below.max(axis=0, initial=0))
            self.rest.append(np.sqrt((below**2).sum(axis=1)))
        self.total = (rows.astype(np.float64) ** 2).sum()

    def _add(self, scores: np.ndarray, queries: np.ndarray, segment: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The scores with a segment's postings added."""
        row, dim, value = segment
        n, dims = self.rows.shape
        if len(row) < SPARSE * n * dims:
            at, starts = np.unique(row, return_index=True)
            for k in range(0, len(queries), 32):
                scores[k : k + 32, at] += np.add.reduceat(queries[k : k + 32, dim] * value.astype(queries.dtype), starts, axis=1)
            return scores
        dense = np.zeros((n, dims), dtype=queries.dtype)
        dense[row, dim] = value
        return scores + queries @ dense.T

    def search(self, query_numbers: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, row's place and exact score of each query's best ``k`` rows here, the row it is itself left out; ties by the smaller id."""
        n, dims = self.rows.shape
        most = float(np.abs(self.rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
        kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
        whole = queries.astype(np.float64)
        size, norm = np.abs(whole), np.sqrt((whole**2).sum(axis=1))
        q = queries.astype(kind)
        scores = np.zeros((len(q), n), dtype=kind)
        own = query_numbers[:, None] == self.numbers[None, :]
        open_ = np.arange(len(q))
        out = []
        for at, segment in enumerate(self.segments):
            scores = self._add(scores, q[open_], segment)
            if at + 1 == len(self.segments) or kind is np.int64 or (self.rest[at] ** 2).sum() > LEFT * self.total:
                continue
            bound = np.minimum(size[open_] @ self.left[at], norm[open_] * self.rest[at].max(initial=0)) * (1 + 1e-6) + 1
            others = np.where(own[open_], np.array(-np.inf, dtype=kind), scores)
            edge = np.partition(others, n - k, axis=1)[:, n - k].astype(np.float64) if n > k else np.full(len(open_), -np.inf)
            possible = others >= np.nextafter((edge - 2 * bound).astype(kind), np.array(-np.inf, dtype=kind))[:, None]
            possible &= ~own[open_]
            proven = possible.sum(axis=1) <= RESCORE
            for j in np.flatnonzero(proven):
                members = np.flatnonzero(possible[j])
                out.append(self._best(open_[j], members, self.rows[members] @ queries[open_[j]], k))
            open_, scores = open_[~proven], scores[~proven]
            if not len(open_):
                break
        for j, exact in zip(open_, scores, strict=True):
            members = np.flatnonzero(~own[j])
            if len(members) > k:
                edge = np.partition(exact[members], len(members) - k)[len(members) - k]
                members = members[exact[members] >= edge]
            out.append(self._best(j, members, exact[members], k))
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))

    def _best(self, query: int, members: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[members], -exact))[:k]
        return np.full(len(order), query, dtype=np.int64), members[order], exact[order].astype(np.int64)


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of ``size`` vectors each: dims, numbers, ids, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for number, i, dims, v in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = held.setdefault(dims, ([], [], []))
                for to, x in zip(own, (number, i, v), strict=True):
                    to.append(x)
                if len(own[0]) == size:
                    yield _block(dims, *own)
                    del held[dims]
        for dims, own in held.items():
            yield _block(dims, *own)

    def _block(dims: int, numbers: list, ids: list, rows: list) -> pa.RecordBatch:
        columns = [np.array(numbers, dtype=np.int64).tobytes(), np.array(ids, dtype=np.int64).tobytes(), b"".join(rows)]
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], ["dims", "numbers", "ids", "vectors"])

    return vectors.mapInArrow(run, "dims int, numbers binary, ids binary, vectors binary")


def _least(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of rows (query, score, id, number) the best ``k`` of each query."""
    query, score, i, number = (np.concatenate([x[c] for x in found]) for c in range(4))
    order = np.lexsort((number, i, -score, query))
    query = query[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    order = order[rank < k]
    return query[rank < k], score[order], i[order], number[order]


def exact_top_k(df: DataFrame, queries: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score: for each row whose id ``queries`` marks, the ``k`` other rows with the highest scores.

    The score is the inner product of floor(``scale`` * x), an integer; ties go to the smaller id; fewer than
    ``k`` candidates are all returned.  Vectors that are null or hold null or non-finite components take no
    part, nor do rows with a null id; vectors of different lengths don't meet; vectors whose scores might not fit in 64 bits are
    refused.  Rows that repeat an id are queries and candidates of their own: only the query's own row is left out.  Ids are
    integers.  Other columns are not kept.
    """
    spark = df.sparkSession
    vectors = written(quantised(df, id_col, vector_col, scale).withColumn("number", F.monotonically_increasing_id()).select("number", "id", "dims", "vector"), "vectors")
    asked = written(vectors.where(F.coalesce(queries(F.col("id")), F.lit(False))), "asked")
    index = written(_blocks(vectors, ROWS), "index")
    facts = asked.agg(F.sum(F.length("vector") + 16).alias("size")).first()
    batches = max(1, -(-(facts["size"] or 0) // BATCH))
    out = None
    for k_batch in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("number"), F.lit(batches)) == k_batch).collect()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dims in {r["dims"] for r in rows}:
            mine = [r for r in rows if r["dims"] == dims]
            held[dims] = np.array([r["number"] for r in mine], dtype=np.int64), np.frombuffer(b"".join(r["vector"] for r in mine), dtype=np.int64).reshape(len(mine), dims)
        shared = spark.sparkContext.broadcast(held)
        found = index.mapInArrow(_search(shared, k), "query bigint, score bigint, id bigint, number bigint")
        if batches > 1:
            found = written(found, "found")
            shared.unpersist()
        out = found if out is None else out.union(found)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "number")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asked.select(F.col("number").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", F.col("id").alias(id_col), "score")


def _search(shared, k: int):
    """The best rows of a task's blocks for a batch of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for dims, numbers, ids, rows in zip(*(batch.column(i) for i in range(4)), strict=True):
                if dims.as_py() not in shared.value:
                    continue
                asks, vectors = shared.value[dims.as_py()]
                own, own_ids = (np.frombuffer(x.as_py(), dtype=np.int64) for x in (numbers, ids))
                block = ImpactIndex(own, own_ids, np.frombuffer(rows.as_py(), dtype=np.int64).reshape(len(own), dims.as_py()))
                for a in range(0, len(asks), GROUP):
                    query, row, score = block.search(asks[a : a + GROUP], vectors[a : a + GROUP], k)
                    found.append((asks[a : a + GROUP][query], score, own_ids[row], own[row]))
                found = [_least(found, k)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], ["query", "score", "id", "number"])

    return run
