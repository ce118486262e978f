"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of the vectors serves as reference points, of which no two are near-duplicates themselves.  Each vector is
described by the order of its :data:`NEAREST` nearest pivots, and each :data:`TOGETHER` of the first :data:`LISTED` put it into an
inverted list.  The number of pivots grows with the cube root of the number of vectors, as the number of lists
grows with its cube: so lists of vectors that have nothing to do with each other keep their lengths at every size.

Postings hold a vector's number and the numbers of its pivots, not the vector.  Of the pairs that meet in a list those with
:data:`SHARED` shared nearest pivots are candidates; a pair that meets in several lists is one in the first only.
Then only the vectors of candidates are fetched, and each candidate is verified by its cosine in double precision.

Equal vectors are one entry with a weight.  A list yields, for each member, the number of its links and one
edge to its part of the list, not pairs.  Lists longer than :data:`BLOCK` are dealt out in
blocks: each pair of blocks is a task's work of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, join_facts, written
from .graph import components
from .sampling import sent
from .vectors import rows_of

COSINE = 0.95
NEAREST, LISTED, TOGETHER, SHARED = 16, 6, 3, 10
#: Pivots for each cube root of the number of vectors, and the fewest.  With so many a vector meets about
#: 2400 / PER_ROOT ** 3 unrelated ones in its twenty lists, of any number of vectors.
PER_ROOT, FEWEST = 5.0, 16
#: Candidates for a pivot, and the cosine to another pivot from which one is left out.
DRAWN, APART = 3, 0.9
BLOCK = 1024
#: One in so many postings tells which lists are longer than a block.
SIZED = 16
#: Members up to which lists are paired many at a time; pairs compared at a time; a list's share of pairs from which all are multiplied.
SHORT, _PAIRS, DENSE = 32, 1 << 16, 16


def pivots_for(n: int) -> int:
    """How many pivots an index of ``n`` vectors has."""
    return max(FEWEST, math.ceil(PER_ROOT * n ** (1 / 3)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither very large nor very small components overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def spread(vectors: list[np.ndarray], most: int) -> dict[int, tuple[int, np.ndarray]]:
    """Pivots by their dimensions, with the number of the first: at most ``most`` of the vectors in their order, none near another."""
    chosen: dict[int, list[np.ndarray]] = {}
    for v in vectors:
        u = unit(v[None])[0]
        own = chosen.setdefault(len(v), [])
        if sum(map(len, chosen.values())) < most and not any(u @ p > APART for p in own):
            own.append(u)
    out, first = {}, 0
    for dim, own in sorted(chosen.items()):
        out[dim] = (first, np.array(own).reshape(len(own), dim).astype(np.float32))
        first += max(len(own), NEAREST)
    return out


def describe(vectors: np.ndarray, first: int, pivots: np.ndarray) -> np.ndarray:
    """For each unit vector the numbers of its nearest pivots, nearest first; where there are fewer, numbers that no pivot has."""
    near = vectors.astype(np.float32) @ pivots.T
    n = min(NEAREST, near.shape[1])
    top = np.argpartition(-near, n - 1, axis=1)[:, :n] if n else np.zeros((len(vectors), 0), dtype=np.int64)
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, axis=1)
    return first + np.concatenate([top, np.tile(np.arange(n, NEAREST), (len(vectors), 1))], axis=1)


def _canonical(column: pa.Array, single: bool) -> list[bytes | None]:
    """Each vector's components as bytes; None for vectors that link with nothing."""
    kind = np.float32 if single else np.float64
    return [(v + 0.0).astype(kind).tobytes() if v is not None and v.any() else None for v in rows_of(column)]


def _source(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, bool]:
    """``id`` and ``vector``, and whether its components are single precision, which then hold all of it."""
    element = getattr(df.schema[vector_col].dataType, "elementType", None)
    single = isinstance(element, T.FloatType)
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), single


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return finite & F.exists(vector, lambda x: x != 0)


def _pivots(source: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Pivots drawn by the hashes of distinct vectors."""
    most = pivots_for(source.count())
    marked = source.where(_usable(F.col("vector"))).select(F.xxhash64("vector").alias("mark"), "vector")
    last = marked.select("mark").distinct().orderBy("mark").limit(DRAWN * most).agg(F.max("mark")).first()[0]
    if last is None:
        return {}
    drawn = marked.where(F.col("mark") <= last).groupBy("mark").agg(F.first("vector").alias("vector")).orderBy("mark").collect()
    return spread([np.array(r["vector"]) for r in drawn], most)


#: Nearest pivots of a vector, 16 bits each, as four numbers.
_NEAR = ("near1", "near2", "near3", "near4")
#: What tells lists and their pairs of blocks apart.
_LIST = ["list", "left", "right"]


def _described(source: DataFrame, single: bool, pivots: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """``id``, a hash of the vector in two numbers (null for vectors that link with nothing) and its nearest pivots."""
    shared = source.sparkSession.sparkContext.broadcast(pivots)

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = _canonical(batch.column(1), single)
            keys = np.zeros((len(raw), 2), dtype=np.int64)
            near = np.zeros((len(raw), NEAREST), dtype="<u2")
            by_dim: dict[int, list[int]] = {}
            for k, b in enumerate(raw):
                if b is not None:
                    keys[k] = np.frombuffer(xxhash.xxh3_128_digest(b), dtype="<i8")
                    by_dim.setdefault(len(b) // (4 if single else 8), []).append(k)
            for dim, own in by_dim.items():
                vectors = np.frombuffer(b"".join(raw[k] for k in own), dtype=np.float32 if single else np.float64).reshape(-1, dim)
                near[own] = describe(unit(vectors.astype(np.float64)), *known.get(dim, (0, np.zeros((0, dim), dtype=np.float32))))
            bad = np.array([b is None for b in raw], dtype=bool)
            quarters = near.view("<i8")
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, mask=bad) for x in (*keys.T, *quarters.T))], names)

        return step

    names = ["id", "key1", "key2", *_NEAR]
    return arrow_map(source, make, T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(x, T.LongType()) for x in names[1:])]), 4096)


def _postings(classes: DataFrame) -> DataFrame:
    """A row for each list a class stands in: list, node and its nearest pivots."""
    places = [F.shiftrightunsigned(F.col(_NEAR[k // 4]), 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)) for k in range(LISTED)]
    lists = F.transform(
        F.array(*(F.array(*map(F.lit, c)) for c in combinations(range(LISTED), TOGETHER))),
        lambda c: F.shiftleft(F.get("first", c[0]), 32).bitwiseOR(F.shiftleft(F.get("first", c[1]), 16)).bitwiseOR(F.get("first", c[2])),
    )
    return classes.withColumn("first", F.sort_array(F.array(*places))).select(F.explode(lists).alias("list"), "node", *_NEAR)


def _shared(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many of the numbers in each row of ``one`` are in the same row of ``other``, of eight or sixteen; numbers are distinct within a row."""
    out = np.zeros(len(one), dtype=np.int8)
    for p in range(one.shape[1]):
        equal = (one[:, p, None] == other).view(np.uint64)
        out += (equal[:, 0] | equal[:, -1]) != 0
    return out


class Members:
    """Whole lists' members that lie together: the columns of a chunk of rows."""

    def __init__(self, rows: pa.Table):
        column = {x: rows[x].to_numpy() for x in (*_LIST, "block", *_NEAR)}
        self.rows = rows
        self.whole, self.block = column["left"] == column["right"], column["block"]
        self.near = np.ascontiguousarray(np.stack([column[x] for x in _NEAR], axis=1)).view("<u2")
        keys = np.stack([column[x] for x in _LIST])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        self.starts, self.ends = np.append(0, change), np.append(change, len(rows))
        #: Pivots of the listed ones that come before the last of the list's own; a pair that shares others of these met before.
        last = (column["list"] & 0xFFFF)[:, None].astype(np.uint16)
        listed = self.near[:, :LISTED]
        self.early = np.full((2, len(rows), 8), 65535, dtype=np.uint16)
        self.early[1] = 65534
        self.early[:, :, :LISTED] = np.where(listed < last, listed, self.early[:, :, :LISTED])

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one list with enough shared nearest pivots, for which this list is the first they meet in."""
        sizes = self.ends - self.starts
        short = np.repeat(sizes <= SHORT, sizes)
        counts = np.where(short, np.repeat(self.ends, sizes) - np.arange(len(self.near)) - 1, 0)
        until = np.cumsum(counts)
        found = [self._long(a, b) for a, b in zip(self.starts[sizes > SHORT].tolist(), self.ends[sizes > SHORT].tolist(), strict=True)]
        begin = 0
        while begin < len(counts):
            done = until[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(until, done + _PAIRS, side="right")))
            c = counts[begin:end]
            x = np.repeat(np.arange(begin, end), c)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
            begin = end
            keep = (self.whole[x] | (self.block[x] != self.block[y])) & (_shared(self.early[0][x], self.early[1][y]) == TOGETHER - 1)
            x, y = x[keep], y[keep]
            keep = _shared(self.near[x], self.near[y]) >= SHARED
            found.append((x[keep], y[keep]))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(2))

    def _long(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of one long list: pivots in common are counted by products of the rows' marks."""
        names, at = np.unique(self.near[a:b], return_inverse=True)
        at = at.reshape(b - a, NEAREST)
        has = np.zeros((b - a, len(names)), dtype=np.float32)
        has[np.arange(b - a)[:, None], at] = 1
        early = np.zeros_like(has)
        row, place = np.nonzero(self.early[0][a:b, :LISTED] < 65535)
        early[row, at[row, place]] = 1
        pairs = (has @ has.T >= SHARED) & (early @ early.T == TOGETHER - 1)
        if not self.whole[a]:
            pairs &= self.block[a:b, None] != self.block[None, a:b]
        x, y = np.nonzero(np.triu(pairs, 1))
        return x + a, y + a


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[Members]:
    """Rows of whole lists, many lists together."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= most:
            rows = Members(pa.Table.from_batches(held).combine_chunks())
            last = int(rows.starts[-1])
            if last:
                yield Members(rows.rows.slice(0, last))
                held = rows.rows.slice(last).to_batches()
                size = sum(b.num_rows for b in held)
    if held:
        yield Members(pa.Table.from_batches(held).combine_chunks())


def _met(posts: DataFrame) -> DataFrame:
    """Members of lists that have a candidate there: list, left, right (its blocks), block, node and nearest pivots."""
    some = posts.where(F.pmod(F.xxhash64("node"), F.lit(SIZED)) == 0).groupBy("list").agg((F.count("*") * SIZED).alias("n")).where(F.col("n") > BLOCK // 2)
    rows = posts.join(sent(some, "sizes", 10_000), "list", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", *_NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _chunks(batches):
            x, y = members.candidates()
            if len(x):
                yield from members.rows.take(pa.array(np.unique(np.concatenate([x, y])))).combine_chunks().to_batches()

    return rows.repartition(*_LIST).sortWithinPartitions(*_LIST).mapInArrow(run, rows.schema)


def _vectors(source: DataFrame, single: bool, wanted: DataFrame) -> DataFrame:
    """``node`` and ``vector`` (its bytes) of the wanted classes: node, least, key1, key2."""
    rows = source.join(wanted, source["id"].eqNullSafe(wanted["least"])).select("vector", "node", "key1", "key2")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = _canonical(batch.column(0), single)
            keys = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            own = [k for k, (b, x) in enumerate(zip(raw, keys, strict=True)) if b is not None and tuple(np.frombuffer(xxhash.xxh3_128_digest(b), dtype="<i8").tolist()) == x]
            return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(own, pa.int64())), pa.array([raw[k] for k in own], pa.binary())], ["node", "vector"])

        return step

    return arrow_map(rows, make, "node bigint, vector binary", 4096).dropDuplicates(["node"])


def _cosines(members: Members, x: np.ndarray, y: np.ndarray, kind: type) -> np.ndarray:
    """Cosines of pairs of rows; where a list's pairs are so many that most of its vectors' products are asked for, all of them are taken at once."""
    raw = members.rows["vector"].to_pylist()
    out = np.zeros(len(x))
    order = np.argsort(x, kind="stable")
    cuts = np.searchsorted(x[order], np.append(members.starts, len(raw)))
    for a, b, i, j in zip(members.starts.tolist(), members.ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if i == j:
            continue
        own = unit(np.frombuffer(b"".join(raw[a:b]), dtype=kind).reshape(b - a, -1).astype(np.float64))
        at = order[i:j]
        if (j - i) * DENSE >= (b - a) ** 2:
            out[at] = (own @ own.T)[x[at] - a, y[at] - a]
        else:
            for k in range(0, len(at), _PAIRS // 4):
                some = at[k : k + _PAIRS // 4]
                out[some] = np.einsum("ij,ij->i", own[x[some] - a], own[y[some] - a])
    return out


def _links(members: DataFrame, single: bool, least: float) -> DataFrame:
    """``a, b, links`` of every list: linked members, an edge of each to its part's least member, and the weight of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _chunks(batches, 4096):
            node, weight = members.rows["node"].to_numpy(), members.rows["weight"].to_numpy()
            x, y = members.candidates()
            linked = _cosines(members, x, y, np.float32 if single else np.float64) >= least
            x, y = x[linked], y[linked]
            if not len(x):
                continue
            weights = np.zeros(len(node), dtype=np.int64)
            np.add.at(weights, x, weight[y])
            np.add.at(weights, y, weight[x])
            label = node.copy()
            while True:
                new = label.copy()
                np.minimum.at(new, x, label[y])
                np.minimum.at(new, y, label[x])
                if (new == label).all():
                    break
                label = new
            some = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (node, label, weights)], ["a", "b", "links"])

    return members.repartition(*_LIST).sortWithinPartitions(*_LIST).mapInArrow(run, "a bigint, b bigint, links bigint")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE) -> DataFrame:
    """One row per vector: ``id_col``, n_links (other vectors linked directly), component_id (least id reachable), kept.

    Vectors link at a cosine of ``least`` or more.  Equal vectors always link.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths never link.  Rows with a null id take part and never name a component; kept is then
    false unless the row is alone.  Repeated rows are vectors of their own.  Other columns are not kept.
    """
    source, single = _source(df, id_col, vector_col)
    rows = written(_described(source, single, _pivots(source)), "described")
    keys = ["key1", "key2"]
    good = rows.where("key1 is not null")
    grouped = good.groupBy(*keys).agg(F.min("id").alias("least"), F.count("*").alias("weight"), *(F.max(x).alias(x) for x in _NEAR))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    met = written(_met(_postings(classes)), "met")
    wanted = classes.join(met.select("node").distinct(), "node").select("node", "least", *keys)
    vectors = _vectors(source, single, wanted)
    members = met.join(vectors, "node").join(classes.select("node", "weight"), "node").select(*_LIST, "block", "node", *_NEAR, "weight", "vector")
    links = written(_links(members, single, least), "links")
    roots = components(links.select("a", "b"))
    named = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), "weight", *keys)
    least_of = named.groupBy("root").agg(F.min("least").alias("component_id"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    facts = named.join(least_of, "root").join(counts, "node", "left").select(*keys, "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "weight")
    linked = join_facts(good.select("id", *keys), written(facts, "facts"), keys, "weight").select("id", "n_links", "component_id")
    alone = rows.where("key1 is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("n_links") == 0).alias("kept"))
