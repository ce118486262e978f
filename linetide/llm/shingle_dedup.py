"""Near-duplicates by the Jaccard similarity of five-word shingles: SimHash, byte-position inverted index, count filter, verification.

Two texts of similarity 0.8 differ in 15 % of the bits of their SimHash.  In 64 bits they need not share a byte, so the
fingerprint of the set of shingles has :data:`WORDS` times 64 bits, which are 144 positional bytes.  A posting is keyed by
two positional bytes at once, in the three pairs of each group of three positions.  A pair of similarity 0.8 that differs in 15 % of
the bits shares no list with probability 0.0001.  Of each list only members are kept that are near another one by :data:`SKETCH_BITS` of
the bits.  Pairs are retained if they share :data:`SHARED` positional bytes, then if they differ in at most :data:`BITS` bits, and every
pair left is verified on the words themselves, so no other pair links.

Members of a list are not paired with each other at first: each takes the one near it that is nearest to the others of the list, of all
its lists the best, and is compared with that leader, the leader's and so on.  What that links needs no further comparison.  Then the
members go that cannot be similar to another one by the number of their shingles that no other member has, which takes a count and
no pairs.  What is left is few, so it meets in lists of a single positional byte, of which :data:`AGAIN` do; there all pairs
of different components are compared, each in the first list it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, join_facts, written
from .graph import components
from .simhash import SEED, one_of_each, text_node

SHINGLE, SIMILARITY = 5, 0.8
#: Numbers of 64 bits of a fingerprint, its positional bytes, and lists of a fingerprint: the pairs of each group of three positions.
WORDS, BYTES, LISTS = 18, 144, 144
#: How often the way to leaders is doubled: a member is compared with the first, second, fourth ... on it.
HUBS = 2
#: Rounds at most in which members without enough common shingles go, and members left for each that went up to which another round is worth it.
PEELS, MANY = 3, 1
#: Lists of a single positional byte in which the members left meet; a pair of similarity 0.8 shares none with probability 0.00001.
AGAIN = 36
#: Positional bytes that a retained pair shares at least, and bits in which it differs at most; sums of few shingles are coarse, so these are not asked below SMALL shingles.
SHARED, BITS, SMALL = 18, 222, 16
#: Bits that travel with a posting, in which two of a list differ at most that are near.
SKETCH_BITS, SKETCH_APART = 167, 52
#: Bits of the sketch that are packed with the key of a posting, and bits of 64 in which two differ at most before all their bits are compared.
PACKED_BITS, FIRST_APART = 39, 31
#: Members from which all of a list count as near another one, and members of a block of a longer list when it is paired.
LONG, BLOCK = 1024, 512
#: Nodes up to which those that are near another one are sent to all tasks, to find their texts without a shuffle of all texts.
SENT = 400_000
#: Shingles whose bits are counted at a time.
MOST = 1 << 19
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, WORDS), dtype=np.uint64)
_ODD, _PLUS = _DRAWS[0] | np.uint64(1), _DRAWS[1]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.uint64(0x0101010101010101)


def shingles(text: bytes, shingle: int = SHINGLE) -> list[bytes]:
    """Word shingles of UTF-8 text: A-Z in lower case, words between ASCII white space; of fewer words a single one, of none none."""
    words = text.lower().split()
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))


def similar(one: set[bytes], other: set[bytes], least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets of shingles is ``least`` or more; that of two empty ones is 1."""
    if min(len(one), len(other)) < least * max(len(one), len(other)) - 1e-9:
        return False
    both = len(one & other)
    return both >= least * (len(one) + len(other) - both) - 1e-9


def fingerprints(sets: list[list[bytes]]) -> np.ndarray:
    """The SimHash of each set of shingles: a row of :data:`BYTES` bytes, zeros for an empty one."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if len(sets) > 1 and sizes.sum() > MOST:
        return np.concatenate([fingerprints(sets[: len(sets) // 2]), fingerprints(sets[len(sets) // 2 :])])
    out = np.zeros((len(sets), WORDS, 8), dtype=np.uint8)
    some = np.flatnonzero(sizes)
    if not some.size:
        return out.reshape(-1, BYTES)
    hashes = np.fromiter((h for x in sets for h in map(xxhash.xxh64_intdigest, x, repeat(SEED))), dtype=np.uint64, count=int(sizes.sum()))
    ends, chunks = np.cumsum(sizes)[some], -(-sizes[some] // 255)
    own = np.cumsum(chunks) - chunks
    starts = np.repeat(ends - sizes[some], chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(own, chunks))
    counts = np.empty((len(starts), 8, 8), dtype=np.int64)
    for word in range(WORDS):
        mixed = hashes * _ODD[word] + _PLUS[word]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        for bit in range(8):
            counts[:, :, bit] = np.add.reduceat((mixed >> np.uint64(bit)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        most = 2 * np.add.reduceat(counts, own, axis=0) > sizes[some][:, None, None]
        out[some, word] = np.packbits(most, axis=2, bitorder="little")[:, :, 0]
    return out.reshape(-1, BYTES)


def _prints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id``, ``node`` (a hash of the text), ``fp`` (its fingerprint) and ``size`` (its number of shingles) of every row."""
    source = _texts(df, id_col, text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [list(set(shingles(t, shingle))) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            found = [x.tobytes() for x in fingerprints(sets)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(list(map(len, sets)), pa.int32())], ["id", "node", "fp", "size"])

        return step

    return arrow_map(source, make, T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("size", T.IntegerType())]))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), text_node(text_col).alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BYTES)


def _postings(distinct: DataFrame) -> DataFrame:
    """Of each node its postings: ``packed`` (list, its two bytes, the first bits of the sketch), ``sketch`` and ``more`` (the rest) and ``node``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _bytes(batch.column(1))
            one, two, three = np.moveaxis(found.reshape(-1, BYTES // 3, 3).astype(np.int64), 2, 0)
            keys = (np.arange(LISTS) << 16) + np.stack([one << 8 | two, one << 8 | three, two << 8 | three], axis=2).reshape(-1, LISTS)
            words = found[:, :24].copy().view("<i8")
            packed = keys << PACKED_BITS | words[:, :1] & (1 << PACKED_BITS) - 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (packed.ravel(), np.repeat(words[:, 1], LISTS), np.repeat(words[:, 2], LISTS), np.repeat(batch.column(0).to_numpy(), LISTS))], ["packed", "sketch", "more", "node"])

        return step

    return arrow_map(distinct.select("node", "fp"), make, "packed bigint, sketch bigint, more bigint, node bigint")


def _met(runs: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows in each stretch of equal values of at most ``longest`` rows, some at a time."""
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    lengths = np.diff(np.r_[starts, len(runs)])
    left_over = np.repeat(starts + lengths, lengths) - np.arange(len(runs)) - 1
    rows = np.flatnonzero(np.repeat(lengths <= longest, lengths))
    for step in range(1, longest):
        rows = rows[left_over[rows] >= step]
        if not rows.size:
            return
        yield rows, rows + step


def _whole_runs(batches: Iterator[pa.RecordBatch], runs_of) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches dealt anew, so that none ends within a stretch of equal values of ``runs_of(batch)``."""
    held = None
    for batch in batches:
        held = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
        if not held.num_rows:
            continue
        runs = runs_of(held)
        last = int(np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])[-1])
        if last:
            yield held.slice(0, last), runs[:last]
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held, runs_of(held)


def _central(sketches: np.ndarray) -> int:
    """The row of those sketches that is nearest to what most of them have, bit by bit."""
    most = np.zeros(sketches.shape[1], dtype=np.uint64)
    for bit in range(64):
        most |= (2 * ((sketches >> np.uint64(bit)) & np.uint64(1)).sum(axis=0, dtype=np.int64) > len(sketches)).astype(np.uint64) << np.uint64(bit)
    return int(np.bitwise_count(sketches ^ most).sum(axis=1, dtype=np.int64).argmin())


def _near(posts: DataFrame) -> DataFrame:
    """``node``, ``hub`` and ``degree`` of each posting that is near another one of its list.

    The hub is the one of those near it, or itself, with the highest ``degree``: the bits by which others are nearer than they need to be.
    All of a list of over :data:`LONG` count as near the one in its middle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, key in _whole_runs(batches, lambda b: b.column(0).to_numpy() >> PACKED_BITS):
            sketches = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lengths = np.diff(np.r_[starts, len(key)])
            degree, lead, met = np.zeros(len(key), dtype=np.int64), np.arange(len(key)), []
            for a, b in _met(key, LONG):
                closer = SKETCH_APART + 1 - np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)
                ok = closer > 0
                a, b = a[ok], b[ok]
                degree[a] += closer[ok]
                degree[b] += closer[ok]
                met.append((a, b))
            node = batch.column(3).to_numpy()
            for a, b in met:
                for x, y in ((a, b), (b, a)):
                    now = lead[x]
                    better = (degree[y] > degree[now]) | ((degree[y] == degree[now]) & (node[y] < node[now]))
                    lead[x[better]] = y[better]
            for start, length in zip(starts[lengths > LONG].tolist(), lengths[lengths > LONG].tolist(), strict=True):
                lead[start : start + length] = start + _central(sketches[start : start + length])
                degree[start : start + length] = length * SKETCH_APART
            near = degree > 0
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[near], node[lead[near]], degree[lead[near]].astype(np.int32))], ["node", "hub", "degree"])

    return posts.repartition(F.expr(f"packed >> {PACKED_BITS}")).sortWithinPartitions("packed").mapInArrow(run, "node bigint, hub bigint, degree int")


def _leaders(near: DataFrame) -> DataFrame:
    """``node`` and ``hub``: of all a node's lists the hub of the highest degree."""
    return near.groupBy("node").agg(F.max_by("hub", F.struct("degree", "hub")).alias("hub"))


def _retained(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of fingerprints pass the count filter and the test of differing bits, and the positional bytes that they share."""
    same = one == other
    apart = np.bitwise_count(one.view(np.uint64) ^ other.view(np.uint64)).sum(axis=1, dtype=np.int64)
    least, most = np.minimum(sizes, others), np.maximum(sizes, others)
    return (least >= similarity * most - 1e-9) & ((least < SMALL) | ((same.sum(axis=1) >= SHARED) & (apart <= BITS))), same


def _counted(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` that :func:`_retained` holds."""
    ends = [facts.select(F.col("node").alias(x), F.col("fp").alias(f"{x}_fp"), F.col("size").alias(f"{x}_size")) for x in "ab"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok, _ = _retained(_bytes(batch.column(2)), _bytes(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), similarity)
            return batch.select(["a", "b"]).filter(pa.array(ok))

        return step

    return arrow_map(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "a_fp", "b_fp", "a_size", "b_size"), make, "a bigint, b bigint", 4096)


def _again(members: DataFrame) -> DataFrame:
    """Of each member its postings by a single positional byte: ``key``, and all that :func:`_paired` asks for."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _bytes(batch.column(4))[:, :: BYTES // AGAIN]
            keys = ((np.arange(AGAIN) << 8) + found).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *batch.take(pa.array(np.repeat(np.arange(batch.num_rows), AGAIN))).columns], ["key", *batch.schema.names])

        return step

    return arrow_map(members.select("node", "root", "size", "most", "fp"), make, "key int, node bigint, root bigint, size int, most double, fp binary")


def _paired(members: DataFrame, similarity: float) -> DataFrame:
    """The pairs of members of different roots that share a positional byte of :data:`AGAIN` and are retained, each from the first list it shares.

    ``members`` tells of each node ``root``, ``fp``, ``size`` and ``most``, the size up to which another one can be similar to it.  A long list is dealt out in pairs of blocks;
    there are at most 256 lists for each byte, so their numbers of blocks are sent to all tasks.
    """
    posts = _again(members)
    blocks = posts.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("key", "blocks")
    own = posts.join(F.broadcast(blocks), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("place"), "own", "node", "root", "size", "most", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(batch: pa.RecordBatch) -> np.ndarray:
            key, i, j = (x.to_numpy().astype(np.int64) for x in batch.column(0).flatten())
            return np.cumsum(np.r_[0, (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])

        for batch, runs in _whole_runs(batches, places):
            key, i, j = (x.to_numpy() for x in batch.column(0).flatten())
            block, node, root, size, most = (batch.column(k).to_numpy() for k in range(1, 6))
            found, pairs = _bytes(batch.column(6)), []
            first = found[:, :8].copy().view(np.uint64).ravel()
            for a, b in _met(runs, len(runs)):
                ok = (root[a] != root[b]) & ((i[a] == j[a]) | (block[a] != block[b])) & (size[a] <= most[b]) & (size[b] <= most[a])
                a, b = a[ok], b[ok]
                ok = np.bitwise_count(first[a] ^ first[b]) <= FIRST_APART
                for at in range(0, int(ok.sum()), 1 << 14):
                    x, y = (z[ok][at : at + (1 << 14)] for z in (a, b))
                    good, same = _retained(found[x], found[y], size[x], size[y], similarity)
                    x, y = x[good], y[good]
                    here = same[good][:, :: BYTES // AGAIN].argmax(axis=1) == key[x] >> 8
                    pairs.append(np.stack([node[x[here]], node[y[here]]]))
            if pairs:
                a, b = np.concatenate(pairs, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(run, "a bigint, b bigint")


def _reach(members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``members`` (node, root, fp, size) that another one can be similar to, with ``most``: the size up to which it can, given the shingles that no other has."""
    source = texts.join(members.select("node"), "node", "left_semi")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [set(shingles(t, shingle)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            hashes = np.fromiter((h for x in sets for h in map(xxhash.xxh64_intdigest, x, repeat(SEED))), dtype=np.uint64, count=sum(map(len, sets)))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])), pa.array(hashes.view(np.int64))], ["node", "h"])

        return step

    alone = arrow_map(source.select("node", "text"), make, "node bigint, h bigint").groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    most = (F.col("size") - F.coalesce("alone", F.lit(0))) * ((1 + similarity) / similarity) - F.col("size") + 1e-6
    return members.join(alone, "node", "left").select("node", "root", "fp", "size", most.alias("most")).where(F.col("most") >= similarity * F.col("size"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are similar."""
    source = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "one", "other")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            one, other = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            sets: dict[bytes, set[bytes]] = {t: set(shingles(t, shingle)) for t in {*one, *other}}
            return batch.select(["a", "b"]).filter(pa.array([similar(sets[x], sets[y], similarity) for x, y in zip(one, other, strict=True)], pa.bool_()))

        return step

    return arrow_map(source, make, "a bigint, b bigint")


def _roots(leaders: DataFrame, facts: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node`` and ``root`` of the nodes that are linked; ``leaders`` and ``texts`` are of the nodes that are near another one."""
    ways = [leaders]
    for _ in range(HUBS):
        way = ways[-1]
        ways.append(way.withColumnRenamed("hub", "via").join(way.select(F.col("node").alias("via"), "hub"), "via").select("node", "hub"))
    met = reduce(DataFrame.union, ways).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = written(_verified(_counted(met, facts, similarity), texts, shingle, similarity), "links")
    roots = written(components(links), "roots")
    members = facts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "fp", "size")
    n = facts.count()
    for _ in range(PEELS):
        members = written(_reach(members, texts, shingle, similarity), "reach")
        left = members.count()
        if not left:
            return roots
        if left >= MANY * (n - left):
            break
        n = left
    return components(links.union(written(_verified(written(_paired(members, similarity), "pairs"), texts, shingle, similarity), "links")))


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Every row's id and node, and for each node its rows' number, their least id and its component's root."""
    prints = written(_prints(df, id_col, text_col, shingle), "prints")
    distinct = prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"))
    facts = written(distinct, "facts")
    leaders = written(_leaders(_near(_postings(facts))), "leaders")
    few = leaders.count() <= SENT
    nodes = leaders.select("node")
    near = written(facts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi"), "near")
    wanted = near.select(F.col("node").alias("own"), "least")
    source = _texts(df, id_col, text_col)
    texts = written(source.join(F.broadcast(wanted) if few else wanted, (source["node"] == wanted["own"]) & source["id"].eqNullSafe(wanted["least"]), "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")
    roots = _roots(leaders, near.select("node", "fp", "size"), texts, shingle, similarity)
    every = prints.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    return prints.select("id", "node"), every.join(roots, "node", "left").select("node", "n", "least", F.coalesce("root", "node").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``id_col``, component_id (least id reachable).

    Documents link at a similarity of ``similarity`` or more; those without words (null, empty, blank) link with each other.  Rows
    with a null id get their component, and never name one unless all its ids are null.
    Repeated rows stay.  Other columns are not kept.
    """
    prints, joined = _grouped(df, id_col, text_col, shingle, similarity)
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "n", "component_id")
    return join_facts(prints, written(named, "named"), ["node"], "n").select(F.col("id").alias(id_col), "component_id")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``df`` for each group of near-duplicates, with all its columns; see ``simhash.one_of_each``."""
    prints, joined = _grouped(df, id_col, text_col, shingle, similarity)
    return one_of_each(df, join_facts(prints, written(joined.select("node", "n", "root"), "named"), ["node"], "n"), id_col, text_col)
