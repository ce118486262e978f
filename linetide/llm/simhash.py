"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes.  Two fingerprints that differ in at most two bits
share at least six of them.  A list for a single byte would hold a 256th of all
fingerprints, so a posting is keyed by four positional bytes at once, in the fourteen sets of four positions in which any
three positions stand together just once.  The lists in which a pair meets are tallied: with six positional bytes in common a pair meets in
three lists or more, with five in one, so pairs with :data:`MEETINGS` are retained and then verified by their differing bits.

Only distinct fingerprints are indexed, so copies never meet.  The pairs of lists longer than
:data:`LONG` are not formed: each member names its 65 centres (itself and itself with
one bit flipped), and two members are within two bits exactly if they share a centre, so
linking every member of a centre to its least member keeps all links' components.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations, repeat
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, join_facts, two_columns, written
from .graph import components
from .sampling import sent

SEED = 42
#: Bits in which linked fingerprints differ at most, and the lists they then meet in at least.
BITS, MEETINGS = 2, 3
#: Members up to which a list's pairs are formed.
LONG = 32
_BLOCK = 1 << 16
_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit set, from the lowest bit."""
    out = np.zeros((8, 8), dtype=np.int64)
    starts = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & _LANES
        out[:, bit] = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 text: A-Z in lower case, words between ASCII white space, XXH64 of word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingles = iter(words)
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for at in range(0, n, _BLOCK):
        counts += bit_counts(np.fromiter(hashes, dtype=np.uint64, count=min(_BLOCK, n - at)))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a signed long) of every row; a null text is empty, with fingerprint zero."""
    source = two_columns(df, id_col, text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

        return step

    return arrow_map(source, make, T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _mask(positions: tuple[int, ...]) -> int:
    whole = sum(0xFF << (8 * p) for p in positions)
    return whole - (1 << 64) if whole >= 1 << 63 else whole


def _flip(bit: int) -> int:
    return 1 << bit if bit < 63 else -(1 << 63)


#: Positional bytes of each of the fourteen lists: four positions whose numbers cancel each other bit by bit.
LISTS = [_mask(four) for four in combinations(range(8), 4) if reduce(xor, four) == 0]


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect the column ``fp`` of distinct fingerprints as all pairs within two bits do."""
    posts = written(distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in LISTS))).alias("list", "bytes")), "postings")
    sizes = posts.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    met = posts.join(sizes, ["list", "bytes"])
    short = met.where(F.col("n") <= LONG)
    other = short.select("list", "bytes", F.col("fp").alias("b"))
    tally = short.withColumnRenamed("fp", "a").join(other, ["list", "bytes"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("meetings"))
    pairs = tally.where(F.col("meetings") >= MEETINGS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    long = met.where(F.col("n") > LONG).select("fp").distinct()
    centres = long.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_flip(k))) for k in range(64)))).alias("centre"))
    stars = centres.join(centres.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "centre").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars)


def _roots(prints: DataFrame) -> DataFrame:
    """``fp``, ``n`` (rows that have it), ``least`` (their least id) and ``root`` (one fingerprint of the component)."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = components(links(distinct.select("fp")))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id (least id reachable).

    Documents link at two or fewer differing bits of their fingerprints; equal fingerprints
    link, those of texts without words (null, empty, blank: zero) too.  Rows with a null id get a
    fingerprint and their component, and never name one unless all its ids are null.
    Repeated rows stay.  Other columns are not kept.
    """
    prints = written(fingerprints(df, id_col, text_col, shingle), "prints")
    joined = _roots(prints)
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "n", "component_id")
    return join_facts(prints, written(named, "named"), ["fp"], "n").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_node(text_col: str) -> Column:
    """A hash of a row's text, the same for a null and an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def one_of_each(df: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each ``root`` of ``members`` (id, node as :func:`text_node`, root: a row for each of ``df``).

    It is the row with the least id, null ids last, and of several texts under that id the one with the least hash; of its copies one
    stays.  So different texts under one id are rows of their own.  What is kept grows with the input, so it meets the rows by a
    shuffle at every size, in hash tables of ids.
    """
    each = members.groupBy("root", "id", "node").agg(F.count("*").alias("n"))
    least = F.min_by(F.struct("id", "node", "n"), F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    node, own_id, own_node, n = (f"{x}_{uuid.uuid4().hex}" for x in ("node", "own_id", "own_node", "n"))
    keep = written(each.groupBy("root").agg(least.alias("row")).select(F.col("row.id").alias(own_id), F.col("row.node").alias(own_node), F.col("row.n").alias(n)), "kept")
    rows = df.withColumn(node, text_node(text_col))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(node) == F.col(own_node))
    once, often = keep.where(F.col(n) == 1).hint("shuffle_hash"), keep.where(F.col(n) > 1)
    own = rows.join(once, same, "left_semi")
    if not often.isEmpty():
        own = own.unionByName(rows.join(sent(often, "often", 10_000), same, "left_semi").dropDuplicates([id_col, node]))
    return own.drop(node)


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of ``df`` for each group of near-duplicates, with all its columns; see :func:`one_of_each`."""
    node = f"node_{uuid.uuid4().hex}"
    rows = df.select(F.struct(F.col(id_col).alias("id"), text_node(text_col).alias("node")).alias(node), F.col(text_col).alias("text"))
    prints = written(fingerprints(rows, node, "text", shingle).select("id.id", "id.node", "fp"), "prints")
    return one_of_each(df, prints.join(_roots(prints).select("fp", "root"), "fp"), id_col, text_col)
