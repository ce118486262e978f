"""Secret scan: three patterns, and strings that zstandard cannot predict in a sensitive context.

The patterns find the known shapes.  The novelty method adds to them: every run of secret-like
characters shortly after a sensitive word is compressed behind the text around it, with a dictionary of common
identifiers.  Its marginal size (compressed with the candidate, less compressed without) is near its length for
random strings, and smaller for identifiers, words, paths and anything the surrounding code says elsewhere.  The
measure alone decides.
"""

from __future__ import annotations

import hashlib
import re
import statistics
import string
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, two_columns

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A greedy run is as long as it can be, so only runs of 16 need to be looked at.
_HEX = re.compile(r"[0-9a-f]{16,}")

SENSITIVE = ("auth", "bearer", "credential", "passphrase", "password", "passwd", "private_key", "privatekey", "pwd", "secret", "token", "api_key", "apikey", "access_key", "signature")
_SENSITIVE = re.compile("|".join(sorted(map(re.escape, SENSITIVE), key=len, reverse=True)), re.IGNORECASE | re.ASCII)
#: Characters from which a run is a candidate.
LEAST = 16
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_SYMBOLS = (string.ascii_letters + string.digits).encode()
#: Code points between a sensitive word and a candidate's start, and of text around it that primes the dictionary.
NEAR, AROUND = 48, 512
#: Marginal bytes from which a candidate counts as unpredictable: as a share of its length, or of what a random string of that length adds.
NOVEL, LIKE_RANDOM = 0.75, 0.82
#: Identifiers of each primer.
PRIMED = (20, 25, 29)
IDENTIFIERS = (
    "abstract access account address admin algorithm allocate amount application argument array assert async attribute auth authorization await backend base64 bearer "
    "binary boolean break buffer builder bytes cache callback catch certificate channel char class client cloud code collection column command comment commit config "
    "configuration connect connection const constructor container content context continue control controller cookie count create credential current data database date "
    "debug default define delete description destination device dictionary directory document domain double element email enable encoding endpoint engine environment error event "
    "example exception execute export extension false field file filter final finally float folder format function gateway generate global group handler hash header height host http https "
    "identifier image implement import include index information initialize input instance integer interface internal iterator json key label language length library limit list listener load local "
    "location logger login long loop main manager map master memory message metadata method model module monitor name namespace network node null number object operation operator option order output "
    "override package page parameter parent parse password path pattern payload permission pipeline platform plugin pointer policy pool port position prefix private process production profile project "
    "property protected protocol provider proxy public query queue random read record redirect reference region register registry release remote repository request require resource response result return "
    "role root route runtime sample schema script search secret section secure security select sender sequence server service session setting signature size socket source stack staging standard start state "
    "static status storage store stream string struct submit suffix super switch sync system table target task template test text thread throw time timeout timestamp title token topic tracking transaction "
    "transfer transform true type union unique unit update upload user username utils valid validate value variable vector version view virtual void volume warning web widget width window worker write"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, value start)`` of the patterns' matches that are long enough."""
    out = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def _primer(size: int) -> bytes:
    """A line of identifiers in all spellings: what it costs to write letters, signs and numbers is known before a candidate is met."""
    words = IDENTIFIERS.decode().split()
    spell = ("_".join, lambda w: w[0] + "".join(map(str.title, w[1:])), lambda w: "".join(map(str.title, w)), "-".join, lambda w: "/" + "/".join(w), lambda w: "_".join(w).upper(), lambda w: f"{w[0]}_{w[1]}{len(w[2])}")
    rows = [[words[(k * step + 5) % len(words)] for step in (11, 17, 29)] for k in range(size)]
    return " ".join(spell[k % len(spell)](w) for k, w in enumerate(rows)).encode()


@lru_cache(maxsize=1)
def _packer() -> tuple[zstandard.ZstdCompressor, list[bytes]]:
    """A compressor with the identifiers as its dictionary, and the primers."""
    known = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False), [_primer(n) for n in PRIMED]


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Compressed bytes that ``candidate`` adds where its surroundings and the identifiers are known: the median of several primers, as a single
    one may lie where the coding changes its tables."""
    packer, primers = _packer()
    around, own = b"\n".join((b"", after.encode(), before.encode())), candidate.encode()
    return statistics.median(len(packer.compress(p + around + own)) - len(packer.compress(p + around)) for p in primers)


@lru_cache(maxsize=4096)
def random_bytes(length: int) -> int:
    """Marginal bytes of a random string of letters and digits: fewer than its length where it is long enough to be coded as symbols."""
    stream = b"".join(xxhash.xxh64_digest(k.to_bytes(8, "big")) for k in range(length // 8 + 1))[:length]
    return marginal_bytes(bytes(_SYMBOLS[x % len(_SYMBOLS)] for x in stream).decode(), "", "")


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether a run of a text is as unpredictable as a random string."""
    size = end - start
    added = marginal_bytes(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND])
    return added >= min(NOVEL * size, LIKE_RANDOM * random_bytes(size))


def novel_spans(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Unpredictable runs that start shortly after a sensitive word and that no pattern's match overlaps.

    Runs that a dot joins are measured one by one and together; what is unpredictable as a whole is so in every part.
    Words, runs and matches are all met in the order of the text, each once.
    """
    low = text.lower()
    if not any(x in low for x in SENSITIVE):
        return []
    out, done, met, reached = [], 0, 0, 0
    for word in _SENSITIVE.finditer(text):
        reach = word.end() + NEAR
        done = max(word.end(), done)
        while (begin := _RUN.search(text, done, reach + LEAST)) and begin.start() <= reach:
            parts = [begin.start()]
            while True:
                done = _RUN.match(text, parts[-1]).end()
                parts.append(done)
                if text[done : done + 1] != "." or not _RUN.match(text, done + 1):
                    break
                parts.append(done + 1)
            whole = len(parts) > 2 and is_novel(text, parts[0], done)
            for start, end in zip(parts[::2], parts[1::2], strict=True):
                while met < len(base) and base[met][0] < end:
                    reached = max(reached, base[met][2])
                    met += 1
                if reached <= start and (whole or is_novel(text, start, end)):
                    out.append((start, 3, end, start))
    return out


def find_spans(text: str) -> list[tuple[int, int, int, int]]:
    """All spans of a text by start, then kind; the patterns' spans are always among them."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base))


def redact(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """``text`` with each secret's characters replaced by the kind's name in brackets."""
    out, done = [], 0
    for _, kind, end, value in sorted(spans, key=lambda s: (s[3], -s[2])):
        if value >= done:
            out += [text[done:value], f"[{KINDS[kind].upper()}]"]
            done = end
        elif end > done:
            done = end
    return "".join([*out, text[done:]])


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_assign, n_access, n_hex, n_novel, base_sha256, spans[, redacted].

    Offsets are code points of the whole text, end exclusive.  A null text is empty and has
    no spans (and redacts to the empty text); rows with null ids and repeated rows are scanned
    like any other; other columns are not kept.
    """
    source = two_columns(df, id_col, text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[list[int]] = [[], [], [], []]
            sha, spans, clean = [], [], []
            for text in batch.column(1).to_pylist():
                found = find_spans(text)
                for kind, to in enumerate(counts):
                    to.append(sum(k == kind for _, k, _, _ in found))
                sha.append(hashlib.sha256(joined([s for s in found if s[1] < 3]).encode()).hexdigest())
                spans.append(joined(found))
                if redacted:
                    clean.append(redact(text, found) if found else text)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(sha), pa.array(spans, pa.string())] + ([pa.array(clean, pa.string())] if redacted else [])
            return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        return step

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    if redacted:
        schema.add("redacted", T.StringType())
    return arrow_map(source, make, schema).withColumnRenamed("id", id_col)


def redact_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its secrets replaced in place; every other column and the order of columns stay.

    A null text stays null.
    """
    names = df.columns
    at = names.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t if t is None else redact(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

        return step

    return arrow_map(df.withColumn(text_col, F.col(text_col).cast("string")), make, df.withColumn(text_col, F.col(text_col).cast("string")).schema)
