"""Line classification: blank, comment and code lines of a file's bytes.

A line is blank if it holds white space only, wherever it stands.  Any other line is code if it has code
or part of a string, else comment if it has part of a comment, else code.  Two forms:
:class:`LineCounter` on bytes for every language, and :func:`native_counts`, a column
expression for the languages whose block comments do not nest.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import Language, Registry

BOM = b"\xef\xbb\xbf"
#: White space of blank lines: the characters with Unicode's White_Space property, but for line feeds.
SPACE = "\t\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = re.compile(rb"(?:[\t\n\x0b\x0c\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)*")
#: Bytes looked at to tell whether a file is binary.
SNIFF = 8192


def is_binary(content: bytes) -> bool:
    """Whether a NUL is among the first bytes."""
    return b"\0" in content[:SNIFF]


def _until(close: bytes, escapes: bool, across: bool) -> bytes:
    """What a string holds after its opener, its closer included if there is one."""
    step, plain = (rb"\\[\s\S]", rb"[^\\]") if across else (rb"\\[^\n]", rb"[^\\\n]")
    if not close or escapes and close.startswith(b"\\"):
        return rb"[\s\S]*+" if across else rb"[^\n]*+"
    end = re.escape(close)
    if not escapes:
        return rb"(?:(?!" + end + rb")[\s\S])*+(?:" + end + rb")?"
    return rb"(?:" + step + rb"|(?!" + end + rb")" + plain + rb")*+(?:" + end + rb")?"


class LineCounter:
    """Counts the lines of one language's files."""

    def __init__(self, language: Language):
        self.language = language
        self.blocks = [(a.encode(), b.encode()) for a, b in language.block]
        kinds: list[bytes] = []
        if self.blocks:
            kinds.append(rb"(?P<block>" + b"|".join(re.escape(a) for a, _ in self.blocks) + rb")")
        if language.line:
            kinds.append(rb"(?P<line>(?:" + b"|".join(re.escape(x.encode()) for x in language.line) + rb")[^\n]*+)")
        strings = [re.escape(a.encode()) + _until(b.encode(), escapes, across) for pairs, escapes, across in ((language.multi, True, True), (language.raw, False, True), (language.quotes, True, False)) for a, b in pairs]
        if strings:
            kinds.append(rb"(?P<string>" + b"|".join(strings) + rb")")
        self.tokens = re.compile(b"|".join(kinds)) if kinds else None
        self.nesting = {a: re.compile(re.escape(a) + b"|" + re.escape(b)) for a, b in self.blocks} if language.nested else {}

    def _block_end(self, content: bytes, opener: bytes, at: int) -> int:
        close = next(b for a, b in self.blocks if a == opener)
        if not self.nesting:
            end = content.find(close, at)
            return len(content) if end < 0 else end + len(close)
        depth = 1
        for m in self.nesting[opener].finditer(content, at):
            depth += 1 if m.group() == opener else -1
            if not depth:
                return m.end()
        return len(content)

    def count(self, content: bytes) -> tuple[int, int, int, int]:
        """Lines, blank, comment and code."""
        content = content.removeprefix(BOM)
        lines = content.split(b"\n")
        if not lines[-1]:
            lines.pop()
        blank = [_BLANK.fullmatch(x) is not None for x in lines]
        n_blank = sum(blank)
        if self.tokens is None:
            return len(lines), n_blank, 0, len(lines) - n_blank
        commented: set[int] = set()
        left: list[bytes] = []
        at = row = 0
        while m := self.tokens.search(content, at):
            begin = m.start()
            gap = content[at:begin]
            left.append(gap)
            row += gap.count(b"\n")
            end = self._block_end(content, m.group(), m.end()) if m.lastgroup == "block" else m.end()
            breaks = content.count(b"\n", begin, end)
            if m.lastgroup == "string":
                left.append(b"s" + b"\ns" * breaks)
            else:
                commented.update(range(row, row + breaks + 1))
                left.append(b" " + b"\n " * breaks)
            row += breaks
            at = end
        left.append(content[at:])
        rest = b"".join(left).split(b"\n")
        comment = sum(1 for k in commented if k < len(lines) and not blank[k] and not rest[k].removesuffix(b"\r").strip(b" \t"))
        return len(lines), n_blank, comment, len(lines) - n_blank - comment


@lru_cache(maxsize=1024)
def counter(language: Language) -> LineCounter:
    return LineCounter(language)


def count(content: bytes, language: Language) -> tuple[int, int, int, int]:
    """Lines, blank, comment and code of one file."""
    return counter(language).count(content)


_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}#&\-~])")


def _q(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def token_regex(language: Language) -> str:
    """The lexer of a language without nesting as one Java regular expression: block, line comment, strings, white space, rest."""
    if language.nested and language.block:
        raise ValueError("nested comments are beyond a regular expression")
    kinds = [rf"{_q(a)}[\s\S]*?(?:{_q(b)}|\z)" for a, b in language.block]
    kinds += [rf"{_q(x)}[^\n]*+" for x in language.line]
    kinds += [rf"{_q(a)}(?:\\[\s\S]|(?!{_q(b)})[^\\])*+(?:{_q(b)})?" for a, b in language.multi]
    kinds += [rf"{_q(a)}[\s\S]*?(?:{_q(b)}|\z)" for a, b in language.raw]
    kinds += [rf"{_q(a)}(?:\\[^\n]|(?!{_q(b)})[^\\\n])*+(?:{_q(b)})?" for a, b in language.quotes]
    openers = sorted({x[0] for pairs in (language.block, language.multi, language.raw, language.quotes) for x, _ in pairs if x} | {x[0] for x in language.line if x})
    begin = "".join(map(_q, openers))
    # What begins with no opener's first character and holds none is one token of code, not one for each character.
    return "|".join([*kinds, rf"[^{begin} \t\n][^{begin}\n]*+", r"[ \t]+", r"\n", r"[\s\S]"])


def blank(line: Column) -> Column:
    """Whether a line of decoded text is blank."""
    return line.rlike(rf"\A[{SPACE}]*\z")


def split_lines(content: Column) -> Column:
    """Lines of decoded text: no line after a last line feed, none of an empty text."""
    text = F.regexp_replace(content, "^\ufeff", "")
    lines = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def plain_counts(content: Column) -> Column:
    """``struct<lines, blank, comment, code>`` where every line that is not blank is code."""
    lines = split_lines(content)
    empty = F.size(F.filter(lines, blank))
    return F.struct(F.size(lines).cast("bigint").alias("lines"), empty.cast("bigint").alias("blank"), F.lit(0).cast("bigint").alias("comment"), (F.size(lines) - empty).cast("bigint").alias("code"))


def native_counts(df, content: str, language: Language, into: str = "counts"):
    """``df`` with ``struct<lines, blank, comment, code>`` of the text column ``content``, by column expressions alone.

    Tokens become marks (C for comments, X for code and strings) that keep the line feeds; the marks of a
    line then tell what it is.  For languages whose block comments do not nest.
    """
    if language.plain:
        return df.withColumn(into, plain_counts(F.col(content)))
    comments = "|".join([*(_q(a) for a, _ in language.block), *(_q(x) for x in language.line)])
    text = F.regexp_replace(F.regexp_replace(F.col(content), "^\ufeff", ""), r"\r(?=\n|\z)", "")
    tokens = F.regexp_extract_all(text, F.lit(token_regex(language)), F.lit(0))

    def mark(t: Column) -> Column:
        gaps = t.rlike(r"\A[ \t]+\z")
        drawn = F.when(t.rlike(rf"\A(?:{comments})"), F.regexp_replace(t, "[^\n]+", "C")) if comments else F.when(F.lit(False), "")
        return F.when(gaps, "").otherwise(drawn.otherwise(F.regexp_replace(t, "[^\n]+", "X")))

    marked = df.withColumn("_lines", split_lines(F.col(content))).withColumn("_marks", F.split(F.array_join(F.transform(tokens, mark), ""), "\n", -1))
    kind = F.zip_with("_lines", F.slice("_marks", F.lit(1), F.size("_lines")), lambda line, m: F.when(blank(line), "b").when(m.contains("X"), "x").when(m.contains("C"), "c").otherwise("x"))
    marked = marked.withColumn("_kinds", kind)

    def n(k: str) -> Column:
        return F.size(F.filter("_kinds", lambda x: x == k)).cast("bigint")

    return marked.withColumn(into, F.struct(F.size("_kinds").cast("bigint").alias("lines"), n("b").alias("blank"), n("c").alias("comment"), n("x").alias("code"))).drop("_lines", "_marks", "_kinds")


def classify(df, content: str, language: str, registry: Registry | None = None, keep: list[str] | None = None):
    """``keep`` columns of ``df`` with lines, blank, comment, code and is_binary of its content (bytes) in its language.

    One pass in Arrow batches; rows of unknown languages and null contents get nulls.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    known = (registry or Registry.builtin()).languages
    keep = [c for c in df.columns if c != content] if keep is None else keep
    source = df.select(*(F.col(c) for c in keep), F.col(language).alias("_language"), F.col(content).cast("binary").alias("_content"))
    counts = [T.StructField(x, T.LongType()) for x in ("lines", "blank", "comment", "code")]
    schema = T.StructType([*source.schema.fields[: len(keep)], *counts, T.StructField("is_binary", T.BooleanType())])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = []
                for name, body in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True):
                    own = known.get(name)
                    if own is None or body is None:
                        found.append((None,) * 5)
                    else:
                        found.append((*count(body, own), is_binary(body)))
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.int64()] * 4 + [pa.bool_()], strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[: len(keep)] + columns, names)

    return source.mapInArrow(run, schema)
