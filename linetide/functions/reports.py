"""Reports: per-language counts with totals and exclusions, and their table, JSON and YAML forms."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: Parts into which the files of one content are dealt.
PARTS = 256
MEASURES = ("files", "lines", "blank", "comment", "code")


def go_quote(text: Column) -> Column:
    """A string in double quotes with its backslashes, quotes, tabs and line ends escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


@dataclass
class Counts:
    files: int = 0
    lines: int = 0
    blank: int = 0
    comment: int = 0
    code: int = 0


@dataclass
class FileDetail:
    path: str
    counts: Counts


@dataclass
class LanguageCounts:
    name: str
    counts: Counts
    detail: list[FileDetail] = field(default_factory=list)


@dataclass
class Report:
    languages: list[LanguageCounts]
    totals: Counts
    excluded: list[tuple[str, str]]


def language_totals(files: DataFrame) -> DataFrame:
    """Counts per language of file rows (language, lines, blank, comment, code), the most code first, then by name."""
    sums = (F.sum(c).cast("bigint").alias(c) for c in MEASURES[1:])
    return files.groupBy("language").agg(F.count("*").alias("files"), *sums).orderBy(F.desc("code"), "language")


def with_total(files: DataFrame) -> DataFrame:
    """As :func:`language_totals`, with the grand total in a row whose language is null."""
    sums = (F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in MEASURES[1:])
    return files.rollup("language").agg(F.grouping_id().alias("_total"), F.count("*").alias("files"), *sums).orderBy("_total", F.desc("code"), "language").drop("_total")


def unique_contents(files: DataFrame, digest: str = "sha256", path: str = "path") -> DataFrame:
    """One file of each content: the one with the least path; adds duplicate_of, null for those that stay.

    The least path is found for parts of a digest's files, then for the digest, and joined back by part: a content that a third of
    all files share is dealt out over :data:`PARTS` tasks.
    """
    part = F.pmod(F.xxhash64(path), F.lit(PARTS)).alias("_part")
    known = files.where(F.col(digest).isNotNull())
    parts = known.groupBy(digest, part).agg(F.min(path).alias("_least"), F.count("*").alias("_n"))
    first = parts.groupBy(digest).agg(F.min("_least").alias("_first"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    firsts = parts.select(digest, "_part").join(first, digest)
    return files.withColumn("_part", part).join(firsts, [digest, "_part"], "left").withColumn("duplicate_of", F.when(F.col("_first") < F.col(path), F.col("_first"))).drop("_first", "_part")


def build(files: DataFrame, excluded: DataFrame | None = None, by_file: bool = False) -> Report:
    """The report of file rows and of exclusions (path, detector).

    What reaches the driver is a row per language, the exclusions and, if asked for, the files: the report itself.
    """
    languages = [LanguageCounts(r["language"], Counts(*(r[m] for m in MEASURES))) for r in language_totals(files).collect()]
    if by_file:
        own = {x.name: x for x in languages}
        for r in files.select("language", "path", *MEASURES[1:]).orderBy("language", "path").toLocalIterator():
            own[r["language"]].detail.append(FileDetail(r["path"], Counts(1, *(r[m] for m in MEASURES[1:]))))
    totals = Counts(*(sum(getattr(x.counts, m) for x in languages) for m in MEASURES))
    gone = [] if excluded is None else [(r["path"], r["detector"]) for r in excluded.select("path", "detector").orderBy("path", "detector").collect()]
    return Report(languages, totals, gone)


def as_table(report: Report) -> str:
    """A table with aligned columns; wide names and numbers widen them."""
    every = [(x.name, x.counts) for x in report.languages] + [("Total", report.totals)]
    name_width = max([22, *(len(n.encode()) + 2 for n, _ in every)])
    width = max([12, *(len(str(getattr(c, m))) + 2 for _, c in every for m in ("files", "blank", "comment", "code"))])
    rule = "-" * (name_width + 4 * width)

    def row(name: str, *values) -> str:
        return name.ljust(name_width) + "".join(str(v).rjust(width) for v in values)

    def numbers(c: Counts) -> tuple[int, ...]:
        return c.files, c.blank, c.comment, c.code

    out = [rule, row("Language", "Files", "Blank", "Comment", "Code"), rule]
    for x in report.languages:
        out.append(row(x.name, *numbers(x.counts)))
        out += ["  " + d.path.ljust(name_width + width - 2) + "".join(str(v).rjust(width) for v in numbers(d.counts)[1:]) for d in x.detail]
    return "\n".join([*out, rule, row("Total", *numbers(report.totals)), rule, ""])


def document(report: Report) -> dict:
    """The report as nested lists and dicts, in the order in which it is written."""
    languages = []
    for x in report.languages:
        one = {"name": x.name, **{m: getattr(x.counts, m) for m in MEASURES}}
        if x.detail:
            one["files_detail"] = [{"path": d.path, **{m: getattr(d.counts, m) for m in MEASURES[1:]}} for d in x.detail]
        languages.append(one)
    return {
        "schema_version": SCHEMA_VERSION,
        "languages": languages,
        "totals": {m: getattr(report.totals, m) for m in MEASURES},
        "excluded": [{"path": p, "detector": d} for p, d in report.excluded],
    }


_IN_JSON = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029", "\x7f": "\x7f"}


def as_json(report: Report) -> str:
    """JSON with two spaces of indent; characters with a meaning in HTML are escaped, invalid UTF-8 is replaced."""
    text = json.dumps(document(report), indent=2, ensure_ascii=False)
    text = re.sub("[<>&\u2028\u2029]", lambda m: _IN_JSON[m.group()], text)
    return re.sub("[\ud800-\udfff]", "\\\\ufffd", text) + "\n"


class _Dumper(yaml.SafeDumper):
    def increase_indent(self, flow=False, indentless=False):
        return super().increase_indent(flow, False)


def _text(dumper: yaml.Dumper, text: str) -> yaml.ScalarNode:
    other = text.lower() in ("y", "n") or dumper.resolve(yaml.ScalarNode, text, (True, False)) != "tag:yaml.org,2002:str"
    return dumper.represent_scalar("tag:yaml.org,2002:str", text, '"' if other else None)


_Dumper.add_representer(str, _text)


def as_yaml(report: Report) -> str:
    """YAML with two spaces of indent and lists indented below their keys; strings that would read as something else are in double quotes."""
    return yaml.dump(document(report), Dumper=_Dumper, indent=2, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 30)


FORMATS: dict[str, Callable[[Report], str]] = {"table": as_table, "json": as_json, "yaml": as_yaml}


def formatter(name: str) -> Callable[[Report], str]:
    """The writer of a format."""
    if name not in FORMATS:
        raise ValueError(f'unknown format "{name}" (available: {", ".join(sorted(FORMATS))})')
    return FORMATS[name]
