"""One query per operator over the tables of a data directory, each with its DuckDB SQL.

The tables are no source trees, so paths and contents are made from their columns by
expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines, reports, shebangs
from ..functions.globs import PatternSet
from ..functions.languages import Language, Registry
from ..operators import cascade, ignore_files
from ..operators.detectors import Detectors
from ..sources.git import clean_objects
from . import scan, scan_catalogue

REGISTRY = Registry.builtin()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- made-up paths and contents -------------------------------------------------------------

PATH = """concat(coalesce(source, 'none'), '/', CASE doc_id % 14
 WHEN 0 THEN concat('a/f', doc_id, '.go') WHEN 1 THEN concat('a/f', doc_id, '.PY') WHEN 2 THEN concat('b/c/f', doc_id, '.tar.gz') WHEN 3 THEN 'Makefile'
 WHEN 4 THEN concat('.hidden/f', doc_id, '.rs') WHEN 5 THEN concat('node_modules/f', doc_id, '.js') WHEN 6 THEN concat('b/README', doc_id) WHEN 7 THEN concat('.git/f', doc_id)
 WHEN 8 THEN concat('b/f', doc_id, '.md') WHEN 9 THEN '.bashrc' WHEN 10 THEN concat('b/c/f', doc_id, '.html') WHEN 11 THEN concat('a/.f', doc_id, '.sql')
 WHEN 12 THEN concat('build/f', doc_id, '.log') ELSE concat('a/b/keep', doc_id, '.log') END)"""
HEAD = """CASE doc_id % 9 WHEN 0 THEN '#!/bin/bash\n' WHEN 1 THEN '#!/usr/bin/env python3.11\n' WHEN 2 THEN '#!/usr/bin/env -S node --x\n' WHEN 3 THEN '#! /usr/bin/perl -w\n'
 WHEN 4 THEN '#!\n' WHEN 5 THEN '#!/usr/bin/env A=1 ruby\n' WHEN 6 THEN '#!/opt/unknown' WHEN 7 THEN 'plain text' ELSE '#!/usr/bin/env' END"""
GO = """concat('package x', chr(10), '// ', replace(replace(coalesce(text, ''), '. ', chr(10)), ', ', ' /* c */ "s // t" '), chr(10), '/* a', chr(10), chr(10), 'b */', chr(10), '`raw // ', chr(10), '/* in raw`', chr(10))"""
PYTHON = """concat('# ', replace(replace(coalesce(text, ''), '. ', ' # c\n'), ', ', '\n\n"x # y" '), '\n\"\"\"doc\n# in doc\n\"\"\"\n', chr(160), '\n')"""
SQL_TEXT = """concat('-- ', replace(replace(coalesce(text, ''), '. ', chr(10)), ', ', ' ''q -- r'' /* b '), ' */ select 1', chr(10))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null id counts as -1."""
    return _table(spark, sf_dir, "documents").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("bigint")))


_DOCUMENTS = "(SELECT * REPLACE (coalesce(doc_id, -1) AS doc_id) FROM documents)"


# --- line counts ------------------------------------------------------------------------------

_SQL_SPACE = r"[\t\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


def _sql_lines(text: str) -> str:
    body = f"regexp_replace({text}, '^\\x{{feff}}', '')"
    return f"CASE WHEN {body} = '' THEN [] WHEN {body}[-1] = chr(10) THEN string_split({body}, chr(10))[:-2] ELSE string_split({body}, chr(10)) END"


def _sql_plain(text: str, source: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST(len(l) AS BIGINT) AS lines, CAST(len(list_filter(l, lambda x: regexp_full_match(x, '{_SQL_SPACE}'))) AS BIGINT) AS blank
 FROM (SELECT *, {_sql_lines(text)} AS l FROM {source})"""


def _re2(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " \n" else c for c in text)


def _sql_lexer(text: str, source: str, keys: str, language: Language) -> str:
    """Counts of a text by tokens, with the look-ahead-free shapes that DuckDB's engine reads."""
    kinds = [rf"{_re2(a)}[\s\S]*?(?:{_re2(b)}|\z)" for a, b in language.block]
    kinds += [rf"{_re2(x)}[^\n]*" for x in language.line]
    kinds += [rf"{_re2(a)}(?:\\[\s\S]|[^\\])*?(?:{_re2(b)}|\z)" for a, b in language.multi]
    kinds += [rf"{_re2(a)}[\s\S]*?(?:{_re2(b)}|\z)" for a, b in language.raw]
    kinds += [rf"{_re2(a)}[^{_re2(b)}\\\n]*(?:\\[^\n][^{_re2(b)}\\\n]*)*{_re2(b)}?" for a, b in language.quotes]
    tokens = "|".join([*kinds, r"[ \t]+", r"\n", r"[\s\S]"]).replace("'", "''")
    comment = "|".join([*(_re2(a) for a, _ in language.block), *(_re2(x) for x in language.line)]).replace("'", "''")
    return f"""WITH b AS (SELECT {keys}, regexp_replace(replace({text}, chr(13) || chr(10), chr(10)), '\\r$', '') AS body FROM {source}),
 l AS (SELECT *, {_sql_lines("body")} AS l,
  string_split(array_to_string(list_transform(regexp_extract_all(body, '{tokens}'), lambda t: CASE WHEN regexp_full_match(t, '[ \\t]+') THEN ''
   WHEN regexp_matches(t, '^(?:{comment})') THEN regexp_replace(t, '[^\\n]+', 'C', 'g') ELSE regexp_replace(t, '[^\\n]+', 'X', 'g') END), ''), chr(10)) AS m FROM b),
 k AS (SELECT {keys}, list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_full_match(l[i], '{_SQL_SPACE}') THEN 'b' WHEN contains(m[i], 'X') THEN 'x' WHEN contains(m[i], 'C') THEN 'c' ELSE 'x' END) AS k FROM l)
 SELECT {keys}, CAST(len(k) AS BIGINT) AS lines, CAST(len(list_filter(k, lambda x: x = 'b')) AS BIGINT) AS blank,
  CAST(len(list_filter(k, lambda x: x = 'c')) AS BIGINT) AS comment, CAST(len(list_filter(k, lambda x: x = 'x')) AS BIGINT) AS code FROM k"""


def _native(df: DataFrame, content: str, language: str, *keys: str) -> DataFrame:
    return lines.native_counts(df, content, REGISTRY.languages[language]).select(*keys, "counts.*")


def _arrow(df: DataFrame, content: str, language: str, *keys: str) -> DataFrame:
    own = df.select(*keys, F.lit(language).alias("language"), F.col(content).cast("binary").alias("content"))
    return lines.classify(own, "content", "language", REGISTRY, list(keys)).drop("is_binary")


_PLAIN_DOCS = f"SELECT lang AS language, lines, blank, CAST(0 AS BIGINT) AS comment, lines - blank AS code FROM ({_sql_plain("coalesce(text, '')", 'documents', 'lang')})"
_SUMS = "count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(code) AS BIGINT) AS code"


def _plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select(F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("path"), lines.plain_counts(F.col("text")).alias("c"), F.sha2("text", 256).alias("sha256")).select("language", "path", "c.*", "sha256")


@_query(f"SELECT language, {_SUMS} FROM ({_PLAIN_DOCS}) GROUP BY language")
def loc_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of plain text per language, by column expressions."""
    return reports.language_totals(_plain_files(spark, sf_dir))


@_query(f"SELECT language, {_SUMS} FROM ({_PLAIN_DOCS}) GROUP BY ROLLUP (language)")
def loc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the grand total."""
    return reports.with_total(_plain_files(spark, sf_dir))


@_query(f"SELECT role, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(blank) AS BIGINT) AS blank FROM ({_sql_plain("coalesce(text, '')", 'conversations', 'role')}) GROUP BY role")
def loc_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the turns by role."""
    own = _table(spark, sf_dir, "conversations").select("role", lines.plain_counts(F.coalesce("text", F.lit(""))).alias("c"))
    return own.groupBy("role").agg(F.sum("c.lines").alias("lines"), F.sum("c.blank").alias("blank"))


_HTML = _sql_lexer("coalesce(html, '')", "pages", "page_id", REGISTRY.languages["HTML"])


@_query(_HTML)
def loc_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page as HTML, by column expressions."""
    return _native(_table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit(""))), "html", "HTML", "page_id")


@_query(_HTML)
def loc_html_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page as HTML, by the classifier on bytes."""
    return _arrow(_table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit(""))), "html", "HTML", "page_id")


def _made(name: str, language: str, text: str, form: Callable) -> None:
    sql = _sql_lexer(text, _DOCUMENTS, "doc_id", REGISTRY.languages[language])

    def own(spark: SparkSession, sf_dir: str) -> DataFrame:
        return form(_documents(spark, sf_dir).select("doc_id", F.expr(text.replace("\\", "\\\\")).alias("body")), "body", language, "doc_id")

    own.__name__ = name
    own.__doc__ = f"Lines of every document made into {language}."
    _query(sql)(own)


_made("loc_go", "Go", GO, _native)
_made("loc_go_bytes", "Go", GO, _arrow)
_made("loc_python", "Python", PYTHON, _native)
_made("loc_python_bytes", "Python", PYTHON, _arrow)
_made("loc_sql", "SQL", SQL_TEXT, _native)


def _values(rows: list[tuple], columns: str) -> str:
    def cell(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


#: Snippets whose counts are known: name, language, text, blank, comment, code.
GOLDEN = [
    ("remark above", "Go", "// adds two\nfunc add(a, b int) int {\n\n\treturn a + b\n}\n", 1, 1, 3), ("long remark", "Java", "/* one\n   two\n\n   three */\nint n;\n", 1, 3, 1),
    ("remark that begins behind code", "C", "n++; /* counts\n rows */ n--;\n/* end */\n", 0, 1, 2), ("raw text", "Go", "var t = `first\n// second\n/* third`\n// out\n", 0, 1, 3),
    ("triple quotes", "Python", "x = \"\"\"# a\n\n# b\"\"\"\n# c\n", 1, 1, 2), ("remarks in remarks", "Rust", "/* a /* b */\nc */ let d = 1;\n/* e */\n", 0, 2, 1),
    ("braces in braces", "Haskell", "{- 1 {- 2 {- 3 -} -}\n-}\nmain = x -- y\n", 0, 2, 1), ("carriage returns", "SQL", "-- a\r\n\r\nselect '--'\r\n", 1, 1, 1),
    ("mark at the start", "JavaScript", "\ufeff// a\nb()\n", 0, 1, 1), ("open quote", "C", "char *s = \"/* no\n/* yes */\n", 0, 1, 1), ("long brackets", "Lua", "--[[\nnote\n]]\n-- note\nf()\n", 0, 4, 1),
    ("hash lines", "Shell", "#!/bin/sh\n# a\n\necho '#'\n", 1, 2, 1), ("slash star slash", "CSS", "/*/ a\n b */\nc {}\n", 0, 2, 1), ("two remarks", "C", "/* a */ /* b */\n/* c */ d;\n", 0, 1, 1),
    ("nothing", "Python", "", 0, 0, 0), ("last line open", "Go", "a\n\n  ", 2, 0, 1), ("prose", "Plain Text", "# a\n\n// b\n", 1, 0, 2), ("wide blanks", "Go", "\u3000\n\u2003// a\n\u00a0b\n", 1, 0, 2),
    ("markup", "HTML", "<p>\n<!-- a\nb -->\n</p>\n", 0, 2, 2), ("escaped quote", "Java", "s = \"\\\"// a\"; // b\n// c\n", 0, 1, 1),
]


@_query(_values([(n, g, b + c + k, b, c, k) for n, g, _, b, c, k in GOLDEN], "name, language, lines, blank, comment, code").replace("SELECT *", "SELECT name, language, CAST(lines AS BIGINT) AS lines, CAST(blank AS BIGINT) AS blank, CAST(comment AS BIGINT) AS comment, CAST(code AS BIGINT) AS code"))
def classify_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of many languages, nested comments among them."""
    own = spark.createDataFrame([(n, g, t.encode()) for n, g, t, *_ in GOLDEN], "name string, language string, content binary")
    return lines.classify(own, "content", "language", REGISTRY, ["name", "language"]).drop("is_binary")


# --- languages --------------------------------------------------------------------------------

_BY_NAME = _values(sorted(REGISTRY.by_filename.items()), "base, language")
_BY_EXT = _values(sorted(REGISTRY.by_extension.items()), "ext, language")
_BY_BANG = _values(sorted(REGISTRY.by_shebang.items()), "program, language")
_PATHS = f"(SELECT doc_id, {PATH} AS path, text FROM {_DOCUMENTS})"
_NAMED = f"""SELECT p.*, coalesce(n.language, e.language) AS language FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base,
 CASE WHEN contains(regexp_extract(path, '([^/]*)$', 1), '.') THEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) END AS ext FROM {_PATHS}) p
 LEFT JOIN ({_BY_NAME}) n ON p.base = n.base LEFT JOIN ({_BY_EXT}) e ON p.ext = e.ext"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.expr(PATH).alias("path"), "text")


@_query(f"SELECT doc_id, path, language FROM ({_NAMED})")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every path by file name or extension."""
    return shebangs.with_path_language(_paths(spark, sf_dir).drop("text"), "path", REGISTRY)


@_query(f"""WITH h AS (SELECT doc_id, {HEAD} AS head FROM {_DOCUMENTS}),
 f AS (SELECT doc_id, list_filter(string_split_regex(substr(split_part(head, chr(10), 1), 3), '[ \\t]+'), lambda x: x <> '') AS f FROM h WHERE starts_with(head, '#!')),
 p AS (SELECT doc_id, regexp_extract(CASE WHEN regexp_extract(f[1], '([^/]*)$', 1) = 'env' THEN list_filter(f[2:], lambda x: NOT starts_with(x, '-') AND NOT contains(x, '='))[1] ELSE f[1] END, '([^/]*)$', 1) AS program FROM f),
 b AS ({_BY_BANG})
 SELECT h.doc_id, coalesce(x.language, y.language) AS language FROM h LEFT JOIN p ON h.doc_id = p.doc_id LEFT JOIN b x ON p.program = x.program LEFT JOIN b y ON regexp_replace(p.program, '[0-9.]+$', '') = y.program""")
def shebang_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by its shebang."""
    own = _documents(spark, sf_dir).select("doc_id", F.expr(HEAD).alias("head"))
    return shebangs.with_shebang_language(own, "head", REGISTRY).drop("head")


@_query(f"SELECT language, count(*) AS files FROM ({_NAMED}) WHERE lower(language) IN ('go', 'python', 'sql') AND ext IN ('go', 'py', 'sql') GROUP BY language")
def filter_ext_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left by an extension and a language filter."""
    options = scan.Options(extensions={"go", "py", "sql"}, languages={"go", "python", "sql"})
    own = _paths(spark, sf_dir).select(F.lit(0).alias("root"), F.lit("").alias("prefix"), F.col("path").alias("abs"), F.col("path").alias("rel"), "path")
    kept, _ = scan.select_candidates(own, options)
    return kept.groupBy("language").agg(F.count("*").alias("files"))


@_query("SELECT doc_id, regexp_matches(substr(hex(encode(concat(coalesce(text, ''), CASE WHEN doc_id % 5 = 0 THEN chr(0) ELSE '' END))), 1, 16384), '^(?:..)*00') AS is_binary FROM documents")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have a NUL among their first bytes, as the classifier finds them."""
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("00")).cast("string")).otherwise("")).cast("binary")
    own = _table(spark, sf_dir, "documents").select("doc_id", F.lit("Plain Text").alias("language"), body.alias("body"))
    return lines.classify(own, "body", "language", REGISTRY, ["doc_id"]).select("doc_id", "is_binary")


# --- patterns and the cascade -----------------------------------------------------------------

PATTERNS = ["*.PY", "./src1/a/", "src*/b/**/*.html", "**/[^a]*/keep?*.log", "node_modules"]


@_query(f"""SELECT doc_id, path, CASE WHEN regexp_matches(path, '(^|/)[^/]*\\.PY(/|$)') THEN '*.PY' WHEN regexp_matches(path, '^src1/a(/|$)') THEN './src1/a/'
 WHEN regexp_matches(path, '^src[^/]*/b/([^/]+/)*[^/]*\\.html(/|$)') THEN 'src*/b/**/*.html' WHEN regexp_matches(path, '^([^/]+/)*[^a/][^/]*/keep[^/][^/]*\\.log(/|$)') THEN '**/[^a]*/keep?*.log'
 WHEN regexp_matches(path, '(^|/)node_modules(/|$)') THEN 'node_modules' END AS pattern FROM {_PATHS}""")
def exclude_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern that matches each path."""
    return _paths(spark, sf_dir).select("doc_id", "path", PatternSet.parse(PATTERNS).column(F.col("path")).alias("pattern"))


_PREFIX = "coalesce(source, 'none')"
IGNORED = "*.log\n!keep*.log\n# c\n/b/c/\n"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree: their paths, a marker and an ignore file in each source, and all directories above."""
    rels = _paths(spark, sf_dir).select(F.col("path").alias("rel")).distinct()
    top = rels.select(F.substring_index("rel", "/", 1).alias("s")).distinct()
    extra = top.select(F.explode(F.array(*(F.concat("s", F.lit(f"/{x}")) for x in ("package.json", ".gitignore", "build/CMakeCache.txt")))).alias("rel"))
    files = rels.union(extra).distinct().withColumn("kind", F.lit("file"))
    dirs = files.select(F.explode(ignore_files.ancestors(F.col("rel"))).alias("up")).select(F.col("up.dir").alias("rel")).where("rel <> ''").distinct().withColumn("kind", F.lit("dir"))
    return cascade.entry_columns(files.union(dirs).select(F.lit(0).alias("root"), F.lit("").alias("prefix"), F.col("rel").alias("abs"), "rel", "kind"))


def _ignore_rules(entries: DataFrame) -> DataFrame:
    own = entries.where("name = '.gitignore'").select("root", F.col("parent").alias("dir"), F.lit(IGNORED).alias("content"))
    return ignore_files.rules_of(own, ["root", "dir"])


_SOURCES = f"(SELECT {_PREFIX} AS s, doc_id, {PATH} AS path FROM {_DOCUMENTS})"
_GIT_SQL = f"""SELECT DISTINCT path AS rel, s || '/.gitignore: "*.log"' AS ignored_by FROM {_SOURCES} WHERE path LIKE '%.log' AND NOT regexp_matches(path, '/keep[^/]*$')
 UNION SELECT DISTINCT s || '/b/c', s || '/.gitignore: "/b/c/"' FROM {_SOURCES} WHERE doc_id % 14 IN (2, 10)"""


@_query(_GIT_SQL)
def gitignore_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the ignore files of the tree ignore by a rule of their own."""
    entries = _tree(spark, sf_dir)
    return ignore_files.ignored(entries, _ignore_rules(entries)).select("rel", "ignored_by")


NESTED = {"": "*.md\n*.tar.gz\nkeep*\n", "b": "!*.md\nREADME1*\n", "b/c": "!f1*.tar.gz\n/f*.html\n!/f2*.html\n", "a/b": "!/keep1*\n"}


@_query(f"""SELECT DISTINCT path AS rel, s || CASE WHEN doc_id % 14 = 6 THEN '/b/.gitignore: "README1*"' WHEN doc_id % 14 = 10 THEN '/b/c/.gitignore: "/f*.html"' WHEN doc_id % 14 = 2 THEN '/.gitignore: "*.tar.gz"' ELSE '/.gitignore: "keep*"' END AS ignored_by
 FROM {_SOURCES} WHERE (doc_id % 14 = 6 AND path LIKE '%/README1%') OR (doc_id % 14 = 10 AND path NOT LIKE '%/f2%') OR (doc_id % 14 = 2 AND path NOT LIKE '%/f1%') OR (doc_id % 14 NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) AND path NOT LIKE '%/keep1%')""")
def gitignore_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries ignored where ignore files on three levels take back what those above say."""
    entries = _tree(spark, sf_dir)
    levels = F.explode(F.array(*(F.struct(F.lit(d).alias("below"), F.lit(t).alias("content")) for d, t in NESTED.items()))).alias("level")
    own = entries.where("parent = '' and kind = 'dir'").select("root", "rel", levels)
    texts = own.select("root", F.concat("rel", F.when(F.col("level.below") == "", "").otherwise(F.concat(F.lit("/"), "level.below"))).alias("dir"), "level.content")
    return ignore_files.ignored(entries, ignore_files.rules_of(texts, ["root", "dir"])).select("rel", "ignored_by")


STARS = ["**/c/**", "src1/**/*.go", "a/**/b", "**.py", "**/.bash*"]


@_query(f"""SELECT doc_id, path, CASE WHEN regexp_matches(path, '(^|/)c/.') THEN '**/c/**' WHEN regexp_matches(path, '^src1/(.*/)?[^/]*[.]go(/|$)') THEN 'src1/**/*.go'
 WHEN regexp_matches(path, '^a/(.*/)?b(/|$)') THEN 'a/**/b' WHEN regexp_matches(path, '(^|/)[^/]*[.]py(/|$)') THEN '**.py' WHEN regexp_matches(path, '(^|/)[.]bash[^/]*(/|$)') THEN '**/.bash*' END AS pattern FROM {_PATHS}""")
def glob_globstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several patterns with double stars that matches each path."""
    return _paths(spark, sf_dir).select("doc_id", "path", PatternSet.parse(STARS).column(F.col("path")).alias("pattern"))


@_query(f"SELECT DISTINCT s || '/node_modules' AS rel, 'node' AS detector FROM {_SOURCES} WHERE doc_id % 14 = 5")
def smart_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories excluded by a marker above them."""
    return Detectors().excluded(_tree(spark, sf_dir)).select("rel", "detector")


@_query(f"SELECT DISTINCT s || '/build' AS rel, 'cmake' AS detector FROM {_SOURCES}")
def self_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that their own listing marks."""
    return Detectors().self_excluded(_tree(spark, sf_dir)).select("rel", "detector")


_CASCADE_SQL = f"""WITH p AS (SELECT * FROM {_SOURCES})
 SELECT DISTINCT s || '/.hidden' AS path, 'hidden' AS reason, 'hidden; use --hidden to count' AS detail FROM p WHERE doc_id % 14 = 4
 UNION SELECT DISTINCT s || '/.git', 'vcs', 'vcs metadata' FROM p WHERE doc_id % 14 = 7
 UNION SELECT DISTINCT s || '/.gitignore', 'hidden', 'hidden; use --hidden to count' FROM p
 UNION SELECT DISTINCT s || '/.bashrc', 'hidden', 'hidden; use --hidden to count' FROM p WHERE doc_id % 14 = 9
 UNION SELECT path, 'hidden', 'hidden; use --hidden to count' FROM p WHERE doc_id % 14 = 11
 UNION SELECT path, 'excluded', 'excluded by pattern "*.PY"' FROM p WHERE doc_id % 14 = 1
 UNION SELECT DISTINCT s || '/node_modules', 'smart', 'smart: node' FROM p WHERE doc_id % 14 = 5
 UNION SELECT DISTINCT s || '/build', 'smart', 'smart: cmake' FROM p
 UNION SELECT DISTINCT s || '/b/c', 'gitignored', 'gitignored by ' || s || '/.gitignore: "/b/c/"' FROM p WHERE doc_id % 14 IN (2, 10)"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = _tree(spark, sf_dir)
    return cascade.decide(cascade.own_reasons(entries, cascade.Rules(exclude=PatternSet.parse(["*.PY"])), _ignore_rules(entries)))


@_query(_CASCADE_SQL)
def cascade_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cascade skips, each with the first rule that holds, nothing below a skipped directory."""
    return _decided(spark, sf_dir)[1].select(F.col("rel").alias("path"), "reason", "detail")


@_query(f"SELECT DISTINCT path FROM {_SOURCES} WHERE doc_id % 14 IN (0, 3, 6, 8, 13) UNION SELECT DISTINCT s || '/package.json' FROM {_SOURCES}")
def cascade_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the cascade keeps."""
    return _decided(spark, sf_dir)[0].select(F.col("rel").alias("path"))


@_query(f"SELECT DISTINCT path FROM {_SOURCES} WHERE doc_id % 14 IN (0, 8, 13)")
def include_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files kept where only some patterns are included."""
    entries = _tree(spark, sf_dir)
    rules = cascade.Rules(exclude=PatternSet.parse(["*.PY"]), include=PatternSet.parse(["*.go", "*.md", "*.log"]))
    return cascade.decide(cascade.own_reasons(entries, rules, _ignore_rules(entries)))[0].select(F.col("rel").alias("path"))


@_query(f"SELECT DISTINCT path AS rel FROM {_SOURCES} WHERE doc_id % 3 = 0 AND doc_id % 14 IN (0, 3, 6, 8)")
def tracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files kept where only those in an index are tracked."""
    entries = _tree(spark, sf_dir)
    index = _paths(spark, sf_dir).where("doc_id % 3 = 0").select(F.lit(0).alias("root"), F.col("path").alias("rel"))
    rules = cascade.Rules(exclude=PatternSet.parse(["*.PY", "keep*.log"]))
    return cascade.decide(cascade.own_reasons(entries, rules, _ignore_rules(entries), index))[0].select("rel")


@_query(f"SELECT path || '.' || doc_id AS rel, CAST(doc_id AS VARCHAR) AS oid FROM {_SOURCES} WHERE doc_id % 4 <> 0")
def clean_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries whose object may be read: each document's path has the id behind it, every fourth is changed."""
    return _clean(_paths(spark, sf_dir), F.concat("path", F.lit("."), F.col("doc_id").cast("string")))


def _clean(paths: DataFrame, rel: Column) -> DataFrame:
    own = paths.select(F.lit(0).alias("root"), rel.alias("rel"), F.lit("100644").alias("mode"), F.col("doc_id").cast("string").alias("oid"), F.lit(0).alias("stage"), (F.col("doc_id") % 4 == 0).alias("dirty"))
    return clean_objects(own).select("rel", "oid")


@_query(f"SELECT doc_id, r AS root FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS r FROM {_SOURCES})")
def overlap_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that two roots reach stay with the first."""
    own = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("abs"))
    both = own.where("doc_id % 2 = 0").withColumn("root", F.lit(0)).union(own.withColumn("root", F.lit(1))).withColumn("rel", F.col("abs"))
    return scan.once_each(both)[0].select("doc_id", "root")


# --- duplicates and details -------------------------------------------------------------------

_HASHED = "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS h FROM documents"


@_query(f"SELECT path, CASE WHEN first < path THEN first END AS duplicate_of FROM (SELECT path, min(path) OVER (PARTITION BY h) AS first FROM ({_HASHED}))")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file each copy is a copy of."""
    return reports.unique_contents(_plain_files(spark, sf_dir)).select("path", "duplicate_of")


@_query(f"SELECT language, {_SUMS} FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM (SELECT lang AS language, path, h, lines, blank, CAST(0 AS BIGINT) AS comment, lines - blank AS code FROM ({_sql_plain('t', "(SELECT lang, CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents)", 'lang, path, h')}))) WHERE n = 1) GROUP BY language")
def loc_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per language with one file of each content."""
    return reports.language_totals(reports.unique_contents(_plain_files(spark, sf_dir)).where("duplicate_of is null"))


@_query(f"SELECT language, path, lines, blank, comment, code FROM (SELECT lang AS language, CAST(doc_id AS VARCHAR) AS path, lines, blank, CAST(0 AS BIGINT) AS comment, lines - blank AS code FROM ({_sql_plain("coalesce(text, '')", 'documents', 'lang, doc_id')}))")
def by_file_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per file, by language and path."""
    return _plain_files(spark, sf_dir).select("language", "path", "lines", "blank", "comment", "code").orderBy("language", "path")


_TOTALS = f"SELECT coalesce(language, '(none)') AS name, {_SUMS} FROM ({_PLAIN_DOCS}) GROUP BY ALL"
_REPORT = f"""WITH l AS ({_TOTALS}), t AS (SELECT CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines, CAST(coalesce(sum(blank), 0) AS BIGINT) AS blank,
 CAST(coalesce(sum(comment), 0) AS BIGINT) AS comment, CAST(coalesce(sum(code), 0) AS BIGINT) AS code FROM l)"""
_WIDTHS = f"""{_REPORT}, w AS (SELECT greatest(22, max(strlen(name)) + 2) AS a, greatest(12, max(greatest(len(CAST(files AS VARCHAR)), len(CAST(blank AS VARCHAR)), len(CAST(comment AS VARCHAR)), len(CAST(code AS VARCHAR)))) + 2) AS b
 FROM (SELECT * FROM l UNION ALL SELECT 'Total', * FROM t)), r AS (SELECT repeat('-', CAST(a + 4 * b AS BIGINT)) || chr(10) AS r FROM w)"""


def _sql_row(name: str) -> str:
    numbers = " || ".join(f"lpad(CAST({x} AS VARCHAR), CAST(b AS INTEGER), ' ')" for x in ("files", "blank", "comment", "code"))
    return f"rpad({name}, CAST(a AS INTEGER), ' ') || {numbers} || chr(10)"


def _sql_fields(before: str, after: str, quote: str = "") -> str:
    fields = [f"'{before}{quote}{x}{quote}: ' || {x}" for x in reports.MEASURES]
    return f" || '{after}' || chr(10) || ".join(fields)


_HEAD_ROW = " || ".join(f"lpad('{x}', CAST(b AS INTEGER), ' ')" for x in ("Files", "Blank", "Comment", "Code"))
#: The three forms of a report, written by string functions of DuckDB.
_FORMS = {
    "table": f"""{_WIDTHS} SELECT 'table' AS format, r || rpad('Language', CAST(a AS INTEGER), ' ') || {_HEAD_ROW} || chr(10) || r ||
 coalesce((SELECT string_agg({_sql_row('name')}, '' ORDER BY code DESC, name) FROM l, w), '') || r || (SELECT {_sql_row("'Total'")} FROM t, w) || r AS report FROM w, r""",
    "json": f"""{_REPORT} SELECT 'json' AS format, '{{' || chr(10) || '  "schema_version": 1,' || chr(10) || '  "languages": [' || chr(10) ||
 (SELECT string_agg('    {{' || chr(10) || '      "name": "' || name || '",' || chr(10) || {_sql_fields("      ", ",", '"')} || chr(10) || '    }}', ',' || chr(10) ORDER BY code DESC, name) FROM l) || chr(10) || '  ],' || chr(10) ||
 '  "totals": {{' || chr(10) || (SELECT {_sql_fields("    ", ",", '"')} FROM t) || chr(10) || '  }},' || chr(10) || '  "excluded": []' || chr(10) || '}}' || chr(10) AS report""",
    "yaml": f"""{_REPORT} SELECT 'yaml' AS format, 'schema_version: 1' || chr(10) || 'languages:' || chr(10) ||
 (SELECT string_agg('  - name: ' || name || chr(10) || {_sql_fields("    ", "")} || chr(10), '' ORDER BY code DESC, name) FROM l) || 'totals:' || chr(10) || (SELECT {_sql_fields("  ", "")} FROM t) || chr(10) || 'excluded: []' || chr(10) AS report""",
}


def _written(name: str) -> None:
    def own(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _plain_files(spark, sf_dir).withColumn("language", F.coalesce("language", F.lit("(none)")))
        return spark.createDataFrame([(name, reports.formatter(name)(reports.build(files)))], "format string, report string")

    own.__name__ = f"report_{name}"
    own.__doc__ = f"The report of plain-text counts as {name}; documents without a language are '(none)'."
    _query(_FORMS[name])(own)


for _name in reports.FORMATS:
    _written(_name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of many languages: languages by path, lines by the classifier on bytes, totals per language."""
    own = shebangs.with_path_language(_paths(spark, sf_dir), "path", REGISTRY).where("language is not null")
    counted = lines.classify(own.withColumn("content", F.coalesce("text", F.lit("")).cast("binary")), "content", "language", REGISTRY, ["path", "language"])
    return reports.with_total(counted.where("not is_binary"))


def _sql_flagship() -> str:
    """The union of every language's own lexer over the documents that its paths name."""
    parts = []
    for name, language in sorted(REGISTRY.languages.items()):
        if {"Go", "Python", "Makefile", "Rust", "JavaScript", "Markdown", "HTML", "SQL", "Shell"} & {name}:
            rows = f"(SELECT doc_id, coalesce(text, '') AS body_text FROM ({_NAMED}) WHERE language = '{name}')"
            counts = f"SELECT doc_id, lines, blank, CAST(0 AS BIGINT) AS comment, lines - blank AS code FROM ({_sql_plain('body_text', rows, 'doc_id')})" if language.plain else _sql_lexer("body_text", rows, "doc_id", language)
            parts.append(f"SELECT '{name}' AS language, * FROM ({counts})")
    return f"SELECT language, {_SUMS} FROM ({' UNION ALL '.join(parts)}) GROUP BY ROLLUP (language)"


def loc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of many languages, counted and summed; see :func:`flagship`."""
    return flagship(spark, sf_dir)


_query(_sql_flagship())(loc_report)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return QUERIES | scan_catalogue.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return ORACLES | scan_catalogue.ORACLES
