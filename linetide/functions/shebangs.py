"""Language lookups as column expressions and broadcast joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .languages import Registry
from .lines import SPACE

#: Bytes of a file that are searched for a shebang.
HEAD = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELD = f"[\n{SPACE}]+"


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(base: Column) -> Column:
    """The folded text after a file name's last dot; null without a dot or text."""
    ext = F.when(base.contains("."), F.substring_index(base, ".", -1))
    short = F.octet_length(ext) <= 8
    return F.when(ext != "", F.when(short, F.translate(ext, _UPPER, _LOWER)).otherwise(F.lower(ext)))


def lookup(spark: SparkSession, owners: dict[str, str], key: str, value: str) -> DataFrame:
    """A registry's table as a small DataFrame; its size is the registry's, so it may be broadcast."""
    rows = sorted(owners.items()) or [("", None)]
    return F.broadcast(spark.createDataFrame(rows, f"{key} string, {value} string"))


def interpreter(head: Column) -> Column:
    """The program that a shebang line names (after ``env`` its first plain argument); null without one."""
    line = F.substring_index(F.substring(head, 3, HEAD), "\n", 1)
    fields = F.filter(F.split(line, _FIELD), lambda x: x != "")
    first = basename(F.element_at(fields, 1))
    rest = F.filter(F.slice(fields, 2, HEAD), lambda x: ~x.startswith("-") & ~x.contains("="))
    found = F.when(first == "env", F.when(F.size(rest) > 0, basename(F.element_at(rest, 1)))).otherwise(first)
    return F.when(head.startswith("#!") & (F.size(fields) > 0), found)


def with_path_language(df: DataFrame, path: str, registry: Registry, into: str = "language") -> DataFrame:
    """Adds the language of each path: by exact file name, else by extension; null if neither is known."""
    spark = df.sparkSession
    base = basename(F.col(path))
    named = df.withColumn("_base", base).withColumn("_ext", extension(base))
    named = named.join(lookup(spark, registry.by_filename, "_base", "_by_name"), "_base", "left").join(lookup(spark, registry.by_extension, "_ext", "_by_ext"), "_ext", "left")
    return named.select(*df.columns, F.coalesce("_by_name", "_by_ext").alias(into))


def with_shebang_language(df: DataFrame, head: str, registry: Registry, into: str = "language") -> DataFrame:
    """Adds the language of each text's shebang, tried as it is and without its trailing version; null if unknown."""
    spark = df.sparkSession
    named = df.withColumn("_exact", interpreter(F.substring(F.col(head).cast("string"), 1, HEAD))).withColumn("_bare", F.regexp_replace("_exact", "[0-9.]+$", ""))
    named = named.join(lookup(spark, registry.by_shebang, "_exact", "_by_exact"), "_exact", "left").join(lookup(spark, registry.by_shebang, "_bare", "_by_bare"), "_bare", "left")
    return named.select(*df.columns, F.coalesce("_by_exact", "_by_bare").alias(into))


def sniffable(base: Column) -> Column:
    """Whether a file of unknown name may be searched for a shebang: it has no extension after one leading dot."""
    bare = F.regexp_replace(base, r"^\.", "")
    return ~bare.contains(".") | bare.endswith(".")
