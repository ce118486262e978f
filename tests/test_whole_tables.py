"""Queries that take every document, whatever its text or id."""

import pytest

from linetide.functions import lines
from linetide.plans import catalogue


@pytest.fixture
def tables(spark, tmp_path):
    texts = ["a", "é" * 5000, "x" * 8191 + "é", "b\0", "é" * 4000, None, "日本\0"] * 4
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(None, "é\0", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_every_document_is_sniffed(spark, tables):
    path, rows = tables
    want = sorted((str(i), lines.is_binary(((t or "") + ("\0" if i is not None and i % 5 == 0 else "")).encode())) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["is_binary"]) for r in catalogue.queries()["binary_sniff"](spark, path).collect()) == want


def test_every_clean_document_is_in_the_index(spark, tables):
    path, rows = tables
    found = catalogue.queries()["clean_index"](spark, path).collect()
    ids = [-1 if i is None else i for i, *_ in rows]
    assert sorted(int(r["oid"]) for r in found) == sorted(i for i in ids if i % 4)
    assert len({r["rel"] for r in found}) == len(found)
