"""Near-duplicates, components and exact search against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linetide.llm import frames, graph, shingle_dedup, simhash, topk, vector_dedup


def plain_components(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(40)] + [(200, 200), (301, 300), (300, 301)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(50)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == plain_components({x for e in edges for x in e}, edges)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_the_plain_ones():
    rng = random.Random(4)
    texts = ["", " \n", "One", "One two", "É a É b\tc", "a b c " * 700] + [" ".join(rng.choice(["a", "Bb", "ç", "dd"]) for _ in range(rng.randrange(1, 60))) for _ in range(100)]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    rows = [(k, base + (f" z{k % 7}" * (k % 3))) for k in range(60)] + [(100 + k, " ".join(f"v{rng.randrange(9999)}" for _ in range(30))) for k in range(40)]
    rows += [(200, None), (201, ""), (202, " "), (7, base), (None, base), (None, "alone in the world")]
    docs = spark.createDataFrame([(i, t, "c", 5, "k", 7) for i, t in rows], "doc_id bigint, text string, fp string, component_id int, kept string, n int")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_components(list(prints), pairs)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert sorted(str(r["component_id"]) for r in found if r["doc_id"] is None) == sorted(["None", str(want[0])])
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_the_tally_tells_how_many_bytes_are_shared():
    places = [{p for p in range(8) if m >> (8 * p) & 0xFF} for m in simhash.LISTS]
    assert len(places) == 14 and all(len(x) == 4 for x in places)
    for n in range(9):
        for same in map(set, combinations(range(8), n)):
            met = sum(x <= same for x in places)
            assert (met >= simhash.MEETINGS) == (n >= 6), same


def test_texts_under_one_id_are_rows_of_their_own(spark):
    rng = random.Random(12)
    one, other, near = ([f"{c}{rng.randrange(900)}" for _ in range(300)] for c in "abc")
    near = one[:150] + ["edited"] + one[151:]
    rows = [(5, " ".join(one)), (5, " ".join(other)), (5, " ".join(one)), (5, " ".join(near)), (9, " ".join(one)), (None, " ".join(other)), (None, "z y x"), (None, "z y x"), (6, None), (6, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, kept_id int")
    for module in (simhash, shingle_dedup):
        kept = module.without_near_duplicates(docs)
        assert kept.columns == docs.columns
        found = sorted((str(r["doc_id"]), (r["text"] or "")[:1]) for r in kept.collect())
        if module is shingle_dedup:
            assert found == [("5", "a"), ("5", "b"), ("6", ""), ("None", "z")]
        else:
            prints = {plain_fingerprint(t): (str(i), (t or "")[:1]) for i, t in reversed(rows)}
            groups = set(plain_components(list(prints), [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]).values())
            assert len(found) == len(groups) and {("5", "a"), ("5", "b"), ("6", ""), ("None", "z")} <= set(found)


def test_facts_of_hot_keys_are_sent(spark, monkeypatch):
    monkeypatch.setattr(frames, "HOT_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as key")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = frames.join_facts(rows, facts, ["key"], "n")
    assert sorted(map(tuple, found.select("id", "key", "least").collect())) == sorted((k, 7 if k % 3 == 0 else k, 0 if k % 3 == 0 else k) if k != 7 else (7, 7, 0) for k in range(1000))


@pytest.mark.parametrize("long", [2, 32])
def test_links_of_long_and_short_lists(spark, monkeypatch, long):
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()]
    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert plain_components(signed, edges) == plain_components(signed, every)
    assert {tuple(sorted(e)) for e in edges} <= set(every)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 24)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    rows = [(k, (centres[k % 12] + rng.normal(size=32) * 0.12).tolist()) for k in range(300)] + [(1000 + k, rng.normal(size=32).tolist()) for k in range(300)]
    rows += [(2000 + k, rows[5][1]) for k in range(40)] + [(2100, (np.array(rows[5][1]) * 1e200).tolist()), (2101, (np.array(rows[5][1]) * 1e-200).tolist())]
    bad = [(3000, None), (3001, [0.0] * 32), (3002, [float("nan")] * 32), (3003, [None] * 32), (3004, []), (3005, [float("inf")] * 32), (3006, [1.0, 2.0]), (3007, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows + bad], "vec_id bigint, embedding array<double>, n_links int, vector string")
    found = {r["vec_id"]: r for r in vector_dedup.near_duplicates(df).collect()}
    assert len(found) == len(rows + bad)
    x = vector_dedup.unit(np.array([v for _, v in rows]))
    linked = x @ x.T >= vector_dedup.COSINE
    ids = [i for i, _ in rows]
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True)]
    degree = dict(zip(ids, linked.sum(axis=1) - 1, strict=True))
    got = sum(found[i]["n_links"] for i in ids)
    assert got >= 0.9 * sum(degree.values()) and all(found[i]["n_links"] <= degree[i] for i in ids)
    want = plain_components(ids, pairs)
    assert np.mean([found[i]["component_id"] == want[i] for i in ids]) > 0.95
    for i, _ in bad[:6]:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert (found[3007]["n_links"], found[3007]["component_id"], found[3007]["kept"]) == (1, 3006, False)
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("batch", [1 << 24, 900])
def test_top_k_equals_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "BATCH", batch)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 24)) * 0.15
    vectors[100:120] = vectors[100]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, [3e3] * 24), (1050, [-3e3] * 24), (50, vectors[7].tolist()), (50, vectors[50].tolist())]
    bad = [(5000, None), (5050, [None] * 24), (5100, [float("nan")] * 24), (None, [0.1] * 24), (5150, [1.0, 2.0]), (5200, [-1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows + bad], "vec_id bigint, embedding array<double>, rank int").repartition(3)
    found = sorted(tuple(r) for r in topk.exact_top_k(df, lambda i: i % 50 == 0).collect())
    want = []
    for group in (rows, bad[4:]):
        q = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in group]
        for n, (i, v) in enumerate(q):
            if i % 50 == 0:
                best = sorted((-int(v @ w), j) for m, (j, w) in enumerate(q) if m != n)[:5]
                want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert found == sorted(want)
    assert topk.exact_top_k(df.where("false"), lambda i: i % 50 == 0).count() == 0


def test_vectors_too_long_for_a_score_are_refused(spark):
    with pytest.raises(Exception, match="too long"):
        topk.exact_top_k(spark.createDataFrame([(0, [1e17]), (50, [1.0])], "vec_id bigint, embedding array<double>"), lambda i: i % 50 == 0).collect()


@pytest.mark.parametrize("scale", [3, 60, 10**5, 10**8])
def test_search_stops_on_proof_and_is_exact(scale):
    rng = np.random.default_rng(1)
    rows = rng.integers(-3, 4, size=(500, 16))
    rows[:5] = 200
    index = topk.ImpactIndex(np.arange(500), np.arange(500), rows)
    found = index.search(np.array([-1]), np.full((1, 16), 100), 5)
    assert sorted(found[1].tolist()) == [0, 1, 2, 3, 4] and set(found[2].tolist()) == {16 * 200 * 100}
    rows = (rng.normal(size=(700, 12)) * scale).astype(np.int64)
    rows[rng.random(rows.shape) < 0.4] = 0
    ids = rng.permutation(700)
    index = topk.ImpactIndex(np.arange(700), ids, rows)
    for k in (1, 5, 900):
        query, row, score = index.search(np.arange(40), rows[:40], k)
        for q in range(40):
            want = sorted((-int(rows[q] @ rows[j]), int(ids[j])) for j in range(700) if j != q)[:k]
            assert sorted((-int(s), int(ids[j])) for x, j, s in zip(query, row, score) if x == q) == want
