"""Near-duplicates by shingle similarity against brute force."""

import random

import pytest

import corpus_pipeline
from linetide.llm import shingle_dedup

from test_pairs import plain_components


def plain_similar(one, other):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (one, other))
    return not (a | b) or len(a & b) / len(a | b) >= 0.8


def copies(rng, n_words, edits):
    one = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    other = list(one)
    for k in rng.sample(range(n_words), edits):
        other[k] = "edited"
    return " ".join(one), " ".join(other)


def test_the_stage_keeps_one_of_near_copies(spark):
    rng = random.Random(3)
    pairs = [copies(rng, n, edits) for n, edits in ((100, 1), (300, 1), (300, 2), (300, 6)) for _ in range(20)]
    assert all(plain_similar(*p) for p in pairs)
    docs = spark.createDataFrame([(2 * k + j, p[j]) for k, p in enumerate(pairs) for j in (0, 1)], "doc_id bigint, text string")
    kept = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [2 * k for k in range(len(pairs))]


@pytest.mark.parametrize("many", [0, 2, 10**9])
def test_components_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(shingle_dedup, "MANY", many)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(90):
        words = list(base)
        for k in rng.sample(range(0, 120, 5), rng.randrange(8)):
            words[k] = f"z{rng.randrange(3)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(999)}" for _ in range(30)) for _ in range(20)] + ["One two", "one  TWO", "one two three", None, "", " \n", texts[0].upper(), texts[0]]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[3]), (None, "alone in the world")]
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id bigint, text string, kept string, n int")
    found = shingle_dedup.near_duplicates(docs).collect()
    want = plain_components(list(range(len(texts))), [(a, b) for a in range(len(texts)) for b in range(a) if plain_similar(texts[a], texts[b])])
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    assert sorted(str(r["component_id"]) for r in found if r["doc_id"] is None) == sorted(["None", str(want[3])])
    kept = shingle_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert shingle_dedup.near_duplicates(docs.where("false")).count() == 0


def test_fingerprints_are_simhashes_and_similar_ones_share_a_list():
    rng = random.Random(7)
    sets = []
    for _ in range(40):
        one, other = copies(rng, 300, 6)
        sets += [list({*shingle_dedup.shingles(t.encode())}) for t in (one, other)]
    sets += [[], [b"alone"]]
    found = shingle_dedup.fingerprints(sets)
    bits = shingle_dedup.np.unpackbits(found, axis=1, bitorder="little")
    assert not found[-2].any()
    single = [shingle_dedup.np.unpackbits(shingle_dedup.fingerprints([[s]]), bitorder="little").astype(int) for s in sets[0]]
    assert (bits[0] == (2 * sum(single) > len(single))).all()
    for a in range(0, 80, 2):
        same = (found[a] == found[a + 1]).reshape(-1, 3).sum(axis=1)
        assert (same >= 2).any()


def test_a_large_group_below_the_similarity_is_not_verified_pair_by_pair(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for n in range(300):
        at = rng.randrange(0, 136)
        texts.append(" ".join(base[:at] + [f"own{n}x{k}" for k in range(14)] + base[at + 14 :]))
    seen = []
    verified = shingle_dedup._verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingle_dedup, "_verified", counted)
    monkeypatch.setattr(shingle_dedup, "PEEL", 0, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs).collect()}
    assert found == plain_components(list(range(300)), [(a, b) for a in range(300) for b in range(a) if plain_similar(texts[a], texts[b])])
    assert sum(seen) < 40 * len(texts)


def test_members_of_a_large_group_are_compared_with_few(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for n in range(400):
        words = list(base)
        for k in rng.sample(range(150), 1 + n % 6):
            words[k] = f"own{n}x{k}"
        texts.append(" ".join(words))
    seen = []
    counted = shingle_dedup._counted

    def noted(pairs, *rest):
        seen.append(pairs.count())
        return counted(pairs, *rest)

    monkeypatch.setattr(shingle_dedup, "_counted", noted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs).collect()}
    assert found == plain_components(list(range(401)), [(a, b) for a in range(401) for b in range(a) if plain_similar(texts[a], texts[b])])
    assert sum(seen) < 4 * len(texts)


def test_texts_without_a_near_one_are_not_near_by_chance(spark):
    rng = shingle_dedup.np.random.default_rng(17)
    prints = rng.integers(0, 256, size=(20000, shingle_dedup.BYTES), dtype="uint8")
    facts = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(prints)], "node bigint, fp binary")
    near = shingle_dedup._near(shingle_dedup._postings(facts))
    assert near.count() < 20
