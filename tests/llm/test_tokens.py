"""Tokens: the automaton, longest match, packing, over all kinds of rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linetide.llm import bpe, packing, token_counts

WORDS = bpe.WordTokenizer(bpe.vocabulary_file())
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PIECES = ["a", "e", "in", "th", "o", "1", "²", "'s", "'re", "'x", "!", "!!", "é", "ß", "語", "🙂", "S", "Σ", "İ", "\x1c", "\x00", "\xa0", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "́", "q" * 40]
ROWS = [(1, "Hello, it's <|endoftext|> World's!"), (1, "Hello, it's <|endoftext|> World's!"), (2, None), (3, ""), (4, " \n\t"), (None, "null id"), (5, "x" * 5000 + " naïve " * 3000), (6, "...!?")]


def made(n, most=30, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(most))) for _ in range(n)]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_encoding_and_decoding_are_the_librarys():
    texts = made(1500) + [t for _, t in ROWS if t]
    keys, codes = WORDS.split_documents(texts)
    ids = WORDS.encode_words(keys)
    for text, own in zip(texts, codes, strict=True):
        found = [i for k in own.tolist() for i in ids[k]]
        assert found == library(text), text
        assert WORDS.decode(found) == LIBRARY.decode(found, skip_special_tokens=False)


def test_words_of_few_letters():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinorstl"[: rng.randrange(1, 10)]) for _ in range(rng.randrange(1, 27))) for _ in range(5000)]
    for word, ids in zip(words, WORDS.automaton.encode_many(words), strict=True):
        assert ids == library(word) == WORDS.automaton.encode(word), word


def test_gadgets_on_repeated_symbols():
    vocab = {s: k for k, s in enumerate(["a", "b", "a</w>", "b</w>", "aa", "aab", "aa</w>", "aaaa"])}
    merges = [("a", "a"), ("aa", "b"), ("a", "a</w>"), ("aa", "aa")]
    automaton = bpe.TokenAutomaton(vocab, merges)

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            k = 0
            while k + 1 < len(parts):
                if (parts[k], parts[k + 1]) == (a, b):
                    parts[k : k + 2] = [a + b]
                k += 1
        return [vocab[p] for p in parts]

    rng = random.Random(0)
    for _ in range(400):
        word = "".join(rng.choice("aaab") for _ in range(rng.randrange(1, 12)))
        assert automaton.encode(word) == plain(word), word


def test_unsupported_vocabulary_is_refused():
    with pytest.raises(ValueError):
        bpe.WordTokenizer(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def test_longest_match_counts_equal_the_plain_greedy_split():
    match = token_counts.LongestMatch(WORDS.automaton.ids)

    def plain(word):
        symbols = [*word[:-1], word[-1] + "</w>"]
        at = n = 0
        while at < len(symbols):
            at = next(j for j in range(len(symbols), at, -1) if "".join(symbols[at:j]) in WORDS.automaton.ids)
            n += 1
        return n

    rng = random.Random(1)
    for _ in range(2000):
        word = "".join(rng.choice("aeinorstlqz") for _ in range(rng.randrange(1, 25)))
        assert match.count(word) == plain(word)
    with pytest.raises(ValueError):
        token_counts.LongestMatch(["ab"])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id bigint, text string, id string, length int")


def test_digests_counts_and_ids_of_all_rows(spark, docs):
    found = bpe.token_digests(docs).collect()
    assert len(found) == len(ROWS)
    want = sorted((str(i), len(library(t or "")), hashlib.sha256(" ".join(map(str, library(t or ""))).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(library(t or ""), skip_special_tokens=False).encode()).hexdigest()) for i, t in ROWS)
    assert sorted((str(r[0]), *r[1:]) for r in found) == want
    counts = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect()}
    assert counts[2] == counts[3] == counts[4] == (0, 0) and counts[6][0] == 1
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs).collect()}[6] == library("...!?")
    for empty in (bpe.token_digests, token_counts.count_tokens, bpe.encode_documents, packing.pack_documents):
        assert empty(docs.where("false")).count() == 0


def check_packing(rows, texts, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    total = 0
    for i, text in texts:
        ids = np.array([*library(text or ""), 0], dtype="<u4")
        total += len(ids)
        own = sorted((r for r in by[i] if r["start"] == r["piece"] * capacity), key=lambda r: r["piece"])
        pieces = {(r["start"], r["length"], r["ids_crc32"]) for r in own}
        assert pieces >= {(a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for a in range(0, len(ids), capacity)}
    assert sum(r["length"] for r in rows) == total
    return len(places), -(-total // capacity)


def test_packing_is_gapless_whole_and_tight(spark, docs):
    bins, least = check_packing(packing.pack_documents(docs, with_ids=True).collect(), ROWS, packing.CAPACITY)
    assert bins <= least + 1
    many = [(k, "w " * (k * 37 % 300)) for k in range(400)]
    bins, least = check_packing(packing.pack_documents(spark.createDataFrame(many, "doc_id bigint, text string").repartition(5), capacity=512).collect(), many, 512)
    assert bins <= least + 1


def test_patterns_use_up_the_histogram():
    rng = random.Random(5)
    for _ in range(30):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 2000) for _ in range(rng.randrange(1, 40))}
        patterns = packing.best_two_fit(histogram, 100)
        used = {}
        for times, content in patterns:
            assert times > 0 and sum(content) <= 100
            for x in content:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        places = packing.Places(patterns)
        seen = set()
        for length, n in histogram.items():
            bins, offsets = places.find(length, np.arange(n))
            own = set(zip(bins.tolist(), offsets.tolist(), strict=True))
            assert len(own) == n and not own & seen
            seen |= own
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 20: 1}, 100)[0] == (1, [60, 20, 20]) or packing.best_two_fit({60: 1, 30: 1, 22: 1, 18: 1}, 100)[0] == (1, [60, 22, 18])
    with pytest.raises(ValueError):
        packing.best_two_fit({101: 1}, 100)
