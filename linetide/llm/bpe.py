"""BPE as a deterministic automaton over tokens, and the word split in front of it.

Compilation starts from the one-state automaton that loops on every base symbol
and applies one gadget for each merge ``a b -> c`` in order of rank: wherever an
arc ``a`` leads to a state with an arc ``b``, the arc ``b`` is taken out of (a copy of)
that state and an arc ``c`` is laid from the first state to where ``b`` led.  The
automaton then accepts exactly the token sequences that BPE produces.

All arcs with the same label lead to the same state at any time, so a state is
named by the token that enters it, and what a gadget changes is one removed arc
with its rank.  A state made for ``c`` is a snapshot of the state of ``b``, and the arc
``c`` is laid wherever ``a`` could be read at that moment; both are kept as references
(right and left part, rank) in place of 49,000 x 49,000 copied arcs.  A transition is
resolved from these tables once and then looked up.

Encoding reads a word left to right.  For each prefix there is one accepted token
sequence, so one state is kept for each position: the label whose arc exists from
the state where it starts.  The labels on the path are the ids.  Decoding emits the labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from itertools import chain

import numpy as np
import regex

from .frames import Generations
from .word_blocks import fast_bytes, split_words

#: The word split of the supported vocabulary files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Beyond these characters Unicode versions of the libraries differ, and the tokenizer's own split is used.
_OLD = regex.compile("[\\u0000-\\u024f\\u2000-\\u206f]*")
_SPACE = regex.compile(r"\s+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Documents whose new words are encoded together.
ROWS = 1024
#: Symbols up to which words are stepped through the tables together.
_TOGETHER = 28
_ODD = np.uint64(0x9E3779B97F4A7C15)


def step_hash(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more symbol in front."""
    hashes = (hashes ^ codes) * _ODD
    return hashes ^ (hashes >> np.uint64(31))


class LabelTable:
    """Labels by the hash of their symbols, last symbol first: an open table of 64-bit hashes."""

    def __init__(self, labels: dict[str, int], final: bool):
        self.salt = np.uint64(0x1F83D9ABFB41BD6B if final else 0x5BE0CD19137E2179)
        hashes = np.full(len(labels), self.salt)
        texts = list(labels)
        sizes = np.array([len(x) for x in texts])
        for k in range(int(sizes.max(initial=0))):
            own = np.flatnonzero(sizes > k)
            hashes[own] = step_hash(hashes[own], np.array([ord(texts[j][-1 - k]) for j in own], dtype=np.uint64))
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two labels have one hash")
        bits = max(4, int(len(labels) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int64)
        self.probes = 1
        for h, label in zip(hashes, labels.values(), strict=True):
            at, probes = int(h >> self.shift), 1
            while self.values[at] >= 0:
                at, probes = (at + 1) & self.mask, probes + 1
            self.keys[at], self.values[at] = h, label
            self.probes = max(self.probes, probes)
        #: Read first: a byte for each place fits where the hashes do not.
        self.taken = self.values >= 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are labels, and the labels."""
        slot = (hashes >> self.shift).astype(np.int64)
        open_ = np.flatnonzero(self.taken[slot])
        slot, wanted = slot[open_], hashes[open_]
        at, label = [], []
        for _ in range(self.probes):
            hit = self.keys[slot] == wanted
            at.append(open_[hit])
            label.append(self.values[slot[hit]])
            slot = (slot + 1) & self.mask
            more = ~hit & self.taken[slot]
            if not more.any():
                break
            open_, slot, wanted = open_[more], slot[more], wanted[more]
        return (at[0], label[0]) if len(at) == 1 else (np.concatenate(at), np.concatenate(label))


class ArcTable:
    """Transitions met so far, in a table of one place for each hash; what is not there is resolved and put there."""

    def __init__(self, resolve, bits: int = 20):
        self.resolve, self.shift = resolve, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, dtype=np.uint64), np.zeros(1 << bits, dtype=bool)

    def has(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        keys = (states.astype(np.uint64) << np.uint64(32)) | labels.astype(np.uint64)
        slot = ((keys * _ODD) >> self.shift).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            found = np.array([self.resolve(int(k >> np.uint64(32)), int(k & np.uint64(0xFFFFFFFF)), float("inf")) for k in new], dtype=bool)
            out[miss] = found[back]
            places = slot[miss][first]
            self.keys[places], self.values[places] = new, found
        return out


class TokenAutomaton:
    """The automaton of one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>", cache: int = 200_000):
        self.ids, self.suffix, self.cache = vocab, suffix, cache
        self.label = {i: s for s, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        self.laid = {vocab[x] for x in vocab if len(x.removesuffix(suffix)) <= 1}
        self.table: dict[tuple[int, int], bool] = {}
        for at, (a, b) in enumerate(merges):
            self._gadget(at, vocab[a], vocab[b], vocab[a + b])
        self.table.clear()
        self.labels_by_hash = self.arcs = None
        self.longest = max((len(s.removesuffix(suffix)) for s, i in vocab.items() if i in self.laid), default=1)
        self.inner = {s: i for s, i in vocab.items() if i in self.laid and not s.endswith(suffix)}
        self.final = {s.removesuffix(suffix): i for s, i in vocab.items() if i in self.laid and s.endswith(suffix)}

    def _gadget(self, at: int, a: int, b: int, c: int) -> None:
        """Applies merge number ``at``; a merge whose two arcs never meet lays no arc."""
        if c in self.rank or c in self.laid:
            raise ValueError(f"token {self.label[c]!r} is made by two merges")
        if a not in self.laid or b not in self.laid or not self._arc(a, b, at):
            return
        self.removed[a, b] = at
        self.rank[c], self.left[c], self.right[c] = at, a, b
        self.laid.add(c)

    def _arc(self, state: int, label: int, when: float) -> bool:
        """Whether the state entered by ``state`` has an arc ``label`` after all gadgets before ``when``."""
        removed, rank, left = self.removed, self.rank, self.left
        until = when
        while True:
            read, known = label, when
            at = removed.get((state, read))
            if at is not None and at < until:
                return False
            while read in rank:
                known, read = rank[read], left[read]
                at = removed.get((state, read))
                if at is not None and at < until and at <= known:
                    return False
            if state not in rank:
                return True
            until = min(until, rank[state])
            state = self.right[state]

    def has(self, state: int, label: int) -> bool:
        """The transition table: does ``label`` leave the state entered by ``state``?"""
        found = self.table.get((state, label))
        if found is None:
            if len(self.table) >= self.cache:
                self.table.clear()
            found = self.table[state, label] = self._arc(state, label, float("inf"))
        return found

    def encode_many(self, words: list[str]) -> list[list[int]]:
        """Ids of non-empty words: those of one length step through the tables together."""
        if self.labels_by_hash is None:
            self.labels_by_hash = LabelTable(self.inner, False), LabelTable(self.final, True)
            self.arcs = ArcTable(self._arc)
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for n, own in by_length.items():
            if n > _TOGETHER or len(own) < 8:
                for k in own:
                    out[k] = self.encode(words[k])
                continue
            for k, ids in zip(own, self._encode_equal([words[k] for k in own], n), strict=True):
                out[k] = ids
        return out

    def _encode_equal(self, words: list[str], n: int) -> list[list[int]]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n).astype(np.uint64)
        enters = np.full((n + 1, len(words)), -1, dtype=np.int64)
        starts = np.zeros((n + 1, len(words)), dtype=np.int64)
        for end in range(1, n + 1):
            table = self.labels_by_hash[end == n]
            hashes = np.full(len(words), table.salt)
            for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                hashes = step_hash(hashes, codes[:, start])
                at, label = table.find(hashes)
                if start and len(at):
                    state = enters[start][at]
                    keep = state >= 0
                    at, label = at[keep], label[keep]
                    keep = self.arcs.has(state[keep], label)
                    at, label = at[keep], label[keep]
                enters[end][at], starts[end][at] = label, start
        found = np.zeros((len(words), n), dtype=np.int64)
        size = np.zeros(len(words), dtype=np.int64)
        end, row = np.full(len(words), n), np.arange(len(words))
        while len(row):
            size[row] += 1
            found[row, n - size[row]] = enters[end[row], row]
            end[row] = starts[end[row], row]
            row = row[end[row] > 0]
        return [ids[n - k :] for ids, k in zip(found.tolist(), size.tolist(), strict=True)]

    def encode(self, word: str) -> list[int]:
        """Ids of a non-empty word given as byte symbols."""
        n, longest, has = len(word), self.longest, self.has
        enters = [-1] * (n + 1)
        starts = [0] * (n + 1)
        for end in range(1, n + 1):
            labels = self.final if end == n else self.inner
            for start in range(max(0, end - longest), end):
                label = labels.get(word[start:end])
                if label is not None and (start == 0 or (enters[start] >= 0 and has(enters[start], label))):
                    enters[end], starts[end] = label, start
                    break
        out, end = [], n
        while end:
            out.append(enters[end])
            end = starts[end]
        return out[::-1]


class WordTokenizer:
    """Special strings, normalisation and word split in front of a :class:`TokenAutomaton`.

    Takes the content of a ``tokenizers`` JSON file with NFC, collapsed white space, lower
    case and byte-level symbols; other pipelines are refused.  White space never
    belongs to a word, so a text is encoded chunk by chunk between white space.
    """

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
        split, level = steps if len(steps) == 2 else ({}, {})
        if (
            model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split.get("pattern") != {"Regex": SPLIT} or not split.get("invert")
            or level.get("use_regex", True) or level.get("add_prefix_space", True) or model.get("continuing_subword_prefix") or not model.get("end_of_word_suffix")
        ):
            raise ValueError("this vocabulary file's normalisation or split is not supported")
        merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = self.automaton.label | {i: s for s, i in self.special.items()}
        self._content, self._own = content, None
        #: Tables that live as long as the tokenizer does in a worker.
        self.memos: dict = {}
        self._split = regex.compile(SPLIT)
        self._marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._symbols = dict(enumerate(byte_symbols()))

    def chunks(self, text: str) -> list[str]:
        """The text between white space (as the word split knows white space)."""
        if _SEPARATORS.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def words(self, plain: str) -> list[str]:
        """Words of a chunk without special strings, as byte symbols."""
        if plain.isascii():
            low = plain.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,;:!?":
                return [low[:-1], low[-1]]
            if low.isprintable():
                return self._split.findall(low)
        elif not _OLD.fullmatch(plain):
            if self._own is None:
                from tokenizers import Tokenizer

                self._own = Tokenizer.from_str(self._content.decode())
            own = self._own
            return [x for x, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(plain))]
        else:
            low = unicodedata.normalize("NFC", plain).replace("Σ", "σ").lower()
        return [x.encode().decode("latin-1").translate(self._symbols) for x in self._split.findall(low)]

    def marks(self, chunk: str):
        """Matches of special strings in a chunk."""
        return self._marks.finditer(chunk) if self._marks and "<" in chunk else ()

    def parts(self, chunk: str) -> list[str | int]:
        """Words and ids of special strings of a chunk that holds no white space, in order."""
        if "<" not in chunk:
            return self.words(chunk)
        out: list[str | int] = []
        done = 0
        for m in self.marks(chunk):
            if m.start() > done:
                out += self.words(chunk[done : m.start()])
            out.append(self.special[m.group()])
            done = m.end()
        return out + self.words(chunk[done:]) if done < len(chunk) else out

    def split_documents(self, texts: list[str]) -> tuple[list[bytes | str | int], list[np.ndarray]]:
        """Distinct words (Latin-1 bytes or byte symbols) and ids of special strings in the texts, and for each text the numbers of its words."""
        fast = [fast_bytes(t) for t in texts]
        plain = [x for x in fast if x is not None]
        words, codes, edges = split_words(plain)
        keys: list[bytes | str | int] = words
        out, row = [], 0
        more: dict[str | int, int] = {}
        for text, own in zip(texts, fast, strict=True):
            if own is not None:
                out.append(codes[edges[row] : edges[row + 1]])
                row += 1
            else:
                parts = [x for chunk in self.chunks(text) for x in self.parts(chunk)]
                out.append(np.array([more.setdefault(x, len(keys) + len(more)) for x in parts], dtype=np.int64))
        return keys + list(more), out

    def symbols(self, word: bytes | str) -> str:
        """A word as byte symbols."""
        if type(word) is str:
            return word
        text = word.decode("latin-1")
        return text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self._symbols)

    def encode_words(self, keys: list[bytes | str | int]) -> list[list[int]]:
        """Ids of words; a special string's id stands for itself."""
        found = iter(self.automaton.encode_many([self.symbols(x) for x in keys if type(x) is not int]))
        return [[x] if type(x) is int else next(found) for x in keys]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        keys, (codes,) = self.split_documents([text])
        ids = self.encode_words(keys)
        return [i for k in codes.tolist() for i in ids[k]]

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids, joined by a space as a vocabulary without a decoder is; unknown ids give nothing."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


def fingerprint(content: bytes) -> str:
    """A key for a vocabulary file's content."""
    return hashlib.sha256(content).hexdigest()


def vocabulary_file(path: str | None = None) -> bytes:
    """Content of a vocabulary file, read on the driver (its size is the vocabulary's, not the data's)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def tokenizer(shared) -> WordTokenizer:
    """The worker's tokenizer for a broadcast vocabulary file."""
    from .frames import kept

    content = shared.value
    return kept("words", hash(content), lambda: WordTokenizer(content))


def encode_documents(df, id_col: str = "doc_id", text_col: str = "text", vocabulary: bytes | None = None):
    """One row per document: ``id_col``, ids ARRAY<INT>, decoded STRING.

    A null or empty text has no ids and decodes to the empty text.  Rows with a null id
    and repeated rows are encoded like any other.  The table keeps no other column.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from .frames import arrow_map, two_columns

    source = two_columns(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_file())

    def make():
        words = tokenizer(shared)
        memo = kept_memo("ids", words, words.encode_words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, codes = words.split_documents(batch.column(1).to_pylist())
            of = memo.values(keys)
            ids = [list(chain.from_iterable(map(of.__getitem__, own.tolist()))) for own in codes]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(words.decode, ids), pa.string())], ["id", "ids", "decoded"])

        return step

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return arrow_map(source, make, schema, ROWS).withColumnRenamed("id", id_col)


def kept_memo(kind: str, words: WordTokenizer, compute, most: int = 200_000):
    """A memo table that lives as long as the worker's tokenizer."""
    return words.memos.setdefault(kind, Generations(compute, most))


def token_digests(df, id_col: str = "doc_id", text_col: str = "text", vocabulary: bytes | None = None):
    """One row per document: ``id_col``, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256.

    The same ids and labels as :func:`encode_documents`, without moving them; both joins
    are made from one table of encoded chunks.  Null and empty texts have no tokens.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from .frames import arrow_map, two_columns

    source = two_columns(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_file())

    def make():
        words = tokenizer(shared)

        number, label = {i: str(i) for i in words.labels}.__getitem__, words.labels.__getitem__

        def render(keys: list[bytes | str | int]) -> list[tuple[int, str, str]]:
            return [(len(ids), " ".join(map(number, ids)), " ".join(map(label, ids))) for ids in words.encode_words(keys)]

        memo = kept_memo("digests", words, render)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded = [], [], []
            keys, codes = words.split_documents(batch.column(1).to_pylist())
            counts, numbers, labels = zip(*memo.values(keys), strict=True) if keys else ((), (), ())
            counts = np.array(counts, dtype=np.int64)
            for own in codes:
                n.append(int(counts[own].sum()))
                order = own.tolist()
                ids.append(hashlib.sha256(" ".join(map(numbers.__getitem__, order)).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join(map(labels.__getitem__, order)).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return arrow_map(source, make, schema, ROWS).withColumnRenamed("id", id_col)
