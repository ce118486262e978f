"""Language identification by interpolated Kneser-Ney character models.

A model is over the characters of words, up to five at a time, from a start mark to an end mark.
Its highest order discounts counts, the lower ones discount continuation counts, and each is
interpolated with the next; the lowest with a uniform share for unseen characters.  Seen
n-grams are stored with their final log probability, contexts with the log of the mass they
leave; both as arrays of sorted 64-bit hashes, searched by bisection.

The language is the one with the lowest cross-entropy per character.  Some documents of each
language are set aside when fitting; their cross-entropies calibrate what is rejected: a text
far above what is usual for the best language, with more allowance for fewer words.

A fit takes at most :data:`SAMPLE` documents of each language; every document is classified over its whole text.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, kept, two_columns
from .sampling import least_hashes, remainder, text_of
from .word_blocks import latin_bytes, split_letters

#: Documents of each language that a fit takes at most; one in TUNE calibrates.
SAMPLE, TUNE = 400, 5
FOLDS, HELD_OUT = 4, 2
ORDER = 5
#: Standard deviations of a document's cross-entropy from which it is rejected, and the least one taken for a language: texts
#: that mix languages or quote others stay.
REJECT, LEAST_SD = 8.0, 0.3
UNDETERMINED = "und"
_START, _END = 2, 3
_UNSEEN = math.log(1e-6)
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(n * 0xFF51AFD7ED558CCD % 2**64) for n in range(1, ORDER + 1)]
#: Words in a worker's table before it starts anew, and documents classified together.
_MOST, _ROWS = 300_000, 512


def has_letter(text: str) -> bool:
    """Whether a text has any letter."""
    return any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    """Lower-case words: runs of letters and their marks, whatever stands between them."""
    return _WORD.findall(text.lower())


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For n from 1 to ORDER the hash of the n characters that end at each position (those before the array's start count as 0)."""
    out, h = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(ORDER):
        back = np.zeros(len(codes), dtype=np.uint64)
        back[n:] = codes[: max(0, len(codes) - n)]
        h = (h ^ (back + _SALTS[n])) * _MIX
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words with their marks, each one's place in its word, and each word's number."""
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return text, place, owner


class Grams:
    """The n-grams that end at each position, each distinct one searched once and in order."""

    def __init__(self, codes: np.ndarray):
        self.orders = [np.unique(h, return_inverse=True) for h in gram_hashes(codes)]

    def search(self, table: tuple[np.ndarray, np.ndarray], n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the n-grams at some positions, and whether each is in the table."""
        keys, back = self.orders[n - 1]
        value, found = _search(table, keys)
        return value[back[at]], found[back[at]]


@dataclass
class CharacterModel:
    """Sorted hashes and log probabilities of seen n-grams, and of contexts with the log of the mass they leave."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    mean: float = 0.0
    document_sd: float = 0.0
    word_sd: float = 0.0

    def log_probs(self, grams: Grams, place: np.ndarray) -> np.ndarray:
        """Natural log probability of the character at each position, given those before it in its word."""
        out = np.zeros(len(place))
        open_ = place > 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (place >= n - 1))
            if not len(at):
                continue
            value, found = grams.search(self.grams[n - 1], n, at)
            out[at[found]] += value[found]
            open_[at[found]] = False
            if n > 1:
                miss = at[~found]
                value, found = grams.search(self.contexts[n - 1], n - 1, miss - 1)
                out[miss] += np.where(found, value, 0.0)
            else:
                out[at[~found]] += _UNSEEN + self.contexts[0][1].sum()
        return out

    def threshold(self, words: np.ndarray) -> np.ndarray:
        """Cross-entropy from which a text with so many words is rejected."""
        return self.mean + REJECT * np.sqrt(max(self.document_sd, LEAST_SD) ** 2 + self.word_sd**2 / np.maximum(words, 1))


def _search(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, values = table
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return values[at], known[at] == keys


def fit_model(counts: Counter) -> CharacterModel:
    """Interpolated Kneser-Ney from the counts of words."""
    grams: list[dict[str, float]] = [{} for _ in range(ORDER)]
    for word, c in counts.items():
        marked = f"\x02{word}\x03"
        for t in range(1, len(marked)):
            n = min(ORDER, t + 1)
            g = marked[t - n + 1 : t + 1]
            grams[n - 1][g] = grams[n - 1].get(g, 0) + c
    for n in range(ORDER, 1, -1):
        below = grams[n - 2]
        for g in grams[n - 1]:
            below[g[1:]] = below.get(g[1:], 0) + 1
    probs: list[dict[str, float]] = [{} for _ in range(ORDER)]
    left: list[dict[str, float]] = [{} for _ in range(ORDER)]
    for n in range(1, ORDER + 1):
        own = grams[n - 1]
        ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        total: dict[str, float] = {}
        kinds: dict[str, int] = {}
        for g, c in own.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        left[n - 1] = {x: d * kinds[x] / total[x] for x in total}
        for g, c in own.items():
            x = g[:-1]
            lower = math.exp(_UNSEEN) if n == 1 else _lower(probs, left, g[1:])
            probs[n - 1][g] = max(c - d, 0) / total[x] + left[n - 1][x] * lower
    return CharacterModel([_table(p) for p in probs], [_table(x) for x in left])


def _lower(probs, left, gram: str) -> float:
    share = 1.0
    while gram:
        p = probs[len(gram) - 1].get(gram)
        if p is not None:
            return share * p
        share *= left[len(gram) - 1].get(gram[:-1], 1.0)
        gram = gram[1:]
    return share * math.exp(_UNSEEN)


def _table(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of one length as sorted hashes, with the logs of their values."""
    if not values:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    if "" in values:
        return np.zeros(1, dtype=np.uint64), np.log([values[""]])
    n = len(next(iter(values)))
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    keys = gram_hashes(codes)[n - 1][n - 1 :: n]
    order = np.argsort(keys)
    return keys[order], np.log(np.maximum(np.fromiter(values.values(), dtype=np.float64), 1e-300))[order]


def fit_language(texts: list[str]) -> CharacterModel:
    """A model of the texts, calibrated on those set aside (all of them if there are few)."""
    few = len(texts) < 2 * TUNE
    counts: Counter = Counter()
    for k, text in enumerate(texts):
        if few or k % TUNE:
            counts.update(words_of(text))
    model = fit_model(counts)
    means, words = [], []
    for k, text in enumerate(texts):
        if few or not k % TUNE:
            own = words_of(text)
            if own:
                codes, place, owner = word_codes(own)
                cost = np.bincount(owner, -model.log_probs(Grams(codes), place))
                size = np.array([len(w) + 1 for w in own])
                means.append(cost.sum() / size.sum())
                words.append(np.std(cost / size) if len(own) > 1 else 0.0)
    if means:
        model.mean, model.document_sd, model.word_sd = float(np.mean(means)), float(np.std(means)), float(np.mean(words))
    return model


class Identifier:
    """Scores texts under all models, with a table of the costs of known words.

    The words of Latin-1 texts are found as arrays, all others by the regular expression that the fit uses; both find the same.
    """

    def __init__(self, models: dict[str, CharacterModel]):
        self.names = sorted(models)
        self.models = [models[x] for x in self.names]
        self._restart()

    def _restart(self) -> None:
        self.row: dict[bytes | str, int] = {}
        self.costs = np.zeros((1024, len(self.names) + 2), dtype=np.float64)

    def _learn(self, keys: list[bytes | str]) -> None:
        new = np.zeros((len(keys), len(self.names) + 2))
        if keys:
            words = [k.decode("latin-1") if type(k) is bytes else k for k in keys]
            codes, place, word = word_codes(words)
            grams = Grams(codes)
            for k, m in enumerate(self.models):
                new[:, k] = np.bincount(word, -m.log_probs(grams, place), minlength=len(keys))
            new[:, -2] = [len(w) + 1 for w in words]
            new[:, -1] = 1
        first = len(self.row)
        while first + len(keys) > len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        self.costs[first : first + len(keys)] = new
        self.row.update(zip(keys, range(first, first + len(keys)), strict=True))

    def totals(self, texts: list[str]) -> np.ndarray:
        """For each text its cost under each model, its characters and its words."""
        fast = [latin_bytes(t) for t in texts]
        words, codes, edges = split_letters([x for x in fast if x is not None])
        slow = [None if f is not None else words_of(t) for t, f in zip(texts, fast, strict=True)]
        keys = [*words, *{w for own in slow if own for w in own}]
        new = [k for k in keys if k not in self.row]
        if len(self.row) + len(new) > _MOST:
            self._restart()
            new = keys
        self._learn(new)
        rows = np.fromiter(map(self.row.__getitem__, keys), dtype=np.int64, count=len(keys))
        out = np.zeros((len(texts), len(self.names) + 2))
        at = 0
        for k, own in enumerate(slow):
            if own is None:
                mine = rows[codes[edges[at] : edges[at + 1]]]
                at += 1
            else:
                mine = np.array([self.row[w] for w in own], dtype=np.int64)
            if len(mine):
                out[k] = self.costs[mine].sum(axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        n = len(texts)
        if not self.names:
            return [UNDETERMINED] * n, np.zeros(n), np.ones(n, dtype=bool)
        totals = self.totals(texts)
        size, words = totals[:, -2], totals[:, -1]
        entropy = totals[:, :-2] / np.maximum(size, 1)[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(n), best]
        scores = 1 / np.exp((least[:, None] - entropy) * np.sqrt(size)[:, None]).sum(axis=1)
        limits = np.array([m.threshold(words) for m in self.models])[best, np.arange(n)]
        lettered = np.array([has_letter(t) for t in texts], dtype=bool)
        rejected = ~lettered | (least > limits)
        return [self.names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], np.where(lettered, scores, 0.0), rejected


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> dict[str, CharacterModel]:
    """A model for each language, from at most ``most`` documents of it that are not held out.

    Null languages, null texts and null ids are left out, and so are languages whose sample has no letter.  An id counts once for
    each of its languages, however often it is repeated; of its texts the least is taken.
    """
    usable = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).where(remainder(id_col, FOLDS) != HELD_OUT)
    sample = least_hashes(usable.select(F.col(id_col).alias("own"), F.col(lang_col).alias("lang")), "lang", "own", most)
    rows = text_of(usable.select(F.col(id_col).alias("own"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")), sample, ["own", "lang"]).select("lang", F.xxhash64("own").alias("mark"), "text")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf.sort_values(["mark", "text"])["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "kind": [], "n": [], "keys": [], "values": []})
        m = fit_language(texts)
        out = [(pdf["lang"].iloc[0], kind, n, k.tobytes(), v.tobytes()) for kind, tables in (("gram", m.grams), ("context", m.contexts)) for n, (k, v) in enumerate(tables)]
        out.append((pdf["lang"].iloc[0], "limits", 0, b"", np.array([m.mean, m.document_sd, m.word_sd]).tobytes()))
        return pd.DataFrame(out, columns=["lang", "kind", "n", "keys", "values"])

    found: dict[str, dict] = {}
    for r in rows.groupBy("lang").applyInPandas(train, "lang string, kind string, n int, keys binary, values binary").collect():
        found.setdefault(r["lang"], {})[r["kind"], r["n"]] = (np.frombuffer(r["keys"], dtype=np.uint64), np.frombuffer(r["values"]))
    return {lang: CharacterModel([x["gram", n] for n in range(ORDER)], [x["context", n] for n in range(ORDER)], *x["limits", 0][1]) for lang, x in found.items()}


def _identifier(shared, key: str) -> Identifier:
    return kept("languages", key, lambda: Identifier(shared.value))


def identify(documents: DataFrame, models: dict[str, CharacterModel], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, lang_pred, score (0 to 1), rejected.

    Only the text is read.  A text that is null or has no letter is ``und`` with score 0 and rejected, as is
    everything where no language was learned.  Rows with null ids and repeated rows are
    classified like any other; other columns are not kept.
    """
    source = two_columns(documents, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(models)
    key = uuid.uuid4().hex

    def make():
        model = _identifier(shared, key)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, rejected = model.predict(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

        return step

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return arrow_map(source, make, schema, _ROWS).withColumnRenamed("id", id_col)


def classify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``id_col``, held_out, lang_pred, score, rejected; learned from the rows that are not held out."""
    found = identify(documents, learn(documents, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, (remainder(id_col, FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def without_rejected(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``documents`` whose language is not rejected, as they were, with all their columns.

    Texts that are null or have no letter are rejected, rows with null ids and repeated rows judged like any other; an
    empty table gives no rows, and where no language was learned every row is rejected.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, id_col, text_col, lang_col))
    key = uuid.uuid4().hex
    at = documents.columns.index(text_col)

    def make():
        model = _identifier(shared, key)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, _, rejected = model.predict([t or "" for t in batch.column(at).to_pylist()])
            return batch.filter(pa.array(~rejected))

        return step

    return arrow_map(documents, make, documents.schema, _ROWS)
