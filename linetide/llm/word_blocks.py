"""The words of many texts at once, as arrays.

Latin-1 texts in lower case are joined, their bytes looked up in a table of classes (letter,
number, white space, other), and words found where the class changes: what the vocabulary's
regular expression finds, without an object for each word.  Words are told apart by their bytes, eight
at a time; equal hashes are compared, so different words never share a code.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_LONG = 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93], dtype=np.uint64)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _class(c: str) -> int:
    if c in "\t\n\x0b\x0c\r \x85\xa0":
        return _SPACE
    kind = unicodedata.category(c)[0]
    return _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER


_CLASS = np.array([_class(chr(k)) for k in range(256)], dtype=np.uint8)
_LETTERS = _CLASS == _LETTER


def fast_bytes(text: str) -> bytes | None:
    """The text in lower case as Latin-1 bytes; None if it has other characters, NULs, or may hold special strings."""
    return None if "<" in text or "\0" in text else latin_bytes(text)


def latin_bytes(text: str) -> bytes | None:
    """The text in lower case as Latin-1 bytes; None if it has other characters."""
    try:
        return text.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None


def split_letters(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As :func:`split_words`, of runs of letters alone."""
    joined = b"\n".join(texts)
    c = _LETTERS[np.frombuffer(joined + bytes(1), dtype=np.uint8)[:-1]]
    start, last = c.copy(), c.copy()
    start[1:] &= ~c[:-1]
    last[:-1] &= ~c[1:]
    begins = np.flatnonzero(start)
    return _coded(joined, texts, begins, np.flatnonzero(last) + 1 - begins)


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in them, and where each text's words begin (and the last one's end)."""
    joined = b"\n".join(texts)
    n = len(joined)
    b = np.frombuffer(joined + bytes(2), dtype=np.uint8)
    c = _CLASS[b[:n]]
    start = c != _SPACE
    start[1:] &= (c[1:] != c[:-1]) | (c[1:] == _NUMBER)
    at = np.flatnonzero(start & (b[:n] == 39))
    if len(at):
        x, y = b[at + 1], b[at + 2]
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        size = np.where(two, 2, np.isin(x, (115, 116, 109, 100)).astype(np.int64))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + 1 + size
        after = after[after < n]
        start[after] |= c[after] != _SPACE
    begins = np.flatnonzero(start)
    last = c != _SPACE
    last[:-1] &= (c[1:] == _SPACE) | start[1:]
    return _coded(joined, texts, begins, np.flatnonzero(last) + 1 - begins)


def _coded(joined: bytes, texts: list[bytes], begins: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words among those that begin at some places of the joined texts, each word's number, and each text's first."""
    n = len(joined)
    padded = joined + bytes(_LONG + 8)
    if not len(begins):
        return [], np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    lanes = np.ndarray((n + _LONG + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = lengths.copy()
    keys = np.zeros((3, len(begins)), dtype=np.uint64)
    keys[0] = lanes[begins] & _MASK[np.minimum(lengths, 8)]
    for k in (1, 2):
        own = np.flatnonzero(lengths > 8 * k)
        keys[k, own] = lanes[begins[own] + 8 * k] & _MASK[np.minimum(lengths[own] - 8 * k, 8)]
    seen: dict[bytes, int] = {}
    for j in np.flatnonzero(lengths > _LONG).tolist():
        word = joined[begins[j] : begins[j] + lengths[j]]
        keys[:, j] = seen.setdefault(word, len(seen))
        size[j] = -1
    hashes = size.astype(np.uint64) * _ODD[3]
    for k in range(3):
        hashes += (keys[k] ^ (keys[k] >> np.uint64(29))) * _ODD[k]
        hashes ^= hashes >> np.uint64(32)
    _, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    same = size[first][codes] == size
    for k in range(3):
        same &= keys[k][first][codes] == keys[k]
    if not same.all():
        rows = np.concatenate([keys, size.astype(np.uint64)[None]]).T
        _, first, codes = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        codes = codes.reshape(-1)
    words = [joined[a : a + k] for a, k in zip(begins[first].tolist(), lengths[first].tolist(), strict=True)]
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, codes, np.searchsorted(begins, edges)
