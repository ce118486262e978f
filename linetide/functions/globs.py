"""Path globs as regular expressions that Python and Java read alike.

In a segment ``*`` and ``?`` do not cross ``/``; ``[^...]`` negates a class (``[!...]`` does not); a backslash
escapes.  ``**`` as a whole segment stands for any number of segments, none included.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadGlob(ValueError):
    """A malformed glob."""


def _literal(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() and c != "_" and c.isprintable() and c != " " else c


def segment_regex(glob: str) -> str:
    """The regular expression of one segment, without anchors."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(glob):
                raise BadGlob(glob)
            out.append(_literal(glob[i]))
            i += 1
        elif c == "[":
            piece, i = _class(glob, i)
            out.append(piece)
        else:
            out.append(_literal(c))
    return "".join(out)


def _class(glob: str, i: int) -> tuple[str, int]:
    negated = glob[i : i + 1] == "^"
    i += negated
    parts: list[str] = []
    any_range = False
    while True:
        if any_range and glob[i : i + 1] == "]":
            break
        low, i = _class_char(glob, i)
        high = low
        if glob[i : i + 1] == "-":
            high, i = _class_char(glob, i + 1)
        any_range = True
        if low <= high:
            parts.append(_literal(low) if low == high else f"{_literal(low)}-{_literal(high)}")
    if not parts:
        return ("[^/]" if negated else "(?!)"), i + 1
    return f"[{'^' if negated else ''}{''.join(parts)}]", i + 1


def _class_char(glob: str, i: int) -> tuple[str, int]:
    if i >= len(glob) or glob[i] in "-]":
        raise BadGlob(glob)
    if glob[i] == "\\":
        i += 1
        if i >= len(glob):
            raise BadGlob(glob)
    if i + 1 >= len(glob):
        raise BadGlob(glob)
    return glob[i], i + 1


def path_regex(segments: list[str], below: bool) -> str:
    """The regular expression of a path, without anchors; with ``below`` everything under a match matches too."""
    out = ""
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            out += "(?:.*)" if last else "(?:[^/]+/)*"
        else:
            out += segment_regex(s) + ("" if last else "/")
    if below:
        return out + "(?:/.*)?"
    return out


def rooted_regex(segments: list[str], below: bool) -> str:
    """As :func:`path_regex`, where a last ``**`` also stands for no segment at all."""
    if len(segments) > 1 and segments[-1] == "**":
        head = segments
        while len(head) > 1 and head[-1] == "**":
            head = head[:-1]
        if head == ["**"]:
            return ".*"
        return path_regex(head, True)
    return path_regex(segments, below)


def java(core: str) -> str:
    """``core`` anchored for Java, with a dot that also matches line ends."""
    return rf"(?s)\A(?:{core})\z"


@dataclass(frozen=True)
class Pattern:
    """An exclude or include pattern: a bare name matches any component, one with a slash is relative to the root.

    Whatever lies under a match is matched too.
    """

    raw: str
    anchored: bool
    segments: tuple[str, ...]

    @classmethod
    def parse(cls, raw: str) -> Pattern:
        if not raw:
            raise ValueError("empty pattern")
        s = raw.removesuffix("/")
        anchored = s.startswith("./") or "/" in s
        if anchored:
            s = s.removeprefix("./")
            s = _clean(s)
            if s in (".", "..") or s.startswith(("../", "/")):
                raise ValueError(f'pattern "{raw}" must name a path inside the scan root')
        segments = tuple(s.split("/"))
        for x in segments:
            if x != "**":
                try:
                    segment_regex(x)
                except BadGlob:
                    raise ValueError(f'pattern "{raw}": bad glob segment "{x}"') from None
        return cls(raw, anchored, segments)

    @cached_property
    def core(self) -> str:
        if self.anchored:
            return rooted_regex(list(self.segments), True)
        name = "[^/]*" if self.segments[0] == "**" else segment_regex(self.segments[0])
        return f"(?:.*/)?{name}(?:/.*)?"

    def matches(self, rel: str) -> bool:
        rel = rel.strip("/")
        return rel not in ("", ".") and re.fullmatch(self.core, rel, re.DOTALL) is not None


def _clean(path: str) -> str:
    return posixpath.normpath(path) if path else "."


@dataclass(frozen=True)
class PatternSet:
    """Patterns in order; the first that matches is the one that is named."""

    patterns: tuple[Pattern, ...] = ()

    @classmethod
    def parse(cls, raw: list[str] | tuple[str, ...]) -> PatternSet:
        return cls(tuple(Pattern.parse(x) for x in raw))

    def __bool__(self) -> bool:
        return bool(self.patterns)

    def matched_by(self, rel: str) -> str | None:
        return next((p.raw for p in self.patterns if p.matches(rel)), None)

    def column(self, rel: Column) -> Column:
        """The first matching pattern's text, or null."""
        path = F.regexp_replace(rel, "^/+|/+$", "")
        usable = (path != "") & (path != ".")
        if not self.patterns:
            return F.lit(None).cast("string")
        return F.coalesce(*(F.when(usable & path.rlike(java(p.core)), F.lit(p.raw)) for p in self.patterns))
