"""Settings files: YAML with known keys only; what is not set stays None."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

from ..functions.languages import Language, Registry
from ..operators.detectors import Detector

NAMES = (".linetide.yml", ".linetide.yaml")


@dataclass
class Config:
    """What a settings file says."""

    format: str | None = None
    smart_exclude: bool | None = None
    gitignore: bool | None = None
    hidden: bool | None = None
    tracked: bool | None = None
    git: bool | None = None
    dedup: bool | None = None
    follow_symlinks: bool | None = None
    by_file: bool | None = None
    jobs: int | None = None
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    detectors: dict = field(default_factory=dict)
    definitions: dict = field(default_factory=dict)
    path: str = ""

    def custom_detectors(self) -> list[Detector]:
        return [Detector(d.get("name", ""), tuple(d.get("markers") or ()), tuple(d.get("exclude") or ()), tuple(d.get("self_markers") or ()), d.get("self_name") or "") for d in self.detectors.get("custom") or []]

    def apply_definitions(self, registry: Registry) -> None:
        """Adds the defined languages in the order of their names, so that the last of two that claim a key owns it."""
        for name in sorted(self.definitions):
            d = self.definitions[name] or {}
            pairs = {k: tuple((a, b) for a, b in d.get(key) or ()) for k, key in (("block", "block_comments"), ("quotes", "quotes"), ("multi", "multiline_quotes"), ("raw", "raw_quotes"))}
            own = Language(name, tuple(d.get("extensions") or ()), tuple(d.get("filenames") or ()), tuple(d.get("shebangs") or ()), tuple(d.get("line_comments") or ()), nested=bool(d.get("nested_comments")), **pairs)
            try:
                own.validate()
            except ValueError as e:
                raise ValueError(f"config {self.path}: {e}") from None
            registry.add(own)


_DETECTORS = {"disable", "custom"}
_CUSTOM = {"name", "markers", "exclude", "self_markers", "self_name"}
_DEFINITION = {"extensions", "filenames", "shebangs", "line_comments", "block_comments", "quotes", "multiline_quotes", "raw_quotes", "nested_comments"}
_LISTS = {"exclude", "include", "extensions", "languages"}


def _only(known: set[str], found, where: str) -> None:
    if not isinstance(found, dict):
        raise ValueError(f"{where} is not a mapping")
    for key in found:
        if key not in known:
            raise ValueError(f"field {key} not found in {where}")


def parse(text: str, path: str = "") -> Config:
    """A settings file's content; an empty one sets nothing."""
    try:
        raw = yaml.safe_load(text)
        if raw is None:
            return Config(path=path)
        kinds = {f.name: str(f.type) for f in fields(Config) if f.name != "path"}
        _only(set(kinds), raw, "settings")
        for key, value in raw.items():
            kind = kinds[key]
            if value is None:
                continue
            if kind.startswith("bool") and not isinstance(value, bool) or kind.startswith("int") and (isinstance(value, bool) or not isinstance(value, int)):
                raise ValueError(f"cannot read {value!r} as {key}")
            if key in _LISTS and not isinstance(value, list):
                raise ValueError(f"{key} is not a list")
        _only(_DETECTORS, raw.get("detectors") or {}, "detectors")
        for d in (raw.get("detectors") or {}).get("custom") or []:
            _only(_CUSTOM, d, "a custom detector")
        for d in (raw.get("definitions") or {}).values():
            _only(_DEFINITION, d or {}, "a definition")
    except (yaml.YAMLError, ValueError) as e:
        raise ValueError(f"parsing config {path}: {e}") from None
    given = {k: v for k, v in raw.items() if v is not None}
    given |= {k: [str(x) for x in given[k]] for k in _LISTS if k in given}
    return Config(**given, path=path)


def load(explicit: str = "") -> Config:
    """The given file, else the first found of the usual places; an explicit file must exist."""
    places = [explicit] if explicit else list(NAMES)
    if not explicit:
        base = os.environ.get("XDG_CONFIG_HOME") or str(Path.home() / ".config")
        places.append(str(Path(base) / "linetide" / "config.yml"))
    for place in places:
        try:
            text = Path(place).read_text(encoding="utf-8")
        except FileNotFoundError:
            continue
        except OSError as e:
            raise ValueError(f"reading config {place}: {e.strerror}") from None
        return parse(text, place)
    if explicit:
        raise ValueError(f"config file {explicit} not found")
    return Config()
