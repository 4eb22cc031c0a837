"""Settings from a .glyphmill.json file: discovery upwards, checks, merging with given values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

NAME = ".glyphmill.json"
#: Modes, clone types and algorithms.
MODES = ("simple", "reachability", "indexStore")
CLONE_TYPES = ("exact", "near", "semantic")
ALGORITHMS = ("rollingHash", "suffixArray", "minHashLSH")
CONFIDENCES = ("low", "medium", "high")


@dataclass(frozen=True)
class Unused:
    mode: str = "reachability"
    min_confidence: str = "medium"
    ignore_public: bool = True
    exclude_paths: tuple[str, ...] = ()
    exclude_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Duplicates:
    types: tuple[str, ...] = ("exact",)
    algorithm: str = "suffixArray"
    min_tokens: int = 50
    min_similarity: float = 0.8
    exclude_paths: tuple[str, ...] = ()

    @property
    def min_nodes(self) -> int:
        return self.min_tokens // 5


@dataclass(frozen=True)
class Settings:
    format: str = "text"
    exclude_paths: tuple[str, ...] = ()
    unused: Unused = field(default_factory=Unused)
    duplicates: Duplicates = field(default_factory=Duplicates)


def find(start: str | Path) -> Path | None:
    """The settings file in the folder or the nearest one above."""
    at = Path(start).resolve()
    for folder in (at, *at.parents) if at.is_dir() else at.parents:
        if (folder / NAME).is_file():
            return folder / NAME
    return None


def _made(kind, data: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    spelled = {"".join(p.title() if i else p for i, p in enumerate(n.split("_"))): n for n in known}
    unknown = [k for k in data if k not in spelled and k not in known]
    if unknown:
        raise ValueError(f"unknown settings in {where}: {unknown}")
    return kind(**{spelled.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def load(path: str | Path) -> Settings:
    data = json.loads(Path(path).read_text())
    parts = {n: _made(k, data.pop(n, {}), n) for n, k in (("unused", Unused), ("duplicates", Duplicates))}
    return checked(replace(_made(Settings, data, NAME), **parts))


def checked(s: Settings) -> Settings:
    if s.unused.mode not in MODES or s.unused.min_confidence not in CONFIDENCES:
        raise ValueError(f"unknown mode or confidence: {s.unused}")
    if not set(s.duplicates.types) <= set(CLONE_TYPES) or s.duplicates.algorithm not in ALGORITHMS:
        raise ValueError(f"unknown clone type or algorithm: {s.duplicates}")
    if s.duplicates.min_tokens < 1 or not 0 <= s.duplicates.min_similarity <= 1:
        raise ValueError(f"out of range: {s.duplicates}")
    return s


def merged(s: Settings, **given) -> Settings:
    """s with the given values (None: not given); names of parts are prefixed, as unused_mode."""
    for name, value in given.items():
        if value is None:
            continue
        part, _, rest = name.partition("_")
        if part in ("unused", "duplicates"):
            s = replace(s, **{part: replace(getattr(s, part), **{rest: value})})
        else:
            s = replace(s, **{name: value})
    return checked(s)
