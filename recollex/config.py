"""Settings with validation; a plain object, never kept in Spark's configuration."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

from recollex import consts as K


@dataclass(frozen=True)
class Config:
    budget_chars: int = K.BUDGET_CHARS
    mild: float = K.MILD
    auto: float = K.AUTO
    demote_days: int = K.DEMOTE_DAYS
    archive_days: int = K.ARCHIVE_DAYS
    scene_days: int = K.SCENE_DAYS
    auto_scenes: bool = False
    keyword_norm: str = "sigmoid"
    warn: float = K.WARN
    warn_language: str = "en"

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            kind = {"int": int, "float": (int, float), "bool": bool, "str": str}[f.type]
            if not isinstance(v, kind) or (f.type in ("int", "float") and isinstance(v, bool)):
                raise TypeError(f"{f.name} is of another type: {v!r}")
        if self.warn_language not in ("en", "zh"):
            raise ValueError("warn_language is en or zh")
        if not (0.1 <= self.mild <= 1 and 0.1 <= self.auto <= 1 and 0.1 <= self.warn <= 1):
            raise ValueError("limits lie between 0.1 and 1")
        if self.budget_chars < K.BUDGET_MIN:
            raise ValueError(f"a budget has at least {K.BUDGET_MIN} characters")
        if self.keyword_norm not in ("sigmoid", "reference"):
            raise ValueError("keyword_norm is sigmoid or reference")

    def changed(self, **values) -> Config:
        return replace(self, **values)

    @classmethod
    def read(cls, path: str) -> Config:
        """The settings of a JSON file; what it lacks, or a file that isn't there, has the defaults, and keys that aren't
        settings are ignored."""
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except FileNotFoundError:
            found = {}
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})

    def set(self, path: str, key: str, value: str) -> Config:
        """The settings with one changed, from text, and written in one step; a wrong key or value changes nothing."""
        kinds = {f.name: f.type for f in fields(self)}
        if key not in kinds:
            raise KeyError(key)
        made = {"int": int, "float": float, "str": str.strip, "bool": lambda v: v.lower() in ("true", "yes", "1", "on")}[kinds[key]](value)
        new = self.changed(**{key: made})
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(asdict(new), f)
        os.replace(path + ".tmp", path)
        return new
