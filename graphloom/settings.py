"""Settings: keyword arguments, over a file of `key = value` lines, over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: The variable that names the file read where none is given.
VARIABLE = "GRAPHLOOM_SETTINGS"


@dataclass(frozen=True)
class Settings:
    """extended: accept what goes beyond SELECT over one basic graph pattern; cross: allow products of disconnected parts;
    decode: return terms, not ids (stores only); statistics: plan by the store's statistics; class_limit: beyond so many classes,
    pairwise statistics leave classes out; runs: how often a batch runs each query."""

    extended: bool = False
    cross: bool = False
    decode: bool = True
    statistics: bool = True
    class_limit: int = 1024
    runs: int = 11

    def but(self, **changes) -> Settings:
        return Settings(**{**vars(self), **changes})


def load(path: str | None = None, **changes) -> Settings:
    """The settings of a file (default: the one that GRAPHLOOM_SETTINGS names, if any), with changes. Unknown keys are errors."""
    path, found = path or os.environ.get(VARIABLE), {}
    kinds = {f.name: f.type for f in fields(Settings)}
    if path:
        with open(path) as f:
            for line in f:
                line = line.split("#")[0].strip()
                if line:
                    key, _, value = (x.strip() for x in line.partition("="))
                    name = key.replace(".", "_").replace("-", "_")
                    if name not in kinds:
                        raise ValueError(f"unknown setting {key}")
                    found[name] = value.lower() in ("true", "on", "yes", "1") if kinds[name] == "bool" else int(value)
    return Settings(**{**found, **changes})
