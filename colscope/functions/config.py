"""Settings: a TOML file, then environment variables COLSCOPE_*, then flags; later ones win."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    format: str | None = None
    output: str | None = None
    quiet: bool = False
    verbose: bool = False
    endpoint: str | None = None
    jobs: int | None = None
    master: str | None = None


def load(path: str | None = None, env: Mapping[str, str] | None = None, **flags) -> Settings:
    env = os.environ if env is None else env
    path = path or env.get("COLSCOPE_CONFIG") or os.path.expanduser("~/.config/colscope/config.toml")
    out, names = Settings(), {f.name: f.type for f in fields(Settings)}
    if os.path.exists(path):
        with open(path, "rb") as f:
            out = replace(out, **{k: v for k, v in tomllib.load(f).items() if k in names})
    found = {}
    for k, kind in names.items():
        if (v := env.get(f"COLSCOPE_{k.upper()}")) is not None:
            found[k] = v.lower() in ("1", "true", "yes") if kind == "bool" else int(v) if "int" in kind else v
    return replace(out, **(found | {k: v for k, v in flags.items() if v not in (None, False)}))
