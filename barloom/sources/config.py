"""Configuration: defaults, then YAML, then the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


def load_yaml(path: str) -> dict:
    import yaml

    text = Path(path).read_text(encoding="utf-8")
    found = yaml.safe_load(text)
    if not found:
        raise ValueError(f"{path} is empty")
    return found


def load_all(folder: str, names: tuple[str, ...] = ("data", "features", "train", "eval")) -> dict[str, dict]:
    """The YAML files that are there, by name."""
    return {n: load_yaml(str(p)) for n in names if (p := Path(folder, f"{n}.yaml")).exists()}


@dataclass(frozen=True)
class SourceConfig:
    """How to reach a paged candle source. Times are in seconds."""

    base_url: str = "https://localhost"
    timeout: float = 10.0
    page: int = 500
    token: str = ""
    user: str = ""
    password: str = ""
    api_key: str = ""
    cookie: str = ""


@dataclass(frozen=True)
class ServiceConfig:
    raw_dir: str = "data/raw"
    log_path: str = "data/reports/decision_log"
    inference_timeout: float = 5.0
    min_candles: int = 32
    source: SourceConfig = field(default_factory=SourceConfig)


def cast_like(old: Any, new: str) -> Any:
    if isinstance(old, bool):
        return new.strip().lower() in ("1", "true", "yes", "on")
    return type(old)(new)


def service_config(path: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "BARLOOM_") -> ServiceConfig:
    """Defaults under the file's values under the environment's (prefix and the field's name in capitals). Relative folders are
    taken from the file's own; values that make no sense are an error.
    """
    given = load_yaml(path) if path else {}
    source = SourceConfig(**{k: v for k, v in (given.pop("source", None) or {}).items()})
    cfg = ServiceConfig(**given, source=source)
    own = lambda c, p: replace(c, **{f.name: cast_like(getattr(c, f.name), env[p + f.name.upper()]) for f in fields(c) if f.name != "source" and p + f.name.upper() in env})
    cfg = replace(own(cfg, prefix), source=own(source, prefix + "SOURCE_"))
    if path:
        at = Path(path).parent
        cfg = replace(cfg, raw_dir=str(at / cfg.raw_dir), log_path=str(at / cfg.log_path))
    if cfg.source.page < 1 or cfg.source.timeout <= 0 or cfg.inference_timeout <= 0 or cfg.min_candles < 1:
        raise ValueError("pages, times and numbers of candles must be positive")
    return cfg
