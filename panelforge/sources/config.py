"""Configuration files: JSON, or YAML where its parser is installed; sections laid over defaults."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str | Path, defaults: dict | None = None) -> dict:
    """The settings of a file over ``defaults``, section by section; ``root`` is the file's folder."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        own = json.loads(text)
    else:
        import yaml

        own = yaml.safe_load(text)
    return merged(defaults or {}, own or {}) | {"root": str(path.resolve().parent)}


def merged(below: dict, above: dict) -> dict:
    out = dict(below)
    for k, v in above.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve(config: dict, key: str) -> str:
    """A path named under ``data`` or ``paths``; relative ones start at ``root``, ones with a scheme stay."""
    for section in ("data", "paths"):
        if key in config.get(section, {}):
            where = str(config[section][key])
            return where if "://" in where or where.startswith("/") else str(Path(config["root"]) / where)
    raise KeyError(key)
