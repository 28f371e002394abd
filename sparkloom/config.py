"""Nested settings from JSON (or YAML, where a reader is installed): a base file, an experiment over it, overrides
over both (IO23)."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

try:
    from yaml import safe_load as _read
except ImportError:
    _read = json.loads

CONFIGS = Path(__file__).parent / "configs"


def _value(text: str) -> object:
    try:
        return _read(text)
    except ValueError:
        return text


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, nested mappings key by key."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def dotted(settings: list[str]) -> dict:
    """['a.b=3'] as {'a': {'b': 3}}; values are read like the files."""
    out: dict = {}
    for setting in settings:
        path, _, value = setting.partition("=")
        nested: object = _value(value)
        for key in reversed(path.split(".")):
            nested = {key: nested}
        out = merged(out, nested)
    return out


def _from_environment(value: object) -> object:
    """``${oc.env:NAME,default}`` inside strings."""
    if isinstance(value, dict):
        return {k: _from_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_from_environment(v) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{oc\.env:(\w+)(?:,([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)
    return value


def load_config(path: str | Path, overrides: list[str] | None = None) -> dict:
    """The file ``path`` (a bare name is one of this package's experiments) over the file that it names as ``base``
    in its folder, if there is one, under the overrides ``a.b=value``."""
    path = Path(path)
    if not path.exists() and (CONFIGS / f"{path}.json").exists():
        path = CONFIGS / f"{path}.json"
    if not path.exists():
        raise FileNotFoundError(f"no such settings: {path}")
    settings = _read(path.read_text()) or {}
    if "base" in settings and (base := path.parent / settings["base"]).exists():
        settings = merged(_read(base.read_text()) or {}, settings)
    return _from_environment(merged(settings, dotted(overrides or [])))
