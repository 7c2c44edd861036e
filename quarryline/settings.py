"""Settings of an analysis: built-in values, under the user's file, under the tree's."""

from __future__ import annotations

import os
import subprocess
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from quarryline.operators import code_metrics

NAME = ".quarryline.toml"
#: Keys outside [bands] and [rules], by table, with the kind of their values.
NUMBERS = {"": {"cut": float}, "clones": {"min_size": int, "threshold": float, "radius_factor": float}, "reimplementation": {"threshold": float}}
#: Bands of the passes over whole files and groups.
RELATIONAL = ("unnatural", "low_cohesion", "scattered", "misplaced")


class SettingsError(ValueError):
    """A file of settings that can't be used as it is."""


@dataclass
class Settings:
    cut: float = 0.95
    bands: dict[str, tuple[int, int]] = field(default_factory=dict)
    rules: dict[str, bool] = field(default_factory=dict)
    clones: dict[str, float] = field(default_factory=lambda: {"min_size": code_metrics.CLONE_SIZE, "threshold": 0.85, "radius_factor": 0.5})
    reimplementation: dict[str, float] = field(default_factory=lambda: {"threshold": 0.6})


def _number(value, kind: type, what: str):
    if isinstance(value, bool) or not isinstance(value, int if kind is int else (int, float)):
        raise SettingsError(f"{what} must be {'an integer' if kind is int else 'a number'}, not {value!r}")
    return kind(value)


def _band(value, what: str) -> tuple[int, int]:
    if not isinstance(value, list) or len(value) != 2:
        raise SettingsError(f"{what} must be two integers, not {value!r}")
    return _number(value[0], int, what), _number(value[1], int, what)


def _switch(value, what: str) -> bool:
    if not isinstance(value, bool):
        raise SettingsError(f"{what} must be true or false, not {value!r}")
    return value


def overlay(settings: Settings, data: dict, source: str) -> Settings:
    """settings under the keys of data; unknown keys warn and are left out, wrong values raise."""
    scalars = {*code_metrics.BANDS, *code_metrics.OPTIONAL_BANDS}
    readers = {
        "bands": (settings.bands, dict.fromkeys([*scalars, *RELATIONAL], _band)),
        "rules": (settings.rules, dict.fromkeys([*scalars, *code_metrics.FLAGS], _switch)),
    }
    for table in ("clones", "reimplementation"):
        readers[table] = (getattr(settings, table), {k: (lambda v, what, kind=kind: _number(v, kind, what)) for k, kind in NUMBERS[table].items()})
    for key, value in data.items():
        if key in NUMBERS[""]:
            setattr(settings, key, _number(value, NUMBERS[""][key], f"{key} in {source}"))
        elif key not in readers:
            warnings.warn(f"{source}: unknown key {key}", stacklevel=2)
        elif not isinstance(value, dict):
            raise SettingsError(f"{key} in {source} must be a table")
        else:
            into, known = readers[key]
            for name, entry in value.items():
                if name in known:
                    into[name] = known[name](entry, f"{key}.{name} in {source}")
                else:
                    warnings.warn(f"{source}: unknown {key} key {name}", stacklevel=2)
    return settings


def top_folder(path: str) -> Path:
    """The work tree's folder around a path, else the path's own folder."""
    here = Path(path) if Path(path).is_dir() else Path(path).parent
    try:
        found = subprocess.run(["git", "-C", str(here), "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return here
    return Path(found.stdout.rstrip("\n"))


def discover(roots: list[str], explicit: str | None = None, use_files: bool = True) -> Settings:
    """Settings for roots: the user's file, then the explicit one (which must exist) or that of the first root's tree."""
    settings = Settings()
    if not use_files:
        return settings
    user = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "quarryline" / "config.toml"
    own = Path(explicit) if explicit else top_folder(roots[0]) / NAME if roots else None
    if explicit and not own.is_file():
        raise SettingsError(f"no such file of settings: {explicit}")
    for path in (user, own):
        if path is not None and path.is_file():
            try:
                data = tomllib.loads(path.read_text())
            except tomllib.TOMLDecodeError as e:
                raise SettingsError(f"{path}: {e}") from e
            overlay(settings, data, str(path))
    return settings
