"""Settings from files: the nearest ``.prismetric.toml``, a table of the nearest ``pyproject.toml``, and the user's own."""

from __future__ import annotations

import os
import tomllib
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .model import BANDS, NameRule

FILE, PROJECT = ".prismetric.toml", "pyproject.toml"
TABLE = ("tool", "prismetric")


class ConfigError(ValueError):
    """A settings file that is there but wrong."""


class ConfigNotFoundError(ConfigError):
    """A settings file that was named but isn't there."""


def _is(kind: type | tuple[type, ...], said: str, also: Callable[[Any], bool] = lambda v: True) -> Callable[[Any], str | None]:
    return lambda v: None if isinstance(v, kind) and (not isinstance(v, bool) or kind is bool) and also(v) else said


# What may be set, and what each must be.
TOP = {
    "persona": _is(str, "a string"),
    "sample": _is(int, "a positive integer", lambda v: v > 0),
    "fail_on_pii": _is(str, "one of low|medium|high", lambda v: v.lower() in BANDS),
    "min_score": _is(int, "an integer from 0 to 100", lambda v: 0 <= v <= 100),
    "no_timeseries": _is(bool, "true or false"),
}
NESTED = {
    "llm": {"base_url": _is(str, "a string"), "model": _is(str, "a string")},
    "pii": {"name_rules": _is(list, "an array of tables")},
    "watch": {"debounce_ms": _is(int, "a non-negative integer", lambda v: v >= 0), "poll_interval": _is((int, float), "a positive number", lambda v: v > 0)},
    "render": {"color": _is(str, "one of auto|always|never", lambda v: v.lower() in ("auto", "always", "never"))},
}


@dataclass(frozen=True)
class LoadedConfig:
    values: dict[str, Any] = field(default_factory=dict)
    sources: dict[str, str] = field(default_factory=dict)
    sources_by_path: tuple[str, ...] = ()


def user_path(env: dict[str, str] | None = None) -> Path:
    env = os.environ if env is None else env
    base = env.get("XDG_CONFIG_HOME") or Path(env.get("HOME", "~")).expanduser() / ".config"
    return Path(base) / "prismetric" / "config.toml"


def _parse(path: Path) -> dict[str, Any]:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: invalid TOML: {e}") from e


def _own(path: Path, data: dict[str, Any]) -> dict[str, Any] | None:
    if path.name != PROJECT:
        return data
    for key in TABLE:
        data = data.get(key) if isinstance(data, dict) else None
    return data


def discover(start: Path | None = None, env: dict[str, str] | None = None) -> list[Path]:
    """Files that count, the strongest first."""
    here = (start or Path.cwd()).resolve()
    up = [here, *here.parents]
    near = next((d / FILE for d in up if (d / FILE).is_file()), None)
    project = next((d / PROJECT for d in up if (d / PROJECT).is_file() and _own(d / PROJECT, _parse(d / PROJECT)) is not None), None)
    user = user_path(env)
    return [p for p in (near, project, user if user.is_file() else None) if p]


def _rules(path: Path, entries: list[Any]) -> list[NameRule]:
    out = []
    for i, entry in enumerate(entries):
        where = f"{path}: [pii].name_rules[{i}]"
        if not isinstance(entry, dict):
            raise ConfigError(f"{where} must be a table, got {type(entry).__name__}.")
        if unknown := set(entry) - {"pattern", "detector", "confidence"}:
            raise ConfigError(f"{where} has unknown keys: {', '.join(sorted(unknown))}.")
        for key in ("pattern", "detector"):
            if not isinstance(entry.get(key), str) or not entry[key]:
                raise ConfigError(f"{where}.{key} must be a non-empty string.")
        level = entry.get("confidence", "medium")
        if not isinstance(level, str) or level.lower() not in BANDS:
            raise ConfigError(f"{where}.confidence must be one of low|medium|high, got {level!r}.")
        out.append(NameRule(entry["pattern"], entry["detector"].lower(), level.lower()))
    return out


def _checked(path: Path) -> dict[str, Any]:
    """A file's settings by dotted name."""
    table = _own(path, _parse(path))
    if not isinstance(table, dict):
        raise ConfigError(f"{path}: root must be a TOML table.")
    out: dict[str, Any] = {}

    def check(name: str, test: Callable[[Any], str | None], value: Any) -> None:
        if said := test(value):
            raise ConfigError(f"{path}: {name} must be {said}, got {value!r}.")
        out[name] = _rules(path, value) if name == "pii.name_rules" else value.lower() if name in ("fail_on_pii", "render.color") else value

    for raw, value in table.items():
        key = raw.replace("-", "_")
        if key in TOP:
            check(key, TOP[key], value)
        elif key in NESTED:
            if not isinstance(value, dict):
                raise ConfigError(f"{path}: [{key}] must be a table.")
            for inner, v in value.items():
                name = inner.replace("-", "_")
                if name not in NESTED[key]:
                    raise ConfigError(f"{path}: unknown key {inner!r} in [{key}].")
                check(f"{key}.{name}", NESTED[key][name], v)
        else:
            warnings.warn(f"{path}: unknown key {raw!r} ignored", stacklevel=2)
    return out


def _shown(path: Path) -> str:
    for base, prefix in ((Path.cwd(), "./"), (Path.home(), "~/")):
        if path.resolve().is_relative_to(base.resolve()):
            return prefix + str(path.resolve().relative_to(base.resolve()))
    return str(path)


def load(explicit: Path | None = None, *, disable: bool = False, start: Path | None = None, env: dict[str, str] | None = None) -> LoadedConfig:
    """Settings of all files, the strongest winning; rules for names add up. A key for a service is never among them."""
    if disable:
        return LoadedConfig()
    if explicit is not None and not explicit.expanduser().is_file():
        raise ConfigNotFoundError(f"Config file not found: {explicit}")
    paths = [explicit.expanduser()] if explicit else discover(start, env)
    values: dict[str, Any] = {}
    sources: dict[str, str] = {}
    for path in reversed(paths):
        for name, value in _checked(path).items():
            section, _, key = name.rpartition(".")
            held = values.setdefault(section, {}) if section else values
            held[key] = held.get(key, []) + value if name == "pii.name_rules" else value
            sources[name] = _shown(path)
    return LoadedConfig(values, sources, tuple(map(_shown, paths)))
