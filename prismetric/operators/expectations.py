"""Starter suites of expectations from a profile, as JSON for one tool and YAML for another."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from ..functions.types import WHOLE
from ..model import BANDS, PERSONAL, ColumnRow, TableProfile
from ..render.values import jsonable

# Formats, versions, the largest set of values, and the name where a path has none.
GX, SODA = "gx", "soda"
FORMATS = (GX, SODA)
VERSION, MAKER, FALLBACK = 1, "prismetric", "prismetric_suite"
MOST_VALUES = 20
SODA_TYPES = {"int": "integer", "float": "decimal", "bool": "boolean", "str": "text", "date": "date", "datetime": "timestamp", "time": "time", "bytes": "text"}
# the first pattern that a type's name fits in full
PLAIN_TYPES = (
    ("bool", "BOOLEAN"), ("int", "|".join(WHOLE)), ("float", "FLOAT|DOUBLE|REAL|(DECIMAL|NUMERIC).*"), ("date", "DATE"),
    ("datetime", "(TIMESTAMP|DATETIME).*"), ("time", "TIME"), ("str", "TEXT|STRING|UUID|(VARCHAR|CHAR).*"), ("bytes", "BLOB"),
)


def plain_type(dtype: str) -> str | None:
    if dtype.endswith("]"):
        return None
    return next((name for name, pattern in PLAIN_TYPES if re.fullmatch(pattern, dtype.upper())), None)


def suite_name(path: Path | str | None) -> str:
    stem = Path(str(path)).stem if path is not None else ""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", stem).strip("_") or FALLBACK


def eligible(report: TableProfile, include_pii: bool, min_samples: int) -> list[ColumnRow]:
    """Columns without likely personal data (unless wanted) and with enough values, as the null share tells."""
    there = lambda c: max(0, round(report.rows * (1 - c.null_share / 100)))
    safe = lambda c: include_pii or all(n.weight < BANDS["medium"] for n in c.about(PERSONAL))
    return [c for c in report.columns if safe(c) and there(c) >= min_samples]


def bounds(c: ColumnRow) -> tuple[Any, Any] | None:
    low, high = jsonable(c.least), jsonable(c.greatest)
    return (low, high) if plain_type(c.type) in ("int", "float") and low is not None and high is not None else None


def value_set(c: ColumnRow, most: int) -> list[Any] | None:
    """All values of the column, if there are few and the frequent values are all of them."""
    if not 0 < c.distinct <= min(most, len(c.common)):
        return None
    values: list[Any] = []
    for v in (jsonable(value) for value, _ in c.common):
        if v is not None and v not in values:
            values.append(v)
    return values or None


def _about(report: TableProfile, include_pii: bool, min_samples: int) -> dict[str, Any]:
    return {"schema_version": VERSION, "source_path": str(report.origin.path) if report.origin.path else None, "rows_profiled": report.rows, "sampled": bool(report.origin.first), "include_pii": include_pii, "min_samples": min_samples}


def _of_column(c: ColumnRow, rows: int, most: int) -> Iterator[tuple[str, dict[str, Any], dict[str, Any]]]:
    """(expectation without its prefix, arguments, more about it)."""
    yield "to_exist", {}, {}
    if kind := plain_type(c.type):
        yield "values_to_be_of_type", {"type_": kind}, {"dtype": c.type}
    if c.null_share == 0 and rows > 0:
        yield "values_to_not_be_null", {}, {}
    if found := bounds(c):
        yield "values_to_be_between", {"min_value": found[0], "max_value": found[1]}, {}
    lengths = [len(value) for value, _ in c.common if isinstance(value, str)] if kind == "str" else []
    if lengths:
        yield "value_lengths_to_be_between", {"min_value": min(lengths), "max_value": max(lengths)}, {"source_hint": "top_k_lengths"}
    if values := value_set(c, most):
        yield "values_to_be_in_set", {"value_set": values}, {}


def to_great_expectations(report: TableProfile, *, name: str | None = None, include_pii: bool = False, min_samples: int = 0, most_values: int = MOST_VALUES) -> dict[str, Any]:
    out = []
    if report.columns:
        out.append({"expectation_type": "expect_table_columns_to_match_set", "kwargs": {"column_set": [c.name for c in report.columns]}, "meta": {"source": MAKER, "level": "table"}})
    for c in eligible(report, include_pii, min_samples):
        for what, kwargs, more in _of_column(c, report.rows, most_values):
            out.append({"expectation_type": f"expect_column_{what}", "kwargs": {"column": c.name, **kwargs}, "meta": {"source": MAKER, "column": c.name, **more}})
    meta = {"generated_by": MAKER, **_about(report, include_pii, min_samples)}
    return {"expectation_suite_name": name or suite_name(report.origin.path), "meta": meta, "expectations": out, "data_asset_type": None, "ge_cloud_id": None}


def to_soda(report: TableProfile, *, name: str | None = None, include_pii: bool = False, min_samples: int = 0, most_values: int = MOST_VALUES) -> dict[str, Any]:
    checks: list[dict[str, Any]] = [{"row_count > 0": None}]
    if report.columns:
        checks.append({"schema": {"name": "expected columns present", "fail": {"when required column missing": [c.name for c in report.columns]}}})
    for c in eligible(report, include_pii, min_samples):
        if c.null_share == 0 and report.rows > 0:
            checks.append({f"missing_count({c.name}) = 0": None})
        if found := bounds(c):
            checks += [{f"min({c.name}) >= {found[0]}": None}, {f"max({c.name}) <= {found[1]}": None}]
        if values := value_set(c, most_values):
            checks.append({f"invalid_count({c.name}) = 0": {"name": f"{c.name} in known value set", "valid values": values}})
        if kind := plain_type(c.type):
            checks.append({f"invalid_count({c.name}) = 0 as {c.name}_type_check": {"name": f"{c.name} matches type {SODA_TYPES[kind]}", "valid format": SODA_TYPES[kind]}})
    return {f"checks for {name or suite_name(report.origin.path)}": checks, MAKER: _about(report, include_pii, min_samples)}


def dumps(report: TableProfile, form: str, **options: Any) -> str:
    form = form.lower().strip()
    if form == GX:
        return json.dumps(to_great_expectations(report, **options), indent=2)
    if form == SODA:
        return "\n".join(yaml_lines(to_soda(report, **options))) + "\n"
    raise ValueError(f"unknown expectations format {form!r}; expected one of {FORMATS}")


# What needs no quotes in YAML.
PLAIN = re.compile(r"(?![-%@>!])[A-Za-z0-9_./+()= @%<>!,-]+")
NUMBERISH = re.compile(r"[+.]?\d[\d_.,eExX+:-]*|\.(inf|nan)", re.IGNORECASE)
WORDS = {"null", "true", "false", "yes", "no", "on", "off", "~"}


def yaml_scalar(value: Any) -> str:
    if value is None or isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    text = str(value)
    plain = PLAIN.fullmatch(text) and text.lower() not in WORDS and not NUMBERISH.fullmatch(text)
    return text if plain else json.dumps(text, ensure_ascii=False)


def yaml_lines(value: Any) -> Iterator[str]:
    """A mapping or list as block lines; lists of scalars stay on one line."""
    if isinstance(value, dict):
        for key, inside in value.items():
            head = f"{yaml_scalar(str(key))}:"
            if isinstance(inside, dict | list | tuple) and inside and not _flat(inside):
                yield head
                yield from ("  " + line for line in yaml_lines(inside))
            else:
                yield f"{head} {_inline(inside)}"
    else:
        for item in value:
            lines = list(yaml_lines(item)) if isinstance(item, dict) and item else [_inline(item)]
            yield from (("- " if i == 0 else "  ") + line for i, line in enumerate(lines))


def _flat(value: Any) -> bool:
    return not isinstance(value, dict) and not any(isinstance(x, dict | list | tuple) for x in value)


def _inline(value: Any) -> str:
    if isinstance(value, dict):
        return "{}"
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(yaml_scalar, value)) + "]"
    return yaml_scalar(value)
