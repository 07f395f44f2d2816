"""CSV and TSV with delimiter, header and types found from the file."""

from __future__ import annotations

import csv
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")
HEAD = 100
# Forms of text that a type is read from; a type is taken if all values of a column have its form.
WHOLE = r"^[+-]?(0|[1-9]\d*)$"
REAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ZERO_LED = r"^[+-]?0\d+$"
FORMS = {"boolean": r"(?i)^(true|false)$", "bigint": WHOLE, "double": REAL, "date": r"^\d{4}-\d{1,2}-\d{1,2}$", "timestamp_ntz": r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?Z?$"}


def sniff(lines: list[str]) -> tuple[str, bool]:
    """(delimiter, whether the first line is a header) from the first lines."""
    if not lines:
        return ",", True

    def rows(delimiter: str) -> list[list[str]]:
        return [r for r in csv.reader(lines, delimiter=delimiter) if r]

    def even(delimiter: str) -> tuple[bool, int]:
        widths = [len(r) for r in rows(delimiter)]
        return len(set(widths[:-1] or widths)) == 1, widths[0] if widths else 0

    best = max(DELIMITERS, key=lambda d: (even(d)[1] > 1 and even(d)[0], even(d)[1], -DELIMITERS.index(d)))
    first, *rest = rows(best)
    return best, header(first, rest)


def header(first: list[str], rest: list[list[str]]) -> bool:
    """A first line is data if one of its cells is empty or repeated, or is typed where the column's others are too."""
    if not rest:
        return not any(typed(v) for v in first)
    if "" in (v.strip() for v in first):
        return False
    return not any(typed(v) and all(typed(r[i]) for r in rest if i < len(r) and r[i]) for i, v in enumerate(first))


def typed(text: str) -> bool:
    return any(re.search(f, text.strip()) for f in FORMS.values())


def kind_of(i: int) -> list[Column]:
    """Aggregates that tell whether each type reads every value of column ``i``."""
    v = F.trim(F.col(f"_c{i}"))
    fits = {kind: v.rlike(form) & v.try_cast(kind).isNotNull() for kind, form in FORMS.items()}
    fits["bigint"] = fits["bigint"] & ~v.rlike(ZERO_LED)
    fits["double"] = fits["double"] & ~v.rlike(ZERO_LED)
    fits["timestamp_ntz"] = fits["timestamp_ntz"] | fits["date"]
    return [F.count(v).alias(f"n{i}"), *(F.count_if(v.isNotNull() & ~ok).alias(f"{kind}{i}") for kind, ok in fits.items())]


def names(head: list[str | None]) -> list[str]:
    """Names for a header's cells: empty ones by place, repeated ones numbered."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(head):
        name = (cell or "").strip() or f"column{i}"
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return out


def broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line of the file has an odd number of quotes, so that a value goes on in the next one. Only then are
    files read whole, each by one task."""
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return bool(spark.read.text(path).where(odd).take(1))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All of the file's text is read as such; one aggregation finds the type that fits every value of each column
    (BOOLEAN, BIGINT, DOUBLE, DATE, TIMESTAMP, else VARCHAR; numbers led by zeros stay text)."""
    lines = [r[0] for r in spark.read.text(path).take(HEAD)]
    delimiter, has_header = sniff(lines)
    raw = spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", broken_lines(spark, path)).option("mode", "PERMISSIVE")
    first = next(csv.reader(lines, delimiter=delimiter), [])
    schema = ", ".join(f"_c{i} string" for i in range(len(first))) or "_c0 string"
    text = raw.schema(schema).option("header", has_header).option("enforceSchema", True).csv(path)
    labels = names(first) if has_header else [f"column{i}" for i in range(len(text.columns))]
    if len(labels) > 1:  # a blank line is no row
        text = text.where(reduce(or_, (F.col(c).isNotNull() for c in text.columns)))
    return typed_columns(text, labels)


def typed_columns(text: DataFrame, labels: list[str]) -> DataFrame:
    """Columns _c0, _c1, ... of text under their labels, each as the first type that reads all its values."""
    counts = text.agg(*(c for i in range(len(labels)) for c in kind_of(i))).first().asDict()
    columns = []
    for i, label in enumerate(labels):
        kind = next((k for k in FORMS if counts[f"n{i}"] and not counts[f"{k}{i}"]), "string")
        c = F.col(f"_c{i}")
        columns.append((F.trim(c).cast(kind) if kind != "string" else c).alias(label))
    return text.select(*columns)
