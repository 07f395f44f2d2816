"""Redacted copies of tables: a plan from a profile, and the expressions that carry it out."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as kinds
from ..functions.masks import DEFAULTS, STRATEGIES, redacted
from ..functions.text import as_text
from ..model import BANDS, PERSONAL, TableProfile

# The output format that each file name stands for.
FORMATS = ("csv", "jsonl", "parquet")
BY_SUFFIX = {".csv": "csv", ".tsv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet", ".sqlite": "parquet", ".sqlite3": "parquet", ".db": "parquet"}


class RedactionError(ValueError):
    """A strategy, band or format that there isn't."""


@dataclass(frozen=True)
class RedactionAction:
    column: str
    kind: str
    strategy: str
    confidence: float


@dataclass(frozen=True)
class RedactionPlan:
    actions: tuple[RedactionAction, ...]
    all_columns: tuple[str, ...] = ()
    min_confidence: str = "high"
    counts: dict[str, int] = field(default_factory=dict)

    def action_for(self, column: str) -> RedactionAction | None:
        return next((a for a in self.actions if a.column == column), None)


def parse_overrides(texts: Iterable[str]) -> dict[str, str]:
    """From texts like ``email=hash``."""
    out = {}
    for text in texts:
        kind, equals, strategy = (part.strip().lower() for part in text.partition("="))
        if not equals:
            raise RedactionError(f"Bad --strategy {text!r}; expected <detector>=<mask|hash|null|keep>.")
        if not kind or strategy not in STRATEGIES:
            raise RedactionError(f"Bad --strategy {text!r}; strategy must be one of {sorted(STRATEGIES)}.")
        out[kind] = strategy
    return out


def build_plan(report: TableProfile, *, min_confidence: str = "high", overrides: dict[str, str] | None = None) -> RedactionPlan:
    """Each column goes by its most confident finding of the band or above; ``keep`` leaves it alone."""
    level = (min_confidence or "high").lower()
    if level not in BANDS:
        raise RedactionError(f"Bad --min-confidence {min_confidence!r}; choose low|medium|high.")
    chosen = DEFAULTS | {k.lower(): v.lower() for k, v in (overrides or {}).items()}
    actions = []
    for column in report.columns:
        best = max(column.about(PERSONAL), key=lambda n: n.weight, default=None)
        if best and best.weight >= BANDS[level] and (strategy := chosen.get(best.kind, "mask")) != "keep":
            actions.append(RedactionAction(column.name, best.kind, strategy, best.weight))
    return RedactionPlan(tuple(actions), tuple(c.name for c in report.columns), level)


def redact(df: DataFrame, plan: RedactionPlan) -> DataFrame:
    """``df`` with the plan's columns as redacted text; no row leaves its task."""
    columns = []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        action = plan.action_for(f.name)
        columns.append(redacted(as_text(c, f.dataType), action.kind, action.strategy).alias(f.name) if action else c)
    return df.select(*columns)


def changed_cells(df: DataFrame, plan: RedactionPlan) -> dict[str, int]:
    """How many values the plan changes, by column; one aggregation. A value that isn't text changes always."""
    wanted = []
    for f in df.schema.fields:
        if not (action := plan.action_for(f.name)):
            continue
        c = F.col("`" + f.name.replace("`", "``") + "`")
        text = as_text(c, f.dataType)
        new = redacted(text, action.kind, action.strategy)
        other = ~new.eqNullSafe(text) if isinstance(f.dataType, T.StringType) else F.lit(True)
        wanted.append(F.count_if(c.isNotNull() & other).alias(f"n{len(wanted)}"))
    if not wanted:
        return {}
    names = [f.name for f in df.schema.fields if plan.action_for(f.name)]
    return {name: n for name, n in zip(names, df.agg(*wanted).first(), strict=True) if n}


def format_of(path: str | Path) -> str:
    return BY_SUFFIX.get(Path(path).suffix.lower(), "csv")


def _safe(f: T.StructField) -> bool:
    return not kinds.nested(f.dataType) and not isinstance(f.dataType, T.DecimalType | T.BinaryType | T.DayTimeIntervalType | T.YearMonthIntervalType)


#: Bytes of input from which on a copy is a folder, unless asked for otherwise; and what Spark says of sources without a size.
ONE_FILE, UNKNOWN = 1 << 30, 1 << 62


def size_of(df: DataFrame) -> int:
    """What Spark takes for the size of ``df`` in bytes, from the sizes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def write(df: DataFrame, path: str | Path, form: str | None = None, *, one_file: bool | None = None) -> None:
    """``df`` as CSV (with header, null empty, commas whatever the name), JSON lines (nulls kept) or Parquet (decimals
    and nested values as text). ``one_file``: a file, written by one task; else a folder that all tasks write. Not given:
    a file unless Spark takes the data for ``ONE_FILE`` bytes or more."""
    one_file = not ONE_FILE <= size_of(df) < UNKNOWN if one_file is None else one_file
    form = (form or format_of(path)).lower()
    if form not in FORMATS:
        raise RedactionError(f"Unsupported output format {form!r}. Choose one of: {sorted(FORMATS)}.")
    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields]
    if form == "csv":
        df = df.select(*(as_text(c, f.dataType).alias(f.name) for c, f in zip(columns, df.schema.fields, strict=True)))
    elif form == "parquet":
        df = df.select(*(c if _safe(f) else as_text(c, f.dataType).alias(f.name) for c, f in zip(columns, df.schema.fields, strict=True)))
    out = Path(tempfile.mkdtemp(dir=Path(path).resolve().parent, prefix=".part-")) / "out" if one_file else path
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(str(out))
    elif form == "jsonl":
        writer.option("ignoreNullFields", False).json(str(out))
    else:
        writer.parquet(str(out))
    if one_file:
        part = next(Path(out).glob("part-*"), None)
        if part:
            shutil.move(part, path)
        elif form == "csv":
            Path(path).write_text(",".join(df.columns) + "\n")
        else:
            Path(path).write_text("")
        shutil.rmtree(Path(out).parent, ignore_errors=True)


def run_redaction(df: DataFrame, path: str | Path, plan: RedactionPlan, *, form: str | None = None, one_file: bool | None = None) -> dict[str, int]:
    """Write the redacted copy; how many cells changed, by column."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    counts = changed_cells(df, plan)
    write(redact(df, plan), path, form, one_file=one_file)
    plan.counts.clear()
    plan.counts.update(counts)
    return counts
