"""What differs between two profiles, and between the columns of two tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import family
from ..model import PERSONAL, SEVERITIES, ColumnRow, TableProfile
from . import stats

# From which change on a severity holds (low, medium, high).
NULL_POINTS = (1.0, 10.0, 25.0)
RELATIVE = (0.10, 0.50, 2.00)
SURE, SHIFT, FAR_SHIFT = 0.60, 0.20, 0.40


#: What a change is of: a fact of the column, or what it gives notice of.
FACT, NOTICE = "fact", "notice"


@dataclass(frozen=True)
class Change:
    """Of the fact or the kind of notice ``of``: its values on both sides (None where there is none), how severe it is,
    and words about it."""

    about: str
    of: str
    sides: tuple[Any, Any]
    severity: str
    words: str | None = None


def worst(severities) -> str:
    return max(severities, key=SEVERITIES.index, default="none")


@dataclass(frozen=True)
class Matched:
    """The columns of one name in two profiles, None where a profile has none, and what has changed between them."""

    sides: tuple[ColumnRow | None, ColumnRow | None]
    changes: tuple[Change, ...] = ()

    @property
    def name(self) -> str:
        return next(c.name for c in self.sides if c)

    @property
    def status(self) -> str:
        before, after = self.sides
        return "added" if not before else "removed" if not after else "changed" if self.changes else "unchanged"

    @property
    def severity(self) -> str:
        least = ["medium"] if None in self.sides else []
        return worst([*least, *(c.severity for c in self.changes)])


@dataclass(frozen=True)
class Comparison:
    before: TableProfile
    after: TableProfile
    columns: tuple[Matched, ...] = ()

    @property
    def severity(self) -> str:
        return worst(c.severity for c in self.columns)


def banded(amount: float, bands: tuple[float, float, float]) -> str:
    return SEVERITIES[sum(amount >= b for b in bands)]


def relative(before: float | None, after: float | None) -> str:
    """The severity of a change in proportion; medium where one of the values is missing."""
    if before is None or after is None:
        return "none" if before is after else "medium"
    return banded(abs(after - before) / max(abs(before), 1e-9), RELATIVE)


def _notices(before: ColumnRow | None, after: ColumnRow | None) -> list[Change]:
    old, new = ({n.kind: n.weight for n in (side.about(PERSONAL) if side else ())} for side in (before, after))
    out = []
    for kind in sorted(old | new):
        b, a = old.get(kind), new.get(kind)
        if a is None or b is None:
            sure = (b if a is None else a) >= SURE
            out.append(Change(NOTICE, kind, (b, a), "high" if sure else "medium", "disappeared" if a is None else "appeared"))
        elif abs(a - b) >= SHIFT:
            out.append(Change(NOTICE, kind, (b, a), "high" if abs(a - b) >= FAR_SHIFT else "medium", "shifted"))
    return out


def _facts(b: ColumnRow, a: ColumnRow) -> list[Change]:
    points = a.null_share - b.null_share
    retyped = "none" if a.type == b.type else "medium" if family(a.type) == family(b.type) else "high"
    seen = [
        Change(FACT, "dtype", (b.type, a.type), retyped),
        Change(FACT, "null_pct", (b.null_share, a.null_share), banded(abs(points), NULL_POINTS), f"Δ {points:+.2f} pp"),
    ]
    for name, old, new in (("distinct", b.distinct, a.distinct), ("mean", b.mean, a.mean), ("stddev", b.deviation, a.deviation)):
        seen.append(Change(FACT, name, (old, new), relative(old, new)))
    return [c for c in seen if c.severity != "none"]


def compare(before: TableProfile, after: TableProfile) -> Comparison:
    """Columns in the order of ``after``, then those that only ``before`` has."""
    old, new = ({c.name: c for c in side.columns} for side in (before, after))
    out = []
    for name in (*new, *(n for n in old if n not in new)):
        b, a = old.get(name), new.get(name)
        facts = _facts(b, a) if a and b else []
        out.append(Matched((b, a), (*facts, *_notices(b, a))))
    return Comparison(before, after, tuple(out))


def compare_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same of two tables' statistics as a DataFrame: a row for each column of either, matched by name."""
    side = lambda df, of: stats.column_stats(df).select("name", *(F.col(c).alias(f"{of}_{c}") for c in ("dtype", "rows", "nulls", "distinct", "mean", "stddev")))
    both = side(before, "before").join(side(after, "after"), "name", "full_outer")
    pct = lambda of: 100.0 * F.col(f"{of}_nulls") / F.greatest(F.col(f"{of}_rows"), F.lit(1))

    def severity(amount, bands):
        return F.when(amount >= bands[2], "high").when(amount >= bands[1], "medium").when(amount >= bands[0], "low").otherwise("none")

    def changed(c: str):
        b, a = F.col(f"before_{c}").cast("double"), F.col(f"after_{c}").cast("double")
        near = severity(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)), RELATIVE)
        return F.when(a.isNull() & b.isNull(), "none").when(a.isNull() | b.isNull(), "medium").otherwise(near)

    status = F.when(F.col("before_dtype").isNull(), "added").when(F.col("after_dtype").isNull(), "removed").otherwise("both")
    return both.select(
        "name", status.alias("status"), "before_dtype", "after_dtype", F.round(pct("after") - pct("before"), 6).alias("null_points"), severity(F.abs(pct("after") - pct("before")), NULL_POINTS).alias("null_severity"),
        *(changed(c).alias(f"{c}_severity") for c in ("distinct", "mean", "stddev")),
    )


DIFF_VERSION = 1


def diff_to_dict(diff: Comparison) -> dict:
    def side(p: TableProfile) -> dict:
        return {"path": str(p.origin.path) if p.origin.path else None, "rows": p.rows, "cols": len(p.columns)}

    def fact(c: Change) -> dict:
        return {"field": c.of, "before": c.sides[0], "after": c.sides[1], "severity": c.severity, "detail": c.words}

    def notice(c: Change) -> dict:
        return {"kind": c.of, "direction": c.words, "before": c.sides[0], "after": c.sides[1], "severity": c.severity}

    def column(c: Matched) -> dict:
        types = {f"{of}_dtype": x.type if x else None for of, x in zip(("before", "after"), c.sides, strict=True)}
        return {
            "name": c.name,
            "status": c.status,
            **types,
            "severity": c.severity,
            "changes": [fact(x) for x in c.changes if x.about == FACT],
            "pii_changes": [notice(x) for x in c.changes if x.about == NOTICE],
        }

    by_status = {s: [c.name for c in diff.columns if c.status == s] for s in ("added", "removed", "changed", "unchanged")}
    return {
        "schema_version": DIFF_VERSION,
        "before": side(diff.before),
        "after": side(diff.after),
        "severity": diff.severity,
        "summary": by_status,
        "columns": [column(c) for c in diff.columns],
    }
