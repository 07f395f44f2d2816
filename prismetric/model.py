"""What a profile is made of: a row for each column, with what was counted in it and what it gives notice of.

Only what is counted or judged is held. What follows from that (shares, labels, missing points) is worked out where it
is shown; the keys of reports are the renderer's. Profiles are plain data: what is derived from them needs no session.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# The least confidence of each band, and how severities are ordered.
BANDS = {"low": 0.30, "medium": 0.60, "high": 0.85}
SEVERITIES = ("none", "low", "medium", "high")
#: What a notice is about: personal data, or values that are odd.
PERSONAL, ODD = "personal", "odd"


def band(confidence: float) -> str:
    """The highest band that the confidence reaches, or none."""
    return max((b for b in BANDS if confidence >= BANDS[b]), key=BANDS.__getitem__, default="none")


@dataclass(frozen=True)
class NameRule:
    """A notice of ``detector`` on every column whose name fits the pattern (as file names do, without case)."""

    pattern: str
    detector: str
    confidence: str = "medium"


@dataclass(frozen=True)
class Notice:
    """``kind`` of personal data, weighed by how many of the values seen match; or of oddity, with a level and words."""

    about: str
    kind: str
    weight: float = 0.0
    hits: int = 0
    seen: int = 0
    level: str = ""
    words: str = ""

    @property
    def share(self) -> float:
        return round(self.hits / self.seen, 3) if self.seen else 0.0


@dataclass(frozen=True)
class Rhythm:
    """A column read as times: how many, from when to when, the usual step in seconds and how many steps keep to it, the
    widest gaps as (from, to, seconds), and the shares of weekdays and hours that stand out as (bucket, label, share)."""

    read_from: str
    n: int
    span: tuple[Any, Any]
    step: float | None = None
    kept: int = 0
    gaps: tuple[tuple[Any, Any, float], ...] = ()
    skew: tuple[tuple[str, str, float], ...] = ()

    @property
    def seconds(self) -> float:
        return (self.span[1] - self.span[0]).total_seconds()

    @property
    def expected(self) -> int | None:
        return round(self.seconds / self.step) + 1 if self.step else None


@dataclass(frozen=True)
class ColumnRow:
    """``common`` are the most frequent values as (value, times)."""

    name: str
    type: str
    rows: int
    nulls: int = 0
    distinct: int = 0
    example: Any = None
    least: Any = None
    greatest: Any = None
    mean: float | None = None
    deviation: float | None = None
    common: tuple[tuple[Any, int], ...] = ()
    notices: tuple[Notice, ...] = ()
    rhythm: Rhythm | None = None

    @property
    def null_share(self) -> float:
        """In percent, with two decimals."""
        return round(self.nulls / self.rows * 100.0, 2) if self.rows else 0.0

    def about(self, what: str, kind: str | None = None) -> Iterator[Notice]:
        return (n for n in self.notices if n.about == what and kind in (None, n.kind))


@dataclass(frozen=True)
class Origin:
    """Where a table comes from; ``first`` rows of it only, if there is such a bound."""

    path: Path | str | None = None
    size: int | None = None
    encoding: str | None = None
    first: int | None = None


@dataclass(frozen=True)
class TableProfile:
    rows: int
    columns: tuple[ColumnRow, ...] = ()
    origin: Origin = field(default_factory=Origin)

    def personal(self) -> Iterator[tuple[ColumnRow, Notice]]:
        return ((c, n) for c in self.columns for n in c.about(PERSONAL))

    def most_personal(self) -> tuple[float, str, str]:
        """(weight, kind, column) of the surest notice of personal data."""
        return max(((n.weight, n.kind, c.name) for c, n in self.personal()), key=lambda x: x[0], default=(0.0, "", ""))
