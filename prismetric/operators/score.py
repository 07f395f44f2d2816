"""A score from 0 to 100 for a profile, and a badge that shows it."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from ..model import ODD, PERSONAL, ColumnRow, TableProfile, band

# Grades by least score with their colours; costs, and the most that each kind may cost.
GRADES = {"A": (90, "#4c1"), "B": (80, "#97CA00"), "C": (70, "#dfb317"), "D": (60, "#fe7d37"), "F": (0, "#e05d44")}
NULL_FLOOR, NULL_COLUMN = 20.0, 20
MIXED, KEYS, ENCODING = 6, 10, 3
OUTLIERS = {"info": 1, "warn": 2, "high": 3}
EXPOSED = {"high": 4, "medium": 2, "low": 1}
MOST = {"null_density": 30, "mixed_types": 18, "pk_duplicates": 20, "numeric_outliers": 8, "pii_exposure": 20, "encoding": 3}
TEXT_FILES = (".csv", ".tsv", ".jsonl", ".ndjson")


@dataclass(frozen=True)
class PenaltyDetail:
    kind: str
    points: int
    detail: str


@dataclass(frozen=True)
class ScoreResult:
    score: int
    grade: str
    penalties: tuple[PenaltyDetail, ...] = ()

    @property
    def color(self) -> str:
        return GRADES.get(self.grade, (0, "#9f9f9f"))[1]


def grade(score: int) -> str:
    return next(letter for letter, (least, _) in GRADES.items() if score >= least)


#: What a column costs, and how it is named in the detail; None if nothing.
Charge = Callable[[ColumnRow], tuple[int, str] | None]


def _nulls(c: ColumnRow) -> tuple[int, str] | None:
    cost = min(round(c.null_share / 2), NULL_COLUMN) if c.null_share > NULL_FLOOR else 0
    return (cost, f"'{c.name}' {c.null_share:.0f}%") if cost > 0 else None


def _flat(kind: str, cost: int) -> Charge:
    return lambda c: (cost, f"'{c.name}'") if any(c.about(ODD, kind)) else None


def _outliers(c: ColumnRow) -> tuple[int, str] | None:
    first = next(c.about(ODD, "numeric_outliers"), None)
    return (OUTLIERS.get(first.level, 1), f"'{c.name}'") if first else None


def _exposed(c: ColumnRow) -> tuple[int, str] | None:
    bands = [(EXPOSED.get(band(n.weight), 0), n) for n in c.about(PERSONAL)]
    cost, worst = max(bands, key=lambda x: x[0], default=(0, None))
    return (cost, f"{c.name} ({worst.kind}:{band(worst.weight)})") if cost else None


def _listed(names: list[str]) -> str:
    return ", ".join(names[:3]) + (f" (+{len(names) - 3} more)" if len(names) > 3 else "")


def _penalty(kind: str, columns: Iterable[ColumnRow], charge: Charge, detail: Callable[[list[str]], str]) -> list[PenaltyDetail]:
    charged = [x for x in map(charge, columns) if x]
    total = min(sum(cost for cost, _ in charged), MOST[kind])
    return [PenaltyDetail(kind, total, detail([name for _, name in charged]))] if total else []


def compute_score(report: TableProfile) -> ScoreResult:
    """100 less the penalties, each kind up to its bound; the dearest come first."""
    columns = report.columns
    by_nulls = sorted(columns, key=lambda c: -c.null_share)
    many = lambda names: f"{len(names)} column{'s' * (len(names) != 1)}"
    found = [
        *_penalty("null_density", by_nulls, _nulls, lambda n: f"high null density ({many(n)} > {NULL_FLOOR:.0f}% null: {', '.join(n[:3])})"),
        *_penalty("mixed_types", columns, _flat("mixed_types", MIXED), lambda n: f"mixed types in {_listed(n)}"),
        *_penalty("pk_duplicates", columns, _flat("pk_duplicates", KEYS), lambda n: f"duplicate values in PK-candidate {_listed(n)}"),
        *_penalty("numeric_outliers", columns, _outliers, lambda n: f"numeric outliers in {_listed(n)}"),
        *_penalty("pii_exposure", columns, _exposed, lambda n: f"PII detected without masking: {_listed(n)}"),
    ]
    kind = getattr(report.origin.path, "suffix", "").lower()
    if kind in TEXT_FILES and not report.origin.encoding:
        found.append(PenaltyDetail("encoding", ENCODING, f"could not confirm text encoding for {kind} input"))
    score = max(0, min(100, 100 - sum(p.points for p in found)))
    return ScoreResult(score, grade(score), tuple(sorted(found, key=lambda p: (-p.points, p.kind))))


def score_to_dict(result: ScoreResult) -> dict:
    return {"score": result.score, "grade": result.grade, "color": result.color, "penalties": [vars(p) for p in result.penalties]}


# Estimated widths of characters in pixels.
WIDE, THIN = "MW@%_", "ijl1.,:'"


def text_width(text: str) -> int:
    return max(20, round(sum(8.5 if c in WIDE else 3.5 if c in THIN else 6.5 for c in text)))


def badge_svg(result: ScoreResult, label: str = "Data Quality", value: str | None = None) -> str:
    """A small two-part badge as SVG, without fonts or styles from elsewhere."""
    texts = [html.escape(label), html.escape(f"{result.score} · {result.grade}" if value is None else value)]
    widths = [text_width(t) + 10 for t in texts]
    total, middles = sum(widths), (widths[0] / 2, widths[0] + widths[1] / 2)
    boxes = "".join(f'<rect x="{x}" width="{w}" height="20" fill="{c}"/>' for x, w, c in ((0, widths[0], "#555"), (widths[0], widths[1], result.color)))
    words = "".join(f'<text x="{x:g}" y="14">{t}</text>' for x, t in zip(middles, texts, strict=True))
    name = ": ".join(texts)
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{total}" height="20" role="img" aria-label="{name}"><title>{name}</title>'
        f'<clipPath id="c"><rect width="{total}" height="20" rx="3"/></clipPath><g clip-path="url(#c)">{boxes}</g>'
        f'<g fill="#fff" text-anchor="middle" font-family="Verdana,DejaVu Sans,sans-serif" font-size="11">{words}</g></svg>'
    )
