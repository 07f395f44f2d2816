"""Reports as JSON, plain text and HTML."""

from __future__ import annotations

import html
import json
from typing import Any

from ..model import ODD, PERSONAL, ColumnRow, Rhythm, TableProfile, band
from ..operators.diff import FACT, Comparison
from ..operators.multi import MultiReport
from ..operators.score import ScoreResult, score_to_dict
from ..operators.timeseries import BUCKETS, duration
from .values import jsonable

VERSION = 4


def _column(c: ColumnRow) -> dict[str, Any]:
    values = {"sample": c.example, "min": c.least, "max": c.greatest, "mean": c.mean, "stddev": c.deviation}
    return {
        "name": c.name, "dtype": c.type, "null_pct": c.null_share, "distinct": c.distinct,
        **{k: jsonable(v) for k, v in values.items()},
        "top": [{"value": jsonable(v), "count": n} for v, n in c.common],
        "pii": [{"kind": n.kind, "confidence": n.weight, "match_ratio": n.share, "matched": n.hits, "sampled": n.seen} for n in c.about(PERSONAL)],
        "anomalies": [{"kind": n.kind, "severity": n.level, "detail": n.words} for n in c.about(ODD)],
    }


def kept_share(t: Rhythm) -> float:
    """Steps that keep to the usual one, in percent."""
    return round(100.0 * t.kept / (t.n - 1), 2) if t.step else 0.0


def missing(t: Rhythm) -> int | None:
    return max(0, t.expected - t.n) if t.step else None


def _skew(bucket: str, label: str, share: float) -> dict[str, Any]:
    even = 1 / BUCKETS[bucket]
    return {"bucket": bucket, "label": label, "share": round(share, 4), "expected_share": round(even, 4), "ratio": round(share / even, 2)}


def _series(name: str, t: Rhythm) -> dict[str, Any]:
    first, last = (at.isoformat() for at in t.span)
    return {
        "column": name, "detected_from": t.read_from, "points": t.n, "range": {"min": first, "max": last},
        "cadence_seconds": t.step, "cadence_label": duration(t.step) if t.step else None, "conformance_pct": kept_share(t),
        "expected_buckets": t.expected, "missing_buckets": missing(t),
        "gaps": [{"start": a.isoformat(), "end": b.isoformat(), "duration_seconds": s} for a, b, s in t.gaps],
        "seasonality": [_skew(*s) for s in t.skew],
    }


def report_to_dict(report: TableProfile, score: ScoreResult | None = None) -> dict[str, Any]:
    """The keys of a report, which its readers rely on."""
    path, size, encoding = report.origin.path, report.origin.size, report.origin.encoding
    out = {
        "schema_version": VERSION,
        "file": {"path": str(path) if path else None, "size_bytes": size, "encoding": encoding},
        "rows": report.rows, "cols": len(report.columns), "sampled": bool(report.origin.first), "sample_size": report.origin.first,
        "columns": [_column(c) for c in report.columns],
        "time_series": [_series(c.name, c.rhythm) for c in report.columns if c.rhythm],
    }
    return out | ({"score": score_to_dict(score)} if score else {})


def multi_to_dict(report: MultiReport) -> dict[str, Any]:
    summary = {"files_loaded": report.loaded_count, "files_failed": report.failed_count, "total_rows": report.total_rows, "schema_clusters": len(report.clusters), "drifted_columns": list(report.drifted_columns)}
    files = [{"path": f.path, "ok": f.ok, "error": f.error, "error_kind": f.error_kind, "profile": report_to_dict(f.report) if f.ok and f.report else None} for f in report.files]
    clusters = [{"size": c.size, "columns": [{"name": n, "dtype": t} for n, t in c.signature], "files": list(c.files)} for c in report.clusters]
    return {"schema_version": VERSION, "kind": "multi", "inputs": list(report.inputs), "summary": summary, "files": files, "clusters": clusters}


def dumps(data: dict[str, Any], indent: int | None = 2) -> str:
    return json.dumps(data, indent=indent, ensure_ascii=False, default=str)


def table(head: list[str], rows: list[list[Any]]) -> str:
    """Columns set out with spaces; long cells are cut."""
    cells = [[("" if v is None else str(v)).replace("\n", " ")[:40] for v in row] for row in [head, *rows]]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def _column_rows(report: TableProfile) -> list[list[Any]]:
    common = lambda c: ", ".join(f"{v} ({n})" for v, n in c.common[:3])
    return [[c.name, c.type, f"{c.null_share:.2f}", c.distinct, c.least, c.greatest, c.mean, c.deviation, common(c)] for c in report.columns]


def _pii_rows(report: TableProfile) -> list[list[Any]]:
    return [[c.name, n.kind, f"{n.weight:.2f}", band(n.weight), f"{n.hits}/{n.seen}"] for c, n in report.personal()]


def _anomaly_rows(report: TableProfile) -> list[list[Any]]:
    return [[c.name, n.kind, n.level, n.words] for c in report.columns for n in c.about(ODD)]


COLUMN_HEAD = ["column", "type", "null %", "distinct", "min", "max", "mean", "stddev", "frequent"]
PII_HEAD = ["column", "kind", "confidence", "band", "matched"]
ANOMALY_HEAD = ["column", "kind", "severity", "detail"]


def text(report: TableProfile, score: ScoreResult | None = None) -> str:
    origin = report.origin
    size = "" if origin.size is None else f", {origin.size:,} bytes"
    parts = [f"{origin.path or 'table'}: {report.rows:,} rows, {len(report.columns)} columns{size}{' (sampled)' if origin.first else ''}"]
    if report.columns:
        parts.append(table(COLUMN_HEAD, _column_rows(report)))
    parts.append("Personal data\n" + (table(PII_HEAD, rows) if (rows := _pii_rows(report)) else "none found"))
    parts.append("Anomalies\n" + (table(ANOMALY_HEAD, rows) if (rows := _anomaly_rows(report)) else "none found"))
    rows = []
    for name, t in ((c.name, c.rhythm) for c in report.columns if c.rhythm):
        skew = ", ".join(f"{label} x{share * BUCKETS[bucket]:.2f}" for bucket, label, share in t.skew)
        step = duration(t.step) if t.step else None
        rows.append([name, *(at.isoformat() for at in t.span), step, f"{kept_share(t):.2f}", missing(t), len(t.gaps), skew])
    if rows:
        parts.append("Times\n" + table(["column", "from", "to", "cadence", "on time %", "missing", "gaps", "skew"], rows))
    if score:
        parts.append(f"Score {score.score} ({score.grade})\n" + "\n".join(f"-{p.points} {p.detail}" for p in score.penalties))
    return "\n\n".join(parts)


def multi_text(report: MultiReport) -> str:
    parts = [f"{report.loaded_count} of {len(report.files)} files, {report.total_rows:,} rows, {len(report.clusters)} schemas"]
    parts += [f"schema {i} ({c.size} files): {', '.join(f'{n} {t}' for n, t in c.signature)}\n" + "\n".join(f"  {f}" for f in c.files) for i, c in enumerate(report.clusters, 1)]
    parts.append("drifted: " + (", ".join(report.drifted_columns) or "none"))
    parts += [f"failed: {f.path}: {f.error}" for f in report.failures]
    return "\n\n".join(parts)


def diff_text(diff: Comparison) -> str:
    b, a = diff.before, diff.after
    counts = f"rows {b.rows:,} -> {a.rows:,}; columns {len(b.columns)} -> {len(a.columns)}"
    head = f"{b.origin.path} -> {a.origin.path}: severity {diff.severity}; {counts}"
    rows = []
    for c in diff.columns:
        said = [f"{x.of} {x.sides[0]} -> {x.sides[1]} ({x.severity})" if x.about == FACT else f"{x.of} {x.words} ({x.severity})" for x in c.changes]
        if c.status != "unchanged":
            rows.append([c.name, c.status, c.severity, "; ".join(said)])
    return head + ("\n\n" + table(["column", "status", "severity", "changes"], rows) if rows else "\n\nno differences")


STYLE = "body{font:15px system-ui,sans-serif;margin:2rem;max-width:75rem}table{border-collapse:collapse;margin:1rem 0}td,th{border:1px solid #ccc;padding:.3rem .6rem;text-align:left}.high{color:#b00020}.medium,.warn{color:#a66300}"


def page(report: TableProfile, title: str = "Profile", reading: str | None = None) -> str:
    """A page that needs nothing else: facts of the file, columns, personal data, anomalies and a reading, if there is one."""
    esc = lambda v: html.escape("" if v is None else str(v))

    def part(name: str, head: list[str], rows: list[list[Any]]) -> str:
        if not rows:
            return f"<h2>{esc(name)}</h2><p>none found</p>"
        cell = lambda v: f'<td class="{esc(v)}">{esc(v)}</td>' if v in ("high", "medium", "low", "warn", "info") else f"<td>{esc(v)}</td>"
        body = "".join("<tr>" + "".join(map(cell, row)) + "</tr>" for row in rows)
        return f"<h2>{esc(name)}</h2><table><tr>{''.join(f'<th>{esc(h)}</th>' for h in head)}</tr>{body}</table>"

    origin = report.origin
    name = str(origin.path).rsplit("/", 1)[-1] if origin.path else "table"
    counts = [["rows", f"{report.rows:,}"], ["columns", len(report.columns)]]
    facts = [["path", origin.path], *counts, ["bytes", origin.size], ["encoding", origin.encoding], ["sampled", bool(origin.first)]]
    parts = [part("File", ["", ""], facts), part("Columns", COLUMN_HEAD, _column_rows(report)), part("Personal data", PII_HEAD, _pii_rows(report)), part("Anomalies", ANOMALY_HEAD, _anomaly_rows(report))]
    if reading:
        parts.append("<h2>Reading</h2>" + "".join(f"<p>{esc(p)}</p>" for p in reading.split("\n\n")))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{esc(title)}: {esc(name)}</title><style>{STYLE}</style></head><body><h1>{esc(title)}: {esc(name)}</h1>{"".join(parts)}</body></html>'
