import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
import yaml

from prismetric.model import ODD, PERSONAL, ColumnRow, Notice, Origin, TableProfile
from prismetric.operators import expectations
from prismetric.operators.diff import compare, compare_tables, diff_to_dict
from prismetric.operators.profile import profile
from prismetric.operators.score import badge_svg, compute_score
from prismetric.render import reports
from prismetric.sources.load import load


def column(name="x", dtype="BIGINT", null_pct=0.0, distinct=5, **more):
    return ColumnRow(name, dtype, 1000, round(10 * null_pct), distinct, **more)


def report(*columns, rows=10, path="orders.csv", encoding="utf-8"):
    return TableProfile(rows, columns, Origin(Path(path), encoding=encoding))


def pii(kind, confidence):
    return (Notice(PERSONAL, kind, confidence, 1, 1),)


def odd(kind, level):
    return (Notice(ODD, kind, level=level),)


def test_clean_score():
    got = compute_score(report(column()))
    assert (got.score, got.grade, got.penalties, got.color) == (100, "A", (), "#4c1")


@pytest.mark.parametrize(
    "columns,kind,points",
    [
        ([column(null_pct=50.0)], "null_density", 20), ([column(null_pct=25.0)], "null_density", 12), ([column(null_pct=100.0)] * 3, "null_density", 30), ([column(null_pct=20.0)], None, 0),
        ([column(notices=odd("mixed_types", "warn"))] * 4, "mixed_types", 18), ([column(notices=odd("pk_duplicates", "high"))] * 3, "pk_duplicates", 20),
        ([column(notices=odd("numeric_outliers", "warn"))] * 5, "numeric_outliers", 8), ([column(notices=odd("numeric_outliers", "info"))], "numeric_outliers", 1),
        ([column(notices=pii("email", 0.9))] * 6, "pii_exposure", 20), ([column(notices=pii("email", 0.7))], "pii_exposure", 2), ([column(notices=pii("email", 0.1))], None, 0),
    ],
)
def test_penalties(columns, kind, points):
    got = {p.kind: p.points for p in compute_score(report(*columns)).penalties}
    assert got == ({kind: points} if kind else {})


def test_score_details():
    got = compute_score(report(column("a", null_pct=90.0), column("b", null_pct=30.0), encoding=None))
    assert [(p.kind, p.points, p.detail) for p in got.penalties] == [
        ("null_density", 30, "high null density (2 columns > 20% null: 'a' 90%, 'b' 30%)"),
        ("encoding", 3, "could not confirm text encoding for .csv input"),
    ]
    assert (got.score, got.grade) == (67, "D")


def test_badge():
    svg = badge_svg(compute_score(report(column())), label="A <b>")
    assert ET.fromstring(svg).tag.endswith("svg") and "100 · A" in svg and "A &lt;b&gt;" in svg


def test_diff():
    before = report(column("a", distinct=10, mean=1.0), column("b", notices=pii("email", 0.9)), column("gone"))
    after = report(column("a", "VARCHAR", null_pct=30.0, distinct=10), column("b", notices=pii("email", 0.65)), column("new"))
    diff = compare(before, after)
    by = {c.name: c for c in diff.columns}
    assert [c.name for c in diff.columns] == ["a", "b", "new", "gone"]
    assert [(x.of, x.severity) for x in by["a"].changes] == [("dtype", "high"), ("null_pct", "high"), ("mean", "medium")]
    assert [(p.words, p.severity) for p in by["b"].changes] == [("shifted", "medium")]
    assert (by["new"].status, by["new"].severity, by["gone"].status, diff.severity) == ("added", "medium", "removed", "high")
    data = json.loads(reports.dumps(diff_to_dict(diff)))
    assert data["summary"] == {"added": ["new"], "removed": ["gone"], "changed": ["a", "b"], "unchanged": []}
    assert data["columns"][0]["changes"][1]["detail"] == "Δ +30.00 pp"
    assert "gone" in reports.diff_text(diff)


@pytest.mark.parametrize("a,b,severity", [(10, 10, None), (10, 11, "low"), (10, 15, "medium"), (10, 30, "high"), (0, 1, "high")])
def test_relative_changes(a, b, severity):
    changes = compare(report(column(distinct=a)), report(column(distinct=b))).columns[0].changes
    assert [c.severity for c in changes] == ([severity] if severity else [])


def test_same_is_unchanged():
    assert compare(report(column()), report(column())).severity == "none"


def test_tables_compared(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, s string")
    b = spark.createDataFrame([(1.0,), (2.0,)], "k double")
    rows = {r["name"]: r for r in compare_tables(a, b).collect()}
    assert (rows["s"]["status"], rows["k"]["status"], rows["k"]["after_dtype"], rows["k"]["mean_severity"]) == ("removed", "both", "DOUBLE", "none")


def test_suites(spark, people):
    r = profile(load(spark, people), path=people)
    gx = expectations.to_great_expectations(r)
    assert gx["expectation_suite_name"] == "people"
    kinds = [(e["expectation_type"], e["kwargs"].get("column")) for e in gx["expectations"]]
    assert kinds[0] == ("expect_table_columns_to_match_set", None)
    assert ("expect_column_values_to_be_between", "id") in kinds and ("expect_column_values_to_be_in_set", "note") in kinds
    assert not any(c == "email" for _, c in kinds)
    assert any(e["kwargs"].get("column") == "email" for e in expectations.to_great_expectations(r, include_pii=True)["expectations"])
    soda = yaml.safe_load(expectations.dumps(r, "soda", name="s"))
    assert soda["checks for s"][0] == {"row_count > 0": None}
    assert {"min(id) >= 1": None} in soda["checks for s"]
    assert json.loads(expectations.dumps(r, "GX"))["meta"]["rows_profiled"] == 3
    assert len(expectations.to_great_expectations(r, min_samples=99)["expectations"]) == 1
    with pytest.raises(ValueError):
        expectations.dumps(r, "x")


def test_value_sets_need_all_values():
    some = column("s", "VARCHAR", distinct=3, common=(("a", 1), ("b", 1)))
    assert expectations.value_set(some, 20) is None
    assert expectations.value_set(column("s", "VARCHAR", distinct=2, common=some.common), 20) == ["a", "b"]
    assert expectations.value_set(column("s", "VARCHAR", distinct=2, common=some.common), 1) is None


@pytest.mark.parametrize("value", [{"a": [], "b": {}, "c d": None}, {"k: x": ["yes", "-1", "é", 'q"', 1.5, True, None]}, {"l": [{"x": 1, "y": {"z": ["1"]}}, {"m": None}]}])
def test_yaml(value):
    assert yaml.safe_load("\n".join(expectations.yaml_lines(value))) == value


def test_types_and_names():
    assert [expectations.plain_type(t) for t in ("BIGINT", "DECIMAL(3,1)", "TIMESTAMP", "UUID", "BLOB", "FLOAT[]", "BOOLEAN")] == ["int", "float", "datetime", "str", "bytes", None, "bool"]
    assert [expectations.suite_name(p) for p in ("/d/my data!.csv", None, "???")] == ["my_data", "prismetric_suite", "prismetric_suite"]


def test_page_and_text(spark, people):
    r = profile(load(spark, people), path=people)
    page = reports.page(r, reading="One <two>\n\nthree")
    assert page.startswith("<!doctype html>") and "One &lt;two&gt;" in page and "credit" not in page
    assert "people.csv" in reports.text(r, compute_score(r)) and "Score" in reports.text(r, compute_score(r))
