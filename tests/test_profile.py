import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismetric.functions.text import as_text
from prismetric.functions.types import family, type_name
from prismetric.model import NameRule
from prismetric.operators import stats
from prismetric.operators.profile import profile
from prismetric.render import reports


@pytest.fixture
def tiny(spark):
    return spark.createDataFrame([(1, "Alice", "alice@example.com", 9.5), (2, "Bob", None, 7.25), (3, "Carol", "carol@example.com", None)], "id long, name string, email string, score double")


def test_golden(tiny):
    report = profile(tiny)
    by = {c.name: c for c in report.columns}
    assert (report.rows, len(report.columns)) == (3, 4)
    assert [c.type for c in report.columns] == ["BIGINT", "VARCHAR", "VARCHAR", "DOUBLE"]
    assert [c.null_share for c in report.columns] == [0.0, 0.0, 33.33, 33.33]
    assert [c.distinct for c in report.columns] == [3, 3, 2, 2]
    assert (by["id"].least, by["id"].greatest, by["id"].mean) == (1, 3, 2.0)
    assert (by["score"].least, by["score"].greatest, by["score"].mean) == (7.25, 9.5, 8.375)
    assert by["name"].common == (("Alice", 1), ("Bob", 1), ("Carol", 1))
    assert not any(c.rhythm for c in report.columns)


def test_json_shape(tiny):
    data = json.loads(reports.dumps(reports.report_to_dict(profile(tiny, path="x.csv"))))
    assert list(data) == ["schema_version", "file", "rows", "cols", "sampled", "sample_size", "columns", "time_series"]
    assert list(data["columns"][0]) == ["name", "dtype", "null_pct", "distinct", "sample", "min", "max", "mean", "stddev", "top", "pii", "anomalies"]
    assert data["schema_version"] == 4 and data["file"] == {"path": "x.csv", "size_bytes": None, "encoding": "utf-8"}


def test_sample_limits_rows(tiny):
    report = profile(tiny, sample=2)
    assert (report.rows, report.origin.first) == (2, 2)


def test_whole_and_sample_agree_on_small_tables(tiny):
    assert profile(tiny) == profile(tiny, detect="all")


def test_empty_and_nested(spark):
    empty = profile(spark.createDataFrame([], "a int, b string"))
    assert empty.rows == 0 and [c.null_share for c in empty.columns] == [0.0, 0.0]
    nested = profile(spark.createDataFrame([([1, 2], {"k": 1}), (None, None)], "xs array<int>, m map<string,int>"))
    assert [(c.type, c.least, c.distinct) for c in nested.columns] == [("INTEGER[]", None, 1), ("MAP(VARCHAR, INTEGER)", None, 0)]


def test_odd_names(spark):
    report = profile(spark.createDataFrame([(1, 2)], ["a.b", "we`ird"]))
    assert [(c.name, c.distinct) for c in report.columns] == [("a.b", 1), ("we`ird", 1)]


def test_repeated_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"]).select("a", F.col("b").alias("a"))
    assert [c.least for c in profile(df).columns] == [1, 2]


def test_frequent_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaacdefg"], ["v"])
    assert stats.frequencies(df, 3) == [(7, [("a", 2), ("b", 2), ("c", 1)])]


@pytest.mark.parametrize("between", [100_000, 40])
def test_quantiles(spark, monkeypatch, between):
    """Against numpy, also where the values between the bounds are too many at first."""
    monkeypatch.setattr(stats, "BETWEEN", between)
    rng = np.random.default_rng(1)
    columns = [rng.normal(size=30_000), rng.integers(0, 5, 30_000).astype(float), np.r_[np.zeros(29_999), 1e9], np.arange(30_000.0)]
    rows = [tuple(map(float, r)) + (None,) for r in zip(*columns, strict=True)] + [(None, None, None, None, None)] * 7
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = stats.quantiles(df, [0.0, 0.25, 0.5, 0.75, 1.0])
    for name, values in zip("abcd", columns, strict=True):
        assert np.allclose(got[name], np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0]), rtol=1e-12)
    assert got["e"] is None and stats.quantiles(df.where("a is not null").limit(1), [0.5])["a"] == [columns[0][0]]


def test_column_stats_rows(tiny):
    rows = {r["name"]: r for r in stats.column_stats(tiny).collect()}
    assert (rows["email"]["nulls"], rows["email"]["distinct"], rows["score"]["mean"]) == (1, 2, 8.375)


def test_plain_and_distinct_are_not_mixed(tiny):
    plan = stats.column_stats(tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


@pytest.mark.parametrize("value", [1e-4, 9.9e-5, 123456789.5, 1e16, 1.5e22, 0.1, -2.0, 1e-7, float("inf"), float("nan"), 1e15])
def test_floats_as_text(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(as_text(F.col("v"), df.schema["v"].dataType)).first()[0] == str(value)


def test_other_values_as_text(spark):
    values = (True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 600), dt.datetime(2024, 1, 2))
    df = spark.createDataFrame([values], "a boolean, b date, c timestamp_ntz, d timestamp_ntz")
    assert tuple(df.select(*(as_text(F.col(f.name), f.dataType) for f in df.schema)).first()) == tuple(map(str, values))


def test_type_names(spark):
    df = spark.createDataFrame([], "a decimal(10,2), b array<float>, c struct<x:int>, d timestamp_ntz, e binary, f tinyint")
    assert [type_name(f.dataType) for f in df.schema] == ["DECIMAL(10,2)", "FLOAT[]", 'STRUCT("x" INTEGER)', "TIMESTAMP", "BLOB", "TINYINT"]
    assert [family(t) for t in ("BIGINT", "VARCHAR", "TIMESTAMP", "BOOLEAN", "MAP(A, B)")] == ["numeric", "text", "temporal", "bool", "other"]


def test_booleans_look_like_names(spark):
    report = profile(spark.createDataFrame([(True,), (False,)], "flag boolean"))
    assert [(f.kind, f.weight) for f in report.columns[0].notices] == [("name", 0.85)]


def test_rules_add_findings(spark):
    report = profile(spark.createDataFrame([("x",)], "customer_ref string"), rules=[NameRule("*_REF", "badge", "high")])
    assert [(f.kind, f.weight, f.hits) for f in report.columns[0].notices] == [("badge", 0.925, 0)]
