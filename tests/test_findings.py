import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from prismetric.functions import patterns
from prismetric.operators import anomalies, pii
from prismetric.operators.timeseries import duration, season, time_series
from prismetric.render.reports import _series as shown


def counts(spark, values):
    df = spark.createDataFrame([(0, str(v)) for v in values], "place int, v string")
    return pii.match_counts(df)[0]


def found(spark, name, values, dtype="VARCHAR"):
    return {f.kind: f.weight for f in pii.findings(name, dtype, counts(spark, values))}


def test_email(spark):
    assert found(spark, "contact", ["a@b.com", "c@d.org", "no"]) == {"email": 0.6}
    assert found(spark, "email", ["a@b.com"]) == {"email": 1.0}


def test_cards(spark):
    got = found(spark, "n", ["4111 1111 1111 1111", "4111111111111112"])
    assert got["credit_card"] == 0.45
    assert "credit_card" not in found(spark, "n", ["18", "0000"])


def test_ssn_strict_and_loose(spark):
    assert found(spark, "x", ["123-45-6789", "000-12-3456", "666-12-3456", "912-12-3456", "123-00-1234", "123-45-0000"])["ssn"] == 0.15
    assert found(spark, "ssn", ["123456789"])["ssn"] == 0.9
    assert "ssn" not in found(spark, "x", ["123456789"])


def test_ips(spark):
    assert found(spark, "x", ["10.0.0.1"])["ipv4"] == 0.9
    assert "ipv4" not in found(spark, "x", ["10.0.0.256"])
    assert found(spark, "x", ["fe80:0:0:0:0:0:0:1"])["ipv6"] == 0.9
    assert "ipv6" not in found(spark, "x", ["fe80::1"])


def test_dates_look_like_phones(spark):
    assert found(spark, "d", ["2024-01-01"])["phone"] == 0.9


def test_names(spark):
    assert found(spark, "who", ["Ann Lee", "dr. who", "x1"]) == {}
    assert found(spark, "name", ["Ann Lee", "Bo"])["name"] == 0.95
    assert found(spark, "name", ["x1", "x2"])["name"] == 0.35


def test_birth_dates(spark):
    assert found(spark, "dob", ["1990-01-02"])["dob"] == 1.0
    assert found(spark, "dob", ["x"], "DATE")["dob"] == 1.0
    assert "dob" not in found(spark, "when", ["1990-01-02"])


def test_no_values():
    assert pii.findings("email", "VARCHAR", {"sampled": 0}) == []


@pytest.mark.parametrize("value,shape", [("", "empty"), ("-1.5", "numeric"), ("0", "numeric"), ("2024-1-5", "date"), ("1/2/24", "date"), ("Yes", "bool"), ("1e5", "string")])
def test_shapes(spark, value, shape):
    assert spark.createDataFrame([(value,)], "v string").select(patterns.shape(F.col("v"))).first()[0] == shape


def test_anomalies():
    assert anomalies.high_nulls(90.0).level == "high" and anomalies.high_nulls(50.0).level == "warn" and anomalies.high_nulls(49.99) is None
    mixed = anomalies.mixed_types("VARCHAR", {"numeric": 5, "date": 0, "bool": 0, "string": 2})
    assert mixed.words == "VARCHAR column carries mixed value shapes (numeric=5, string=2)."
    assert anomalies.mixed_types("BIGINT", {"numeric": 5, "string": 2}) is None
    assert anomalies.mixed_types("VARCHAR", {"numeric": 1, "string": 99}) is None
    assert anomalies.key_duplicates("user_id", 5, 4).words == "PK-candidate column has 1 duplicate value(s) (4/5 distinct)."
    assert anomalies.key_duplicates("name", 5, 4) is None
    out = anomalies.numeric_outliers([1.0, 2, 3, 4, 5, 6, 7, 8, 10000.0])
    assert (out.level, out.words) == ("warn", "1 of 9 values lie outside IQR fence [-3, 13] (11.1%).")
    assert anomalies.numeric_outliers([1.0] * 20) is None and anomalies.numeric_outliers([1.0, 100]) is None


def series(spark, name, values, kind="string", whole=False):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    found = time_series(name, df.schema[0].dataType, df, whole)
    return shown(name, found) if found else None


@pytest.mark.parametrize("whole", [False, True])
def test_daily(spark, whole):
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(d)) for d in range(30)]
    got = series(spark, "created_at", days, whole=whole)
    assert (got["detected_from"], got["cadence_label"], got["conformance_pct"], got["points"], got["missing_buckets"]) == ("parsed", "1d", 100.0, 30, 0)
    assert got["range"] == {"min": "2024-01-01T00:00:00", "max": "2024-01-30T00:00:00"}


@pytest.mark.parametrize("whole", [False, True])
def test_hourly_and_gaps(spark, whole):
    start = dt.datetime(2024, 1, 1)
    hours = [start + dt.timedelta(hours=h) for h in range(48) if h not in (5, 6, 30)]
    got = series(spark, "ts", hours, "timestamp_ntz", whole)
    assert (got["detected_from"], got["cadence_label"], got["expected_buckets"], got["missing_buckets"]) == ("dtype", "1h", 48, 3)
    assert [(g["start"], g["duration_seconds"]) for g in got["gaps"]] == [("2024-01-01T04:00:00", 10800.0), ("2024-01-02T05:00:00", 7200.0)]


def test_mondays(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(weeks=w) for w in range(20)] + [dt.datetime(2024, 1, 2)]
    got = series(spark, "event_at", days, "timestamp_ntz")
    assert [(s["bucket"], s["label"]) for s in got["seasonality"]] == [("day_of_week", "Mon")]


def test_not_times(spark):
    assert series(spark, "notes", ["2024-01-01"] * 5) is None
    assert series(spark, "created_at", ["hello there friend"] * 5) is None
    assert series(spark, "ts", [dt.datetime(2024, 1, 1)] * 3, "timestamp_ntz") is None


def test_same_time_has_no_cadence(spark):
    got = series(spark, "ts", [dt.datetime(2024, 1, 1)] * 5, "timestamp_ntz")
    assert (got["cadence_seconds"], got["cadence_label"], got["expected_buckets"]) == (None, None, None)


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-1-5", "2024-01-05 00:00:00"), ("2024-01-05T06:07:08Z", "2024-01-05 06:07:08"), ("2024-01-05T06:07:08+02:00", "2024-01-05 06:07:08"), ("2024-01-05 06:07:08.5", "2024-01-05 06:07:08.5"),
        ("2024/02/03", "2024-02-03 00:00:00"), ("03/04/2024", "2024-03-04 00:00:00"), ("13/04/2024", "2024-04-13 00:00:00"), ("20240105", "2024-01-05 00:00:00"), ("2024-01-05 06:07", "2024-01-05 06:07:00"), ("x", None),
    ],
)
def test_parsed(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(patterns.parsed(F.col("v")).cast("string")).first()[0] == want


def test_durations():
    assert [duration(s) for s in (86400, 7200, 300, 30, 3723, 0.2, 90)] == ["1d", "2h", "5m", "30s", "1h2m3s", "0.200s", "1m30s"]


def test_season_shares():
    (one,) = season({0: 9, 1: 1}, list("ABCDEFG"), "x")
    assert one == ("x", "A", 0.9)


def test_java_and_python_patterns_agree(spark):
    values = ["a@b.co", "a@b.c", "+1 (555) 123-4567", "1234567", "123", "12345.67", "10.1.1.1", "::", "1:2:3:4:5:6:7:8", "Ann", "O’Neil Mc-Coy", "ann"]
    tests = {"EMAIL": patterns.EMAIL, "PHONE": patterns.PHONE, "IPV4": patterns.IPV4, "IPV6": patterns.IPV6, "NAME": patterns.NAME}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for pattern in tests.values():
        got = [r[0] for r in df.select(F.col("v").rlike(pattern)).collect()]
        assert got == [bool(re.match(pattern.replace("(?U)", ""), v)) for v in values]
