import hashlib
import json

import pytest
from pyspark.sql import functions as F

from prismetric.functions.masks import redacted
from prismetric.operators import redact
from prismetric.operators.profile import profile
from prismetric.sources.load import load


@pytest.mark.parametrize(
    "kind,value,want",
    [
        ("email", "ann@mail.example.com", "***@***.com"), ("email", "nothing", "***"), ("email", "a@host", "***@***"), ("email", "a@b.", "***@***"), ("email", "a@b@c.de", "***@***.de"),
        ("phone", "+1 (555) 123-4567", "*******4567"), ("phone", "123", "***"), ("phone", "none", ""), ("credit_card", "4111 1111 1111 1111", "************1111"), ("ssn", "123-45-6789", "***-**-****"),
        ("ipv4", "10.20.30.40", "10.20.30.0"), ("ipv4", "10.20.30", "***"), ("ipv6", "2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8:85a3::"), ("ipv6", "::1", "::"), ("ipv6", "fe80::1", "fe80::"), ("name", "Ann", "***"), ("other", "x", "***"),
    ],
)
def test_masks(spark, kind, value, want):
    assert spark.createDataFrame([(value,), (None,)], "v string").select(redacted(F.col("v"), kind, "mask")).collect() == [(want,), (None,)]


def test_strategies(spark):
    df = spark.createDataFrame([("born 1990-01-02",), ("x",), (None,)], "v string")
    of = lambda s: [r[0] for r in df.select(redacted(F.col("v"), "name", s)).collect()]
    assert of("year") == ["1990", "***", None]
    assert of("hash") == [hashlib.sha256(b"born 1990-01-02").hexdigest()[:16], hashlib.sha256(b"x").hexdigest()[:16], None]
    assert of("null") == [None, None, None] and of("keep") == ["born 1990-01-02", "x", None]


def test_plan(spark, people):
    report = profile(load(spark, people))
    plan = redact.build_plan(report, overrides={"email": "hash", "phone": "keep"})
    assert {a.column: (a.kind, a.strategy) for a in plan.actions} == {
        "full_name": ("name", "hash"), "email": ("email", "hash"), "ssn": ("ssn", "mask"), "dob": ("dob", "year"), "ip_address": ("ipv4", "mask"),
    }
    with pytest.raises(redact.RedactionError):
        redact.build_plan(report, min_confidence="none")


def test_overrides():
    assert redact.parse_overrides(["Email = HASH"]) == {"email": "hash"}
    for bad in ("email", "email=x", "=mask"):
        with pytest.raises(redact.RedactionError):
            redact.parse_overrides([bad])


@pytest.mark.parametrize("name", ["out.csv", "out.jsonl", "out.parquet", "out.tsv"])
def test_run(spark, people, tmp_path, name):
    df = load(spark, people)
    plan = redact.build_plan(profile(df))
    counts = redact.run_redaction(df, tmp_path / name, plan)
    assert counts == plan.counts == {"full_name": 3, "email": 3, "phone": 3, "ssn": 3, "dob": 3, "ip_address": 3}
    out = tmp_path / name
    assert out.is_file()
    if name == "out.tsv":
        assert out.read_text().splitlines()[0] == "id,full_name,email,phone,ssn,dob,ip_address,note"
        return
    again = load(spark, out)
    kinds = {n.kind for _, n in profile(again).personal() if n.weight >= 0.85}
    assert kinds <= {"ipv4"}
    if name == "out.jsonl":
        assert json.loads(out.read_text().splitlines()[1])["note"] is None


def test_other_types(spark, tmp_path):
    df = spark.sql("SELECT 1.50BD AS d, array(1, 2) AS xs, timestamp_ntz'2024-01-02 03:04:05' AS t, CAST(NULL AS int) AS n")
    redact.write(df, tmp_path / "o.parquet")
    assert tuple(load(spark, tmp_path / "o.parquet").select("d", "xs", "n").first()) == ("1.50", "[1,2]", None)
    with pytest.raises(redact.RedactionError):
        redact.write(df, tmp_path / "o.x", "xml")


def test_folder(spark, people, tmp_path):
    redact.write(load(spark, people).repartition(3), tmp_path / "many.parquet", one_file=False)
    assert load(spark, tmp_path / "many.parquet").count() == 3


def test_no_python_in_plan(spark, people):
    df = load(spark, people)
    plan = redact.redact(df, redact.build_plan(profile(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
