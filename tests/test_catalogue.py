"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from prismetric.operators.profile import whole_outliers
from prismetric.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>", "nan"):
            return None
        return float(v) if isinstance(v, float) else str(v)

    return columns, sorted((tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert plain(got) == plain(oracle.sql(catalogue.ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_outlier_fences_as_in_sql(spark, tmp_path):
    """Fences that doubles hold a little beside a tie of the fifth digit, and a column spread over less than a millionth."""
    con = duckdb.connect()
    for name in os.listdir(SF):
        table, path = name.removesuffix(".parquet"), tmp_path / name
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM '{SF}/{name}'")
        if table == "events":
            con.execute("UPDATE events SET value = [0, 0.1, 0.575, 1, 1.5, 2, 2.8, 3, 100][event_id % 9 + 1] WHERE event_id < 9")
            con.execute("DELETE FROM events WHERE event_id >= 9")
        if table == "orders":
            con.execute("UPDATE orders SET o_totalprice = o_orderkey % 2 * 1e-9 + (o_orderkey % 100 = 0)::INT")
        con.execute(f"COPY {table} TO '{path}' (FORMAT parquet)")
    name = "outlier_anomalies"
    want = plain(con.sql(catalogue.ORACLES[name]).df())
    assert any("6.138" in str(row) for row in want[1]) and not any("orders" in str(row) for row in want[1])
    assert plain(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == want


def test_values_on_a_fence_as_in_sql(spark):
    """Quartiles that differ in their last bit count a value on the fence in or out."""
    rng, con, columns = np.random.default_rng(5), duckdb.connect(), {}
    for k in range(40):
        a = np.round(rng.exponential(50, 30), 2)
        for _ in range(3):  # the largest value goes to the fence
            low, high = np.quantile(a, [0.25, 0.75])
            a[a.argmax()] = round(high + 1.5 * (high - low), 6)
        columns[f"v{k}"] = a.tolist()
    t = pa.table(columns)  # noqa: F841
    want = {c: con.execute(f"SELECT outside FROM ({catalogue._outlier_sql('t', c)}) WHERE outside > 0").fetchone() for c in columns}
    got = whole_outliers(spark.createDataFrame(t.to_pandas()))
    assert {c: int(got[c].words.split()[0]) if c in got else 0 for c in columns} == {c: n[0] if n else 0 for c, n in want.items()}
