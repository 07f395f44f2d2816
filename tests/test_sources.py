import datetime as dt
import sqlite3
import zipfile

import pytest

from prismetric.functions.types import type_name
from prismetric.operators import multi
from prismetric.operators.profile import profile
from prismetric.sources import csv, excel, sqlite
from prismetric.sources import load as loading
from prismetric.sources.errors import ExcelReaderError, RemoteAccessError, SQLiteTableError, UnsupportedFormatError
from prismetric.sources.load import load

TINY = "id,name,email,score\n1,Alice,alice@example.com,9.5\n2,Bob,,7.25\n3,Carol,carol@example.com,\n"


def types(df):
    return {f.name: type_name(f.dataType) for f in df.schema.fields}


def test_csv_types(spark, tmp_path):
    p = tmp_path / "tiny.csv"
    p.write_text(TINY)
    df = load(spark, p)
    assert types(df) == {"id": "BIGINT", "name": "VARCHAR", "email": "VARCHAR", "score": "DOUBLE"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Alice", "alice@example.com", 9.5), (2, "Bob", None, 7.25), (3, "Carol", "carol@example.com", None)]


def test_csv_more_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("zip;ok;day;at;mixed\n01234;true;2024-01-02;2024-01-02 03:04:05;1\n98765;FALSE;2024-02-03;2024-02-03T00:00:00;x\n")
    df = load(spark, p)
    assert types(df) == {"zip": "VARCHAR", "ok": "BOOLEAN", "day": "DATE", "at": "TIMESTAMP", "mixed": "VARCHAR"}
    assert tuple(df.collect()[0]) == ("01234", True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), "1")


def test_csv_quotes_and_lines(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a,b\n"x, y","say ""hi"""\n"two\nlines",z\n')
    assert [tuple(r) for r in load(spark, p).collect()] == [("x, y", 'say "hi"'), ("two\nlines", "z")]


def test_csv_lines_broken_far_down(spark, tmp_path):
    p = tmp_path / "far.csv"
    p.write_text("a,b\n" + "".join(f"{i},x\n" for i in range(300)) + '300,"two\nlines"\n')
    df = load(spark, p)
    assert df.count() == 301 and df.where("a = 300").first()["b"] == "two\nlines"


def test_csv_without_header(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("1,2\n3,4\n")
    assert [tuple(r) for r in load(spark, p).orderBy("column0").collect()] == [(1, 2), (3, 4)]


def test_tsv(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("a\tb\n1\tx,y\n")
    assert [tuple(r) for r in load(spark, p).collect()] == [(1, "x,y")]


def test_sniff():
    assert csv.sniff(["a;b", "1;2"]) == (";", True)
    assert csv.sniff([]) == (",", True)
    assert csv.names(["a", "", "a", None]) == ["a", "column1", "a_1", "column3"]


def test_json_and_parquet(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": 1, "name": "A", "score": 9.5}\n{"id": 2, "name": "B", "score": null}\n')
    df = load(spark, tmp_path / "t.jsonl")
    assert types(df) == {"id": "BIGINT", "name": "VARCHAR", "score": "DOUBLE"}
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert load(spark, tmp_path / "t.parquet").count() == 2


def test_format_override(spark, tmp_path):
    p = tmp_path / "data.bin"
    p.write_text(TINY)
    assert load(spark, p, form=".CSV").count() == 3
    with pytest.raises(UnsupportedFormatError, match="Unknown --format"):
        load(spark, p, form="xml")
    with pytest.raises(UnsupportedFormatError, match="No reader registered"):
        load(spark, p)
    with pytest.raises(FileNotFoundError):
        load(spark, tmp_path / "none.csv")


@pytest.fixture
def database(tmp_path):
    p = tmp_path / "t.sqlite"
    with sqlite3.connect(p) as con:
        con.execute("CREATE TABLE visits (id INTEGER, kind TEXT)")
        con.execute("CREATE TABLE guests (id INTEGER, name TEXT, score REAL)")
        con.executemany("INSERT INTO guests VALUES (?, ?, ?)", [(1, "A", 1.5), (2, "B", None), (3, None, 2)])
        con.executemany("INSERT INTO visits VALUES (?, ?)", [(1, "x"), (2, "y")])
    return p


def test_sqlite(spark, database, monkeypatch):
    monkeypatch.setattr(sqlite, "ROWS", 2)
    df = load(spark, database)
    assert types(df) == {"id": "BIGINT", "name": "VARCHAR", "score": "DOUBLE"}
    assert sorted(tuple(r) for r in df.collect()) == [(1, "A", 1.5), (2, "B", None), (3, None, 2.0)]
    assert load(spark, database, table="visits").count() == 2
    assert sqlite.list_tables(database) == ["guests", "visits"]
    with pytest.raises(SQLiteTableError, match="Available: guests, visits"):
        load(spark, database, table="none")


def workbook(path, sheets, active=0):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, dt.date):
                        cells += f'<c r="{at}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
                    elif isinstance(v, str):
                        cells += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
                    else:
                        cells += f'<c r="{at}"><v>{v}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture
def book(tmp_path):
    p = tmp_path / "book.xlsx"
    workbook(p, {"people": [[None], ["id", "name", None, "name", "born"], [1, "A", 1.5, "x", dt.date(2024, 1, 2)], [None], [2, None, 2, "y"]], "notes": [["a"], ["b"]], "empty": []})
    return p


def test_excel(spark, book):
    df = load(spark, book)
    assert types(df) == {"id": "BIGINT", "name": "VARCHAR", "column_3": "DOUBLE", "name_1": "VARCHAR", "born": "TIMESTAMP"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "A", 1.5, "x", dt.datetime(2024, 1, 2)), (2, None, 2.0, "y", None)]
    assert load(spark, book, sheet="notes").columns == ["a"] and load(spark, book, sheet=1).count() == 1 and load(spark, book, sheet="1").count() == 1
    assert excel.list_sheets(book) == [("people", 4), ("notes", 1), ("empty", 0)]


@pytest.mark.parametrize("sheet,said", [("none", "not found"), (7, "out of range"), ("empty", "appears to be empty")])
def test_excel_errors(spark, book, sheet, said):
    with pytest.raises(ExcelReaderError, match=said):
        load(spark, book, sheet=sheet)


def test_not_a_workbook(spark, tmp_path):
    p = tmp_path / "x.xlsx"
    p.write_text("no")
    with pytest.raises(ExcelReaderError, match="Could not open"):
        load(spark, p)


def test_remote_rules(spark, monkeypatch, tmp_path):
    with pytest.raises(UnsupportedFormatError, match="SQLite files cannot be read"):
        load(spark, "https://x.test/a.sqlite")
    with pytest.raises(UnsupportedFormatError, match="No remote reader"):
        load(spark, "https://x.test/a.xlsx")
    p = tmp_path / "t.csv"
    p.write_text(TINY)
    monkeypatch.setattr(loading, "fetched", lambda uri, suffix: str(p))
    assert load(spark, "https://x.test/a.csv?token=1#top").count() == 3
    assert load(spark, "https://x.test/opaque", form="csv").count() == 3
    monkeypatch.setattr(loading, "fetched", lambda *_: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(RemoteAccessError, match="x.test"):
        load(spark, "https://x.test/a.csv")
    seen = []
    monkeypatch.setattr(loading, "read_as", lambda s, reader, path: seen.append((reader, path)))
    load(spark, "s3://bucket/a.parquet", region="eu-x-1")
    assert seen == [("parquet", "s3a://bucket/a.parquet")]
    assert spark._jsc.hadoopConfiguration().get("fs.s3a.endpoint.region") == "eu-x-1"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "d"
    (d / "sub").mkdir(parents=True)
    (d / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (d / "b.csv").write_text("id,name\n3,z\n4,w\n")
    (d / "sub" / "c.csv").write_text("id,name,extra\n5,q,1\n6,r,2\n")
    (d / "README.md").write_text("no")
    return d


def test_expand(spark, folder):
    names = lambda found: [p.rsplit("/", 1)[-1] for p in found]
    assert names(multi.expand_inputs(spark, folder)) == ["a.csv", "b.csv", "c.csv"]
    assert names(multi.expand_inputs(spark, f"{folder}/*.csv")) == ["a.csv", "b.csv"]
    assert names(multi.expand_inputs(spark, folder, include=["a*", "c*"], exclude=["c*"])) == ["a.csv"]
    with pytest.raises(multi.MultiInputError, match="exceeds"):
        multi.expand_inputs(spark, folder, max_files=2)
    with pytest.raises(multi.MultiInputError, match="No supported files"):
        multi.expand_inputs(spark, folder, include=["none"])
    with pytest.raises(multi.MultiInputError, match="does not exist"):
        multi.expand_inputs(spark, folder / "none")


def test_many(spark, folder):
    (folder / "bad.xlsx").write_text("no")
    report = multi.profile_many(spark, multi.expand_inputs(spark, folder), timeseries_=False)
    assert (report.loaded_count, report.failed_count, report.total_rows, len(report.clusters)) == (3, 1, 6, 2)
    assert report.drifted_columns == ("extra",) and report.clusters[0].size == 2
    assert report.failures[0].error_kind == "excel_error"


def test_drift_by_type():
    clusters, drifted = multi.clusters_of([("a", [("id", "BIGINT"), ("x", "VARCHAR")]), ("b", [("id", "VARCHAR"), ("x", "VARCHAR")])])
    assert drifted == ("id",) and [c.size for c in clusters] == [1, 1]
    assert multi.clusters_of([]) == ((), ())


def test_profile_of_file(spark, tmp_path):
    p = tmp_path / "tiny.csv"
    p.write_text(TINY)
    report = profile(load(spark, p), path=p)
    assert (report.origin.size, report.origin.encoding) == (len(TINY), "utf-8")
