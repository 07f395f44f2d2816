"""Worksheets of .xlsx and .xlsm files, read with the standard library."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from . import csv as csv_source
from .errors import ExcelReaderError

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats that stand for dates and times.
DATES = {*range(14, 23), *range(45, 48)}


class Book:
    """An open workbook."""

    def __init__(self, path: str | Path):
        try:
            self.zip = zipfile.ZipFile(path)
            book = self._xml("xl/workbook.xml")
            links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        except (OSError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            raise ExcelReaderError(f"Could not open workbook {path}: {e}") from e
        self.parts = {s.get("name"): "xl/" + links[s.get(LINK)].removeprefix("/xl/") for s in book.iter(f"{MAIN}sheet")}
        view = next(book.iter(f"{MAIN}workbookView"), None)
        self.active = int(view.get("activeTab", 0)) if view is not None else 0
        self.shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._date_styles()

    def _xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def _date_styles(self) -> list[bool]:
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{MAIN}numFmt")}
        used = styles.find(f"{MAIN}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in used] if used is not None else []
        return [i in DATES or bool(re.search("[ymdhs]", own.get(i, ""), re.IGNORECASE)) for i in ids]

    def sheet(self, which: str | int | None) -> str:
        """A sheet's name by name, place (also as text), or the active one."""
        names = list(self.parts)
        if not names:
            raise ExcelReaderError("Workbook contains no sheets.")
        if which is None:
            return names[min(self.active, len(names) - 1)]
        if which in self.parts:
            return which
        if isinstance(which, int) or which.lstrip("-").isdigit():
            if 0 <= int(which) < len(names):
                return names[int(which)]
            listed = ", ".join(f"{i}={n!r}" for i, n in enumerate(names))
            raise ExcelReaderError(f"Sheet index {which} out of range (workbook has {len(names)} sheets: {listed}).")
        raise ExcelReaderError(f"Sheet {which!r} not found. Available: {', '.join(map(repr, names))}.")

    def rows(self, sheet: str) -> Iterator[list[Any]]:
        """Rows of values; cells that the file leaves out are None."""
        with self.zip.open(self.parts[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[Any] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at - len(out))
                    out.append(self._value(cell))
                yield out
                row.clear()

    def _value(self, cell: ElementTree.Element) -> Any:
        kind, text = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if text is None:
            return None
        if kind == "s":
            return self.shared[int(text)]
        if kind == "b":
            return text == "1"
        if kind != "n":
            return text
        number = float(text)
        style = int(cell.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return (dt.datetime(1899, 12, 30) + dt.timedelta(days=number)).isoformat(sep=" ", timespec="seconds")
        return int(number) if number.is_integer() else number


def column(reference: str) -> int:
    """The place of a cell like B7, from 0."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def list_sheets(path: str | Path) -> list[tuple[str, int]]:
    """(name, rows below the first) of each sheet."""
    book = Book(path)
    return [(name, max(0, sum(1 for _ in book.rows(name)) - 1)) for name in book.parts]


def headed(rows: Iterator[list[Any]]) -> tuple[list[str], list[list[Any]]] | None:
    """The first row that isn't empty as names, and the others that aren't, each as long as it."""
    full = [r for r in rows if any(v is not None for v in r)]
    if not full:
        return None
    seen: dict[str, int] = {}
    names = []
    for i, cell in enumerate(full[0]):
        name = ("" if cell is None else str(cell)).strip() or f"column_{i + 1}"
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}_{seen[name]}" if seen[name] else name)
    width = len(names)
    return names, [(r + [None] * width)[:width] for r in full[1:]]


def read(spark: SparkSession, path: str | Path, sheet: str | int | None = None) -> DataFrame:
    """A sheet, its columns typed as those of a CSV file with the same text. A sheet has a million rows at most and is
    read by the driver."""
    book = Book(path)
    name = book.sheet(sheet)
    found = headed(book.rows(name))
    if not found:
        raise ExcelReaderError(f"Sheet {name!r} in {path} appears to be empty (no header row).")
    names, rows = found
    text = [[None if v is None or v == "" else str(v) for v in r] for r in rows]
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    return csv_source.typed_columns(spark.createDataFrame(text, schema), names)

