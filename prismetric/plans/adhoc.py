"""Free SQL over a loaded table, with some forms of another dialect put into Spark's."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import type_name
from ..operators.profile import profile
from ..sources.load import load

LIMIT, PREVIEW = 200, 50


class DialectError(ValueError):
    """A form that Spark has not, and for which there is no other."""


# What has no counterpart, and what to write instead.
NONE = {
    r"\bASOF\s+JOIN\b": "ASOF JOIN: join on the key and time ranges, or use a window with last_value",
    r"\bPOSITIONAL\s+JOIN\b": "POSITIONAL JOIN: join on row_number()",
    r"\bPIVOT\b.*\bON\b.*\bUSING\b": "PIVOT ... ON: use PIVOT (aggregate FOR column IN (values))",
}
# Functions under other names, and formats of times: letter by letter after the percent sign.
NAMES = {"list_value": "array", "list_contains": "array_contains", "epoch_ms": "unix_millis", "list_distinct": "array_distinct", "regexp_matches": "regexp_like", "str_split": "string_split"}
TIMES = {"strptime": "to_timestamp_ntz", "strftime": "date_format"}
LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "-m": "M", "d": "dd", "-d": "d", "H": "HH", "-H": "H", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "g": "SSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "%": "%",
}
#: What Spark's own functions do otherwise: a separator is text there, not a pattern.
FUNCTIONS = ("CREATE OR REPLACE TEMPORARY FUNCTION string_split(s STRING, separator STRING) RETURNS ARRAY<STRING> RETURN split(s, concat('\\\\Q', replace(separator, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), -1)",)
STRINGS = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/)", re.DOTALL)


def outside_strings(sql: str, change) -> str:
    """``sql`` with the parts that aren't quoted or comments changed."""
    return "".join(part if i % 2 else change(part) for i, part in enumerate(STRINGS.split(sql)))


def bare(sql: str) -> str:
    """``sql`` with what is quoted and comments blanked out."""
    return "".join(" " * len(part) if i % 2 else part for i, part in enumerate(STRINGS.split(sql)))


def outermost(sql: str) -> str:
    """``sql`` with what is quoted, comments and all that stands in brackets blanked out."""
    out, depth = [], 0
    for c in bare(sql):
        depth -= c in ")]"
        out.append(c if not depth else " ")
        depth += c in "(["
    return "".join(out)


def closing(text: str, at: int) -> int:
    """Where the bracket closes that opens at ``at`` of bare text."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "([") - (text[i] in ")]")
        if not depth:
            return i
    raise DialectError("a bracket isn't closed.")


def time_format(text: str) -> str:
    """A format with percent signs as one with letters; what has no letter is refused."""
    out = []
    for code, plain in re.findall(r"%(-?.)|([^%]+)", text):
        if code and code not in LETTERS:
            raise DialectError(f"%{code} in a format of times has no counterpart.")
        out.append(LETTERS[code] if code else re.sub(r"([A-Za-z]+)", r"''\1''", plain))
    return "".join(out)


def timed(sql: str) -> str:
    """strptime and strftime, whose format must be written out."""
    for name, instead in TIMES.items():
        while m := re.search(rf"\b{name}\s*\(", bare(sql), re.IGNORECASE):
            end = closing(bare(sql), m.end() - 1)
            form = re.search(r",\s*'((?:[^']|'')*)'\s*$", sql[m.end() : end])
            if not form:
                raise DialectError(f"{name}: the format must be one text, written out.")
            sql = f"{sql[: m.start()]}{instead}({sql[m.end() : m.end() + form.start()]}, '{time_format(form[1])}'){sql[end + 1 :]}"
    return sql


def operand(sql: str) -> int:
    """Where the operand begins that ``sql`` ends with: a name, a call or brackets."""
    text, at = bare(sql), len(sql.rstrip())
    if text[at - 1] == ")":
        depth = 0
        while at:
            at -= 1
            depth += (text[at] == ")") - (text[at] == "(")
            if not depth:
                break
    return at - len(re.search(r"""(?:(?:\w+|"[^"]*")\s*\.\s*)*(?:\w+|"[^"]*")?$""", sql[:at])[0])


def subscripted(sql: str) -> str:
    """Lists in square brackets as arrays, and places in lists, which count from 1 there; a key of text stays."""
    done, rest = "", sql
    while (at := bare(rest).find("[")) >= 0:
        end = closing(bare(rest), at)
        inside, head = rest[at + 1 : end], done + rest[:at]
        key = inside.strip().startswith("'")
        if not re.search(r"""[\w\])"]\s*$""", head) or re.search(r"\b(SELECT|IN|FROM|WHERE|AND|OR|THEN|ELSE|WHEN|BY)\s*$", bare(head), re.IGNORECASE):
            done = f"{head}array({subscripted(inside)})"
        elif ":" in outermost(inside):
            raise DialectError("list[a:b]: use slice(list, start, length).")
        elif key:
            done = f"{head}[{inside}]"
        else:
            begin = operand(head)
            done = f"{head[:begin]}try_element_at({head[begin:].strip()}, nullif({subscripted(inside)}, 0))"
        rest = rest[end + 1 :]
    return done + rest


def sampled(sql: str) -> str:
    """A final USING SAMPLE as a sample of the select's result."""
    m = re.search(r"\bUSING\s+SAMPLE\s+(\d+(?:\.\d+)?)\s*(%|PERCENT|ROWS)?\s*$", outermost(sql), re.IGNORECASE)
    if m:
        unit = "PERCENT" if (m[2] or "").upper() in ("%", "PERCENT") else "ROWS"
        return f"SELECT * FROM ({sql[: m.start()].strip()}) TABLESAMPLE ({m[1]} {unit})"
    if re.search(r"\bUSING\s+SAMPLE\b", bare(sql), re.IGNORECASE):
        raise DialectError("USING SAMPLE: only as the last part of a select, as n ROWS or n PERCENT; else use TABLESAMPLE.")
    return sql


def translated(sql: str) -> str:
    """EXCLUDE as EXCEPT, list and struct literals as functions, places in lists, formats of times, samples, renamed
    functions, QUALIFY as an outer filter. What would mean something else is refused."""
    for pattern, instead in NONE.items():
        if re.search(pattern, bare(sql), re.IGNORECASE | re.DOTALL):
            raise DialectError(f"Not in this dialect — {instead}.")

    def change(part: str) -> str:
        part = re.sub(r"\*\s*EXCLUDE\b", "* EXCEPT", part, flags=re.IGNORECASE)
        part = re.sub(r"(\*\s*EXCEPT)\s+(\w+)", r"\1(\2)", part, flags=re.IGNORECASE)
        for old, new in NAMES.items():
            part = re.sub(rf"\b{old}\s*\(", f"{new}(", part, flags=re.IGNORECASE)
        return part

    return qualified(outside_strings(subscripted(timed(sampled(sql))), change))


def by_name(sql: str) -> tuple[list[str], bool] | None:
    """The selects that UNION [ALL] BY NAME joins at the outermost level, and whether repeated rows stay."""
    parts, at, kinds = [], 0, set()
    text = outermost(sql)
    for m in re.finditer(r"\bUNION\s+(ALL\s+)?BY\s+NAME\b", text, re.IGNORECASE):
        parts.append(sql[at : m.start()])
        kinds.add(bool(m[1]))
        at = m.end()
    if not parts:
        if re.search(r"\bUNION\s+(ALL\s+)?BY\s+NAME\b", bare(sql), re.IGNORECASE):
            raise DialectError("UNION BY NAME: only at the outermost level.")
        return None
    if len(kinds) > 1 or re.search(r"\b(ORDER\s+BY|LIMIT|WITH|UNION\s+(?!(ALL\s+)?BY))\b", text, re.IGNORECASE):
        raise DialectError("UNION BY NAME: without WITH, ORDER BY, LIMIT or other unions beside it.")
    return [*parts, sql[at:]], kinds.pop()


def qualified(sql: str) -> str:
    """A final QUALIFY becomes a filter around the select, on the condition as one more column."""
    text = bare(sql)
    found = [m for m in re.finditer(r"\bQUALIFY\b", text, re.IGNORECASE) if text[: m.start()].count("(") == text[: m.start()].count(")")]
    if not found:
        return sql
    at, end = found[-1].span()
    tail = re.search(r"\b(ORDER\s+BY|LIMIT)\b", text[end:], re.IGNORECASE)
    # an ORDER BY inside the condition's windows is in brackets
    while tail and text[end : end + tail.start()].count("(") != text[end : end + tail.start()].count(")"):
        more = re.compile(r"\b(ORDER\s+BY|LIMIT)\b", re.IGNORECASE).search(text, end + tail.end())
        if not more:
            tail = None
            break
        tail = re.compile(r"\b(ORDER\s+BY|LIMIT)\b", re.IGNORECASE).search(text[end:], more.start() - end)
    stop = end + tail.start() if tail else len(sql)
    head = re.match(r"\s*SELECT\b", text, re.IGNORECASE)
    if not head:
        raise DialectError("QUALIFY: only after a SELECT at the start.")
    inner = f"SELECT {sql[end:stop].strip()} AS __keep, {sql[head.end() : at].strip()}"
    return f"SELECT * EXCEPT(__keep) FROM ({inner}) WHERE __keep {sql[stop:]}".strip()


def limited(sql: str, limit: int) -> str:
    """``sql`` with a limit, unless it has one of its own at the outermost level."""
    return sql if re.search(r"\bLIMIT\b", outermost(sql), re.IGNORECASE) or not re.match(r"\s*(SELECT|WITH|FROM|VALUES)\b", sql, re.IGNORECASE) else f"{sql} LIMIT {limit}"


@dataclass(frozen=True)
class Session:
    """A table as view ``data``, open to SQL."""

    spark: SparkSession
    path: Path | str
    columns: tuple[tuple[str, str], ...]
    view: str = "data"

    @property
    def row_count(self) -> int:
        return self.spark.table(self.view).count()

    def query(self, sql: str) -> DataFrame:
        """The whole result, lazy."""
        sql = sql.strip().rstrip(";").strip()
        if named := by_name(sql):
            selects, all_rows = named
            frames = [self._run(translated(s.strip())) for s in selects]
            out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
            return out if all_rows else out.distinct()
        return self._run(translated(sql))

    def _run(self, sql: str) -> DataFrame:
        for function in FUNCTIONS:
            self.spark.sql(function)
        return self.spark.sql(sql)

    def run_sql(self, sql: str, limit: int = LIMIT) -> tuple[list[str], list[tuple[Any, ...]]]:
        """(names, rows), 200 rows unless the text limits itself; nothing for empty text. SUMMARIZE gives the profile's
        statistics."""
        text = sql.strip().rstrip(";").strip()
        if not text:
            return [], []
        if m := re.fullmatch(r"SUMMARIZE(\s+(\w+))?", text, re.IGNORECASE):
            report = profile(self.spark.table(m[2] or self.view), timeseries_=False)
            head = ["column_name", "column_type", "min", "max", "approx_unique", "avg", "std", "count", "null_percentage"]
            return head, [(c.name, c.type, c.least, c.greatest, c.distinct, c.mean, c.deviation, c.rows, c.null_share) for c in report.columns]
        df = self.query(text) if by_name(text) else self._run(limited(translated(text), limit))
        df = df.limit(limit) if by_name(text) else df
        return df.columns, [tuple(r) for r in df.collect()]

    def sample(self, limit: int = PREVIEW) -> tuple[list[str], list[tuple[Any, ...]]]:
        return self.run_sql(f"SELECT * FROM {self.view}", limit)


def open_session(spark: SparkSession, path: str | Path, *, table: str | None = None, sheet: str | int | None = None) -> Session:
    df = load(spark, path, table=table, sheet=sheet)
    df.createOrReplaceTempView("data")
    return Session(spark, path, tuple((f.name, type_name(f.dataType)) for f in df.schema.fields))
