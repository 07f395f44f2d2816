"""Statistics of columns: one wide aggregation for all of them, and one frequency table for each."""

from __future__ import annotations

from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate
from math import fma
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as kinds

#: Frequency tables that are made at the same time.
AT_ONCE = 4


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> tuple[DataFrame, list[T.StructField]]:
    """``df`` with columns c0, c1, ... whatever their names, repeated ones too."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), list(df.schema.fields)


def wide_row(df: DataFrame) -> tuple[int, list[dict[str, Any]]]:
    """The number of rows and, for each column, nulls, some value, least, greatest, mean and deviation. One pass that
    reads each column once, and a row for the driver."""
    df, fields = numbered(df)
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c, kind = F.col(f"c{i}"), f.dataType
        wanted += [F.count_if(c.isNull()).alias(f"nulls{i}"), F.any_value(c, F.lit(True)).alias(f"sample{i}")]
        if not kinds.nested(kind):
            wanted += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
        if kinds.numeric(kind):
            wanted += [F.avg(c.cast("double")).alias(f"mean{i}"), F.stddev_samp(c.cast("double")).alias(f"stddev{i}")]
    row = df.agg(*wanted).first().asDict()
    names = ("nulls", "sample", "min", "max", "mean", "stddev")
    return row["rows"], [{n: row.get(f"{n}{i}") for n in names} for i in range(len(fields))]


def frequencies(df: DataFrame, k: int) -> list[tuple[int, list[tuple[Any, int]]]]:
    """For each column the number of distinct values and the ``k`` most frequent, the least value first among
    equals; nulls don't count. A column is one job: its frequency table is shuffled once and read for both."""
    df, fields = numbered(df)

    def of(i: int) -> tuple[int, list[tuple[Any, int]]]:
        if not kinds.countable(fields[i].dataType):
            return 0, []
        table = df.select(F.col(f"c{i}").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        top = table.orderBy(F.desc("n"), "v").limit(k).select("n", "v")
        total = table.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).cast(fields[i].dataType).alias("v"))
        rows = total.unionAll(top).collect() if k > 0 else total.collect()
        distinct = next(r["n"] for r in rows if r["v"] is None)
        return distinct, sorted(((r["v"], r["n"]) for r in rows if r["v"] is not None), key=lambda x: -x[1])

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(of, range(len(fields))))


def column_stats(df: DataFrame) -> DataFrame:
    """A row for each column: name, dtype, rows, nulls, distinct, min, max, mean, stddev; min and max as text. Plain
    statistics and distinct counts are made apart and joined: one aggregation of both kinds is many times slower."""
    df, fields = numbered(df)
    plain, counts = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        c, kind = F.col(f"c{i}"), f.dataType
        low, high = (F.min(c), F.max(c)) if not kinds.nested(kind) else (F.lit(None), F.lit(None))
        mean, spread = (F.avg(c.cast("double")), F.stddev_samp(c.cast("double"))) if kinds.numeric(kind) else (F.lit(None), F.lit(None))
        one = F.struct(
            F.lit(f.name).alias("name"), F.lit(kinds.type_name(kind)).alias("dtype"), F.count_if(c.isNull()).alias("nulls"), low.cast("string").alias("min"), high.cast("string").alias("max"),
            mean.cast("double").alias("mean"), spread.cast("double").alias("stddev"),
        )
        plain.append(one.alias(f"s{i}"))
        values = df.select(c.alias("v")).where("v is not null")
        counts.append((values.groupBy("v").agg(F.lit(1)) if kinds.countable(kind) else values.limit(0)).agg(F.count(F.lit(1)).alias("distinct")).select(F.lit(i).alias("place"), "distinct"))
    wide = df.agg(*plain)
    # one row, turned into a row for each column
    long = wide.select("rows", F.posexplode(F.array(*(f"s{i}" for i in range(len(fields))))).alias("place", "s"))
    distinct = counts[0]
    for more in counts[1:]:
        distinct = distinct.unionAll(more)
    return long.join(distinct, "place").orderBy("place").select("s.name", "s.dtype", "rows", "s.nulls", "distinct", "s.min", "s.max", "s.mean", "s.stddev")


#: Accuracy of the sketches that bound a rank, and distinct values between the bounds that the driver reads at most.
SKETCH, BETWEEN = 1000, 100_000


def quantiles(df: DataFrame, shares: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of each (double) column of ``df``, interpolated between neighbours (to the last bit as DuckDB does,
    for values that lie on a fence); None for a column without values.

    The values at the two ranks beside each share are bounded by sketches of a fixed size, what lies below the bounds is
    counted, and the values between are counted by value. Where these are too many for the driver, the bounds are drawn
    closer in the same way; no task ever holds a column's values. Three passes as a rule.
    """
    names = df.columns
    inner = df.toDF(*(f"c{i}" for i in range(len(names))))
    sizes = inner.agg(*(F.count(c) for c in inner.columns)).first()
    # of each column and share: the bounds, how many values lie below them and between, and the values once known
    todo = [(i, q) for i, n in enumerate(sizes) if n for q in shares]
    bounds: dict[tuple[int, float], tuple[float, float] | None] = dict.fromkeys(todo)
    base, inside = dict.fromkeys(todo, 0), {t: sizes[t[0]] for t in todo}
    found: dict[tuple[int, float], tuple[float, float]] = {}

    def ranks(t: tuple[int, float]) -> tuple[int, int]:
        at = int(t[1] * (sizes[t[0]] - 1))
        return at, min(at + 1, sizes[t[0]] - 1)

    def within(t: tuple[int, float]) -> Column:
        return F.col(f"c{t[0]}").between(*bounds[t]) if bounds[t] else F.lit(True)

    while todo:
        probes = []
        for t in todo:
            low, high = ((rank - base[t] + 1) / inside[t] for rank in ranks(t))
            edges = F.array(F.lit(max(0.0, low - 2 / SKETCH)), F.lit(min(1.0, high + 2 / SKETCH)))
            probes.append(F.percentile_approx(F.when(within(t), F.col(f"c{t[0]}")), edges, F.lit(SKETCH)))
        bounds |= {t: tuple(edges) for t, edges in zip(todo, inner.agg(*probes).first(), strict=True)}
        counts = inner.agg(*(c for t in todo for c in (F.count_if(F.col(f"c{t[0]}") < bounds[t][0]), F.count_if(within(t))))).first()
        for i, t in enumerate(todo):
            base[t], inside[t] = counts[2 * i], counts[2 * i + 1]
        found |= {t: bounds[t] for t in todo if bounds[t][0] == bounds[t][1]}
        todo = [t for t in todo if t not in found]
        if not todo:
            break
        held = F.array(*(F.when(within(t), F.struct(F.lit(i).alias("i"), F.col(f"c{t[0]}").alias("v"))) for i, t in enumerate(todo)))
        values = inner.select(F.explode(F.filter(held, lambda x: x.isNotNull())).alias("s")).groupBy("s.i", "s.v").agg(F.count(F.lit(1)).alias("n"))
        rows = values.limit(BETWEEN + 1).collect()
        if len(rows) <= BETWEEN:
            for i, t in enumerate(todo):
                ordered = sorted((r["v"], r["n"]) for r in rows if r["i"] == i)
                ends = list(accumulate((n for _, n in ordered), initial=base[t]))[1:]
                found[t] = tuple(ordered[bisect_right(ends, rank)][0] for rank in ranks(t))
            break

    def value(i: int, q: float) -> float:
        a, b = found[i, q]
        part = q * (sizes[i] - 1) % 1
        return fma(a, 1 - part, b * part) if a != b else a

    return {name: [value(i, q) for q in shares] if sizes[i] else None for i, name in enumerate(names)}


def first_values(df: DataFrame, column: int, n: int, rows: list | None = None) -> list[Any]:
    """The first ``n`` values of a column that are not null. ``rows``: the first rows of ``df``, if they are known."""
    known = [r[column] for r in rows or [] if r[column] is not None]
    if rows is not None and len(known) >= n:
        return known[:n]
    c = numbered(df)[0].select(f"c{column}")
    return [r[0] for r in c.where(F.col(f"c{column}").isNotNull()).take(n)]
