"""Cadence, gaps and seasonality of a column of times, as one small job over a bounded sample or a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import patterns
from ..functions import types as kinds
from ..model import Rhythm
from . import stats

# Tolerances, least numbers, labels, and parts of names that promise times.
TOLERANCE, TOP_GAPS, RATIO, LEAST, LEAST_SEASON = 0.10, 5, 2.0, 4, 14
SHAPED, PARSED = 0.7, 0.8
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
NAMES = ("date", "time", "timestamp", "_at", "_on", "created", "updated", "occurred", "logged")
DAY, HOUR, MINUTE = 86400, 3600, 60


def promising(name: str) -> bool:
    return any(part in name.lower() for part in NAMES)


def duration(seconds: float) -> str:
    """1d, 2h, 5m or 30s where it comes out even, else like 1h2m3s; under half a second with three decimals."""
    whole = round(seconds)
    if whole <= 0:
        return f"{seconds:.3f}s"
    for size, unit in ((DAY, "d"), (HOUR, "h"), (MINUTE, "m")):
        if whole % size == 0:
            return f"{whole // size}{unit}"
    parts = ((whole // HOUR, "h"), (whole % HOUR // MINUTE, "m"), (whole % MINUTE, "s"))
    return "".join(f"{n}{unit}" for n, unit in parts if n)


def times(values: DataFrame, kind: T.DataType) -> tuple[DataFrame, str] | None:
    """(ts) rows from the one column of ``values``, and how they were got; None if its values aren't times."""
    v = values.columns[0]
    values = values.toDF("v").where("v is not null")
    if kinds.temporal(kind):
        return values.select(F.col("v").cast("timestamp_ntz").alias("ts")), "dtype"
    if not isinstance(kind, T.StringType) or not promising(v):
        return None
    text = values.select(F.trim("v").alias("v")).where("v <> ''")
    text = text.select(patterns.parsed(F.col("v")).alias("ts"), patterns.date_shaped(F.col("v")).alias("shaped"))
    n, shaped, read = text.agg(F.count(F.lit(1)), F.count_if("shaped"), F.count("ts")).first()
    if not n or shaped / n < SHAPED or read / n < PARSED:
        return None
    return text.where("ts is not null").select("ts"), "parsed"


def deltas(points: DataFrame) -> DataFrame:
    """(before, ts, delta): consecutive times and the seconds between them.

    Over a sample: an order without a partition puts all rows in one task. For whole columns use ``spacing``.
    """
    before = F.lag("ts").over(Window.orderBy("ts"))
    between = (F.unix_micros(F.col("ts").cast("timestamp_ltz")) - F.unix_micros(F.col("before").cast("timestamp_ltz"))) / 1e6
    return points.select(before.alias("before"), "ts").where("before is not null").withColumn("delta", between)


def spacing(points: DataFrame, chunk: str = "day") -> DataFrame:
    """The same for a column of any size: neighbours are found within each chunk of time, and between a chunk's last
    and the next one's first; only a row for each chunk meets in one task."""
    seconds = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp_ltz")) - F.unix_micros(F.col(a).cast("timestamp_ltz"))) / 1e6
    cut = points.where("ts is not null").withColumn("chunk", F.date_trunc(chunk, F.col("ts").cast("timestamp_ltz")))
    inside = cut.select("ts", F.lag("ts").over(Window.partitionBy("chunk").orderBy("ts")).alias("before")).where("before is not null")
    ends = cut.groupBy("chunk").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    across = ends.select(F.col("first").alias("ts"), F.lag("last").over(Window.orderBy("chunk")).alias("before")).where("before is not null")
    return inside.unionByName(across).select("before", "ts", seconds("before", "ts").alias("delta"))


#: Into how many labels each bucket parts the times.
BUCKETS = {"day_of_week": 7, "hour_of_day": 24}


def season(counts: dict[int, int], labels: list[str], bucket: str) -> list[tuple[str, str, float]]:
    """(bucket, label, share) of the labels that have ``RATIO`` times their even share or more."""
    total = sum(counts.values())
    shares = ((label, counts.get(i, 0) / total) for i, label in enumerate(labels))
    return [(bucket, label, s) for label, s in shares if s * len(labels) >= RATIO]


def time_series(name: str, kind: T.DataType, values: DataFrame, whole: bool = False) -> Rhythm | None:
    """The rhythm of the one column of ``values`` as times, or None. ``whole``: the column may be of any size."""
    got = times(values.toDF(name), kind)
    if not got:
        return None
    points, source = got
    first, last, n, hours = points.agg(F.min("ts"), F.max("ts"), F.count("ts"), F.count_if((F.hour("ts") > 0) | (F.minute("ts") > 0) | (F.second("ts") >= 1))).first()
    if n < LEAST:
        return None
    steps = spacing(points) if whole else deltas(points)
    steps = steps.persist()
    try:
        cadence = (stats.quantiles(steps.select("delta"), [0.5])["delta"] or [None])[0]
        cadence = cadence if cadence and cadence > 0 else None
        span = (last - first).total_seconds()
        on_time, gaps = 0, ()
        if cadence:
            on_time = steps.where(F.abs(F.col("delta") - cadence) <= cadence * TOLERANCE).count()
            wide = steps.where(F.col("delta") > cadence * (1 + TOLERANCE)).orderBy(F.desc("delta"), "before").limit(TOP_GAPS).collect()
            gaps = tuple((r["before"], r["ts"], r["delta"]) for r in wide)
    finally:
        steps.unpersist()
    signals: list[tuple[str, str, float]] = []
    if n >= LEAST_SEASON and span >= DAY:
        by = {(r[0], r[1]): r[2] for r in points.groupBy(F.weekday("ts"), F.hour("ts")).count().collect()}
        fold = lambda k: {x: sum(c for key, c in by.items() if key[k] == x) for x in {key[k] for key in by}}
        signals += season(fold(0), list(DAYS), "day_of_week") if span >= 7 * DAY else []
        signals += season(fold(1), [f"{h:02d}" for h in range(24)], "hour_of_day") if hours else []
    return Rhythm(source, n, (first, last), cadence, on_time, gaps, tuple(signals))
