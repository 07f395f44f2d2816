"""Many files: which there are, their profiles, what schemas they share and where they drift."""

from __future__ import annotations

import fnmatch
import glob
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import type_name
from ..model import TableProfile
from ..sources.errors import ExcelReaderError, RemoteAccessError, SQLiteTableError, UnsupportedFormatError
from ..sources.load import SUFFIXES, load, remote_listing
from .profile import is_remote, profile

MOST_FILES = 50
#: Error kinds, in the order in which they are tried.
ERRORS = ((UnsupportedFormatError, "unsupported_format"), (RemoteAccessError, "remote_error"), (SQLiteTableError, "sqlite_error"), (ExcelReaderError, "excel_error"), (FileNotFoundError, "not_found"))


class MultiInputError(ValueError):
    """Nothing matches, or too much."""


@dataclass(frozen=True)
class FileOutcome:
    path: str
    ok: bool
    report: TableProfile | None = None
    error: str | None = None
    error_kind: str | None = None


@dataclass(frozen=True)
class SchemaCluster:
    signature: tuple[tuple[str, str], ...]
    files: tuple[str, ...]

    @property
    def size(self) -> int:
        return len(self.files)


@dataclass(frozen=True)
class MultiReport:
    inputs: tuple[str, ...]
    files: tuple[FileOutcome, ...] = ()
    clusters: tuple[SchemaCluster, ...] = ()
    drifted_columns: tuple[str, ...] = ()

    @property
    def failures(self) -> tuple[FileOutcome, ...]:
        return tuple(f for f in self.files if not f.ok)

    @property
    def loaded_count(self) -> int:
        return len(self.files) - len(self.failures)

    @property
    def failed_count(self) -> int:
        return len(self.failures)

    @property
    def total_rows(self) -> int:
        return sum(f.report.rows for f in self.files if f.report)


def has_glob(text: str) -> bool:
    return any(c in text for c in "*?[")


def is_multi(path: str | Path) -> bool:
    text = str(path)
    return has_glob(text) or not is_remote(text) and Path(text).is_dir() and not _one_table(text)


def _one_table(path: str) -> bool:
    """A folder that Spark wrote as one table."""
    return path.rstrip("/").lower().endswith(SUFFIXES) and any(Path(path).glob("part-*"))


def expand_inputs(spark: SparkSession, pattern: str | Path, *, include: Iterable[str] = (), exclude: Iterable[str] = (), max_files: int = MOST_FILES, region: str | None = None) -> list[str]:
    """Files for a path, a folder (all below it that can be read), or a glob, in order; ``include`` and ``exclude`` go
    by file name. A single path is taken whatever its name."""
    text = str(pattern)
    one = False
    if is_remote(text):
        one = not has_glob(text)
        found = [text] if one else remote_listing(spark, text, region)
    elif has_glob(text):
        found = sorted(glob.glob(text, recursive=True))
    elif is_multi(text):
        found = sorted(str(p) for p in Path(text).rglob("*") if p.is_file())
    elif Path(text).exists():
        found, one = [text], True
    else:
        raise MultiInputError(f"No files match {text!r} — path does not exist and is not a glob.")
    fits = lambda p, patterns: any(fnmatch.fnmatch(p.rsplit("/", 1)[-1], x) for x in patterns)
    include, exclude = tuple(include), tuple(exclude)
    found = [p for p in found if (one or p.lower().endswith(SUFFIXES)) and (not include or fits(p, include)) and not fits(p, exclude)]
    if not found:
        raise MultiInputError(f"No supported files matched {text!r} after include/exclude filters.")
    if 0 < max_files < len(found):
        raise MultiInputError(f"{len(found)} files matched {text!r} — exceeds --max-files cap ({max_files}). Raise the cap or tighten your pattern.")
    return found


def clusters_of(signatures: Iterable[tuple[str, Iterable[tuple[str, str]]]]) -> tuple[tuple[SchemaCluster, ...], tuple[str, ...]]:
    """(clusters, drifted columns) from files with the (name, type) of their columns. A column drifts that has two types,
    or that some files lack."""
    files: dict[tuple, list[str]] = defaultdict(list)
    for path, columns in signatures:
        files[tuple(sorted(columns))].append(path)
    ordered = sorted(files.items(), key=lambda x: (-len(x[1]), x[0]))
    everywhere = set.intersection(*(set(s) for s in files)) if files else set()
    drifted = {name for s in files for name, dtype in s if (name, dtype) not in everywhere}
    return tuple(SchemaCluster(s, tuple(f)) for s, f in ordered), tuple(sorted(drifted))


def profile_many(spark: SparkSession, inputs: Iterable[str], *, sample: int | None = None, table: str | None = None, sheet: str | int | None = None, region: str | None = None, form: str | None = None, **options) -> MultiReport:
    """A profile for each file; a file that can't be read doesn't stop the others."""
    outcomes = []
    for path in (inputs := tuple(map(str, inputs))):
        try:
            df = load(spark, path, table=table, sheet=sheet, region=region, form=form)
            outcomes.append(FileOutcome(path, True, profile(df, path=path, sample=sample, **options)))
        except (PySparkException, OSError, ValueError, RuntimeError) as e:
            kind = next((name for cause, name in ERRORS if isinstance(e, cause)), "load_error")
            outcomes.append(FileOutcome(path, False, error=str(e), error_kind=kind))
    clusters, drifted = clusters_of((o.path, [(c.name, c.type) for c in o.report.columns]) for o in outcomes if o.report)
    return MultiReport(inputs, tuple(outcomes), clusters, drifted)


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(file, name, dtype) rows: the schemas of many tables as one."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(path, f.name, type_name(f.dataType)) for path, df in tables.items() for f in df.schema.fields], "file string, name string, dtype string")


def drift(schemas: DataFrame) -> DataFrame:
    """(name, n_dtypes, n_files, drifted) from ``schema_rows``, for any number of files."""
    files = schemas.agg(F.count_distinct("file")).first()[0]
    by = schemas.groupBy("name").agg(F.count_distinct("dtype").alias("n_dtypes"), F.count_distinct("file").alias("n_files"))
    return by.withColumn("drifted", (F.col("n_dtypes") > 1) | (F.col("n_files") < files))
