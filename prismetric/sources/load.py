"""One way in for every kind of file, here or remote."""

from __future__ import annotations

import os
import tempfile
import urllib.request
import uuid
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from . import csv, excel, sqlite
from .errors import RemoteAccessError, UnsupportedFormatError

# The reader for each ending of a name.
READERS = {
    ".csv": "csv", ".tsv": "csv", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".pq": "parquet",
    ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".xlsx": "excel", ".xlsm": "excel",
}
SUFFIXES = tuple(READERS)
#: Formats that can be named, and that can be read from afar.
NAMED = ("csv", "jsonl", "ndjson", "parquet", "tsv")


def suffix_of(path: str, form: str | None) -> str:
    if form is None:
        text = urlparse(path).path if _remote(path) else path
        return Path(text.rstrip("/")).suffix.lower()
    name = form.lower().lstrip(".")
    if name not in NAMED:
        raise UnsupportedFormatError(f"Unknown --format {form!r}. Choose one of: {', '.join(NAMED)}.")
    return f".{name}"


def _remote(path: str) -> bool:
    return urlparse(path).scheme.lower() in ("s3", "http", "https")


def _on_store(path: str) -> bool:
    """Other schemes that Spark's file systems know, like hdfs or viewfs."""
    return "://" in path and not _remote(path)


def read_as(spark: SparkSession, reader: str, path: str) -> DataFrame:
    if reader == "csv":
        return csv.read(spark, path)
    if reader == "json":
        return spark.read.json(path)
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str | Path, *, table: str | None = None, form: str | None = None, region: str | None = None, sheet: str | int | None = None) -> DataFrame:
    """The file, folder or remote object at ``path`` as a DataFrame; nothing but heads and types is read yet.

    ``form`` stands in for the name's ending (csv, tsv, jsonl, ndjson or parquet). ``table`` and ``sheet`` choose
    within SQLite files and workbooks. ``region`` is for s3.
    """
    path = str(path)
    if not _remote(path) and not _on_store(path) and not Path(path).exists():
        raise FileNotFoundError(path)
    suffix = suffix_of(path, form)
    reader = READERS.get(suffix)
    if _remote(path):
        return _load_remote(spark, path, suffix, reader, region)
    if reader is None:
        raise UnsupportedFormatError(f"No reader registered for extension {suffix!r} (path={path}).")
    if reader == "sqlite":
        return sqlite.read(spark, path, table)
    if reader == "excel":
        return excel.read(spark, path, sheet)
    return read_as(spark, reader, path)


def _load_remote(spark: SparkSession, uri: str, suffix: str, reader: str | None, region: str | None) -> DataFrame:
    if reader == "sqlite":
        raise UnsupportedFormatError("SQLite files cannot be read directly over the network — download the .sqlite file locally first.")
    if reader not in ("csv", "json", "parquet"):
        raise UnsupportedFormatError(f"No remote reader for extension {suffix!r} (uri={uri}). Pass --format to override extension inference.")
    try:
        if uri.lower().startswith("s3://"):
            configure_s3(spark, region)
            return read_as(spark, reader, "s3a" + uri[2:])
        return read_as(spark, reader, fetched(spark, uri, suffix))
    except (PySparkException, Py4JJavaError, OSError) as e:
        raise RemoteAccessError(f"Could not reach {uri!r}: {e}") from e


def fetched(spark: SparkSession, uri: str, suffix: str) -> str:
    """A copy of a web resource where all executors see it: Spark has no file system for the web. That is the folder in
    ``spark.checkpoint.dir``; only in local mode a temporary file will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RemoteAccessError(f"{uri!r} has to be copied for the executors: set spark.checkpoint.dir to a folder that they share.")
    with urllib.request.urlopen(uri, timeout=60) as source, tempfile.NamedTemporaryFile(suffix=suffix, delete=False) as out:  # noqa: S310
        while part := source.read(1 << 20):
            out.write(part)
    if not shared:
        return out.name
    paths = spark._jvm.org.apache.hadoop.fs
    to = paths.Path(f"{shared.rstrip('/')}/prismetric-fetched/{uuid.uuid4().hex}{suffix}")
    to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, paths.Path(f"file://{out.name}"), to)
    return to.toString()


def configure_s3(spark: SparkSession, region: str | None = None) -> None:
    """The region given, or that of the environment; credentials come by the usual chain of the s3a file system."""
    conf = spark._jsc.hadoopConfiguration()
    region = region or os.environ.get("AWS_REGION") or os.environ.get("AWS_DEFAULT_REGION")
    if region:
        conf.set("fs.s3a.endpoint.region", region)
    for key, name in (("fs.s3a.access.key", "AWS_ACCESS_KEY_ID"), ("fs.s3a.secret.key", "AWS_SECRET_ACCESS_KEY"), ("fs.s3a.session.token", "AWS_SESSION_TOKEN")):
        if value := os.environ.get(name):
            conf.set(key, value)


def remote_listing(spark: SparkSession, uri: str, region: str | None = None) -> list[str]:
    """Objects that fit a remote glob, in order; region and credentials as for reading them."""
    if uri.lower().startswith("s3://"):
        configure_s3(spark, region)
    name = "s3a" + uri[2:] if uri.lower().startswith("s3://") else uri
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [str(s.getPath()) for s in found or []]
    except Py4JJavaError as e:
        raise RemoteAccessError(f"Could not enumerate remote glob {uri!r}: {e.java_exception}") from e
    return sorted("s3" + n[3:] if n.startswith("s3a://") else n for n in names)
