"""Exact duplicates by a cuckoo-filter index over the digests of whole texts."""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts, whole_text, written

SLOTS = 4
KICKS = 400


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each item in one of two buckets; supports deletion."""

    def __init__(self, capacity: int = 1024, seed: int = 7):
        self.buckets = 1 << max(4, (int(capacity / 0.9) // SLOTS).bit_length())
        self.table = array("H", bytes(2 * SLOTS * self.buckets))
        self.random = random.Random(seed)
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _slot(self, bucket: int, mark: int) -> int:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.table[at] == mark:
                return at
        return -1

    def may_hold(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        return self._slot(first, mark) >= 0 or self._slot(second, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False when no place is found; the filter is then unfit and must be made anew from the stored keys."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if (at := self._slot(bucket, 0)) >= 0:
                self.table[at] = mark
                self.size += 1
                return True
        bucket = self.random.choice((first, second))
        for _ in range(KICKS):
            at = bucket * SLOTS + self.random.randrange(SLOTS)
            mark, self.table[at] = self.table[at], mark
            bucket = self._other(bucket, mark)
            if (at := self._slot(bucket, 0)) >= 0:
                self.table[at] = mark
                self.size += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if (at := self._slot(bucket, mark)) >= 0:
                self.table[at] = 0
                self.size -= 1
                return True
        return False


class CuckooIndex:
    """Live digests: the filter answers "surely new" at once; its hits verify against the content kept in buckets
    by digest prefix. An overflow resizes the filter from the stored keys."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.content: dict[bytes, dict[bytes, list]] = {}
        self.resizes = 0

    def __len__(self) -> int:
        return self.filter.size

    def find(self, digest: bytes) -> list | None:
        if not self.filter.may_hold(digest):
            return None
        return self.content.get(digest[-3:], {}).get(digest)

    def insert(self, digest: bytes, record: list) -> None:
        self.content.setdefault(digest[-3:], {})[digest] = record
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> list | None:
        bucket = self.content.get(digest[-3:], {})
        record = bucket.pop(digest, None)
        if record is not None:
            self.filter.delete(digest)
            if not bucket:
                del self.content[digest[-3:]]
        return record

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content.values():
            yield from bucket.items()

    def _resize(self) -> None:
        capacity = self.filter.buckets * SLOTS
        while True:
            self.resizes += 1
            capacity *= 2
            self.filter = CuckooFilter(capacity)
            if all(self.filter.insert(digest) for digest, _ in self.items()):
                return


def _later(one: tuple, other: tuple) -> bool:
    """Whether (id, row) one comes after other; a null id comes first."""
    return (one[0] is not None, one[0] if one[0] is not None else 0, one[1]) > (other[0] is not None, other[0] if other[0] is not None else 0, other[1])


def _merge(live: int):
    """Rows (digest, n, keep_id, keep_row, at_keep) merged by digest over one task's rows. With a bound on live
    digests the older half leaves the index whenever it is full: such digests come out more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex(4096)
        schema = None

        def table(items: list) -> pa.RecordBatch:
            rows = [(d, *r) for d, r in items]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for digest, n, key, row, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = index.find(digest)
                if held is None:
                    index.insert(digest, [n, key, row, at])
                    continue
                held[0] += n
                if held[1] == key:
                    held[2], held[3] = max(held[2], row), held[3] + at
                elif _later((key, row), (held[1], held[2])):
                    held[1:] = [key, row, at]
            if live and len(index) > live:
                old = list(index.items())[: live // 2]
                yield table(old)
                for digest, _ in old:
                    index.delete(digest)
        if len(index):
            yield table(list(index.items()))

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(keep_row, keep_id, digest) for every row, written; keep_row is unique."""
    return written(docs.select(F.monotonically_increasing_id().alias("keep_row"), F.col(id_col).alias("keep_id"), F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256)).alias("digest")), "digests")


def groups(rows: DataFrame, live: int = 400_000) -> DataFrame:
    """One row for each distinct digest of ``rows``: (digest, n, keep_id, keep_row, at_keep).

    Each task first merges what it reads through its own index, so that a group of any size leaves a task as a
    row or a few; these rows are dealt by digest and merged again. Memory: ``live`` digests in the first pass,
    about as many in a partition of the second.
    """
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), rows.schema["keep_id"], T.StructField("keep_row", T.LongType()), T.StructField("at_keep", T.LongType())])
    schema["keep_id"].nullable = True
    one = rows.select("digest", F.lit(1).cast("long").alias("n"), "keep_id", "keep_row", F.lit(1).cast("long").alias("at_keep"))
    partial = one.mapInArrow(_merge(live), schema)
    return partial.repartition(parts(rows.sparkSession, rows.count(), live), "digest").mapInArrow(_merge(0), schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical byte for byte (their SHA-256 stands for them); a null text counts as empty.
    Of equal texts the row with the largest id stays; a null id is the smallest. Rows that repeat id and text
    count each, and exactly one of them stays. Other columns are not looked at. An empty table gives an empty
    result.
    """
    rows = digests(docs, id_col, text_col)
    found = written(groups(rows), "groups").select("digest", "n", F.col("keep_id").alias("best"), F.col("keep_row").alias("best_row"))
    return rows.join(found, "digest").select(
        F.col("keep_id").alias(id_col), F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep_row") == F.col("best_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    columns = docs.columns
    found = written(groups(digests(docs, id_col, text_col)), "groups").select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("at_keep").alias("__at"))
    marked = docs.withColumn("__d", F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256)))
    stay = lambda g: marked.join(g, (marked["__d"] == g["__digest"]) & marked[id_col].eqNullSafe(g["__keep"]))
    once = stay(found.where("__at = 1")).select(*[marked[c] for c in columns])
    repeated = found.where("__at > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(stay(repeated).dropDuplicates(["__d"]).select(*[F.col(c) for c in columns]))
