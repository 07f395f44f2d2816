"""Packing documents into sequences of tokens by cutting-stock column generation."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .cutting_stock import classes, plan, wasteful
from .shared import parts, running, whole_text, written

CAPACITY = 2048
END = 1
#: One of so many documents is kept to fill gaps, cut wherever a gap ends.
FILLERS = 20
#: Token ids in one row of a filler document.
ROW = 1 << 16
#: Sequences whose gaps are filled together.
TOGETHER = 5000
#: Buckets of such sequences in one task.
BUCKETS = 16

FULL, REST, FILL = 0, 1, 2
#: Where sequence numbers of full pieces and of filled buckets begin; patterns' sequences count from 0.
FULL_FROM, FILL_FROM = 1 << 61, 1 << 60

PIECES = "kind int, uid long, {id}, turn long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
#: Long words are slow in the quick library, and long white space overflows its stack.
LONG_RUN = re.compile(r"\S{400}|\s{400}")


class Tokens:
    """Ids of ``byte_bpe_50k``. A merge table's file serves both libraries; the quicker one gives the same ids and
    is used, but for texts with a special token's string or very long runs of letters or of white space, where their
    rules or costs differ."""

    def __init__(self, tokenizer: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.careful = Tokenizer.from_file(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        letters = {c: b for b, c in self._letters().items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _letters() -> dict[int, str]:
        """The printable letter that stands for each byte in such files: itself where printable in Latin-1, else
        the next from code point 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __call__(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text) or any(s in text for s in self.special):
            ids = self.careful.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick.encode_ordinary(text)
        return np.array([*ids, END], "<u4")


def _cut(tokenizer: str, capacity: int, fillers: int):
    """Documents to pieces: full ones and a rest, or for every document that fills gaps its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, uid = None, TaskContext.get().partitionId() << 34
        for batch in batches:
            tokens = tokens or Tokens(tokenizer)
            rows: list[tuple] = []
            for key, text, turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = tokens(text)
                n = len(ids)
                if turn % fillers == 0:
                    step, kinds = ROW, (FILL, FILL)
                else:
                    step, kinds = capacity, (FULL, REST)
                for at in range(0, n, step):
                    piece = ids[at : at + step].tobytes()
                    kind = kinds[len(piece) < 4 * step]
                    rows.append((kind, uid, key, turn, at, len(piece) // 4, zlib.crc32(piece), n, piece if kind == FILL else None))
                    uid += 1
            types = [pa.int32(), pa.int64(), batch.schema.field(0).type, *[pa.int64()] * 5, pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["kind", "uid", "id", "turn", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def _rests(tokenizer: str, capacity: int):
    """(id, turn, text) to the ids of each text's rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or Tokens(tokenizer)
            found = [tokens(t.as_py()) for t in batch.column(2)]
            ids = pa.array([x[len(x) // capacity * capacity :].tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["id", "turn", "ids"])

    return run


def _filled(capacity: int):
    """Rows sorted by (bucket, kind, ...): first a bucket's gaps (kind 0: sequence, used), then its filler rows. The
    ids go on through gaps, then through sequences of their own; the last one is cut at powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, gaps, held = None, [], []
        out: list[tuple] = []
        new = room = sequence = offset = 0
        kind_id = None

        def opened() -> None:
            nonlocal room, sequence, offset, new
            if gaps:
                sequence, offset = gaps.pop()
            else:
                sequence, offset = FILL_FROM + (bucket << 32) + new, 0
                new += 1
            room = capacity - offset

        def put(key, at: int, n: int, ids: bytes) -> None:
            nonlocal room, offset
            out.append((key, at[0], n, zlib.crc32(ids), at[1], sequence, offset))
            room, offset = room - n, offset + n

        def ended() -> None:
            """The pieces of an unfinished sequence of the bucket's own are dealt out to powers of two."""
            nonlocal held, new
            total = sum(len(p[3]) // 4 for p in held)
            sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
            todo = held[::-1]
            for size in sizes:
                number, filled = FILL_FROM + (bucket << 32) + new, 0
                new += 1
                while filled < size:
                    key, start, whole, ids = todo.pop()
                    n = min(size - filled, len(ids) // 4)
                    out.append((key, start, n, zlib.crc32(ids[: 4 * n]), whole, number, filled))
                    filled += n
                    if 4 * n < len(ids):
                        todo.append((key, start + n, whole, ids[4 * n :]))
            held = []

        def flushed() -> pa.RecordBatch:
            types = [kind_id, *[pa.int64()] * 6]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind_id = batch.schema.field("id").type
            for b, kind, seq, used, key, start, whole, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "sequence_id", "used", "id", "start", "doc_tokens", "ids")), strict=True):
                if b != bucket:
                    if bucket is not None:
                        ended()
                    bucket, gaps, new, room, held = b, [], 0, 0, []
                if kind == 0:
                    gaps.append((seq, used))
                    continue
                while ids:
                    if not room and not gaps and not held or held and sum(len(p[3]) for p in held) == 4 * capacity:
                        if held:
                            sequence, offset, room = FILL_FROM + (bucket << 32) + new, 0, capacity
                            new += 1
                            for k, s, w, part in held:
                                put(k, (s, w), len(part) // 4, part)
                            held, room = [], 0
                    if not room and gaps:
                        opened()
                    if room:
                        n = min(room, len(ids) // 4)
                        put(key, (start, whole), n, ids[: 4 * n])
                    else:
                        n = min(capacity - sum(len(p[3]) // 4 for p in held), len(ids) // 4)
                        held.append((key, start, whole, ids[: 4 * n]))
                    start, ids = start + n, ids[4 * n :]
                if len(out) > 20_000:
                    yield flushed()
        if bucket is not None:
            ended()
        if out:
            yield flushed()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, fillers: int = FILLERS) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is the ids of its whole text (null: empty) and one id 1. It is cut into full sequences and a
    rest. The rests' lengths, in classes, give a cutting-stock problem, solved by column generation on the
    histogram (as many numbers as there are classes, whatever the input); its patterns, rounded, are dealt to
    the rests in the order of their rank within their class. Patterns that would stay too empty are given up, and
    their rests may be cut (their texts are then read once more). One of ``fillers`` documents, chosen by a hash of
    id and text, goes whole into the gaps that are left, cut wherever a gap ends; what remains of them goes into
    sequences of their own, the last cut at powers of two, which need no padding. Sequence numbers are unique,
    not gapless. Null or repeated ids and repeated rows are documents like others; other columns are not looked
    at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("turn", F.xxhash64("id", "text"))
    pieces = written(rows.mapInArrow(_cut(tokenizer, capacity, fillers), PIECES.format(id=f"id {kind}")), "pieces")
    rests = pieces.where(F.col("kind") == REST)
    lengths = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    supply = pieces.where(F.col("kind") == FILL).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    # each class's ranks, cut into ranges that belong to one pattern; one that is given up has no sequences
    of = classes(lengths, capacity)
    demand: dict[int, int] = {}
    for x, n in lengths.items():
        demand[of[x]] = demand.get(of[x], 0) + n
    patterns = plan(demand, capacity)
    gone = wasteful(patterns, capacity, sum(n * (of[x] - x) for x, n in lengths.items()), supply)
    ranges, seen, sequences = [], {}, 0
    for k, (pattern, times) in enumerate(patterns):
        for length, items in pattern.items():
            low = seen.get(length, 0)
            seen[length] = low + items * times
            ranges.append((length, low, seen[length], items, None if k in gone else sequences))
        sequences += 0 if k in gone else times
    classed = F.element_at(F.lit([of.get(x, 0) for x in range(1, capacity)]), F.col("length").cast("int")).cast("long")
    rests = rests.drop("ids", "kind").withColumns({"class": classed, "chunk": F.shiftright("uid", 16), "one": F.lit(1).cast("long")})
    ranked = running(rests, ["class"], "chunk", ["uid"], "one", "rank")
    schema = "class long, low long, high long, items long, first long"
    held = F.broadcast(spark.createDataFrame(ranges, schema).withColumnRenamed("class", "__class"))
    dealt = ranked.join(held, (F.col("class") == F.col("__class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = dealt.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("items")))
    if gone:
        dealt = written(dealt, "dealt")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = dealt.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*columns)
    placed = written(placed, "placed")

    full = pieces.where(F.col("kind") == FULL).withColumn("sequence_id", F.col("uid") + FULL_FROM).withColumn("offset", F.lit(0).cast("long")).select(*columns)
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < capacity)
    fill = pieces.where(F.col("kind") == FILL).select("uid", "id", "start", "doc_tokens", "ids")
    spare = 0
    if gone:  # the rests of patterns given up are cut too: their texts are read once more
        pool = dealt.where("sequence_id is null").select("uid", F.col("id").alias("__id"), F.col("turn").alias("__turn"), "start", "doc_tokens")
        spare = pool.count()
        wanted = pool.select("__id", "__turn").distinct()
        again = rows.join(wanted, rows["id"].eqNullSafe(wanted["__id"]) & (rows["turn"] == wanted["__turn"]), "left_semi").dropDuplicates(["id", "turn"]).select("id", "turn", "text")
        again = again.mapInArrow(_rests(tokenizer, capacity), f"id {kind}, turn long, ids binary")
        pool = pool.join(again, again["id"].eqNullSafe(pool["__id"]) & (again["turn"] == pool["__turn"]))
        fill = fill.unionByName(pool.select("uid", "id", "start", "doc_tokens", "ids"))
    buckets = (sequences + spare) // TOGETHER + 1
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("long").alias("bucket")
    gaps = used.select(bucket("sequence_id"), F.lit(0).alias("kind"), F.col("sequence_id").alias("uid"), "sequence_id", "used", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("doc_tokens"), F.lit(None).cast("binary").alias("ids"))
    fill = fill.select(bucket("uid"), F.lit(1).alias("kind"), "uid", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("used"), "id", "start", "doc_tokens", "ids")
    together = gaps.unionByName(fill).repartition(parts(spark, buckets, BUCKETS), "bucket").sortWithinPartitions("bucket", "kind", "uid")
    filled = together.mapInArrow(_filled(capacity), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(placed).unionByName(filled).withColumnRenamed("id", id_col)
