"""Near-duplicate embeddings by spherical-cap filters with structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import components, parts, written

#: Vectors of one filter that a task compares at once; a larger set is cut into blocks that meet in pairs.
GROUP = 1024


@dataclass(frozen=True)
class Filters:
    """A filter is a direction made of one code word for each of ``blocks`` parts of the (rotated) space; a vector
    passes all filters on which its projection exceeds a level of its own: that of its ``passes`` best ones."""

    dim: int
    blocks: int
    words: int
    passes: int
    seed: int = 1

    def codes(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """A random rotation, and for each block its code words as rows, of length 1 / sqrt(blocks)."""
        rng = np.random.default_rng(self.seed)
        turn, _ = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
        books = []
        for part in np.array_split(np.arange(self.dim), self.blocks):
            book = rng.standard_normal((self.words, len(part)))
            books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(self.blocks))
        return turn, books


def filters_for(rows: int, dim: int, passes: int) -> Filters:
    """Filters for ``rows`` vectors: so many that about two unlike vectors pass each, if each vector passes ``passes``
    of them. Vectors as close as copies share most of what either passes. A level for all vectors would let some pass
    hundreds and others none, since projections on a few words have wide tails; a vector's own level does not."""
    tail = min(0.02, max(2 / max(rows, 1), 1e-12))
    blocks = min(dim, 2 if tail > 1e-4 else 3 if tail > 1e-7 else 4)
    return Filters(dim, blocks, max(2, math.ceil((passes / tail) ** (1 / blocks))), passes)


def decode(unit: np.ndarray, filters: Filters, codes: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
    """A row of filters for each vector, in their order: those on which it projects best. Block by block: the best
    choices of words for the blocks so far are all that the best ones for one block more can be made of."""
    turn, books = codes
    turned, n = unit @ turn, filters.passes
    splits = np.array_split(np.arange(filters.dim), filters.blocks)
    reached, marks = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
    for part, book in zip(splits, books, strict=True):
        gains = turned[:, part] @ book.T
        best = np.argsort(-gains, axis=1, kind="stable")[:, :n]
        total = (reached[:, :, None] + np.take_along_axis(gains, best, 1)[:, None, :]).reshape(len(unit), -1)
        mark = (marks[:, :, None] * filters.words + best[:, None, :]).reshape(len(unit), -1)
        held = np.argsort(-total, axis=1, kind="stable")[:, :n]
        reached, marks = np.take_along_axis(total, held, 1), np.take_along_axis(mark, held, 1)
    return np.sort(marks, axis=1)


def _units(column: pa.Array | tuple) -> np.ndarray:
    """Vectors of one length as rows of length 1; divided by their largest component first, so that no square overflows
    or vanishes."""
    found = np.array(column.to_pylist() if isinstance(column, pa.Array) else column, float).reshape(len(column), -1)
    found /= np.abs(found).max(1, keepdims=True)
    return found / np.sqrt((found * found).sum(1, keepdims=True))


def _spread(filters: Filters):
    """(node, label, vector) to (node, label, mark, passed): a row for each filter passed; the first of a node's rows has
    all of them as passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = filters.codes()
        for batch in (b.slice(at, 250) for b in batches for at in range(0, b.num_rows, 250)):
            marks = decode(_units(batch.column("vector")), filters, codes)
            n, each = marks.shape
            passed: list[bytes | None] = [None] * (n * each)
            passed[::each] = [row.tobytes() for row in marks]
            same = [batch.column(c).take(pa.array(np.repeat(np.arange(n), each))) for c in ("node", "label")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(marks.ravel()), pa.array(passed, pa.binary())], names=["node", "label", "mark", "passed"])

    return run


def compare(nodes: np.ndarray, times: np.ndarray, unit: np.ndarray, passed: list[np.ndarray], mark: int, cosine: float, side: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the nodes of one filter: how many rows each links with whose first shared filter is this one, and links
    that connect what all these links connect. ``times``: the rows that a node stands for. ``side``: 0 or 1 where two different blocks meet (only pairs across count),
    -1 within one block."""
    n = len(nodes)
    degree, low, tree = np.zeros(n, np.int64), np.arange(n), []
    before = np.concatenate([p[: np.searchsorted(p, mark)] for p in passed])
    owner = np.repeat(np.arange(n), [np.searchsorted(p, mark) for p in passed])
    names, place = np.unique(before, return_inverse=True)
    member = np.zeros((n, len(names)), np.float32)
    member[owner, place] = 1
    for at in range(0, n, 256):
        near = unit[at : at + 256] @ unit.T >= cosine
        near &= member[at : at + 256] @ member.T < 0.5
        one, other = np.nonzero(near)
        one = one + at
        fits = (one != other) & ((side[one] < 0) | (side[one] != side[other]))
        one, other = one[fits], other[fits]
        degree += np.bincount(one, times[other], minlength=n).astype(np.int64)
        while True:
            a, b = low[one], low[other]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                break
            _, first = np.unique(np.stack([a[apart], b[apart]], 1).ravel(), return_index=True)
            taken = apart[np.unique(first // 2)]
            tree.append(np.stack([nodes[one[taken]], nodes[other[taken]]], 1))
            while True:
                a, b = low[one[taken]], low[other[taken]]
                if (a == b).all():
                    break
                np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
                while (low[low] != low).any():
                    low = low[low]
    return degree, tree


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _linked(cosine: float):
    """Rows sorted by group to (a, null, n): a has n links found here; and (a, b, null): a link."""

    def group(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        _, nodes, marks, vectors, passed, side, times = zip(*rows, strict=True)
        degree, tree = compare(
            np.array(nodes), np.array(times), _units(vectors), [np.frombuffer(x, np.int64) for x in passed], marks[0], cosine, np.array(side)
        )
        some = np.flatnonzero(degree)
        if not len(some):
            return None
        a = [*(rows[k][1] for k in some), *(int(x) for t in tree for x in t[:, 0])]
        b = [*([None] * len(some)), *(int(x) for t in tree for x in t[:, 1])]
        n = [*degree[some].tolist(), *([None] * (len(b) - len(some)))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "mark", "vector", "passed", "side", "times")), strict=True):
                if held and held[0][0] != row[0]:
                    if (out := group(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if (out := group(held)) is not None:
            yield out

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, group: int = GROUP, passes: int = 24) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept).

    Vectors link when their labels are equal and not null and their cosine in double precision is at least
    ``cosine``; one that is null, empty, zero or holds a null or a non-finite component links with nothing, nor
    do vectors of different lengths. Rows with equal label and vector are one node that counts as many links as
    it has rows, less one; repeated rows are vectors like others. Pairs of nodes are found by the filters both
    pass and verified; each is counted in the first filter they share. component_id is the smallest id
    reachable, itself included (null ids only where there is no other); kept: component_id is the row's own id.
    Other columns are not looked at. An empty table gives an empty result.

    Only one filter's vectors, ``group`` at most, meet in a task; a larger filter is cut into blocks that meet
    in pairs.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    # vectors travel as they come (single precision is half as long); they are compared in double precision
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("links", F.coalesce(whole, F.lit(False)) & F.col("label").isNotNull())
    # negative zero counts as zero; vectors that are multiples of each other are nodes of their own that link
    rows = rows.withColumn("vector", F.when(F.col("links"), F.transform(v, lambda x: x + F.lit(0).cast(kind[6:-1]))))
    hashes = {"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "vector", "label")}
    rows = written(rows.withColumns({c: F.when(F.col("links"), h) for c, h in hashes.items()}), "vectors")
    nodes = rows.where("links").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("low"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    found = None
    for dim in [r[0] for r in nodes.select(F.size("vector")).distinct().collect()]:
        own = nodes.where(F.size("vector") == dim)
        filters = filters_for(own.count(), dim, passes)
        schema = T.StructType([nodes.schema["node"], nodes.schema["label"], T.StructField("mark", T.LongType()), T.StructField("passed", T.BinaryType())])
        passing = own.select("node", "label", "vector").repartition(parts(spark, own.count(), 20_000)).mapInArrow(_spread(filters), schema)
        passing = written(passing, "passing")
        # most filters have one vector of a label; only the others' vectors are brought together
        together = F.count(F.lit(1)).over(Window.partitionBy("label", "mark"))
        cut = passing.select("node", "label", "mark", together.alias("rows")).where("rows > 1")
        blocks = F.ceil(F.col("rows") / (group // 2)).cast("int")
        cut = cut.withColumn("blocks", F.when(blocks <= 2, 1).otherwise(blocks)).drop("rows")
        data = own.select("node", "times", "vector").join(passing.where("passed is not null").select("node", "passed"), "node")
        cut = written(cut.join(data, "node"), "meeting")
        cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
        key = F.xxhash64("label", "mark", F.least("own", "other"), F.greatest("own", "other"))
        pairs = cut.select(key.alias("key"), "node", "mark", "vector", "passed", side.alias("side"), "times")
        dealt = pairs.repartition(parts(spark, cut.count(), 50_000), "key").sortWithinPartitions("key", "mark")
        links = written(dealt.mapInArrow(_linked(cosine), PAIRS), "links")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], PAIRS)

    roots = components(found.where("b is not null").select("a", "b"))
    degrees = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    rooted = nodes.select("h1", "h2", "node", "times", "low").join(roots, "node", "left").join(degrees, "node", "left")
    rooted = written(rooted.select("h1", "h2", "low", F.coalesce("root", "node").alias("root"), (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(least, "root").select("h1", "h2", "n_links", "component_id")
    apart = rows.where("not links").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = rows.where("links").select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component_id")
    out = joined.unionByName(apart)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
