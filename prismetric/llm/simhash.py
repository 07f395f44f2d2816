"""SimHash near-duplicates found by deletion variants of fingerprint segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, mix, parts, whole_text, written

SEED = 42
#: Distinct fingerprints of one key that a task compares at once; a larger group is dealt anew by finer keys.
GROUP = 2048
#: Up to so many a group is compared by shifting, many groups at once.
SMALL = 8
#: Of a set's node, the bits that are the first of its wide fingerprint; the others tell apart sets that agree in them.
FIRST, FIRST_BITS = np.uint64((1 << 40) - 1), 40
#: Bits by which groups are compared: those, and the 64 of the second word of the wide fingerprint.
NEAR_BITS = FIRST_BITS + 64
#: Of a cluster that is compared whole, bytes of hashes in a block, and hashes told apart at a time.
BLOCK_BYTES, AT_ONCE = 8 << 20, 16384


def hashes_of(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles in order, repeats included. A-Z count as a-z; words lie between ASCII white space.
    Fewer words than a shingle: all of them are the one shingle; no word (null, empty, white space): none."""
    split = (text or "").encode().lower().split()
    n = max(1, len(split) - shingle + 1) if split else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(split[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def words_of(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits; a bit is 1 if it is set in over half the hashes; no hash: zero. The first 64 bits
    come from the hash itself, the others from mixtures of it."""
    n = len(hashes)
    out = np.empty(words, np.uint64)
    for word in range(words):
        set_bits, turned = np.zeros(64, np.int64), mix(hashes + np.uint64(word)) if word else hashes
        for at in range(0, n, 65536):
            set_bits += np.unpackbits(turned[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[word] = np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: str | None, shingle: int) -> int:
    return int(words_of(hashes_of(text, shingle))[0])


def node_of(found: np.ndarray, wide: np.ndarray) -> np.uint64:
    """What stands for a set of hashes (sorted, distinct): its first bits in ``wide``, and above them a hash of the set."""
    return (wide[0] & FIRST) | np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)) & ~FIRST


def set_node(text: str | None, shingle: int) -> int:
    found = np.unique(hashes_of(text, shingle))
    return int(node_of(found, words_of(found)).view(np.int64))


def shingle_sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(fp, hashes) for every row: the node of its set of shingles, and 48 bits of the hash of each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes_of(x.as_py(), shingle)) for x in batch.column(0)]
            nodes = np.array([node_of(x, words_of(x)) for x in sets], np.uint64)
            cut = [x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(cut, pa.binary())], names=["fp", "hashes"])

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "fp long, hashes binary")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int = 1) -> DataFrame:
    """(id, fp long in two's complement, wide binary) for every row. With one word, fp is the fingerprint, repeated
    shingles included, and wide is null; with more, they are the node and the wide fingerprint of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashes_of(x.as_py(), shingle) if words == 1 else np.unique(hashes_of(x.as_py(), shingle)) for x in batch.column(1)]
            marks = [words_of(x, words) for x in sets]
            fp = np.array([m[0] if words == 1 else node_of(x, m) for x, m in zip(sets, marks, strict=True)], np.uint64)
            wide = [m.tobytes() if words > 1 else None for m in marks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), pa.array(wide, pa.binary())], names=["id", "fp", "wide"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("wide", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


ROWS = T.StructType([T.StructField("key", T.LongType()), T.StructField("used", T.LongType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("hot", T.BooleanType()), *ROWS.fields])


def _table(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in arrays], names=names)


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under 64 keys: either half of it with each one of its 32 bits taken as a wildcard.

    Two fingerprints that differ in at most three bits differ in at most one bit of one half, and so share a key.
    """
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for half in range(2):
            for bit in range(32):
                used = np.uint64((0xFFFFFFFF ^ (1 << bit)) << (32 * half))
                key = mix((fp & used) ^ mix(np.full(1, 64 * half + bit + 1, np.uint64))[0])
                yield _table(["key", "used", "fp"], key, np.full(len(fp), used, np.uint64), fp)


def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a large group under four keys each: the bits not fixed so far are cut into four pieces, of which
    one is equal wherever at most three bits differ. Each round fixes a quarter of what is left, so groups of
    distinct fingerprints end."""
    for batch in batches:
        key, used, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in range(3))
        for fixed in np.unique(used):
            rows = used == fixed
            left = [b for b in range(64) if not int(fixed) >> b & 1]
            for piece in range(4):
                mask = np.uint64(sum(1 << b for b in left[piece::4]))
                yield _table(["key", "used", "fp"], mix(mix(key[rows] + np.uint64(piece + 1)) ^ (fp[rows] & mask)), np.full(rows.sum(), fixed | mask, np.uint64), fp[rows])


def close_pairs(fp: np.ndarray, bits: int, more: np.ndarray | None = None) -> np.ndarray:
    """(place, place, distance) of the pairs within ``bits``, those of ``more`` added if it is there, closest first."""
    found = []
    for at in range(0, len(fp), 256):
        apart = np.bitwise_count(fp[at : at + 256, None] ^ fp[None, at:])
        if more is not None:
            apart = apart + np.bitwise_count(more[at : at + 256, None] ^ more[None, at:])
        one, other = np.nonzero(apart <= bits)
        kept = one < other
        found.append(np.stack([one[kept] + at, other[kept] + at, apart[one[kept], other[kept]]], 1).astype(np.int32))
    pairs = np.concatenate(found)
    return pairs[np.argsort(pairs[:, 2], kind="stable")]


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Of ``close_pairs`` among ``n``, those that connect what all of them connect, without a cycle: each set takes the
    closest pair that leaves it, sets so joined become one, and so on. So for each lesser bound too, those of the
    pairs that are within it connect what all within it connect."""
    pairs = pairs[:, :2]
    low, tree = np.arange(n), [np.empty((0, 2), np.int64)]
    while True:
        sets = low[pairs]
        apart = sets[:, 0] != sets[:, 1]
        pairs, sets = pairs[apart], sets[apart]
        if not len(pairs):
            return np.concatenate(tree)
        taken = np.unique(np.unique(sets.ravel(), return_index=True)[1] // 2)
        tree.append(pairs[taken].astype(np.int64))
        while True:
            a, b = low[pairs[taken]].T
            if (a == b).all():
                break
            np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while (low[low] != low).any():
                low = low[low]


def link_runs(bits: int, group: int, mask: np.uint64 = ~np.uint64(0), wide: bool = False):
    """Rows sorted by key to links (hot false: key and fp are the ends) and rows of groups too large (hot true).
    Only bits in ``mask`` are compared, and with ``wide`` those of used as well. A link's used is 1 where its group
    has more links than it proposes."""

    def links(key: np.ndarray, used: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= SMALL, sizes)
        pairs, some = [], [np.empty((0, 2), np.int64)]
        for shift in range(1, SMALL):
            at = np.flatnonzero((key[:-shift] == key[shift:]) & small[:-shift]) if len(key) > shift else np.empty(0, int)
            apart = np.bitwise_count((fp[at] ^ fp[at + shift]) & mask)
            if wide:
                apart = apart + np.bitwise_count(used[at] ^ used[at + shift])
            at = at[apart <= bits]
            pairs.append(np.stack([at, at + shift], 1))
        for s, n in zip(starts, sizes, strict=True):
            if SMALL < n <= group:
                every = close_pairs(fp[s : s + n] & mask, bits, used[s : s + n] if wide else None)
                tree = forest(n, every) + s
                (some if len(tree) < len(every) else pairs).append(tree)
        for part, found in enumerate((np.concatenate(pairs), np.concatenate(some))):
            if len(found):
                ends = np.unique(np.sort(fp[found], axis=1), axis=0)
                yield _table(LINKS.names, np.zeros(len(ends), bool), ends[:, 0], np.full(len(ends), part, np.uint64), ends[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.uint64)] * 3
        big = None  # the key of a group that has proved too large
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in range(3)]
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            while len(rest[0]):
                key = rest[0]
                last = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
                if last:
                    done, rest = [x[:last] for x in rest], [x[last:] for x in rest]
                    if big is not None and done[0][0] == big:
                        n = int(np.argmax(done[0] != big)) if (done[0] != big).any() else len(done[0])
                        yield _table(LINKS.names, np.ones(n, bool), *(x[:n] for x in done))
                        done = [x[n:] for x in done]
                        if not len(done[0]):
                            continue
                    yield from close(done)
                elif len(key) > group or big is not None and key[0] == big:
                    big = key[0]
                    yield _table(LINKS.names, np.ones(len(key), bool), *rest)
                    rest = [x[:0] for x in rest]
                else:
                    break
        if len(rest[0]):
            if big is not None and rest[0][0] == big:
                yield _table(LINKS.names, np.ones(len(rest[0]), bool), *rest)
            else:
                yield from close(rest)

    def close(done: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole groups; those over the bound go out as hot rows."""
        starts = np.flatnonzero(np.r_[True, done[0][1:] != done[0][:-1]])
        sizes = np.diff(np.r_[starts, len(done[0])])
        hot = np.repeat(sizes > group, sizes)
        if hot.any():
            yield _table(LINKS.names, np.ones(hot.sum(), bool), *(x[hot] for x in done))
        some = ~hot & np.repeat(sizes > 1, sizes)
        if some.any():
            yield from links(*(x[some] for x in done))

    return run


def near_links(marks: DataFrame, bits: int = 3, group: int = GROUP) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``marks(fp)`` that connect just what all pairs within
    ``bits`` (three at most) connect."""
    if not 0 <= bits <= 3:
        raise ValueError("the halves and quarters of the keys hold for at most three differing bits")
    spark = marks.sparkSession
    rows = marks.mapInArrow(variants, ROWS)
    count, out = 64 * marks.count(), None
    while count:
        dealt = rows.repartition(parts(spark, count, 2_000_000), "key").sortWithinPartitions("key")
        found = written(dealt.mapInArrow(link_runs(bits, group), LINKS), "links")
        links = found.where("not hot").select(F.col("key").alias("a"), F.col("fp").alias("b"))
        out = links if out is None else out.union(links)
        hot = found.where("hot").select("key", "used", "fp")
        count = 4 * hot.count()
        rows = hot.mapInArrow(finer, ROWS)
    return out if out is not None else spark.createDataFrame([], "a long, b long")


def expected_share(similarity: float) -> float:
    """Of SimHash bits, the share that differs between texts whose shingle sets have this Jaccard similarity (equal sizes)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Search:
    """How texts of at least ``similarity`` are found: ``segments`` of ``length`` bits of a wide fingerprint, each
    under all its one-wildcard variants; ``words`` in all. Before sets are compared, pairs go that differ in more than
    ``near`` of the first 104 bits, or in more than ``share`` of all."""

    length: int
    segments: int
    words: int
    near: int
    share: float


def search_for(rows: int, similarity: float, recall: float = 0.9) -> Search:
    """Segments so long that unlike texts rarely share a variant among ``rows`` texts, and so many that texts just
    at the similarity share one with probability ``recall`` (more alike ones: far more often). Both limits are three
    standard deviations (over 512 bits, whatever the rows) above what such texts differ in."""
    share = expected_share(similarity)
    length = max(16, math.ceil(math.log2(max(rows, 2))) + 2)
    one = (1 - share) ** length + length * share * (1 - share) ** (length - 1)
    segments = math.ceil(math.log(1 - recall) / math.log(1 - one))
    words = max(8, 1 + -(-segments * length // 64))
    spread = math.sqrt(share * (1 - share))
    return Search(length, segments, words, round(NEAR_BITS * share + 3 * math.sqrt(NEAR_BITS) * spread), share + 3 * spread / math.sqrt(512))


def wide_variants(how: Search):
    """(key, used, fp) rows: every one-wildcard variant of every segment; used is the second word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                fp = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                whole = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(len(fp), -1)
                bits, second = np.unpackbits(whole[:, 8:], axis=1, bitorder="little"), whole[:, 8:16].copy().view(np.uint64).ravel()
                for segment in range(how.segments):
                    cut = bits[:, segment * how.length : (segment + 1) * how.length].astype(np.uint64)
                    value = (cut << np.arange(how.length, dtype=np.uint64)).sum(1, dtype=np.uint64)
                    for bit in range(how.length):
                        salt = mix(np.full(1, segment * 64 + bit + 1, np.uint64))[0]
                        # 40 bits of a key are enough: what falls together by chance is compared and let go
                        key = mix((value & ~np.uint64(1 << bit)) ^ salt) >> np.uint64(24)
                        yield _table(["key", "used", "fp"], key, second, fp)

    return run


def similar_links(marks: DataFrame, how: Search, group: int = GROUP, sets: DataFrame | None = None, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) between ``marks(fp, wide)``: pairs that share a segment variant, are within the limits of ``how``
    and, with ``sets(fp, hashes)``, whose sets have a Jaccard similarity of at least ``similarity``. They connect what
    all such pairs connect. A group over the bound is cut into blocks, every two of which meet in one task.

    Each group proposes a cycle-free part of its links. Where all of these hold, they connect what the group's links
    connect. Where it left some out, the ends of each one that it left out are connected by those that it proposed: so
    a cluster that such links connect, and in which one of them fails, is compared whole, one row for each of its texts.
    """
    spark = marks.sparkSession
    rows = marks.select("fp", "wide").mapInArrow(wide_variants(how), ROWS)
    count = how.segments * how.length * marks.count()
    deal = lambda r, n: r.repartition(parts(spark, n, 2_000_000), "key").sortWithinPartitions("key")
    found = written(deal(rows, count).mapInArrow(link_runs(how.near, group, FIRST, True), LINKS), "links")
    hot = found.where("hot").select("key", "used", "fp")
    if not hot.isEmpty():
        pair = _in_blocks(hot, "key", F.ceil(F.count(F.lit(1)) / (group // 2)))
        found = found.where("not hot").union(written(deal(pair, pair.count()).mapInArrow(link_runs(how.near, 1 << 62, FIRST, True), LINKS), "links"))
    end = lambda t, c: t.select(F.col("fp").alias(c), F.col(t.columns[1]).alias(f"of_{c}"))
    both = lambda pairs, t, test: pairs.join(end(t, "a"), "a").join(end(t, "b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(test, "a long, b long")
    marks = marks.select("fp", "wide")
    new = written(found.where("not hot").groupBy(F.col("key").alias("a"), F.col("fp").alias("b")).agg(F.max("used").alias("part")), "proposed")
    out = written(both(new, marks, _close(how.share)), "near")
    some, held = new.where("part = 1").select("a", "b"), None
    if sets is not None:
        ends = out.union(some).select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        held = written(sets.join(written(ends, "ends"), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes")), "sets")
        out = written(both(out, held, _alike(similarity)), "alike")
    failed = written(some.join(out, ["a", "b"], "left_anti").select(F.col("a").alias("node")).distinct(), "failed")
    if failed.isEmpty():
        return out
    clusters = components(some)
    left = clusters.join(clusters.join(failed, "node", "left_semi").select("root").distinct(), "root", "left_semi").withColumnRenamed("node", "fp").join(marks, "fp")
    left = written(left.join(held, "fp") if held is not None else left.withColumn("hashes", F.lit(None).cast("binary")), "again")
    size = F.greatest(F.count(F.lit(1)) / (group // 2), F.coalesce(F.sum(F.length("hashes")), F.lit(0)) / BLOCK_BYTES)
    pair = _in_blocks(left.select(F.col("root").alias("key"), "fp", "wide", "hashes"), "key", F.ceil(size))
    return out.union(written(pair.groupBy("key").applyInArrow(whole_links(how.share, similarity if sets is not None else None), "a long, b long"), "again"))


def _in_blocks(rows: DataFrame, key: str, blocks) -> DataFrame:
    """The rows of each key in as many blocks as ``blocks``, an aggregate, says; every two blocks share a new key."""
    sizes = rows.groupBy(F.col(key).alias("of")).agg(blocks.cast("int").alias("blocks"))
    cut = rows.join(sizes, F.col(key) == F.col("of")).withColumn("one", F.pmod(F.xxhash64("fp"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select(F.xxhash64(key, F.least("one", "other"), F.greatest("one", "other")).alias(key), *(c for c in rows.columns if c != key))


def _hashes(cut: bytes) -> np.ndarray:
    whole = np.zeros((len(cut) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(cut, np.uint8).reshape(-1, 6)
    return np.unique(whole.view(np.uint64).ravel())


def whole_links(share: float, similarity: float | None):
    """A group of rows (key, fp, wide, hashes) to links that connect all pairs that differ in at most ``share`` of the
    bits and, unless it is None, whose sets have at least that ``similarity``."""

    def run(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy()
        wide = np.frombuffer(b"".join(group["wide"].to_pylist()), np.uint64).reshape(len(fp), -1)
        pairs = [np.empty((0, 2), np.int64)]
        for i in range(len(fp)):
            other = np.flatnonzero(np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(1) <= share * 64 * wide.shape[1]) + i + 1
            pairs.append(np.stack([np.full(len(other), i), other], 1))
        pairs = np.concatenate(pairs)
        if similarity is not None and len(pairs):
            sets = [_hashes(x) for x in group["hashes"].to_pylist()]
            sizes = np.array([len(x) for x in sets])
            both = sizes[pairs].sum(1)
            common = common_counts(sets, pairs)
            pairs = pairs[common + 1e-9 >= similarity * (both - common)]
        ends = np.sort(fp[forest(len(fp), pairs)], axis=1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return run


def common_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """For each pair of places how many hashes the two sets share; hashes are bits of rows, some thousand at a time."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, place = row[times[place] > 1], np.cumsum(times > 1)[place[times[place] > 1]] - 1
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros(len(pairs), np.int64)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, AT_ONCE):
        s, e = np.searchsorted(place, [at, at + AT_ONCE])
        held = np.zeros((len(sets), AT_ONCE), bool)
        held[row[s:e], place[s:e] - at] = True
        held = np.packbits(held[:, : -(-(int(place[e - 1]) + 1 - at) // 64) * 64], axis=1).view(np.uint64)
        for k in range(0, len(pairs), 8192):
            one, other = pairs[k : k + 8192].T
            common[k : k + 8192] += np.bitwise_count(held[one] & held[other]).sum(1, dtype=np.int64)
    return common


def _alike(similarity: float):
    """Of links with the sets of their ends those whose Jaccard similarity is at least ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                a, b = _hashes(one.as_py()), _hashes(other.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0
                kept.append(common + 1e-9 >= similarity * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _close(share: float):
    """Of links with the wide fingerprints of their ends those that differ in at most ``share`` of the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (2, 3))
                near = np.bitwise_count(one ^ other).sum(1) <= share * 64 * one.shape[1]
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int | None, similarity: float | None = None) -> DataFrame:
    """(id, fp, root, component_id) for every row; root stands for the component also where ids are null or repeat.
    Texts link within ``bits`` of the 64-bit fingerprint, or by the Jaccard ``similarity`` of their sets of shingles."""
    how = search_for(docs.count(), similarity) if similarity else None
    rows = written(fingerprints(docs, id_col, text_col, shingle, how.words if how else 1), "fingerprints")
    marks = written(rows.groupBy("fp").agg(F.min("id").alias("low"), F.min("wide").alias("wide")), "marks")
    links = similar_links(marks.select("fp", "wide"), how, sets=shingle_sets(docs, text_col, shingle), similarity=similarity) if how else near_links(marks.select("fp"), bits)
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = written(marks.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select("id", "fp", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: (id, fingerprint, component_id).

    Texts link when their fingerprints (see ``fingerprint``) differ in at most ``bits`` bits. component_id is
    the smallest id reachable over links, itself included; null ids are passed over while another one is there.
    A null text counts as empty; equal texts link, repeated rows included. Other columns are not looked at. An
    empty table gives an empty result.
    """
    found = labelled(docs, id_col, text_col, shingle, bits)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, with all their columns; one row for each group,
    also where ids are null or repeat. Texts link where the Jaccard similarity of their sets of shingles is at least ``similarity``."""
    found = written(labelled(docs, id_col, text_col, shingle, None, similarity), "labelled")
    stays = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root"))
    again = written(found.groupBy(F.col("id").alias("__again")).count().where("count > 1").select("__again"), "again")
    if again.isEmpty():
        return docs.join(stays, docs[id_col].eqNullSafe(stays["__id"]), "left_semi")
    mark = F.udf(lambda t: set_node(t, shingle), T.LongType())
    stays_once = stays.join(again, stays["__id"].eqNullSafe(again["__again"]), "left_anti")
    once = docs.join(stays_once, docs[id_col].eqNullSafe(stays_once["__id"]), "left_semi")
    odd = docs.join(again, docs[id_col].eqNullSafe(again["__again"]), "left_semi").withColumn("__mark", mark(whole_text(text_col)))
    odd = odd.join(stays.distinct(), odd[id_col].eqNullSafe(stays["__id"]) & (odd["__mark"] == stays["__fp"])).dropDuplicates(["__root"])
    return once.unionByName(odd.select(docs.columns))
