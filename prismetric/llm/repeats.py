"""Repeated passages by prefix-free parsing.

Texts are cut into phrases where a rolling hash of ``TRIGGER`` bytes is least among those of a window of the
given length; each phrase starts with its trigger and overlaps the next one by it. Unlike triggers taken at a
fixed residue, these stand in every window, and equal windows have theirs at the same place. So every window
belongs to one trigger, and equal windows belong to equal triggers. A phrase here is a trigger with as much text
before and behind as the windows reach that belong to it; the dictionary is the set of phrases, the parse the
list of their places in the order of the corpus.

The parse is sorted by phrase and place. All windows of a phrase that the parse has had before are repeats. In
this step phrases are told apart by 128 bits: the hash of the trigger, and one of its first and last window.
Dictionary phrases that share their trigger with another one may share windows too: of these the suffixes are
sorted by their bytes, eight at a time, to the depth of a window, which is as far as a suffix can matter here
(``suffix_runs``). Suffixes that agree to that depth stand in the order in which the parse has their phrases, and
so in the order of the corpus: the first of each run is where that window starts first, the others are repeats.
Suffixes of phrases with different triggers can't agree, so triggers are dealt out to tasks. Only where one trigger
has over ``GROUP`` windows its phrases are dealt out by window, told apart by 128 bits as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix, parts, whole_text, written

TRIGGER = 32
#: Bytes parsed at once, windows sorted at once, and windows of one trigger that a task sorts at most.
PIECE, WINDOWS, GROUP = 1 << 20, 1 << 20, 1 << 20
#: Phrases among which a task looks for repeats before they are dealt out.
PHRASES = 1 << 19
NEW, CUT = 0, 1
LOWEST = -(1 << 63)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * np.uint64(0x9E3779B97F4A7C15)
    out += right
    out ^= out >> np.uint64(29)
    return out


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolled(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place, made from those of the powers of two in the length."""
    out, size, done = None, 1, 0
    power = BYTES[data]
    while True:
        if length & size:
            n = len(data) - length + 1
            here = power[done : done + n]
            out = here.copy() if out is None else _join(out, here)
            done += size
        size *= 2
        if size > length:
            return out
        power = _join(power[: -size // 2], power[size // 2 :])


def phrases(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, content, first, last): each phrase's trigger and its whole content as hashes, and the starts of the
    windows that belong to it. The first and the last window cover a phrase."""
    hashes = mix(rolled(data, TRIGGER))
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, size, least = window - TRIGGER + 1, 1, order
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(hashes) - span + 1], least[span - size :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    windows = rolled(data, window)
    content = mix(windows[first] ^ mix(windows[last] + (last - first).astype(np.uint64)))
    return hashes[place[first]], content, first, last


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


PARSE = "state int, trigger long, content long, id long, hash long, first long, last long"


def _parse(window: int):
    """(id, hash, text) to phrases; one that the task has had before is cut at once (its last is then where the cut
    ends), and neighbouring cuts are one. So a phrase of any frequency is dealt out once for each task."""
    names = [x.split()[0] for x in PARSE.split(", ")]

    def told(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda h: h[:3])
        held = [h for i, h in enumerate(held) if not i or h[:3] != held[i - 1][:3]]  # rows that repeat id and text
        trigger, content, first, last = (np.concatenate(x) for x in zip(*(h[3:] for h in held), strict=True))
        sizes = [len(h[3]) for h in held]
        key, text = (np.repeat(np.array([h[k] for h in held], np.int64), sizes) for k in (0, 1))
        both = mix(trigger ^ mix(content))
        new = np.zeros(len(both), bool)
        new[np.unique(both, return_index=True)[1]] = True
        # runs of cuts that touch
        cut = np.flatnonzero(~new)
        joined = np.zeros(len(cut), bool)
        joined[1:] = (cut[1:] == cut[:-1] + 1) & (key[cut[1:]] == key[cut[:-1]]) & (text[cut[1:]] == text[cut[:-1]]) & (first[cut[1:]] == last[cut[:-1]] + 1)
        begin = np.flatnonzero(~joined)
        end = np.r_[begin[1:], len(cut)][: len(begin)] - 1
        begin, end, new = cut[begin], cut[end], np.flatnonzero(new)
        rows = np.r_[new, begin]
        state = np.r_[np.full(len(new), NEW), np.full(len(begin), CUT)].astype(np.int32)
        # a cut has no trigger that matters: it goes anywhere
        trigger[begin] = mix(text[begin].view(np.uint64) + first[begin].astype(np.uint64))
        until = np.r_[last[new], last[end] + window]
        return pa.RecordBatch.from_arrays([pa.array(state), *(_longs(x[rows]) for x in (trigger, content, key, text, first)), _longs(until)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, text, value in zip(*(batch.column(c) for c in range(3)), strict=True):
                data = np.frombuffer(value.as_py().encode(), np.uint8)
                for at in range(0, len(data) - window + 1, PIECE):
                    trigger, content, first, last = phrases(data[at : at + PIECE + window - 1], window)
                    held.append((key.as_py(), text.as_py(), at, trigger, content, first + at, last + at))
                    size += len(trigger)
                    if size >= PHRASES:
                        yield told(held)
                        held, size = [], 0
        if held:
            yield told(held)

    return run


REPEATING = "state int, trigger long, id long, hash long, first long, last long"


def _repeating(window: int):
    """Rows sorted by trigger, content and place: what has the content of the row before is cut; of a trigger with
    several contents the first row of each stays in question (state new); all else is unique and goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting = None, None  # the last row seen; the first of its trigger, while all have had its content
        for batch in batches:
            names = ("state", "trigger", "content", "id", "hash", "first", "last")
            state, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            done = np.flatnonzero(state == CUT)
            todo = np.flatnonzero(state == NEW)
            trigger, content, key, text, first, last = (x[todo] for x in rest)
            out = [np.stack([np.full(len(done), CUT), *(rest[k][done] for k in (0, 2, 3, 4, 5))])]
            if len(todo):
                old = before if before is not None else (~trigger[0], 0, 0, 0, 0)
                shift = lambda x, k, old=old: np.r_[np.array([old[k]], np.int64), x[:-1]]
                same_trigger = trigger == shift(trigger, 0)
                same = same_trigger & (content == shift(content, 1))
                again = same & (key == shift(key, 2)) & (text == shift(text, 3)) & (first == shift(first, 4))
                cut = same & ~again
                other = same_trigger & ~same  # another content of the same trigger
                open_ = other.copy()
                # the first row of a trigger is in question as soon as another content follows
                start = np.flatnonzero(~same_trigger)
                owner = np.searchsorted(start, np.arange(len(todo)), side="right") - 1
                open_[start[np.unique(owner[other & (owner >= 0)])]] = True
                if waiting is not None and (other & (owner < 0)).any():
                    out.append(waiting)
                    waiting = None
                if len(start):
                    s = start[-1]
                    waiting = None if open_[s] else np.array([[NEW], *([x[s]] for x in (trigger, key, text, first, last))])
                before = tuple(x[-1] for x in (trigger, content, key, text, first))
                for mask, kind, end in ((cut, CUT, last + window), (open_, NEW, last)):
                    out.append(np.stack([np.full(mask.sum(), kind), *(x[mask] for x in (trigger, key, text, first, end))]))
            rows = np.concatenate(out, axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), *(pa.array(x) for x in rows[1:])], names=["state", "trigger", "id", "hash", "first", "last"])

    return run


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do; zeros stand behind the end."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_runs(data: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): the suffixes of ``data`` at ``places`` that share their first ``depth`` bytes with another, sorted
    by these bytes and, where they agree, as in ``places``; run numbers those that agree.

    Sorted by the first eight bytes, then within equal ones by the next eight, and so on; a suffix that nothing
    agrees with any more has its place and is looked at no further.
    """
    words, order, run = eights(data), np.arange(len(places)), np.zeros(len(places), np.int64)
    for at in range(0, depth, 8):
        at = min(at, depth - 8)
        key = words[places[order] + at]
        # order is by run already: a stable sort by the new key and then by run keeps places in order
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(run[by], kind="stable")]
        order, run, key = order[by], run[by], key[by]
        new = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])][: len(order)]
        run = np.cumsum(new) - 1
        alone = new & np.r_[new[1:], True][: len(order)]
        order, run = order[~alone], run[~alone]
    return order, run


class Sorted:
    """Phrases of the dictionary, with their first places, whose suffixes are sorted together."""

    def __init__(self, window: int):
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []  # trigger, id, hash, first, bytes
        self.windows = 0

    def add(self, trigger: int, key: int, text: int, first: int, context: bytes) -> None:
        self.rows.append((trigger, key, text, first, context))
        self.windows += len(context) - self.window + 1

    def solved(self) -> list[tuple]:
        """(id, hash, start, end) of bytes that repeat."""
        if not self.rows:
            return []
        rows = sorted(self.rows, key=lambda r: (r[1], r[2], r[3]))
        w = self.window
        sizes = np.array([len(r[4]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        counts = sizes - w + 1
        row = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]  # place in the phrase
        order, run = suffix_runs(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), begin[row] + at, w)
        head = np.r_[True, run[1:] != run[:-1]][: len(run)]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        place = np.array([r[3] for r in rows])[row] + at
        doc = np.array([(r[1], r[2]) for r in rows], np.int64).reshape(-1, 2)[row]
        # the same place read twice (rows that repeat id and text) is no repeat
        later = (place[order] != place[lead]) | (doc[order] != doc[lead]).any(1)
        repeat = np.zeros(len(row), bool)
        repeat[order] = ~head & later
        edge = np.flatnonzero(np.diff(np.r_[False, repeat]) | np.r_[False, row[1:] != row[:-1]] & repeat)
        stops = np.flatnonzero(repeat & ~np.r_[repeat[1:] & (row[1:] == row[:-1]), False])
        starts = edge[repeat[edge]]
        cuts = [(int(doc[a][0]), int(doc[a][1]), int(place[a]), int(place[b]) + w) for a, b in zip(starts, stops, strict=True)]
        self.clear()
        return cuts


FOUND = "trigger long, id long, hash long, first long, last long, context binary"


def _found(cuts: list[tuple], rest: list[tuple]) -> Iterator[pa.RecordBatch]:
    if cuts or rest:
        columns = [[None] * len(cuts) + [r[0] for r in rest], [c[0] for c in cuts] + [r[1] for r in rest], [c[1] for c in cuts] + [r[2] for r in rest], [c[2] for c in cuts] + [r[3] for r in rest], [c[3] for c in cuts] + [None] * len(rest)]
        context = pa.array([None] * len(cuts) + [r[4] for r in rest], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), context], names=["trigger", "id", "hash", "first", "last", "context"])


CONTEXT = "trigger long, id long, hash long, first long, context binary"


def _contexts(window: int):
    """(id, hash, packed, phrases) to the bytes of each phrase in question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, text, packed, found in zip(*(batch.column(c) for c in ("id", "hash", "packed", "phrases")), strict=True):
                data, struct = open_.decompress(packed.as_py()), found.values
                first, last = (struct.field(c).to_pylist() for c in ("first", "last"))
                context = pa.array([data[a : b + window] for a, b in zip(first, last, strict=True)], pa.binary())
                n = len(first)
                yield pa.RecordBatch.from_arrays([struct.field("trigger"), pa.array([key.as_py()] * n, pa.int64()), pa.array([text.as_py()] * n, pa.int64()), struct.field("first"), context], names=["trigger", "id", "hash", "first", "context"])

    return run


def _cuts(window: int, group: int):
    """Contexts sorted by trigger to cuts; those of a trigger with too many windows come out again, to be dealt by
    window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, hot, trigger = Sorted(window), Sorted(window), False, None

        def closed() -> None:
            if not hot:
                held.rows += own.rows
                held.windows += own.windows
            own.clear()

        for batch in batches:
            for t, key, text, first, context in zip(*(batch.column(c).to_pylist() for c in ("trigger", "id", "hash", "first", "context")), strict=True):
                if t != trigger:
                    if hot:
                        yield from _found([], own.rows)
                    closed()
                    trigger, hot = t, False
                    if held.windows >= WINDOWS:
                        yield from _found(held.solved(), [])
                own.add(t, key, text, first, context)
                if own.windows > group or hot:
                    hot = True
                    if own.windows > WINDOWS:
                        yield from _found([], own.rows)
                        own.clear()
        if hot:
            yield from _found([], own.rows)
        closed()
        yield from _found(held.solved(), [])

    return run


def _each_window(window: int):
    """Contexts to a row for each window: (h1, h2, id, hash, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                got: list[tuple] = []
                for trigger, key, text, first, context in zip(*(rows.column(c).to_pylist() for c in ("trigger", "id", "hash", "first", "context")), strict=True):
                    h = rolled(np.frombuffer(context, np.uint8), window)
                    n = len(h)
                    got.append((np.full(n, trigger), h, np.full(n, key), np.full(n, text), first + np.arange(n)))
                if got:
                    yield pa.RecordBatch.from_arrays([_longs(np.concatenate(x)) for x in zip(*got, strict=True)], names=["h1", "h2", "id", "hash", "first"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(out_id, packed, cuts) to the result's rows."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for packed, cuts in zip(batch.column("packed"), batch.column("cuts"), strict=True):
            data, n_removed, n_spans, at, sha = open_.decompress(packed.as_py()), 0, 0, 0, hashlib.sha256()
            until = -1  # where the last span ends
            if cuts.is_valid and len(cuts.values):
                starts, ends = (cuts.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                order = np.argsort(starts, kind="stable")
                for start, end in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
                    if start > until:
                        sha.update(data[at:start])
                        n_spans += 1
                    n_removed += max(0, end - max(start, at))
                    at = until = max(at, end)
            sha.update(data[at:])
            rows.append((len(data), n_removed, n_spans, sha.hexdigest()))
        n, removed, spans, sha = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("out_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["out_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([pack.compress(t.as_py().encode()) for t in batch.column(3)], pa.binary())], names=["out_id", "id", "hash", "packed"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_removed, n_spans, kept_sha256).

    Texts are UTF-8 bytes; a null text counts as empty. A byte goes if a string of ``window`` bytes covers it that
    also starts earlier: in a text with a smaller id (a null id is the smallest), or before in the same one. Rows
    that repeat id and text count as one document, and each gets its result; of different texts with one id, one
    is taken as earlier, the same one always. Ids must be integers. Other columns are not looked at; texts
    shorter than the window lose nothing; an empty table gives an empty result.
    """
    if window < 2 * TRIGGER:
        raise ValueError(f"a window has {2 * TRIGGER} bytes at least")
    kind = docs.schema[id_col].dataType.simpleString()
    spark, text = docs.sparkSession, whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("out_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))

    parsed = rows.select("id", "hash", "text").mapInArrow(_parse(window), PARSE)
    n = docs.count()
    dealt = parsed.repartition(parts(spark, n, 20_000), "trigger").sortWithinPartitions("trigger", "content", "id", "hash", "first")
    repeating = written(dealt.mapInArrow(_repeating(window), REPEATING), "repeating")

    texts = rows.mapInArrow(_packed, f"out_id {kind}, id long, hash long, packed binary")
    of_text = repeating.where(F.col("state") == NEW).groupBy("id", "hash").agg(F.collect_set(F.struct("trigger", "first", "last")).alias("phrases"))
    with_text = texts.select("id", "hash", "packed").join(of_text.hint("shuffle_hash"), ["id", "hash"])
    contexts = with_text.mapInArrow(_contexts(window), CONTEXT)
    sorted_ = contexts.repartition(parts(spark, n, 20_000), "trigger").sortWithinPartitions("trigger")
    again = written(sorted_.mapInArrow(_cuts(window, group), FOUND), "cuts")
    cuts = repeating.where(F.col("state") == CUT).unionByName(again.where("context is null").withColumn("state", F.lit(CUT)).drop("context")).select("id", "hash", "first", "last")
    hot = again.where("context is not null")
    if not hot.isEmpty():
        windows = hot.mapInArrow(_each_window(window), "h1 long, h2 long, id long, hash long, first long")
        place = F.struct("id", "hash", "first")
        lead = windows.groupBy("h1", "h2").agg(F.min(place).alias("lead"), F.max(place).alias("end")).where("lead <> end").drop("end")
        later = windows.join(lead, ["h1", "h2"]).where(place != F.col("lead"))
        cuts = cuts.unionByName(later.select("id", "hash", "first", (F.col("first") + window).alias("last")))
    of_text = cuts.groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    out = texts.join(of_text.hint("shuffle_hash"), ["id", "hash"], "left").select("out_id", "packed", "cuts")
    return out.mapInArrow(_kept, f"out_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("out_id", id_col)
