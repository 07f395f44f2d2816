"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import running, whole_text, written

WORD = r"[^\x20\x09-\x0D]+"
#: Point i of the schedule is i times this, modulo ``CIRCLE``: multiples of the golden ratio in parts of a circle.
GOLDEN, CIRCLE = 2654435769, 1 << 32
#: Cells of the circle by which points meet the ranges of their sources.
CELLS = 1024
#: Words of one block at most, whatever the input; slots that a smaller input is cut into.
BLOCK, SLOTS = 1 << 16, 1 << 20
#: Rows that repeat id, text and source and are counted as one row, at most.
COPIES = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target, place) from (source, source_size): one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. A target is weight times a level, but ``most``
    times the source's size where that is less. With sources ordered by the level at which they reach that
    bound, the level that spends all words is the largest of those that take the sources before as bounded and
    share the rest.
    """
    total = Window.partitionBy()
    ahead = Window.orderBy("bound_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("bound_at", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bound = F.lit(most) * F.col("source_size")
    w = F.col("weight")
    rows = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("bound_at", bound.cast("double") / w)
    spent = F.coalesce(F.sum(bound).over(ahead), F.lit(0))
    level = (F.sum("source_size").over(total) - spent).cast("double") / F.sum(w).over(rest)
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(total))
    target = F.least(bound.cast("double"), F.col("level") * w)
    return rows.select("source", "source_size", target.alias("target"), "place")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, order, chunk, id, size, copies), written: rows that repeat all of these are one, up to ``COPIES`` of them,
    so that no number of copies makes a source's order long. The order is a shuffle fixed by id and text."""
    text = whole_text(text_col)
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.select(
        F.col(source_col).cast("string").alias("source"),
        order.alias("order"),
        F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.floor(F.monotonically_increasing_id() / COPIES).alias("part"),
    )
    rows = rows.groupBy("source", "order", "id", "size", "part").agg(F.count(F.lit(1)).alias("copies"))
    return written(rows.drop("part").withColumn("chunk", F.substring("order", 1, 3)), "sizes")


def aimed(rows: DataFrame, weights: tuple[int, ...], most: int, slots: int) -> tuple[DataFrame, int, int]:
    """(sources, slots, words of a block). sources: (source, source_size, target, place, from, to), written; the source
    has the points of the circle between ``from`` and ``to``, as many as its target is of all words."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    aims = targets(sums, weights, most).withColumn("quota", F.round("target").cast("long"))
    words = aims.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    block = min(BLOCK, max(1, -(-words // slots)))
    before = F.sum("quota").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on_circle = lambda quota: F.floor(quota.cast("double") / max(words, 1) * CIRCLE).cast("long")
    aims = aims.withColumn("until", before)
    aims = aims.withColumns({"from": on_circle(F.col("until") - F.col("quota")), "to": on_circle(F.col("until"))})
    return written(aims.drop("quota", "until"), "aims"), -(-words // block), block


def schedule(aims: DataFrame, slots: int, golden: int = GOLDEN) -> DataFrame:
    """(slot, place, rank): slot i lies at point i times ``golden`` of the circle and belongs to the source whose range
    holds it; rank counts the slots of the source before it."""
    cell = CIRCLE // CELLS
    points = aims.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.col("id") * golden % CIRCLE).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    cells = F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))
    ranges = aims.where("`from` < `to`").select("place", "from", "to", F.explode(cells).alias("cell"))
    held = points.join(ranges, "cell").where("point >= `from` and point < `to`")
    held = held.select("slot", "place", F.lit(1).alias("one"), F.floor(F.col("slot") / 8192).alias("chunk"))
    return running(held, ["place"], "chunk", ["slot"], "one", "rank").select("slot", "place", "rank")


def pieces(rows: DataFrame, aims: DataFrame, slots: DataFrame, block: int, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces). placed: (row, id, size, source_size, target, place, start), a row for each document; pieces:
    (row, slot, from, words): the slot takes ``words`` of the document from its ``from`` on.

    A source's documents in their order, repeated ``most`` times, are one run of words, cut into blocks of ``block``
    words; the block at ``rank`` goes to the source's slot of that rank. Blocks behind the run's end have no words.
    """
    size = F.col("size")
    heads = running(rows.withColumn("words", size * F.col("copies")), ["source"], "chunk", ["order", "id", "size"], "words", "head")
    known = aims.select(F.col("source").alias("__source"), "source_size", "target", "place")
    heads = heads.join(known, F.col("source").eqNullSafe(F.col("__source")))
    each = heads.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.withColumn("start", F.col("head") + F.col("copy") * size).withColumn("row", F.monotonically_increasing_id())
    placed = written(each.select("row", "id", "order", "source", "size", "source_size", "target", "place", "start"), "placed")

    # how far the source's slots reach bounds the passes that its documents are cut for
    reach = slots.groupBy("place").agg((F.count(F.lit(1)) * block).alias("reach"))
    runs = placed.where("size > 0").join(reach, "place")
    runs = runs.withColumn("reach", F.least("reach", F.col("source_size") * most))
    runs = runs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    runs = runs.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size")).where("begin < reach")
    runs = runs.withColumn("end", F.least(F.col("begin") + size, F.col("reach")))
    ranks = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    cut = runs.select("row", "place", "begin", "end", F.explode(ranks).alias("rank"))
    low = F.greatest("begin", F.col("rank") * block)
    high = F.least("end", (F.col("rank") + 1) * block)
    cut = cut.join(slots, ["place", "rank"])
    return placed, cut.select("row", "slot", (low - F.col("begin")).alias("from"), (high - low).alias("words"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    slots: int = SLOTS,
    golden: int = GOLDEN,
) -> DataFrame:
    """One row per row of ``docs``: (id, size, source_size, target, taken, n_slots, first_slot).

    size counts words between ASCII white space; a null text has none. The schedule has a slot for each block of all
    words, about ``slots`` of them (a block has 65,536 words at most, so a large input has more). Slot i lies at the
    i-th multiple of the golden ratio, and belongs to the source in whose part of the cumulated targets that point
    falls; the slots of a source, ranked, take the blocks of its documents, shuffled by a hash of id and text, one
    after the other, and begin again at the end, ``most`` times in all. So a source's words are within a few blocks of
    its target, and neighbouring slots have all sources in near their shares. taken are the words that a document's
    slots take of it, n_slots their number (each pass counted), first_slot the first of them, -1 if there is none.
    Null ids and sources are values like others; rows that repeat id, text and source are interchangeable; other
    columns are not looked at; an empty table gives an empty result.
    """
    rows = sized(docs, id_col, text_col, source_col)
    aims, n, block = aimed(rows, weights, most, slots)
    placed, cut = pieces(rows, aims, written(schedule(aims, n, golden), "schedule"), block, most)
    got = cut.groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_slots"), F.min("slot").alias("first_slot"))
    taken, times = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_slots"))
    first = F.coalesce("first_slot", F.lit(-1)).alias("first_slot")
    return placed.join(got, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", taken, times, first)


def repeat_to_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, slots: int = SLOTS, rounds: int = 4,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it: whole documents, not at all, once,
    or up to ``most`` times. Rows without words stay as they are.

    A source's slots reach a number of words; its documents are taken for every whole pass of the source, and those
    that end within what is left of it once more. The words up to there that the next document is too long for are
    carried on: the documents behind it that are short enough take them in their order, in ``rounds`` rounds, so that a
    long document at the end doesn't move a source from its target. Rows that repeat id, text and source share one number.
    """
    rows = sized(docs, id_col, text_col, source_col)
    aims, n, block = aimed(rows, weights, most, slots)
    reach = schedule(aims, n).groupBy("place").agg((F.count(F.lit(1)) * block).alias("reach"))
    sources = aims.join(reach, "place", "left").where("source_size > 0")
    reach = F.least(F.coalesce("reach", F.lit(0)), F.col("source_size") * most)
    sources = sources.select(
        F.col("source").alias("__source"),
        "place",
        F.floor(reach / F.col("source_size")).cast("int").alias("whole"),
        (reach % F.col("source_size")).alias("left"),
    )
    # rows that repeat id, text and source go together
    rows = rows.where("size > 0").groupBy("source", "order", "id", "size", "chunk").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("words", F.col("size") * F.col("copies")).join(F.broadcast(sources) if sources.count() <= 100_000 else sources, F.col("source").eqNullSafe(F.col("__source")))
    open_ = written(rows.drop("__source"), "open")
    out, whole = [], []
    for _ in range(rounds):
        placed = running(open_, ["place"], "chunk", ["order", "id", "size"], "words", "start")
        placed = written(placed.withColumn("in", F.col("start") + F.col("words") <= F.col("left")), "placed")
        out.append(placed.where("in"))
        whole.append(placed)
        taken = placed.groupBy("place").agg(F.coalesce(F.sum(F.when(F.col("in"), F.col("words"))), F.lit(0)).alias("taken"))
        rest = placed.where("not in").drop("start", "in").join(taken, "place").withColumn("left", F.col("left") - F.col("taken")).drop("taken")
        open_ = rest.where(F.col("words") <= F.col("left"))
    times = whole[0].select("id", "order", "source", "whole")
    more = out[0].select("id", "order", "source")
    for o in out[1:]:
        more = more.union(o.select("id", "order", "source"))
    names = {"id": "__id", "order": "__order", "source": "__source"}
    more = more.withColumn("more", F.lit(1)).withColumnsRenamed({k: f"__more{v}" for k, v in names.items()})
    times = times.withColumnsRenamed(names)
    same: Column = F.lit(True)
    for v in names.values():
        same = same & times[v].eqNullSafe(more[f"__more{v}"])
    times = written(times.join(more, same, "left").select(*names.values(), (F.col("whole") + F.coalesce("more", F.lit(0))).alias("__times")), "times")
    text = whole_text(text_col)
    keyed = docs.withColumn("__key", F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)))
    same = keyed[id_col].eqNullSafe(times["__id"]) & (keyed["__key"] == times["__order"]) & keyed[source_col].cast("string").eqNullSafe(times["__source"])
    copies = F.coalesce(F.col("__times"), F.lit(1))
    found = keyed.join(times, same, "left").where(copies > 0)
    return found.select(*[keyed[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).drop("__copy")
