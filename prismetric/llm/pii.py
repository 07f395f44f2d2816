"""Personal data: patterns, and terms that reveal an entity they stand in a text with; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import whole_text, written

KINDS = ["email", "ip", "card", "phone"]
# Each finds what its plain form (in the comment) finds, from left to right: a start is tried only where a run
# begins or the last match ended, and runs are never given back, so that no text takes more than linear time.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ where it holds 13 digits or more
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SIGNS = {"email": "@", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
LETTERS, OTHERS = r"\p{L}+", r"[^\p{L}]+"


def holds(kind: str, match: Column) -> Column:
    """Whether a match counts: parts up to 255; 13 to 19 digits that pass Luhn's test; 9 to 15 digits."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_like(match, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, texts), written. rows: (id, text_hash, some) for each row of ``docs``; texts: (text_hash, text, found), once
    for each text with some match: found has for each match of a kind, valid or not, in order: kind, place among them,
    characters since the last one, and the match."""
    text = whole_text(text_col)

    def of(kind: str, pattern: str) -> Column:
        hits = between(text, pattern)
        one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x["since"].alias("since"), x["match"].alias("match"))
        there = F.regexp_like(text, F.lit(pattern))
        return F.when(F.contains(text, F.lit(SIGNS[kind])) & there if kind in SIGNS else there, F.transform(hits, one))

    found = [of(*pair) for pair in PATTERNS.items()]
    empty = F.array().cast("array<struct<kind:string,place:int,since:bigint,match:string>>")
    all_found = F.concat(*[F.coalesce(f, empty) for f in found])
    every = docs.select(F.col(id_col).alias("id"), hash_of(text).alias("text_hash"), text.alias("text"), all_found.alias("found"))
    some = F.size("found") > 0
    every = written(every.select("id", "text_hash", some.alias("some"), F.when(some, F.col("text")).alias("text"), F.when(some, F.col("found")).alias("found")), "matches")
    texts = every.where("some").groupBy("text_hash").agg(F.first("text").alias("text"), F.first("found").alias("found"))
    return every.select("id", "text_hash", "some"), written(texts, "texts")


def between(text: Column, pattern: str) -> Column:
    """(match, since) for each match of a pattern, in order; since are the characters from the one before. The parts are
    zipped, not looked up: what a function of an element looks up is made anew for every element."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda part: F.length(part).cast("long"))
    zipped = F.arrays_zip(hits.alias("match"), gaps.alias("since"))
    return F.filter(zipped, lambda x: x["match"].isNotNull())


def hash_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def located(texts: DataFrame) -> DataFrame:
    """(text_hash, kind, start, end, match) of the matches that count; code points, end exclusive."""
    each = texts.select("text_hash", F.explode("found").alias("m")).select("text_hash", "m.*")
    so_far = Window.partitionBy("text_hash", "kind").orderBy("place")
    end = F.sum(F.col("since") + F.length("match")).over(so_far)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    valid = F.lit(False)
    for kind in KINDS:
        valid = valid | ((F.col("kind") == kind) & holds(kind, F.col("match")))
    return each.where(valid).select("text_hash", "kind", "start", "end", "match")


def terms_of(text: Column) -> Column:
    """The distinct words (3 to 40 letters, in lower case) of a text outside its addresses."""
    words = F.transform(F.split(F.regexp_replace(text, PATTERNS["email"], " "), OTHERS), F.lower)
    return F.array_distinct(F.filter(words, lambda w: F.length(w).between(3, 40)))


def entities_of(spans: DataFrame) -> DataFrame:
    """(entity, text_hash), each once: what the spans hold, and the hosts of their addresses, which many texts share."""
    own = F.xxhash64("kind", F.lower("match"))
    host = F.when(F.col("kind") == "email", F.xxhash64(F.lit("host"), F.lower(F.substring_index("match", "@", -1))))
    each = spans.select(F.explode(F.array(own, host)).alias("entity"), "text_hash")
    return each.where("entity is not null").distinct()


def telling(docs: DataFrame, rows: DataFrame, holds: DataFrame, texts: DataFrame, text_col: str, support: int, share: float, bound: int) -> DataFrame:
    """(entity, term, share): terms whose pointwise mutual information with an entity is at least ``share`` of the
    entity's own information, over distinct texts. ``holds(entity, n_entity, text_hash)`` and ``texts(text_hash,
    terms)`` have the entities and the words of whole texts. A pair counts from ``support`` texts on; each term's
    frequency is taken over all texts. Terms and copied texts are broadcast where there are at most ``bound`` of them."""
    n = rows.select("text_hash").distinct().count()
    own = F.log2(F.lit(n) / F.col("n_entity"))
    mutual = lambda n_term: F.log2(F.col("both") * F.lit(n) / (F.col(n_term) * F.col("n_entity")))
    with_terms = holds.where(own > 0).join(texts.select("text_hash", "terms"), "text_hash")
    with_terms = with_terms.select("entity", "n_entity", F.explode("terms").alias("term"))
    pairs = with_terms.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    # a term is in at least as many texts as it is in beside some entity: what can't reach the share by that goes at once
    around = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_around"))
    pairs = pairs.join(around, "term").where(mutual("n_around") / own >= share)
    pairs = written(pairs.select("entity", "term", "both", "n_entity"), "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("share"))

    copied = rows.groupBy(F.col("text_hash").alias("of")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copied = written(copied, "copied")
    copied = F.broadcast(copied) if copied.count() <= bound else copied
    # of a text with c copies each word is met c times: rows are counted by word and c in each task first, and divided,
    # so that no pair of word and text is ever moved
    words = F.array_distinct(F.transform(F.split(whole_text(text_col), OTHERS), F.lower))
    met = docs.select(hash_of(whole_text(text_col)).alias("text_hash"), words.alias("words"))
    met = met.join(copied, F.col("text_hash") == F.col("of"), "left")
    met = met.select(F.coalesce("copies", F.lit(1)).alias("c"), F.explode("words").alias("term"))
    terms = written(pairs.select("term").distinct(), "terms")
    if terms.count() <= bound:
        met = met.join(F.broadcast(terms), "term", "left_semi")
    met = met.groupBy("term", "c").agg(F.count(F.lit(1)).alias("times"))
    of_term = met.groupBy("term").agg(F.sum(F.floor(F.col("times") / F.col("c"))).alias("n_term"))
    found = pairs.join(of_term, "term").withColumn("share", mutual("n_term") / own)
    return written(found.where(F.col("share") >= share).select("entity", "term", "share"), "telling")


#: Words (40 letters at most) or texts' hashes that are broadcast: some 30 MB at the very most.
BOUND = 200_000


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 2, share: float = 0.8, bound: int = BOUND) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans): see ``matches`` for the first two. spans: (text_hash, kind, start, end) of whole texts, in
    code points, end exclusive; the kinds are those of ``KINDS`` and "term". Equal texts are looked at once.

    Base kinds: the leftmost matches that don't overlap, per kind, less those that fail their test. A term is a
    word (3 to 40 letters, outside addresses) that reveals an entity of its text, wherever it stands there: see
    ``telling``. Entities are the matches and the hosts of addresses, from ``support`` distinct texts on.
    """
    rows, texts = matches(docs, id_col, text_col)
    spans = written(located(texts), "spans")
    held = written(entities_of(spans), "entities")
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    held = written(held.join(often, "entity").select("entity", "n_entity", "text_hash"), "holds")
    worded = texts.join(held.select("text_hash").distinct(), "text_hash", "left_semi")
    worded = written(worded.select("text_hash", terms_of(F.col("text")).alias("terms")), "terms")
    known = telling(docs, rows, held, worded, text_col, support, share, bound)

    # the words of a text that tell, not all words that tell one of its entities somewhere
    there = held.join(worded, "text_hash").select("entity", "text_hash", F.explode("terms").alias("term"))
    told = written(there.join(known, ["entity", "term"]).select("text_hash", "term").distinct(), "told")
    each = texts.join(told.select("text_hash").distinct(), "text_hash", "left_semi")
    each = each.select("text_hash", F.posexplode(between(F.col("text"), LETTERS)).alias("place", "w"))
    each = each.select("text_hash", "place", "w.since", F.col("w.match").alias("word"))
    end = F.sum(F.col("since") + F.length("word")).over(Window.partitionBy("text_hash").orderBy("place"))
    each = each.select("text_hash", F.lower("word").alias("term"), (end - F.length("word")).alias("start"), end.alias("end"))
    each = each.join(told, ["text_hash", "term"])
    inside = spans.where("kind = 'email'").select(F.col("text_hash").alias("of"), F.col("start").alias("from"), F.col("end").alias("to"))
    covered = (F.col("text_hash") == F.col("of")) & (F.col("start") >= F.col("from")) & (F.col("end") <= F.col("to"))
    terms = each.join(inside, covered, "left_anti").select("text_hash", F.lit("term").alias("kind"), "start", "end")
    return rows, texts, written(spans.select("text_hash", "kind", "start", "end").unionByName(terms), "all-spans")


#: Characters of a text that are cut out together, so that a span costs the same wherever it stands.
CHUNK = 2048


def sanitised(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(text_hash, sanitised) for the texts that have spans: the text with each span generalised to its kind in
    brackets. Spans that overlap become one, named after the first."""
    so_far = Window.partitionBy("text_hash").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cuts = spans.withColumn("from", F.coalesce(F.max("end").over(so_far), F.lit(0)))
    open_ = F.when(F.col("start") >= F.col("from"), F.struct("start", "from", F.upper("kind").alias("kind")))
    cuts = cuts.groupBy("text_hash").agg(F.sort_array(F.collect_list(open_)).alias("cuts"), F.max("end").alias("last"))
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    cuts = texts.join(cuts, "text_hash").select("text_hash", "cuts", "last", F.length("text").cast("long").alias("length"), chunks.alias("chunks"))

    def part(begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        chunk = lambda i: F.coalesce(F.get("chunks", i), F.lit(""))
        into = lambda at: (at % CHUNK).cast("int")
        within = F.substring(chunk(first), into(begin) + 1, (end - begin).cast("int"))
        between = F.array_join(F.slice("chunks", first + 2, last - first - 1), "")
        over = F.concat(F.substring(chunk(first), into(begin) + 1, F.lit(CHUNK)), between, F.substring(chunk(last), F.lit(1), into(end)))
        return F.when(first == last, within).otherwise(over)

    parts = F.transform("cuts", lambda x: F.concat(part(x["from"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
    return cuts.select("text_hash", F.concat(F.array_join(parts, ""), part(F.col("last"), F.col("length"))).alias("sanitised"))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: (id, n_email, n_ip, n_card, n_phone, base, spans, sanitised).

    spans joins kind:start:end of all spans by kind in the order of ``KINDS``, then "term", then by start, with
    commas; base is the same without terms. sanitised is the text with its spans generalised (see ``sanitised``), null
    where there is nothing to hide. A null or empty text has none. Repeated rows count each, but once as texts in the
    statistics; other columns are not looked at; an empty table gives an empty result. Terms are words of 3 to 40
    letters of whole texts; ``how`` goes to ``find_pii``.
    """
    rows, texts, spans = find_pii(docs, id_col, text_col, **how)
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, "term"])), F.col("kind"))
    line = F.concat_ws(":", "kind", "start", "end")
    found = F.struct(rank.alias("rank"), "start", "end", line.alias("line"), "kind")
    held = spans.groupBy("text_hash").agg(F.sort_array(F.collect_list(found)).alias("s"))
    base = F.filter("s", lambda x: x["kind"] != "term")
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["line"]), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    held = held.select("text_hash", *map(count, KINDS), joined(base).alias("base"), joined(F.col("s")).alias("spans"))
    held = written(held.join(sanitised(texts, spans), "text_hash").withColumnRenamed("text_hash", "of"), "held")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    lists = [F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")]
    out = rows.join(held, F.when(F.col("some"), F.col("text_hash")) == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), *counts, *lists, "sanitised")
