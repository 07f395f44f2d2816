import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from prismetric.llm import toxicity as t

from . import cases

BAD = ["vile", "scumbag", "worthless"]


def tables(spark, n=900):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), "a"))
        labels.append((i, 1, int(toxic)))
    return rows, labels, cases.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    _, labels, docs, table = tables(spark)
    got = {r.doc_id: r for r in t.toxicity(docs, table).collect()}
    truth = {i: y for i, _, y in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_are_never_read(spark):
    _, labels, docs, table = tables(spark, 300)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    other = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    scores = lambda x: sorted((r.doc_id, r.score) for r in t.toxicity(docs, x).collect())
    assert scores(table) == scores(other)


def test_ids_and_sources_are_no_inputs(spark):
    rows, _, docs, table = tables(spark, 300)
    again = cases.documents(spark, [(i, x, "z") for i, x, _ in rows]).withColumn("n_chars", F.lit(9)).withColumn("lang", F.lit("xx"))
    scores = lambda d: sorted((r.doc_id, r.score) for r in t.toxicity(d, table).collect())
    assert scores(docs) == scores(again)


def test_odd_rows(spark):
    _, _, _, table = tables(spark, 300)
    docs = cases.documents(spark, cases.odd_rows() + tables(spark, 300)[0][20:])
    got = t.toxicity(docs, table).collect()
    assert len(got) == docs.count()
    odd = [r for r in got if r.doc_id in (None, 1, 2)]
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_repeated_ids_are_learnt_from_once(spark):
    """However often an id stands in the table, one text of it goes to the task that learns: the least."""
    rows, _, docs, table = tables(spark, 300)
    more = cases.documents(spark, [r for r in rows[:20] for _ in range(50)] + [(i, "zzz " + x, "a") for i, x, _ in rows[:20]])
    scores = lambda d: {r.doc_id: r.score for r in t.toxicity(d, table).where("score is not null").collect() if r.doc_id >= 20}
    assert scores(docs) == scores(docs.unionByName(more))


def test_no_labels(spark):
    docs = cases.documents(spark, cases.odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = t.toxicity(docs, none).collect()
    assert {r.score for r in got} == {0.0} and len(got) == len(cases.odd_rows())
    assert t.drop_toxic(docs, none).count() == len(cases.odd_rows())
    assert t.toxicity(cases.empty(spark), none).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in t.toxicity(docs, nulls).collect()} == {0.0}


def test_drop(spark):
    _, labels, docs, table = tables(spark)
    kept = t.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    scored = {r.doc_id for r in t.toxicity(docs, table).collect() if not r.predicted}
    assert ids == scored


def test_features_see_words_pairs_and_skips():
    f = t.Features(20)
    assert len(f("a")) == 1 and len(f("a b")) == 3 and len(f("a b c")) == 6 and len(f("")) == 0
    assert set(f("Bad word")) == set(f("bad  WORD!")) and set(f("a b")) != set(f("b a"))


def test_l1_keeps_few_weights():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.r_[rng.integers(10, 1 << 10, 20), [5] if y else []]).astype(np.int32), y) for y in rng.integers(0, 2, 500).tolist()]
    places, weights, _ = t.fit(rows, t.Training(bits=10))
    assert 5 in places and len(places) < 200 and weights[list(places).index(5)] == max(weights)
