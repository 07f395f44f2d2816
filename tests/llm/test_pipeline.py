import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline as pipeline
from prismetric.llm import simhash, toxicity

from .test_other_operators import check_packing
from .test_simhash import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, the documents first."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t.parquet")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(stages[0], labels).collect() if r.predicted}
    assert sorted(pairs(stages[1])) == sorted(p for p in pairs(stages[0]) if p[0] not in rejected)


def test_copies_go(stages):
    best = {}
    for i, t in pairs(stages[1]):
        best[t] = max(best.get(t, -1), i)
    assert sorted(pairs(stages[2])) == sorted((i, t) for t, i in best.items())


def test_near_copies_go(stages):
    before, kept = dict(pairs(stages[2])), dict(pairs(stages[3]))
    sets = {i: shingles(t) for i, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert set(kept.items()) <= set(before.items())
    for i in set(before) - set(kept):  # each that went is like another one
        assert max(alike(i, j) for j in before if j != i) >= 0.7
    found = [(a, b) for a in kept for b in kept if a < b and alike(a, b) >= 0.85]
    assert not found


def test_sources_are_mixed(stages):
    before = Counter(pairs(stages[3]))
    after = Counter(pairs(stages[4]))
    assert set(after) <= set(before) and all(n <= 3 for n in after.values())
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) * n for (_, t), n in rows.items())
    assert abs(words(after) - words(before)) < 0.1 * words(before)


def test_packed(stages):
    rows = [(i, t, None) for i, t in pairs(stages[4])]
    padding, total = check_packing(rows, stages[5].collect())
    assert padding <= 0.02 * total


def test_run(spark, stages):
    assert pipeline.ORACLE_SQL is None and __spark_entry__.queries()["pipeline"].__wrapped__ is pipeline.run
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pipeline.run(spark, SF).collect())
    assert sum(got.values()) == stages[5].count() and sum(r[2] * n for r, n in got.items()) == stages[5].groupBy().sum("length").first()[0]


def test_search_is_sized_by_the_rows():
    small, large = simhash.search_for(1000, 0.8), simhash.search_for(10**9, 0.8)
    assert small.length < large.length and small.segments < large.segments
    assert 1 - (1 - ((1 - 0.1516) ** large.length + large.length * 0.1516 * (1 - 0.1516) ** (large.length - 1))) ** large.segments >= 0.9
