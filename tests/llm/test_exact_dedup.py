import hashlib
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from prismetric.llm import exact_dedup as e

from . import cases


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, _ in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = e.exact_dedup(cases.documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len({r.text_sha256 for r in got}) == len(kept)


def test_brute_force(spark):
    check(spark, cases.sample())


def test_odd_rows(spark):
    check(spark, cases.odd_rows())


def test_empty(spark):
    assert e.exact_dedup(cases.empty(spark)).count() == 0 and e.keep_distinct(cases.empty(spark)).count() == 0


def test_large_group(spark):
    check(spark, [(i, "same", "a") for i in range(500)] + [(i, f"t{i}", "a") for i in range(100)])


def test_keep_distinct(spark):
    rows = cases.odd_rows() + cases.sample(60)
    docs = cases.documents(spark, rows)
    got = e.keep_distinct(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text or "") for r in got.collect()]
    assert len(kept) == len({t for _, t in kept}) == len({t or "" for _, t, _ in rows})
    best = {t: k for _, k, _, t in [(i, k, n, s) for i, k, n, s in brute(rows)]}
    assert all(best[hashlib.sha256(t.encode()).hexdigest()] == i for i, t in kept)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 200)), max_size=600))
def test_index_against_a_dict(steps):
    index, held = e.CuckooIndex(8), {}
    for add, n in steps:
        digest = hashlib.sha256(str(n).encode()).digest()
        if add and index.find(digest) is None:
            index.insert(digest, [n])
            held[digest] = [n]
        elif not add:
            assert index.delete(digest) == held.pop(digest, None)
        assert len(index) == len(held)
    assert dict(index.items()) == held
    assert all(index.find(d) == r for d, r in held.items())


def test_overflow_resizes():
    index = e.CuckooIndex(8)
    digests = [hashlib.sha256(str(n).encode()).digest() for n in range(5000)]
    for d in digests:
        index.insert(d, [1])
    assert index.resizes > 3 and all(index.find(d) for d in digests)
    for d in digests[:2500]:
        index.delete(d)
    assert sum(index.find(d) is not None for d in digests) == 2500


def test_merge_evicts(spark):
    rows = [{"digest": hashlib.sha256(str(n % 50).encode()).digest(), "n": 1, "keep_id": n, "keep_row": n, "at_keep": 1} for n in range(300)]
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("at_keep", pa.int64())])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 40], schema) for i in range(0, 300, 40)]
    once = [r for b in e._merge(20)(iter(batches)) for r in b.to_pylist()]
    assert len(once) > 50 and sum(r["n"] for r in once) == 300
    again = [r for b in e._merge(0)(iter([pa.RecordBatch.from_pylist(once, schema)])) for r in b.to_pylist()]
    assert len(again) == 50 and all(r["n"] == 6 and r["keep_id"] >= 250 for r in again)
