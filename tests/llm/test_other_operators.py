import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismetric.llm import cutting_stock, licences, mixing, packing, pii, queries, repeats, token_counts
from prismetric.llm import embedding_dedup as emb

from . import cases

BPE = queries.tokenizer("byte_bpe_50k.json")
RANKS = queries.tokenizer("byte_bpe_50k.tiktoken")
ROWS = {"sample": cases.sample(), "odd": cases.odd_rows()}


@pytest.fixture(params=list(ROWS))
def rows(request):
    return ROWS[request.param]


# -- token counts -------------------------------------------------------------------------------------------------


def best(scores, token):
    longest = max(map(len, scores))
    found = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        found.append(max((found[s][0] + scores[token[s:end]], found[s][1] - 1) for s in range(max(0, end - longest), end) if token[s:end] in scores))
    return -found[-1][1]


def test_token_counts(spark, rows):
    scores = token_counts.read_scores(RANKS)
    got = [tuple(r) for r in token_counts.token_counts(cases.documents(spark, rows), RANKS).collect()]
    want = []
    for i, t, _ in rows:
        if t and len(t) > 4000:
            continue
        tokens = token_counts.PRETOKEN.findall(t or "")
        want.append((i, len(tokens), sum(best(scores, x.encode()) for x in tokens)))
    assert not Counter(want) - Counter(got) and len(got) == len(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sl 1\n\té漢🙂. "), max_size=40), max_size=5))
def test_parts_are_whole_pretokens(texts):
    scores = token_counts.read_scores(RANKS)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    (out,) = token_counts.counter(RANKS)(iter([batch]))
    for t, pre, n in zip(texts, out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
        tokens = token_counts.PRETOKEN.findall(t)
        assert (pre, n) == (len(tokens), sum(best(scores, x.encode()) for x in tokens))


def test_trie_shares_prefixes():
    trie = token_counts.Trie({bytes([b]): -9.0 for b in range(256)} | {b"ab": -1.0, b"abc": -1.5})
    assert (trie.count(b"abc"), trie.count(b"abd"), len(trie.best)) == (1, 2, 5)
    assert trie.count_alone(b"ab" * 100) == 100 and len(trie.best) == 5


# -- packing ------------------------------------------------------------------------------------------------------


def check_packing(rows, pieces, capacity=2048):
    tokenizer = Tokenizer.from_file(BPE)
    docs = Counter()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        docs[i, ids.tobytes()] += 1
    left = defaultdict(list)
    for p in pieces:
        left[p.doc_id, p.doc_tokens].append(p)
    for (i, data), times in docs.items():
        n = len(data) // 4
        for _ in range(times):
            at = 0
            while at < n:  # a piece of this text that begins here
                p = next(p for p in left[i, n] if p.start == at and p.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + p.length)]))
                left[i, n].remove(p)
                at += p.length
            assert at == n
    assert not any(left.values())
    padding = total = 0
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, total


def test_packing(spark, rows):
    pieces = packing.pack(cases.documents(spark, rows), BPE).collect()
    check_packing(rows, pieces)


def test_packing_pads_little(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["one", "three", "seven", "words"]) for _ in range(rng.randint(1, 1500))), "a") for i in range(400)]
    padding, total = check_packing(rows, packing.pack(cases.documents(spark, rows), BPE).collect())
    assert padding <= 0.01 * total


def test_packing_empty(spark):
    assert packing.pack(cases.empty(spark), BPE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("ab <|endoftext|> \x85\x1c "), max_size=60))
def test_both_tokenizers_agree(text):
    if not hasattr(test_both_tokenizers_agree, "made"):
        test_both_tokenizers_agree.made = packing.Tokens(BPE), Tokenizer.from_file(BPE)
    own, other = test_both_tokenizers_agree.made
    assert own(text).tolist() == [*other.encode(text, add_special_tokens=False).ids, 1]


LONG_SPACES = [f"a{gap}b" for gap in (" " * 2_000_000, "\n" * 2_000_000, "\t" * 1_000_000, " \n\t\r\x0b" * 150_000, "\u3000 " * 300_000)] + ["a" + "\n" * 399 + " b"]


def test_packing_long_spaces(spark):
    rows = [(i, text, "a") for i, text in enumerate([LONG_SPACES[0], *LONG_SPACES[3:]])]
    check_packing(rows, packing.pack(cases.documents(spark, rows), BPE).collect())


def test_long_words_and_special_strings():
    own, other = packing.Tokens(BPE), Tokenizer.from_file(BPE)
    for text in ("a<|endoftext|>b", "x" * 20000, "é" * 3000 + " end", *LONG_SPACES):
        assert own(text).tolist() == [*other.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("draw", ["uniform", "short", "one", "half"])
def test_cutting_stock(draw):
    rng = np.random.default_rng(1)
    lengths = {"uniform": rng.integers(1, 2048, 3000), "short": rng.integers(1, 60, 3000), "one": np.full(500, 700), "half": np.r_[np.full(300, 1025), np.full(300, 1000)]}[draw]
    counts = Counter(lengths.tolist())
    of = cutting_stock.classes(counts, 2048)
    demand = Counter()
    for x, n in counts.items():
        assert of[x] >= x
        demand[of[x]] += n
    patterns = cutting_stock.plan(demand, 2048)
    assert all(sum(w * a for w, a in p.items()) <= 2048 for p, _ in patterns)
    placed = Counter()
    for p, x in patterns:
        placed.update({w: a * x for w, a in p.items()})
    assert placed == demand
    bound = max(sum(w * n for w, n in demand.items()) / 2048, (lengths > 1024).sum())
    assert sum(x for _, x in patterns) <= 1.03 * bound + 3 or draw == "one" and sum(x for _, x in patterns) == 250
    assert cutting_stock.plan({}, 2048) == []


@pytest.mark.parametrize("words", [1100, 700, 2047])
def test_equal_lengths_are_cut(spark, words):
    rows = [(i, "one" + " two" * (words - 2), "a") for i in range(300)]
    padding, total = check_packing(rows, packing.pack(cases.documents(spark, rows), BPE).collect())
    assert padding <= 0.01 * total


def test_knapsack():
    rng = np.random.default_rng(2)
    for _ in range(20):
        weights, values = np.unique(rng.integers(1, 30, 5)), rng.random(5)
        values = values[: len(weights)]
        best_value, pattern = cutting_stock.knapsack(weights, values, 60)
        table = [0.0] * 61
        for c in range(1, 61):
            table[c] = max([table[c - 1], *(table[c - w] + v for w, v in zip(weights.tolist(), values.tolist(), strict=True) if w <= c)])
        assert abs(best_value - table[60]) < 1e-9 and weights @ pattern <= 60 and abs(values @ pattern - best_value) < 1e-9


# -- personal data ------------------------------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def counts_as(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    return kind == "email" or (13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FORMS.items() for m in re.finditer(p, text or "") if counts_as(k, m[0])]


def check_pii(spark, rows):
    got = queries.pii_digests(pii.pii(cases.documents(spark, rows))).collect()
    want = Counter()
    for i, t, _ in rows:
        spans = base(t)
        want[i, *(sum(s.startswith(k) for s in spans) for k in FORMS), hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)] += 1
    plain = lambda s: ",".join(x for x in s.split(",") if x and not x.startswith("term"))
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, plain(r.spans)) for r in got) == want


def test_pii_odd(spark, rows):
    check_pii(spark, rows)
    assert pii.pii(cases.empty(spark)).count() == 0


def test_pii_random(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "x.y@z-w.example.com", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "++12 34567890", " ", "-", "7", "é", "🙂", "_", "c@d", "+44.20.7946.0958.", "12 3 4", "a@b.c_x@e.f", "5555555555554444 1"]
    check_pii(spark, [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "a") for i in range(400)])


def test_pii_long_runs(spark):
    check_pii(spark, [(1, "a" * 60000, "a"), (2, "1" * 60000, "a"), (3, "1 " * 30000, "a"), (4, "a." * 30000 + "@b", "a"), (5, "+1" + "2" * 50000, "a"), (6, "1.2.3.4 " * 3000, "a")])


def telling_by_hand(rows, support=2, share=0.8):
    """The term spans of each text, by counting over all pairs of entity and word."""
    texts = {t or "" for _, t, _ in rows}
    words, ents = {}, {}
    for t in texts:
        outside = re.sub(FORMS["email"], " ", t)
        words[t] = {w.lower() for w in re.findall(r"[^\W\d_]+", outside) if 3 <= len(w) <= 40}
        ents[t] = {(k, m[0].lower()) for k, p in FORMS.items() for m in re.finditer(p, t) if counts_as(k, m[0])}
        ents[t] |= {("host", x.split("@")[-1]) for k, x in ents[t] if k == "email"}
    every = {t: {w.lower() for w in re.findall(r"[^\W\d_]+", t)} for t in texts}
    n_word = Counter(w for t in texts for w in every[t])
    n_ent = Counter(e for t in texts for e in ents[t])
    both = Counter((e, w) for t in texts for e in ents[t] for w in words[t])
    n = len(texts)
    told = {p for p, k in both.items() if k >= support and n_ent[p[0]] < n and np.log2(k * n / (n_word[p[1]] * n_ent[p[0]])) / np.log2(n / n_ent[p[0]]) >= share}
    out = {}
    for t in texts:
        hidden = [m.span() for m in re.finditer(FORMS["email"], t)]
        out[t] = [m.span() for m in re.finditer(r"[^\W\d_]+", t) if any((e, m[0].lower()) in told for e in ents[t]) and not any(a <= m.start() and m.end() <= b for a, b in hidden)]
    return out


def check_terms(spark, rows):
    got = Counter((r.doc_id, tuple(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term"))) for r in pii.pii(cases.documents(spark, rows)).collect())
    want = telling_by_hand(rows)
    assert got == Counter((i, tuple(want[t or ""])) for i, t, _ in rows)
    return sum(map(len, want.values()))


def test_terms_by_brute_force(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    firms = [("Zanzibarov", "zb.example.com"), ("Quorkel", "quorkel.example.org"), ("Über", "ueber.example.net")]
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            name, host = rng.choice(firms)
            text = f"{name} says {text}, see {rng.choice('ab')}{i % 7}@{host} or {rng.choice(['1.2.3.4', '10.0.0.7', '+1 (555) 123-4567'])} for {name if rng.random() < 0.5 else 'it'}"
        rows.append((i, text, "a"))
    assert check_terms(spark, rows) > 20
    # copies change nothing
    copies = [(1000 + i, rows[i % 5][1], "a") for i in range(300)] + [(None, rows[7][1], "b")] * 40
    check_terms(spark, rows + copies)
    assert telling_by_hand(rows) == telling_by_hand(rows + copies)


def test_terms_of_odd_rows(spark, rows):
    check_terms(spark, rows)


def test_sanitised(spark):
    texts = ["é mail a@b.c or 1.2.3.4!", "x 4111 1111 1111 1111 x", None, "nothing", "to a@1.2.3.4!"]
    got = {r.doc_id: r for r in pii.pii(cases.documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got[0].sanitised == "é mail [EMAIL] or [IP]!" and got[2].sanitised is None and got[3].sanitised is None
    assert got[1].spans == "card:2:21" and got[1].sanitised == "x [CARD] x"
    assert got[4].spans == "email:3:12,ip:5:12" and got[4].sanitised == "to [EMAIL]!"


def test_sanitised_over_chunks(spark, monkeypatch):
    """Spans at all places of chunks that are shorter than what lies between them."""
    monkeypatch.setattr(pii, "CHUNK", 7)
    rng = random.Random(13)
    texts = ["".join(rng.choice(["a@b.cd", "1.2.3.4", " é🙂 ", "words and ", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    for r in pii.pii(cases.documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect():
        text, at, out = texts[r.doc_id], 0, ""
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in r.spans.split(",") if s))
        for a, b, k in spans:
            if a >= at:
                out += f"{text[at:a]}[{k.upper()}]"
            at = max(at, b)
        assert r.sanitised == (out + text[at:] if spans else None)


def test_terms_are_found_on_the_tables(spark):
    found = pii.pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert found.where("spans like '%term%'").count() > 0


# -- mixing -------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, full, rest = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] = rest * weight[s] / total
        over = [s for s in open_ if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        for s in over:
            full.add(s)
            target[s] = 3.0 * sizes[s]
            rest -= target[s]


#: Blocks that a source's slots may be away from its target: what the multiples of the golden ratio leave.
NEAR = 6


def test_mixing(spark, rows):
    docs = cases.documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = plain_targets(sizes)
    by_size = {sizes[s]: (s, target[s]) for s in sizes}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if len(by_size) == len(sizes):
            assert abs(r.target - by_size[r.source_size][1]) < 1e-6
            taken[by_size[r.source_size][0]] += r.taken
    if len(by_size) == len(sizes):
        assert all(abs(taken[s] - target[s]) <= NEAR for s in sizes)
    assert len(got) == len(rows)


@pytest.mark.parametrize("slots", [1, 7, 64, 1 << 20])
def test_any_block_size_fills_the_target(spark, slots):
    got = mixing.mix(cases.documents(spark, ROWS["sample"]), slots=slots).collect()
    sums, target = Counter(), {}
    for r in got:
        sums[r.source_size] += r.taken
        target[r.source_size] = r.target
    block = -(-sum(round(t) for t in target.values()) // slots)
    assert all(abs(sums[s] - target[s]) <= NEAR * block for s in target)


def test_the_schedule_decides(spark):
    """Each slot once, blocks of equal size in the order of each source, and another step gives another mix."""
    docs = cases.documents(spark, ROWS["sample"])
    rows = mixing.sized(docs, "doc_id", "text", "source")
    aims, n, block = mixing.aimed(rows, (5, 2, 1), 3, 500)
    slots = mixing.schedule(aims, n)
    placed, cut = mixing.pieces(rows, aims, slots, block)
    found = cut.join(placed, "row").select("slot", "place", "row", "start", "from", "words").collect()
    place = {a.place: a for a in aims.collect()}
    for r in slots.collect():
        point = r.slot * mixing.GOLDEN % mixing.CIRCLE
        assert place[r.place]["from"] <= point < place[r.place]["to"]
    words = Counter()
    for r in found:
        words[r.slot] += r.words
    assert set(words.values()) == {block} or sorted(words.values())[len(place)] == block  # the last of a bounded source may be short
    # along the schedule each source has its share at any time
    order = sorted(slots.collect(), key=lambda r: r.slot)
    seen = Counter()
    for i, r in enumerate(order, 1):
        seen[r.place] += 1
        assert all(abs(seen[k] - i * (a.to - a["from"]) / mixing.CIRCLE) <= NEAR for k, a in place.items())
    one, other = (sorted(map(str, mixing.mix(docs, slots=500, golden=g).collect())) for g in (mixing.GOLDEN, 1))
    assert one != other and {r.split(", n_slots")[0] for r in map(str, one)} != {r.split(", n_slots")[0] for r in map(str, other)}

def test_mixing_empty(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.repeat_to_mix(cases.empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(cases.documents(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_repeat(spark, rows):
    docs = cases.documents(spark, rows)
    out = mixing.repeat_to_mix(docs)
    assert out.columns == docs.columns
    assert all(n <= 3 * Counter((i, t) for i, t, _ in rows)[k] for k, n in Counter((r.doc_id, r.text) for r in out.collect()).items())


def test_whole_documents_come_near_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["word"] * int(rng.paretovariate(1.0) * 20 % 4000)), rng.choice("abcdef")) for i in range(3000)]
    out = Counter()
    for r in mixing.repeat_to_mix(cases.documents(spark, rows)).select("source", "text").collect():
        out[r.source] += len(r.text.split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = plain_targets(sizes)
    assert all(abs(out[s] - target[s]) <= 0.01 * target[s] for s in target)


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 8)
    rows = [(None, "one two three", None)] * 100 + [(1, "four five", None), (2, "a b c d", "s")] * 3
    got = mixing.mix(cases.documents(spark, rows)).collect()
    assert len(got) == 106 and all(r.taken <= 3 * r.size for r in got) and abs(sum(r.taken for r in got) - sum(r.size for r in got)) <= 2 * NEAR


def test_mixing_is_native(spark):
    plan = mixing.mix(cases.documents(spark, ROWS["odd"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- repeats ------------------------------------------------------------------------------------------------------


def without_repeats(rows, window=100):
    docs = sorted({((-(2**63) if i is None else i), (t or "").encode()) for i, t, _ in rows}, key=lambda d: d[0])
    seen, out = set(), {}
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        edges = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out[i, b] = (len(b), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def check_repeats(spark, rows, **how):
    got = Counter(tuple(r) for r in repeats.drop_repeats(cases.documents(spark, rows), **how).collect())
    want = without_repeats(rows)
    assert got == Counter((i, *want[(-(2**63) if i is None else i), (t or "").encode()]) for i, t, _ in rows)


@pytest.mark.parametrize("group", [10, 1 << 20])
def test_repeats(spark, group):
    check_repeats(spark, ROWS["sample"], group=group)


def test_repeats_odd(spark):
    check_repeats(spark, [*ROWS["odd"], (20, "ab" * 300, "a"), (21, "é" * 200, "b"), (22, cases.LONG[:3000], "c")])
    assert repeats.drop_repeats(cases.empty(spark)).count() == 0


def test_repeats_in_long_texts(spark):
    """Long texts that repeat themselves, whole, in part, and with small changes."""
    rng = random.Random(7)
    line = "".join(rng.choice("abcdef ") for _ in range(700))
    prose = "".join(rng.choice("abcdefghij ") for _ in range(60_000))
    rows = [(1, line * 100, "a"), (2, "x" + line * 90, "a"), (3, prose, "a"), (4, prose[:20_000] + "!" + prose[20_000:], "a"), (5, prose[30_000:] + line + prose[:30_000], "b"), (6, "\0" * 3000, "b"), (7, "\0" * 2999 + "é" * 500, "b")]
    check_repeats(spark, rows)
    check_repeats(spark, rows, group=500)


@pytest.mark.parametrize("depth", [8, 13, 64, 100])
def test_suffix_runs(depth):
    rng = np.random.default_rng(depth)
    data = rng.integers(0, 2, 900).astype(np.uint8)
    data[300:600] = data[:300]
    places = np.arange(len(data) - depth + 1)
    order, run = repeats.suffix_runs(data, places, depth)
    text = data.tobytes()
    by_hand = sorted(range(len(places)), key=lambda i: (text[i : i + depth], i))
    times = Counter(text[i : i + depth] for i in range(len(places)))
    by_hand = [i for i in by_hand if times[text[i : i + depth]] > 1]
    assert order.tolist() == by_hand
    assert [a == b for a, b in zip(run[1:], run[:-1], strict=True)] == [text[a : a + depth] == text[b : b + depth] for a, b in zip(by_hand[1:], by_hand[:-1], strict=True)]


def test_repeats_over_small_pieces(spark, monkeypatch):
    """In this process, with pieces, chunks and batches so small that all bounds are met."""
    monkeypatch.setattr(repeats, "PIECE", 150)
    monkeypatch.setattr(repeats, "PHRASES", 40)
    monkeypatch.setattr(repeats, "WINDOWS", 300)
    rows = sorted(ROWS["sample"][:80])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([r[1] for r in rows])], names=["id", "hash", "text"])
    parsed = pa.Table.from_batches(list(repeats._parse(100)(iter([batch])))).sort_by([(c, "ascending") for c in ("trigger", "content", "id", "hash", "first")])
    for size in (1, 2, 5, 64, 10_000):
        out = pa.concat_tables([pa.Table.from_batches([b]) for b in repeats._repeating(100)(iter(parsed.combine_chunks().to_batches(size)))])
        cuts, asked = defaultdict(list), []
        text = {r[0]: r[1].encode() for r in rows}
        for r in out.to_pylist():
            if r["state"] == repeats.CUT:
                cuts[r["id"]].append((r["first"], r["last"]))
            else:
                asked.append({"trigger": r["trigger"], "id": r["id"], "hash": r["hash"], "first": r["first"], "context": text[r["id"]][r["first"] : r["last"] + 100]})
        asked.sort(key=lambda r: r["trigger"])
        if asked:
            for b in repeats._cuts(100, 1 << 20)(iter(pa.Table.from_pylist(asked).to_batches(size))):
                for r in b.to_pylist():
                    cuts[r["id"]].append((r["first"], r["last"]))
        for (i, b), (_, gone, _, _) in without_repeats(rows).items():
            mask = np.zeros(len(b), bool)
            for x, y in cuts[i]:
                mask[x:y] = True
            assert mask.sum() == gone, (size, i)


@pytest.mark.parametrize("length", [1, 2, 3, 31, 32, 100])
def test_rolled(length):
    data = np.frombuffer(b"abracadabra" * 20, np.uint8)
    got = repeats.rolled(data, length)
    assert len(got) == len(data) - length + 1
    same = {bytes(data[i : i + length]): got[i] for i in range(len(got))}
    assert all(got[i] == same[bytes(data[i : i + length])] for i in range(len(got))) and len(set(same.values())) == len(same)


# -- licences -----------------------------------------------------------------------------------------------------


MIT_COMMENT = """/*
 * Copyright (c) Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 */"""
BSD_HEADER = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
   conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
APACHE_LINE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."


def scanned(spark, texts):
    rows = licences.licence_scan(cases.documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    return [r.licences for r in sorted(rows, key=lambda r: r.doc_id)]


def test_licences(spark):
    rows = [
        (1, "Foo bar. Licensed under the Apache License, Version 2.0. More text.", "a"),
        (2, "Title\nReleased under the MIT License.\nOther line", "a"), (3, BSD_HEADER, "a"),
        (4, "Permission is hereby granted. Nothing else.", "a"), (5, None, "a"), (6, "", None), (None, "LICENSED under CC  BY-NC 4.0!  Released under the MIT License", "a"),
        (7, "you can redistribute it and/or modify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even that.", "a"),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licences, r.n_sentences) for r in licences.licence_scan(cases.documents(spark, rows)).collect()}
    assert got == {
        1: ("apache-2.0-notice", "Apache-2.0", 1), 2: ("mit-notice", "MIT", 1), 3: ("bsd-permit,bsd-source,bsd-binary", "BSD-2-Clause", 3), 4: ("", "", 0), 5: ("", "", 0), 6: ("", "", 0),
        None: ("cc-by-nc-4.0-notice,mit-notice", "MIT,CC-BY-NC-4.0", 2), 7: ("gpl-terms,either-3,gpl-hope", "GPL-3.0-or-later", 3),
    }


def test_licences_in_comments_wrapped_and_long(spark):
    texts = [MIT_COMMENT, APACHE_LINE, LGPL, "// SPDX-License-Identifier: MPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "it is released under the\n# MIT License by them", "Released under the MIT License" + "-" * 6000, "word " * 100_000 + "licensed under the EUPL 1.2", "\n" * 300_000 + "Released under the MIT License"]
    assert scanned(spark, texts) == ["MIT", "Apache-2.0", "LGPL-2.1-or-later", "MPL-2.0", "GPL-2.0-or-later", "MIT", "MIT", "EUPL-1.2", "MIT"]
    assert scanned(spark, ["Released under the MIT\n\nLicense", "we permit licenses", "Released under the MIT Licenses"]) == ["", "", ""]


def plain_scan(text):
    """By looking for each known sentence at each word."""
    known, _ = licences.known_sentences()
    words = re.sub("[^a-z0-9\x01]+", " ", re.sub(r"\n[^A-Za-z0-9\n]*\n[^A-Za-z0-9]*", " \x01 ", text or "").lower()).split()
    longest, out, at = max(len(k.split()) for k in known), [], 0
    while at < len(words):
        n = next((n for n in range(longest, 0, -1) if " ".join(words[at : at + n]) in known and at + n <= len(words)), 0)
        if n:
            out.append(known[" ".join(words[at : at + n])])
        at += n or 1
    return ",".join(out)


def test_licences_by_brute_force(spark):
    rng = random.Random(8)
    known, rules = licences.known_sentences()
    parts = [*rng.sample(sorted(known), 60), MIT_COMMENT, BSD_HEADER, APACHE_LINE, LGPL, "some words", "licensed under", "the", "License", "\n\n", "\n * \n", ". ", "; ", "ß"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(parts) + rng.choice([" ", "\n", ". "]) for _ in range(rng.randint(0, 12))), "a") for i in range(300)]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.licence_scan(cases.documents(spark, rows)).collect()}
    for i, text, _ in rows:
        ids = plain_scan(text)
        shown = [name for name, wanted in rules if f",{','.join(wanted)}," in f",{ids},"]
        assert got[i] == (ids, ",".join(dict.fromkeys(shown))), text


def test_licences_rules_need_order(spark):
    one, two = {"a": "first sentence", "b": "second sentence"}, [("X", ["a", "b"])]
    rows = [(1, "First sentence. Second sentence.", "a"), (2, "Second sentence. First sentence.", "a"), (3, "First sentence. Unknown. Second sentence.", "a")]
    got = {r.doc_id: r.licences for r in licences.licence_scan(cases.documents(spark, rows), sentences=one, rules=two).collect()}
    assert got == {1: "X", 2: "", 3: "X"}


def test_licences_odd(spark, rows):
    assert licences.licence_scan(cases.documents(spark, rows)).count() == len(rows)
    assert licences.licence_scan(cases.empty(spark)).count() == 0
    plan = licences.licence_scan(cases.documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# -- embeddings ---------------------------------------------------------------------------------------------------


def check_embeddings(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {k: tuple(r)[1:] for k, r in zip(range(len(rows)), emb.embedding_groups(df.withColumn("node", df.vec_id), **how).orderBy("vec_id").collect(), strict=True)}
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    unit = {}
    for k in order:
        v, label = rows[k][1], rows[k][2]
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    low = {k: k for k in order}
    for a, b in links * 1:
        ra, rb = a, b
        while low[ra] != ra:
            ra = low[ra]
        while low[rb] != rb:
            rb = low[rb]
        if ra != rb:
            low[max(ra, rb, key=lambda k: rows[k][0])] = min(ra, rb, key=lambda k: rows[k][0])
    degree = Counter(a for a, _ in links)
    for place, k in enumerate(order):
        root = k
        while low[root] != root:
            root = low[root]
        assert got[place] == (degree[k], rows[root][0], root == k), rows[k]


def vectors(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            v = np.array(out[int(rng.integers(len(out)))][1]) * rng.choice([1.0, 2.0])
            v = v + (rng.standard_normal(dim) * 0.12 * np.linalg.norm(v) / 8 if rng.random() < 0.8 else 0)
        else:
            v = rng.standard_normal(dim)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return out


@pytest.mark.parametrize("group", [8, 1024])
def test_embeddings(spark, group):
    check_embeddings(spark, vectors(250), group=group)


def test_embeddings_odd(spark):
    v = [1.0] * 64
    nan, inf = float("nan"), float("inf")
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0] * 64, 1), (6, [nan] * 64, 1), (7, [inf] + [1.0] * 63, 1), (8, [None] + [1.0] * 63, 1), (9, [], 1), (10, [1e-30] * 64, 1), (11, [3e38] * 64, 1), (12, [1.0, 2.0], 1), (13, [2.0, 4.0], 1), (14, v, 2)]
    check_embeddings(spark, rows)
    assert emb.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_hot_group(spark):
    rng = np.random.default_rng(1)
    base_ = rng.standard_normal(64)
    near = [(i, [float(np.float32(x)) for x in base_ + rng.standard_normal(64) * 0.05], 1) for i in range(150)]
    check_embeddings(spark, near + [(1000 + i, near[0][1], 1) for i in range(100)], group=32)


def test_decode_finds_the_best_filters():
    filters = emb.Filters(12, 3, 5, 7)
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((40, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn, books = filters.codes()
    gains = np.empty((40, 5**3))
    for m in range(5**3):
        words = [m // 25, m // 5 % 5, m % 5]
        direction = np.concatenate([book[w] for book, w in zip(books, words, strict=True)])
        gains[:, m] = (unit @ turn) @ direction
    assert (emb.decode(unit, filters, (turn, books)) == np.sort(np.argsort(-gains, axis=1)[:, :7], axis=1)).all()


@pytest.mark.parametrize("rows", [500, 50_000, 10**6, 10**8, 10**10])
def test_close_vectors_share_a_filter(rows):
    """With the filters of a table of any size, pairs just at the cosine meet, and unlike ones hardly ever."""
    filters = emb.filters_for(rows, 64, 24)
    codes, rng = filters.codes(), np.random.default_rng(5)
    one, other = rng.standard_normal((2, 500, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.9801 * one + np.sqrt(1 - 0.9801**2) * other
    found = [[set(row) for row in emb.decode(x, filters, codes)] for x in (one, near)]
    assert np.mean([bool(a & b) for a, b in zip(*found, strict=True)]) >= 0.96
    assert np.mean([len(a & b) for a, b in zip(found[0], found[0][1:], strict=False)]) <= max(0.12, 24 * 24 / filters.words**filters.blocks * 10)


# -- all together -------------------------------------------------------------------------------------------------


def test_licence_oracle(spark):
    """The SQL against the operator on texts with many licences."""
    known, _ = licences.known_sentences()
    texts = [f"x {k}. y" for k in sorted(known)[::7]] + [MIT_COMMENT, BSD_HEADER, APACHE_LINE, LGPL, None, "", APACHE_LINE + "\n\n" + MIT_COMMENT + " all rights reserved"]
    docs = cases.documents(spark, [(i, t, "a") for i, t in enumerate(texts)])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(con.sql(queries.ORACLES["op8_licence_scan"]).fetchall())
    assert sorted(map(tuple, licences.licence_scan(docs).collect())) == want


def test_oracles(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        same = lambda f: sorted(map(str, f[columns].itertuples(index=False, name=None)))
        assert same(got) == same(want), name
