import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litforge.llm import ngram_join, suffix_dedup
from litforge.llm import suffix_sort
from litforge.llm.suffix_sort import Scratch, repeated_starts, suffix_sort as sort_suffixes

rng = random.Random(7)
VOCAB = ["w%d" % i for i in range(400)]


def words(n):
    return " ".join(rng.choices(VOCAB, k=n))


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def near_rows():
    base, shared = [words(n) for n in (60, 200, 700, 2500, 40)], words(80)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, edited(t, max(1, len(t.split()) // k))) for i, (t, k) in enumerate((t, k) for t in base for k in (40, 60, 90, 120))]
    rows += [(100 + i, edited(base[1], 2)) for i in range(60)]  # a large group
    rows += [(200 + i, shared + " " + words(60 + i)) for i in range(40)]  # a passage that many share
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "ONE two"), (305, "one"), (306, base[0].upper()), (307, base[0]), (308, base[3] + " " + words(1500))]
    return rows


def test_join_like_brute_force(spark, documents, folder):
    rows = near_rows()
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_join(spark, folder(documents(rows).repartition(5), "documents")).collect()}
    assert got == brute_groups(rows)


def test_join_splits_large_components(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    base, rows = words(200), near_rows()
    for i in range(80):  # a chain: each text is near the one before and far from the first
        base = edited(base, 1)
        rows.append((400 + i, base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(rows)).collect()}
    assert got == brute_groups(rows)


def test_join_edges(spark, documents):
    assert ngram_join.near_duplicates(documents([])).count() == 0
    text = words(50)
    rows = [(None, text), (5, text), (5, text), (7, edited(text, 1)), (8, "other words")]
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.near_duplicates(documents(rows)).collect())
    assert got[1:] == [(5, 5), (5, 5), (7, 5 if brute_groups(rows[2:4])[7][1] == 5 else 7), (8, 8)]
    kept = ngram_join.keep_one(documents([(1, text), (1, text), (2, text), (3, "x y"), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == documents([]).columns
    other = words(40)
    rows = [(1, text), (9, text), (9, other), (None, text), (None, "alone"), (None, "alone"), (None, None), (11, "x " + text)]
    kept = ngram_join.keep_one(documents(rows)).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == sorted([(1, text), (9, other), (0, "alone"), (0, "")])


def test_join_deals_sets_once(spark, documents, monkeypatch):
    seen, real = {}, ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges, name: real(seen.setdefault(name, edges), name))
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 50)  # known sets go out by shares
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = near_rows()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert got == brute_groups(rows)
    plan = seen["join-exact"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_join_has_no_row_for_each_list_of_a_set(spark, documents, monkeypatch):
    seen, real = {}, ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges, name: real(seen.setdefault(name, edges), name))
    monkeypatch.setattr(ngram_join, "LIST_BYTES", 2000)  # many lists
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(rows)).collect()}
    assert got == brute_groups(rows)
    plan = seen["join-possible"]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_lists_keep_sizes_that_link():
    assert ngram_join.POSTING.itemsize <= 13
    for n in (1, 5, 99, 100, 4000, 10**6):
        for m in range(-(-80 * n // 100), n + 1, max(1, n // 50)):
            assert ngram_join.size_class(n) - ngram_join.size_class(m) <= ngram_join.classes_apart(80)
    postings = [(7, 100, 1), (7, 200, 2), (7, 210, 3), (7, 210, 3), (9, 100, 1), (9, 300, 4), (11, 100, 5)]
    packed = np.array([(x, ngram_join.size_class(n), key) for x, n, key in postings], ngram_join.POSTING).tobytes()
    out = ngram_join._shared(80)(pa.table({"part": pa.array([0], pa.int32()), "data": pa.array([packed], pa.binary())}))
    assert out.column("keys").to_pylist() == [[2, 3]] and out.column("times").to_pylist() == [[1, 1]]
    assert len(out.column("data")[0].as_py()) == 2 * ngram_join.POSTING.itemsize


def test_tree_bound_is_safe():
    sets = [ngram_join.shingles(t) for _, t in near_rows() if t and len(t.split()) > 4]
    for a in sets[:30]:
        for b in sets[:30]:
            x, y = ngram_join.heights(a, 64), ngram_join.heights(b, 64)
            spare = min(len(a) - int(x.sum()), len(b) - int(y.sum()))
            assert np.minimum(x, y).sum() + spare >= len(np.intersect1d(a, b))


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=90), st.sampled_from([200, 3000, 1 << 30]), st.sampled_from([1, 3, 256]), st.sampled_from([5, 400]), st.booleans())
def test_suffixes_and_common_prefixes(tmp_path_factory, values, memory, alphabet, cap, twice):
    t = np.array([*(values * 2 if twice else values), 0], np.uint16)
    before = suffix_sort.ALPHABET, suffix_sort.DIRECT
    suffix_sort.ALPHABET, suffix_sort.DIRECT = alphabet, 0  # every level by induction, names as one digit or two
    scratch = Scratch(f"file://{tmp_path_factory.getbasetemp()}", memory)
    order, lcp = sort_suffixes(t, cap, scratch)
    scratch.close()
    suffix_sort.ALPHABET, suffix_sort.DIRECT = before
    rest = [t[i:].tolist() for i in order]
    if cap > len(t):
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sorted(order.tolist()) == list(range(len(t))) and [r[:cap] for r in rest] == sorted(r[:cap] for r in rest)
    assert lcp.tolist() == [0] + [min(cap, common(a, b)) for a, b in zip(rest, rest[1:])]


def test_repeated_starts(tmp_path):
    data = (words(400) + words(100) * 2 + "ab" * 300 + words(30) + "z" * 900).encode()
    for length in (200, 700):
        starts = np.arange(len(data) - length + 1)
        count = Counter(data[i : i + length] for i in starts)
        want = [count[data[i : i + length]] > 1 for i in starts]
        assert repeated_starts(data, starts, length).tolist() == want
        assert repeated_starts(data, starts, length, memory=5000, folder=f"file://{tmp_path}").tolist() == want
    with pytest.raises(ValueError):
        repeated_starts(data, starts, 70_000)
    assert not list(tmp_path.iterdir())  # nothing is left behind


def test_shard_of_ten_times_the_memory(tmp_path):
    passage = words(90)
    texts = [words(rng.randint(30, 120)) + (passage if i % 7 == 0 else "") + words(20) for i in range(400)]
    data = "\0".join(texts).encode()
    gap = np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
    starts = np.concatenate([np.arange(a, b - 199) for a, b in zip(np.concatenate(([0], gap + 1)), np.append(gap, len(data))) if b - a >= 200])
    count = Counter(data[i : i + 200] for i in starts)
    seen = []
    close = Scratch.close
    Scratch.close = lambda self: (seen.append(self.spilled), close(self))
    got = repeated_starts(data, starts, 200, gap, 8 * len(data) // 10, f"file://{tmp_path}")
    Scratch.close = close
    assert got.tolist() == [count[data[i : i + 200]] > 1 for i in starts] and any(got) and not all(got)
    assert seen[0] > 8 * len(data)


def brute_cut(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows():
    passage, short = words(60), words(25)[:150]
    rows = [(i, words(50) + " " + passage + " " + words(40)) for i in range(6)]
    rows += [(10, words(300)), (11, short + words(20)), (12, short + words(20)), (13, "a" * 700), (14, "ab" * 300), (15, None), (16, ""), (17, words(20)), (18, "é" * 150 + words(10)), (19, "x" + "é" * 150)]
    rows += [(20, rows[6][1]), (21, passage[:199]), (22, passage[:200]), (23, words(30) + passage[50:270] + passage[10:240])]
    return rows


def test_repeats_like_brute_force(spark, documents, folder):
    rows = repeat_rows()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op4_suffix_dedup(spark, folder(documents(rows).repartition(4), "documents")).collect()}
    assert [got[i] for i, _ in rows] == brute_cut(rows)


def test_repeats_in_small_memory(spark, documents, folder, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MEMORY", 20_000)
    rows = repeat_rows() + [(50 + i, words(700) + "q" * 250 + words(300)) for i in range(5)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op4_suffix_dedup(spark, folder(documents(rows).repartition(4), "documents")).collect()}
    assert [got[i] for i, _ in rows] == brute_cut(rows)


def test_repeats_edges(spark, documents, folder):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0
    text = words(80)
    rows = [(None, text + " tail"), (2, "head " + text), (3, None)]
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(rows)).collect()}
    assert cut[None].text.endswith("tail") and len(cut[None].text) < 10 and cut[2].n_chars == len(cut[2].text) < 10 and cut[3].text is None
    assert cut[2].key == "kept"
    again = suffix_dedup.op4_suffix_dedup(spark, folder(documents([(1, text), (1, text)]), "documents")).collect()
    assert [(r.n_removed, r.kept_sha256) for r in again] == [(len(text), suffix_dedup.EMPTY)] * 2
