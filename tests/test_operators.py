import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litforge.operators import corpus, detectors, evaluate, graph, layout, queue, relational
from litforge.operators.highlight import find_snippet
from litforge.sources.catalog import Catalog


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_section_tf(spark):
    s = spark.createDataFrame([(1, "alpha beta", None, None), (2, None, None, "alpha"), (3, None, None, None)], "doc_id int, abstract string, methods string, conclusion string")
    tf = {(r.doc_id, r.term): r.tf for r in corpus.section_tf(s).collect()}
    assert tf == {(1, "alpha"): 0.5, (1, "beta"): 0.5, (2, "alpha"): 1.0}
    w = {(r.doc_id, r.term): r.weight for r in corpus.tfidf(corpus.section_tf(s), 3).collect()}
    assert math.isclose(w[2, "alpha"], math.log(4 / 3) + 1) and math.isclose(w[1, "beta"], 0.5 * (math.log(2) + 1))


def test_words_do_not_carry_their_section(spark):
    """A word's row beside its section's words takes the square of a text's length."""
    s = spark.createDataFrame([(1, "alpha beta", "gamma")], "doc_id int, abstract string, methods string")
    node = corpus.section_tf(s)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":
        node = node.children().apply(0)
    assert not [x for x in map(node.output().apply, range(node.output().size())) if "array" in x.dataType().catalogString()]


def test_weights_by_bounds(spark, monkeypatch):
    """What bounds leave out is neither among the best nor of the least weight, and most is left out."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{t:04d}" for t in (rng.zipf(1.3, 300) % 3000).tolist())) for i in range(60)]
    tf = corpus.section_tf(spark.createDataFrame(texts, "doc_id int, abstract string"))
    monkeypatch.setattr(corpus, "FREQUENT", 10)
    whole = corpus.tfidf(tf, 60)
    best = corpus.tfidf(tf, 60, top=5)
    assert rows(corpus.top_terms(best, 5), "doc_id", "rank") == rows(corpus.top_terms(whole, 5), "doc_id", "rank")
    assert best.count() < whole.count() / 2
    strong = corpus.tfidf(tf, 60, least=0.05)
    assert rows(strong.filter("weight >= 0.05"), "doc_id", "term") == rows(whole.filter("weight >= 0.05"), "doc_id", "term")
    assert strong.count() < whole.count() / 2


def test_similarity_and_gaps(spark):
    w = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0)], "doc_id int, term string, weight double")
    assert [(a, b, round(s, 9)) for a, b, s in rows(corpus.cosine_pairs(w), "a")] == [(1, 2, 1.0)]
    near = corpus.neighbours(corpus.cosine_pairs(w), 2)
    full = corpus.with_fillers(near, spark.createDataFrame([(1,), (2,), (3,)], "doc_id int"), 2)
    assert [(d, r, n) for d, r, n, _ in rows(full, "doc_id", "rank")] == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    s = spark.createDataFrame([(1, True, False), (2, False, True)], "doc_id int, strong boolean, weak boolean")
    assert rows(corpus.contradictions(corpus.cosine_pairs(w), s).select("a", "b"), "a") == [(1, 2)]
    shared = corpus.shared_terms(w, 0.5)
    none, edge = spark.createDataFrame([], "src int, dst int"), spark.createDataFrame([(2, 1)], "src int, dst int")
    assert corpus.bridges(shared, none, least=2).count() == 1
    assert corpus.bridges(shared, edge, least=2).count() == 0
    known = spark.createDataFrame([(3,)], "doc_id int")
    assert corpus.bridges(shared, none, known, least=2).count() == 0


def test_bm25_order(spark):
    d = spark.createDataFrame([(1, "graph theory", "text"), (2, "other", "some graph words"), (3, "none", "none")], "doc_id int, title string, summary string")
    assert [r.doc_id for r in corpus.bm25(d, "graph", {"title": 2.0, "summary": 1.5}).collect()] == [1, 2]


def test_pairs_in_blocks(spark, monkeypatch):
    """Candidates by prefixes and lists in blocks give what all pairs give."""
    rng = np.random.default_rng(3)
    rows = [(i, f"t{t}", float(rng.integers(1, 9))) for i in range(60) for t in set(rng.integers(0, 40, 12).tolist()) | {0}]
    w = spark.createDataFrame(rows, "doc_id int, term string, weight double")
    vec = {}
    for i, t, x in rows:
        vec.setdefault(i, {})[t] = x
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    dot = {(a, b): sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) / norm[a] / norm[b] for a in vec for b in vec if a < b}
    monkeypatch.setattr(corpus, "BLOCK", 7)
    for least in (0.0, 0.45):
        got = {(r.a, r.b): r.score for r in corpus.cosine_pairs(w, least).collect()}
        assert got.keys() == {p for p, s in dot.items() if s >= max(least, 1e-12)} and all(math.isclose(got[p], dot[p]) for p in got)
    shared = {(r.a, r.b): r.terms for r in corpus.shared_terms(w, 5.0).collect()}
    want = {(a, b): sorted(t for t, x in vec[a].items() if x >= 5 and vec[b].get(t, 0) >= 5) for a, b in dot}
    assert shared == {p: t for p, t in want.items() if t}
    q, r = spark.range(7).withColumnRenamed("id", "q"), spark.range(23).withColumnRenamed("id", "r")
    assert sorted(map(tuple, evaluate.against_all(q, r, 4).select("q", "r").collect())) == [(i, j) for i in range(7) for j in range(23)]


def test_model_gate(spark):
    d = spark.createDataFrame([("x",), ("no way",)], "context string")
    say = F.pandas_udf(lambda s: pd.Series(["No" if "no" in x else "yes" for x in s]), "string")
    assert rows(corpus.verified(d, F.col("context"), say).select("context"), "context") == [("x",)]
    assert corpus.verified(d, F.col("context")).count() == 0


def test_nearest_deals_out_no_pair(spark, monkeypatch):
    """As by all pairs, over several blocks, with copies, short lists and terms of one document; no pair becomes a row."""
    from litforge.operators import nearest

    rng = random.Random(7)
    texts = [[f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(rng.randrange(3, 40))] for _ in range(90)]
    texts += [list(texts[i % 5]) for i in range(30)] + [["only"], ["pair"], ["pair"], []]
    tf = [(i, t, x.count(t) / len(x)) for i, x in enumerate(texts) for t in sorted(set(x))]
    tf = spark.createDataFrame(tf, "doc_id long, term string, tf double")
    scored = corpus.cosine_pairs(corpus.tfidf(tf, len(texts))).withColumn("score", corpus.T.rounded(F.col("score")))
    want = rows(corpus.neighbours(scored, 6), "doc_id", "rank")

    def stop(*args, **kwargs):
        raise AssertionError("pairs are dealt out")

    monkeypatch.setattr(corpus, "_salted", stop)
    monkeypatch.setattr(nearest, "ENTRIES", 500)
    assert rows(corpus.nearest(tf, len(texts), 6), "doc_id", "rank") == want and len(want) > 600
    ids = spark.range(len(texts)).withColumnRenamed("id", "doc_id")
    full = corpus.similar_papers(tf, len(texts), ids, 6).collect()
    assert len(full) == 6 * len(texts) and {(r.doc_id, r.rank, r.neighbour, r.score) for r in full} >= set(want)
    assert {tuple(r.shared) for r in full if {r.doc_id, r.neighbour} == {121, 122}} == {("pair",)}


def test_similar_papers_write_terms_once(spark, monkeypatch):
    tf = spark.createDataFrame([(i, f"w{j}", 0.5) for i in range(6) for j in range(i % 3 + 1)], "doc_id long, term string, tf double")
    written, write = [], corpus.materialize
    monkeypatch.setattr(corpus, "materialize", lambda df, name: written.append(name) or write(df, name))
    found = corpus.similar_papers(tf, 6, spark.range(6).withColumnRenamed("id", "doc_id"), 2).collect()
    assert len(found) == 12 and [x for x in written if x.endswith("-tf")] == ["similar-tf"]


def test_pieces_meet_once_for_both(spark, monkeypatch):
    """Documents of like words are in a piece; two pieces' products, by matrices or term by term, give the k best of both, ties to the smaller id."""
    from litforge.operators import nearest

    rng = np.random.default_rng(3)
    tf = spark.createDataFrame([(i, f"{'abc'[i % 3]}{j}", 0.5) for i in range(36) for j in range(4) if (i + j) % 5], "doc_id long, term string, tf double")
    df = tf.groupBy("term").count().selectExpr("term", "cast(ascii(term) * 10 + substr(term, 2) AS int) AS id", "count AS df")
    found = nearest.kinds(tf, df)
    assert len(found) == 12 and len({(i // 10, k) for i, k in found.items()}) == len(set(found.values())) == 3
    dense = [np.where(rng.random((n, 30)) < rng.random(30) ** 2, rng.integers(1, 4, (n, 30)), 0).astype(float) for n in (40, 25)]
    for x in dense:
        x[3:9] = x[3]  # copies tie
        x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1)[:, None]
    a, b = (nearest.Piece(5, len(x), ids.astype("i4"), (doc + 5).astype("i4"), x[doc, ids]) for x in dense for ids, doc in [np.nonzero(x.T)])
    want = dense[0] @ dense[1].T
    place = np.full(31, -1)
    place[a.terms] = np.arange(len(a.terms))
    for single, width, at_once in ((0, 1024, 7), (10**9, 4, 7), (3, 4, 50)):
        monkeypatch.setattr(nearest, "SINGLE", single)
        monkeypatch.setattr(nearest, "WIDTH", width)
        monkeypatch.setattr(nearest, "AT_ONCE", at_once)
        assert np.allclose(nearest.scores(a, b, place), want, atol=1e-12)
    assert nearest.scores(a, nearest.Piece(0, 1, np.array([30]), np.array([0]), np.ones(1)), place) is None
    for side, s in ((0, want), (1, want.T)):
        names = rng.permutation(100)[: s.shape[1]]
        best = nearest.Best(5 + len(s), 2)
        for part in (slice(0, 9), slice(9, None)):
            best.take(5, want[:, part] if side == 0 else want[part], names[part], side)
        for i, codes in enumerate(best.codes[5:]):
            keys = sorted((-np.floor(x * 1e6 + 0.5), n) for x, n in zip(s[i], names, strict=True) if x > 0)[:2]
            assert [(c >> 31, c & (2**31 - 1)) for c in codes if c < nearest.NONE] == [(nearest.TOP + x, n) for x, n in keys]


def test_shared_terms_deal_out_no_pair(spark, monkeypatch):
    """As by all pairs, over several blocks, with numbers or strings as ids; no pair is dealt out."""
    from litforge.operators import together

    rng = random.Random(9)
    texts = [sorted({f"w{min(int(rng.paretovariate(0.7)), 200)}" for _ in range(rng.randrange(1, 15))}) for _ in range(70)]
    monkeypatch.setattr(corpus, "_salted", None)
    monkeypatch.setattr(together, "ENTRIES", 60)
    for name, kind in ((lambda i: i, "long"), (lambda i: f"d{i}", "string")):
        w = spark.createDataFrame([(name(i), t, 1.0) for i, x in enumerate(texts) for t in x] + [(name(0), "low", 0.5), (name(1), "low", 0.5)], f"doc_id {kind}, term string, weight double")
        ids = sorted((name(i), x) for i, x in enumerate(texts))
        for least in (1, 3):
            found = corpus.shared_terms(w, 1.0, least)
            assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
            want = {(a, b): sorted(set(x) & set(y)) for i, (a, x) in enumerate(ids) for b, y in ids[i + 1 :]}
            got = [(r.a, r.b, r.terms) for r in found.collect()]
            assert sorted(got) == sorted((a, b, t) for (a, b), t in want.items() if len(t) >= least)
    assert corpus.shared_terms(w.limit(0), 1.0).count() == 0


def test_bridges_leave_pairs_in_place(spark):
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = spark.createDataFrame([(1, 2, list("abc")), (1, 3, list("abc")), (2, 3, ["a"])], "a long, b long, terms array<string>")
        found = corpus.bridges(shared, spark.createDataFrame([(3, 1)], "src long, dst long"))
        problems = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "doc_id long, open_problems array<string>")
        out = corpus.bridge_context(problems, found.select("a", "b", "terms"))
        assert [(r.a, r.b) for r in out.collect()] == [(1, 2)] and "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_contradictions_meet_by_strength(spark, monkeypatch):
    """Only a strong and a weak document meet; with both marks, repeated marks and none, as from all pairs."""
    rng = random.Random(11)
    rows_ = [(i, f"w{min(int(rng.paretovariate(0.9)), 30)}", rng.random() + 0.1) for i in range(40) for _ in range(6)]
    w = spark.createDataFrame([(i, t, x) for (i, t), x in {(i, t): x for i, t, x in rows_}.items()], "doc_id int, term string, weight double")
    marks = [(i, i % 3 == 0, i % 5 == 0) for i in range(34)] + [(7, True, None), (100, True, True)]
    s = spark.createDataFrame(marks, "doc_id int, strong boolean, weak boolean")
    monkeypatch.setattr(corpus, "BLOCK", 3)
    want = sorted((r.a, r.b, round(r.confidence, 9)) for r in corpus.contradictions(corpus.cosine_pairs(w, 0.3), s).collect())
    monkeypatch.setattr(corpus, "_salted", None)
    got = sorted((r.a, r.b, round(r.confidence, 9)) for r in corpus.contradictions(corpus.cosine_pairs(w, 0.3, s), s).collect())
    assert got == want and len(want) > 10


def chain(spark):
    return spark.createDataFrame([("A", "B"), ("B", "C")], "src string, dst string"), spark.createDataFrame([(x,) for x in "ABC"], "id string")


def test_chain_metrics(spark):
    e, n = chain(spark)
    m = {r.id: r for r in graph.metrics(e, n).collect()}
    assert m["C"].pagerank > m["B"].pagerank > m["A"].pagerank > 0
    assert math.isclose(sum(r.pagerank for r in m.values()), 1.0, abs_tol=1e-9)
    assert (m["A"].betweenness, m["B"].betweenness, m["C"].betweenness) == (0.0, 0.5, 0.0)
    assert rows(graph.bfs(e, n.limit(1).filter("id = 'A'").unionByName(n.filter("id = 'A'")), 1), "id") == [("A", 0), ("B", 1)]


def test_metrics_deal_out_no_round(spark, monkeypatch):
    """Ranks of components taken apart are those of the whole graph, with sinks, self-loops, repeated edges, lone and unknown nodes; no round is dealt out."""
    rng = random.Random(17)
    pairs = [(100 * c + rng.randrange(30), 100 * c + rng.randrange(25)) for c in range(4) for _ in range(15 + 20 * c)] + [(500, 501), (501, 501), (502, 502), (503, 999), (500, 501)]
    ids = [100 * c + i for c in range(4) for i in range(30)] + [500, 501, 502, 503]
    e, n = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i,) for i in ids], "id long")
    want = {x.id: pytest.approx(x.pagerank, rel=1e-12) for x in graph.pagerank(e, n, 7).collect()}

    def stop(*args, **kwargs):
        raise AssertionError("rounds are dealt out")

    monkeypatch.setattr(graph, "pagerank", stop)
    for few in (40, 10_000):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        got = {x.id: x.pagerank for x in graph.metrics(e, n, 7).collect()}
        assert got == want and math.isclose(sum(got.values()), 1.0)
    monkeypatch.setattr(graph, "MOST_EDGES", 20)
    with pytest.raises(ValueError):
        graph.metrics(e, n)
    assert graph.metrics(e.limit(0), n.limit(0)).count() == 0
    assert [x.pagerank for x in graph.metrics(e.limit(0), n).collect()] == [pytest.approx(1 / len(ids))] * len(ids)


def test_betweenness_by_component(spark, monkeypatch):
    """Components apart, in blocks of sources or many to a task, as by counting paths; none is held back by the size of all."""
    rng = random.Random(5)
    base = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(70)})
    pairs = [(100 * c + a, 100 * c + b) for c in range(3) for a, b in base]
    e, n = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(100 * c + i,) for c in range(3) for i in range(30)], "id long")
    out = {v: [b for a, b in base if a == v] for v in range(30)}

    def reach(s):
        depth, count, level = {s: 0}, {s: 1}, [s]
        while level:
            new = []
            for v in level:
                for w in out[v]:
                    if w not in depth:
                        depth[w], count[w] = depth[v] + 1, 0
                        new.append(w)
                    if depth[w] == depth[v] + 1:
                        count[w] += count[v]
            level = new
        return depth, count

    d = {v: reach(v) for v in range(30)}
    between = lambda v, s, t: v in d[s][0] and t in d[v][0] and d[s][0][v] + d[v][0][t] == d[s][0][t]
    want = {v: sum(d[s][1][v] * d[v][1][t] / d[s][1][t] for s in out for t in d[s][0] if len({s, t, v}) == 3 and between(v, s, t)) for v in out}
    monkeypatch.setattr(graph, "MOST_EDGES", 100)  # fewer than all have
    for few, work in ((10, 500), (10_000, 500)):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        monkeypatch.setattr(graph, "BLOCK_WORK", work)
        got = {r.id: r.betweenness * 89 * 88 for r in graph.betweenness(e, n).collect()}
        assert len(got) == 90 and all(math.isclose(got[100 * c + v], want[v], abs_tol=1e-9) for c in range(3) for v in out)


def test_dependencies_in_products(monkeypatch):
    """Sums of few paths take two bytes a cell, those of many or of shares eight; depths may pass a byte. As by plain Brandes."""
    from litforge.operators import paths

    rng = random.Random(13)
    layered = [(12 * i + a, 12 * i + 12 + b) for i in range(7) for a in range(12) for b in range(12)]
    cases = [sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(400)} - {(i, i) for i in range(60)}), layered, [(i, i + 1) for i in range(299)] + [(0, 150)]]
    kinds, times = set(), paths.Links.times
    monkeypatch.setattr(paths.Links, "times", lambda self, x, *out: kinds.add(x.dtype.itemsize) or times(self, x, *out))
    for edges in cases:
        src, dst = np.array(edges).T
        n = int(max(src.max(), dst.max())) + 1
        want = np.zeros(n)
        for s in range(n):
            depth, count, seen, share = {s: 0}, {s: 1}, [s], dict.fromkeys(range(n), 0.0)
            near = {v: dst[src == v].tolist() for v in range(n)} if s == 0 else near  # noqa: F821
            for v in seen:
                for w in near[v]:
                    if w not in depth:
                        depth[w], count[w] = depth[v] + 1, 0
                        seen.append(w)
                    if depth[w] == depth[v] + 1:
                        count[w] += count[v]
            for v in reversed(seen[1:]):
                share[v] = sum(count[v] / count[w] * (1 + share[w]) for w in near[v] if depth[w] == depth[v] + 1)
                want[v] += share[v]
        for factor in (10**9, 1):  # products alone, or cells alone
            monkeypatch.setattr(paths, "SMALL", factor, raising=False)
            monkeypatch.setattr(paths, "SINGLE", factor)
            assert np.allclose(paths.dependencies(src, dst, n, np.arange(n)), want, rtol=1e-12, atol=1e-12)
    assert kinds == {2, 8}


def plain_moves(pairs):
    """The first pass of local moves, every node asked in every sweep."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1.0
    at, degree, total, moved = {v: v for v in near}, {v: float(len(x)) for v, x in near.items()}, 2.0 * len(pairs), True
    while moved:
        moved = False
        for v in sorted(near):
            mass = lambda c: sum(degree[u] for u in at if at[u] == c and u != v)  # noqa: B023, E731
            gain = {c: sum(w for u, w in near[v].items() if at[u] == c) - degree[v] * mass(c) / total for c in {at[u] for u in near[v]} | {at[v]}}  # noqa: B023
            best = min(gain, key=lambda c: (-round(gain[c], 12), c != at[v], c))  # noqa: B023
            moved, at[v] = moved or best != at[v], best
    return at


def test_communities_by_component(spark, monkeypatch):
    """Moves as when every node is asked each time, and components dealt to tasks by their number of edges, however few their bytes."""
    rng = random.Random(3)
    base = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)})
    moved, whole = plain_moves(base), graph.louvain_partition([(a, b, 1.0) for a, b in base])
    assert all(whole[a] == whole[b] for a in moved for b in moved if moved[a] == moved[b])
    plans, write = {}, graph.materialize

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return write(df, name)

    monkeypatch.setattr(graph, "materialize", kept)
    monkeypatch.setattr(graph, "TASK_EDGES", 50, raising=False)
    pairs = [(100 * c + a, 100 * c + b) for c in range(3) for a, b in base]
    found = {r.id: r.community_id for r in graph.communities(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(x,) for x in sorted({v for p in pairs for v in p})], "id long")).collect()}
    assert all((found[100 * c + a] == found[100 * c + b]) == (whole[a] == whole[b]) for c in range(3) for a in whole for b in whole if graph.OTHER not in (found[100 * c + a], found[100 * c + b]))
    assert "REPARTITION_BY_NUM" in plans["communities"]


def test_partitions_hold_links_in_arrays():
    """A partition takes few bytes an edge, and names communities as one of named pairs does; fractional weights and self-loops too."""
    import tracemalloc

    rng = random.Random(17)
    pairs = sorted({tuple(sorted((rng.randrange(1500), rng.randrange(1500)))) for _ in range(30_000)})
    a, b = np.array(pairs).T
    tracemalloc.start()
    try:
        graph.louvain_arrays(a, b, np.ones(len(a)), 1500)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 400 * len(pairs)
    blocks = [(10 * c + i, 10 * c + j, 0.3) for c in range(4) for i in range(6) for j in range(i, 6)] + [(10 * c, 10 * c + 10, 0.1) for c in range(3)]
    found = graph.louvain_partition([(f"{x:02}", f"{y:02}", w) for x, y, w in blocks])
    assert {frozenset(v for v in found if found[v] == c) for c in found.values()} == {frozenset(f"{10 * c + i:02}" for i in range(6)) for c in range(4)}


def test_tag_pairs_are_made_in_many_tasks(spark, monkeypatch):
    """One set that all have doesn't leave its pairs to one task; pairs and scores as by scoring each."""
    monkeypatch.setattr(corpus, "BLOCK", 4)
    sets = [["a", "b"]] * 25 + [["b", "c"]] * 6 + [["c"], ["d"]]
    out = corpus.set_cosine(spark.createDataFrame([(i, t) for i, x in enumerate(sets) for t in x], "doc_id long, tag string"))
    df = {t: sum(t in x for x in sets) for t in "abcd"}
    w = {t: math.log((1 + len(sets)) / (1 + n)) + 1 for t, n in df.items()}
    size = lambda x: math.sqrt(sum(w[t] ** 2 for t in x))
    want = {(i, j): sum(w[t] ** 2 for t in x if t in sets[j]) / size(x) / size(sets[j]) for i, x in enumerate(sets) for j in range(i + 1, len(sets)) if set(x) & set(sets[j])}
    got = [(r.a, r.b, r.score) for r in out.collect()]
    assert len(got) == len(want) and all(math.isclose(s, want[a, b]) for a, b, s in got)
    made = [len(x) for x in out.rdd.glom().collect()]
    assert len(made) > 20 and max(made) < len(got) / 4


def test_two_cliques(spark):
    pairs = [(i, j) for b in (0, 10) for i in range(b, b + 6) for j in range(i + 1, b + 6)] + [(0, 10)]
    e, n = spark.createDataFrame(pairs, "src long, dst long"), spark.range(0, 16).filter("id < 6 OR id >= 10")
    found = {r.id: r.community_id for r in graph.communities(e, n).collect()}
    assert len({found[i] for i in range(6)}) == 1 and len({found[i] for i in range(10, 16)}) == 1 and found[0] != found[10]
    assert graph.communities(e, n.limit(5)).count() == 0
    comps = graph.connected_components(e, spark.range(0, 17).filter("id < 6 OR id >= 10"))
    assert {r.component for r in comps.collect()} == {0, 16}


def test_closed_forms(spark):
    m = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y")], "k int, p int, c string")
    assert rows(relational.method_matrix(m, "k", "p", "c"), "a", "b") == [("x", "x", 3), ("x", "y", 2), ("y", "y", 1)]
    w = spark.createDataFrame([(i, "t", 1.0) for i in range(4)], "doc_id long, term string, weight double")
    members = spark.range(4).withColumn("community_id", F.lit(7).cast("long"))
    assert rows(graph.shared_in_community(w, members), "rank") == [(7, 1, "t", 6)]


def test_upsert_and_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    row = lambda i, f: (i, 0.5, 0.1, f, "now")
    schema = "arxiv_id string, pagerank double, betweenness double, corpus_fingerprint string, computed_at string"
    c.upsert("graph_metrics", spark.createDataFrame([row("1v2", "a"), row("2", "b")], schema))
    c.upsert("graph_metrics", spark.createDataFrame([row("1", "c")], schema))
    assert rows(c.read("graph_metrics").select("arxiv_id", "corpus_fingerprint"), "arxiv_id") == [("1", "c"), ("2", "b")]
    assert c.exists("graph_metrics", "1v9") and not c.exists("graph_metrics", "3")
    assert c.is_current("graph_metrics", "c") and c.delete_stale("graph_metrics", "c") == 1
    assert c.read("graph_metrics").count() == 1 and c.read("gap_finding").count() == 0
    gap = spark.createDataFrame([("abc_bridge", ["1"], ["t"], "j", 0.5, "now")], "gap_type string, paper_ids array<string>, shared_terms array<string>, justification string, confidence double, found_at string")
    c.append("gap_finding", gap)
    c.append("gap_finding", gap)
    assert c.read("gap_finding").count() == 2


def test_queue(spark):
    refs = spark.createDataFrame([("s", "a"), ("s", "bv2"), ("a", "c"), ("c", "d")], "src string, dst string")
    known = spark.createDataFrame([("s",), ("a",), ("c",), ("d",)], "id string")
    final, edges = queue.crawl(refs, known, "s", 1)
    assert rows(final.select("paper_id", "depth_level", "status", "retry_count"), "paper_id") == [("a", 1, "done", 0), ("b", 1, "failed", 2), ("c", 2, "done", 0), ("s", 0, "done", 0)]
    assert edges.count() == 3 and queue.has_completed(final, "s")
    assert queue.clear(final, "s").count() == 0


def test_statistics(spark):
    s = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "score double, positive boolean")
    assert evaluate.auc(s).first()["auc"] == 0.875
    assert math.isclose(evaluate.fisher_one_sided(3, 1, 1, 3), 17 / 70)
    assert math.isclose(evaluate.binomial_tail(2, 3, 0.5), 0.5)
    assert evaluate.mann_whitney_p(0.5, 5, 5) == 0.5 and evaluate.wilcoxon_above(np.arange(1, 20)) < 0.01
    same = spark.createDataFrame([(True, True), (False, False)], "a boolean, b boolean")
    assert evaluate.kappa(same).first()["kappa"] == 1.0
    r = spark.createDataFrame([(["c", "x", "a", "c"], ["a", "b", "c"])], "r array<string>, p array<string>")
    assert r.select(evaluate.repaired_ranking(F.col("r"), F.col("p"))).first()[0] == ["c", "a", "b"]
    b = evaluate.bootstrap_ci(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "value double")).first()
    assert b["low"] <= b["mean"] == 2.0 <= b["high"]


def test_catalytic_sets(spark):
    r = lambda needs, helps, makes: {"reactants": set(needs), "catalysts": set(helps), "products": set(makes)}
    food = {"f", "g"}
    table = {"a0": r("f", "g", "A"), "a1": r("A", "A", "B"), "b0": r("g", "f", "X"), "b1": r("Xf", "X", "Y"), "both": r("BY", "A", "Z"), "none": r("f", "Q", "N"), "far": r("M", "f", "O")}
    kept = detectors.raf_closure(table, food)
    assert kept == set(table) - {"none", "far"}
    sets = detectors.minimal_rafs({k: table[k] for k in kept}, food)
    assert sets == [{"a0", "a1", "both"}, {"b0", "b1", "both"}]
    assert detectors.minimal_rafs({k: table[k] for k in ("a0", "a1")}, food) == [{"a0", "a1"}]
    # A ring that only makes itself is closed, as all it needs is among its products.
    assert detectors.raf_closure({"p": r("U", "V", "V"), "q": r("V", "U", "U")}, food) == {"p", "q"}
    rows = [(k, sorted(x["reactants"]), sorted(x["catalysts"]), sorted(x["products"]), "s") for k, x in table.items()]
    frame = spark.createDataFrame(rows, "id string, reactants array<string>, catalysts array<string>, products array<string>, source string")
    assert {x.id for x in detectors.closed_reactions(frame, sorted(food)).collect()} == kept
    assert [(x.id, x.rafs) for x in detectors.raf_bridges(detectors.raf_sets(frame, sorted(food))).collect()] == [("both", [0, 1])]
    assert sorted(map(tuple, detectors.raf_contractions(frame, sorted(food)).collect())) == [("s", "both", 0, 1), ("s", "both", 1, 1)]


def test_detectors(spark):
    ring = [(i, (i + k) % 10) for i in range(10) for k in (1, 2)]
    pairs = ring + [(a + 10, b + 10) for a, b in ring] + [(0, 10)]
    e = spark.createDataFrame([(1, a, b) for a, b in pairs], "graph int, src long, dst long")
    cut = detectors.kuramoto_bridges(e, coupling=10.0).orderBy("rank").first()
    assert (cut.src, cut.dst) == (0, 10)
    terms = spark.createDataFrame([(1, i, t) for i in range(20) for t in ("p", "q")], "graph int, id long, term string")
    top = detectors.sheaf_bridges(terms, e).orderBy("rank").first()
    assert (top.src, top.dst) == (0, 10)
    table = {f"r{k}": {"reactants": {"food", "food" if k == 0 else f"m{k}"}, "catalysts": {f"m{(k + 2) % 3}"}, "products": {f"m{k + 1}"}} for k in range(3)}
    table["r2"]["products"] = {"m0"}
    table["odd"] = {"reactants": {"missing"}, "catalysts": {"food"}, "products": {"z"}}
    assert detectors.raf_closure(table, {"food"}) == {"r0", "r1", "r2"}
    rel = [("a", "b", "causes"), ("b", "c", "blocks")]
    assert detectors.best_mapping(rel, [("x", "y", "causes"), ("y", "z", "blocks")]) == 2
    assert detectors.best_mapping(rel, [("x", "y", "causes"), ("z", "y", "blocks")]) == 1
    roles = [{"a": 1, "b": 1, "c": 2}, {"x": 1, "y": 1, "z": 3}]
    assert detectors.best_mapping(rel, [("x", "y", "causes"), ("y", "z", "blocks")], *roles) == 1
    two = [("a", "b", "causes"), ("b", "a", "causes"), ("a", "a", "blocks")]
    assert detectors.best_mapping(two, [("x", "y", "causes")]) == 0 and detectors.best_mapping(two, two) == 2 and detectors.best_mapping([], two) == 0
    assert len(detectors.null_graph(20, pairs, "erdos", 1)) == len(pairs)
    degrees = lambda es: sorted(np.bincount(np.array(es).ravel()))
    assert degrees(detectors.null_graph(20, pairs, "configuration", 1)) == degrees(pairs)
    assert detectors.precision_at(list("abcdefghijk"), {"a", "k"}, 10) == 0.1


def test_layout():
    points = np.array([[0, 0], [0, 1], [10, 0], [10, 1], [5, 9], [5, 8]], float)
    label = layout.kmeans(points)
    assert label[0] == label[1] and label[2] == label[3] and label[4] == label[5] and len(set(label)) == 3
    assert layout.convex_hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    x = layout.force_layout(2, [], 50)
    start = layout.force_layout(2, [], 0)
    assert np.hypot(*(x[0] - x[1])) > np.hypot(*(start[0] - start[1]))


def test_highlight():
    text = "Été one  Two three four"
    a, b = find_snippet(text, "two THREE")
    assert text.encode()[a:b].decode() == "Two three"
    a, b = find_snippet(text, "three five")
    assert "three" in text.encode()[a:b].decode()
    assert find_snippet(text, "nothing like it") is None and find_snippet(None, "x") is None


def test_expressions(spark):
    d = spark.createDataFrame([(None, ["strong"], "2001"), (9, ["strong_evidence", "weak"], "x")], "c int, s array<string>, y string")
    got = d.select(relational.node_radius(F.col("c")), relational.strength_radius(F.col("s")), relational.in_years(F.col("y"), 1990, 2000)).collect()
    assert tuple(got[0]) == (4.0, 2.0, False) and got[1][1:] == (3.0, True)
    long = spark.createDataFrame([("x" * 61,), ("x" * 60,)], "t string").select(F.length(relational.shortened(F.col("t")))).collect()
    assert [r[0] for r in long] == [60, 60]


def test_verification_and_mining(spark):
    s = spark.createDataFrame([(1, 10, 0.9, False), (1, 11, 0.8, True), (1, 12, 0.7, True), (2, 10, 0.1, True), (2, 11, 0.2, True), (2, 12, 0.3, False)], "query_id int, cand_id int, score double, pruned boolean")
    truth = spark.createDataFrame([(1, 10), (2, 10)], "query_id int, cand_id int")
    r = evaluate.cascade_recall(s, truth).first()
    assert (r.recall_all, r.recall_pruned, r.passes) == (1.0, 0.5, True)
    c = spark.range(1).select(evaluate.cas_verify(F.lit(0.2), F.lit(2), F.lit(0.3)).alias("c"))
    got = c.select(*[evaluate.pruned(F.col("c"), m) for m in ("conservative", "aggressive", "headline")]).first()
    assert tuple(got) == (False, True, False)
    refs = spark.createDataFrame([("b1", "p1", "x"), ("b1", "p2", "x"), ("b1", "p3", "y"), ("b2", "p1", "x"), ("b2", "p4", "z"), ("b3", "p9", "x")], "bridge string, paper string, field string")
    assert rows(evaluate.mine_pairs(refs), "bridge") == [("b1", "p1", "p3")]
    cards = spark.createDataFrame([(1, 2, 0.5, False, True), (1, 3, 0.4, True, False), (2, 3, 0.41, False, True), (2, 4, 0.4, True, False)], "query_id int, cand_id int, cosine double, same_field boolean, is_true boolean")
    assert {r.query_id: r.card for r in evaluate.objective_cards(cards).collect()} == {1: True, 2: False}


def test_annotations_and_clusters(spark):
    from litforge.sources import payloads

    good = '{"paper_type":"review","methods":[],"findings":[],"open_problems":["p"]}'
    a = spark.createDataFrame([(1, "q", good), (2, "q", "not json"), (3, "q", '{"paper_type":"x"}')], "id int, prompt string, answer string")
    assert rows(payloads.annotations(a).select("id"), "id") == [(1,)]
    ask = F.pandas_udf(lambda s: pd.Series([good] * len(s)), "string")
    assert payloads.annotations(a, ask).count() == 3
    c = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1)], "graph int, id int, cluster long")
    k = spark.createDataFrame([(1, "b", 1.0), (2, "a", 0.5), (2, "b", 0.1), (3, "a", 1.0), (3, "c", 1.0)], "id int, keyword string, score double")
    assert rows(layout.cluster_keywords(c, k), "cluster") == [(1, 0, "b"), (1, 1, "a")]


def test_layout_as_edge_by_edge():
    """Springs of all edges at once give bit for bit what one after the other gives, and sooner."""
    n, rng = 40, np.random.default_rng(1)
    pairs = sorted({(min(p), max(p)) for p in rng.integers(0, n, (90, 2)).tolist() if p[0] != p[1]})

    def plain(ticks):
        rng = np.random.default_rng(0)
        angle = 2 * np.pi * np.arange(n) / n
        x = np.stack((np.cos(angle), np.sin(angle)), axis=1) * 10 * math.sqrt(n) + rng.normal(0, 0.01, (n, 2))
        v, alpha = np.zeros((n, 2)), 1.0
        degree = np.bincount(np.array(pairs).reshape(-1), minlength=n).clip(1)
        for _ in range(ticks):
            d = x[:, None] - x[None]
            force = 300.0 * (d / ((d**2).sum(axis=2) + 1.0)[..., None]).sum(axis=1)
            for a, b in pairs:
                gap = x[b] - x[a]
                length = max(float(np.hypot(*gap)), 1e-6)
                pull = 0.1 * (length - 60.0) * gap / length
                force[a] += pull / degree[a]
                force[b] -= pull / degree[b]
            v = np.clip((v + alpha * force) * 0.6, -200, 200)
            x = x + alpha * v * 0.1
            alpha *= 0.995
        return x

    began = time.process_time()
    want = plain(60)
    slow, began = time.process_time() - began, time.process_time()
    got = layout.force_layout(n, pairs, 60)
    assert (got == want).all() and time.process_time() - began < slow / 2
    assert layout.force_layout(3, []).shape == (3, 2)


def test_tag_sets_meet_by_class(spark, monkeypatch):
    """Pairs are made by the last join alone, after which nothing is dealt out."""
    rows_ = [(i, t) for i in range(40) for t in "abcd"[: i % 3 + 1]] + [(99, "z"), (98, None)]
    monkeypatch.setattr(corpus, "BLOCK", 5)
    out = corpus.set_cosine(spark.createDataFrame(rows_, "doc_id int, tag string"))
    got = {(r.a, r.b): r.score for r in out.collect()}
    df = {t: sum(u == t for _, u in rows_) for t in "abcz"}
    vec = {i: {t: math.log(43 / (1 + df[t])) + 1 for j, t in rows_ if j == i and t} for i in [*range(40), 99]}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    want = {(a, b): sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) / norm[a] / norm[b] for a in vec for b in vec if a < b}
    want = {p: s for p, s in want.items() if s}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in got)
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Project"  # no aggregate over pairs


def test_shared_by_given_pairs(spark):
    w = spark.createDataFrame([(i, t, x) for i, t, x in [(1, "b", 1.0), (1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.6), (3, "a", 0.1)]], "doc_id int, term string, weight double")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert rows(corpus.shared_by(pairs, w, 0.5), "a") == [(1, 2, ["a", "b"]), (2, 3, None)]


def test_layouts_stay_dealt(spark):
    """Small graphs are few bytes, and still go to several tasks."""
    e = spark.createDataFrame([(g, 0, 1) for g in range(40)], "graph int, src int, dst int")
    out = layout.layouts(e, 1).withColumn("task", F.spark_partition_id())
    assert len({r.task for r in out.collect()}) > 3
