"""Registered queries without a SQL twin, on small tables."""

import hashlib

import pytest

from litforge.plans import corpus_queries, graph_queries, lookup_queries


@pytest.fixture
def citing(spark, tmp_path):
    """Orders 1 and 3 make the edges 1 -> 2 -> 3 and 3 -> 4; order 20 makes 4 -> 5."""
    lines = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (3, 1, 3), (3, 2, 4), (20, 1, 4), (20, 2, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 13)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_all_orders_cite(spark, citing):
    # On the path 1 .. 5 node 2 lies between 1 x 3 pairs, 3 between 2 x 2 and 4 between 3 x 1, of 11 x 10.
    want = {2: 3 / 110, 3: 4 / 110, 4: 3 / 110}
    for name in (graph_queries.betweenness, graph_queries.graph_metrics):
        got = {r.id: r.betweenness for r in name(spark, citing).collect()}
        assert got == {i: pytest.approx(want.get(i, 0), abs=1e-6) for i in range(1, 13)}
    ranks = [(r.id, r.pagerank) for r in lookup_queries.top_pagerank(spark, citing).collect()]
    assert [i for i, _ in ranks[:5]] == [5, 4, 3, 2, 1] and ranks[3][1] == pytest.approx(1.85 * ranks[4][1], abs=1e-5)
    assert {(r.paper_id, r.depth_level) for r in graph_queries.crawl(spark, citing).collect()} == {("1", 0), ("2", 1), ("3", 2), ("4", 3), ("5", 4)}
    found = {r.id: r.community_id for r in graph_queries.communities(spark, citing).collect()}
    assert found[1] == found[2] and found[1] < graph_queries.graph.OTHER


def test_sections_hold_whole_texts(spark, tmp_path):
    text = "alpha\n\n\n\n\nzeppelin zeppelin"
    spark.createDataFrame([(1, text, "en", "src"), (2, "alpha", "en", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    labels = lookup_queries.community_labels(spark, d).collect()
    assert any("zeppelin" in str(r) for r in labels)
    assert any("zeppelin" in r.json for r in graph_queries.graph_export(spark, d).collect())
    assert any("zeppelin" in r.keywords for r in graph_queries.community_summary(spark, d).collect())
    want = "\n\n".join(f"## {k}\n{v}" for k, v in zip(corpus_queries.SECTIONS, ["alpha", "[EMPTY]", "[EMPTY]", "[EMPTY]", "\nzeppelin zeppelin"], strict=True))
    assert {r.doc_id: r.prompt_sha for r in lookup_queries.prompt_lengths(spark, d).collect()}[1] == hashlib.sha256(want.encode()).hexdigest()


def test_labels_do_not_carry_sections(spark, tmp_path, monkeypatch):
    """No word's row in the sums of a source holds all words of its section: executors ran out of memory by that."""
    texts = [(1, "alpha beta beta\ngamma", "en", "a"), (2, "alpha\n\n\n\n\ndelta delta", "en", "b"), (3, None, "en", "b")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = [], lookup_queries.corpus.materialize
    monkeypatch.setattr(lookup_queries.corpus, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan()) or write(df, name))
    labels = {r.community_id: r.label for r in lookup_queries.community_labels(spark, str(tmp_path)).collect()}
    # a: beta 4/3 and gamma 1/2 of 5/2, times ln(2) + 1, alpha 2/3; b: alpha 2 and delta 1/2 of 5/2, over two papers.
    assert labels == {"a": "beta gamma", "b": "alpha delta"}
    found = []
    while plans:
        node = plans.pop()
        plans.extend(map(node.children().apply, range(node.children().size())))
        if node.nodeName() == "Generate":
            types = [node.output().apply(i).dataType().catalogString() for i in range(node.output().size())]
            found.append(("string" in [node.generatorOutput().apply(i).dataType().catalogString() for i in range(node.generatorOutput().size())], any("array" in t for t in types)))
    assert [arrays for words, arrays in found if words] == [False]


def test_ladders_hold_all_customers(spark, tmp_path):
    sizes = {1: 95, 2: 41, 3: 40, 4: 7, 5: 3, 6: 2}
    rows = [(100 * n + i, n) for n, m in sizes.items() for i in range(m)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found: dict = {}
    for r in graph_queries.ladder_graphs(spark, str(tmp_path)).collect():
        assert r.src != r.dst
        found.setdefault(r.graph, []).append((r.src, r.dst))
    held: dict = {}
    for g, edges in found.items():
        ids = {i for e in edges for i in e}
        assert ids == set(range(len(ids))) and len(ids) <= 40 and len(edges) == len(set(edges))
        half = len(ids) // 2
        assert [(a, b) for a, b in edges if (a < half) != (b < half)] == [(0, half)]
        n = int(g.split("/")[0])
        held[n] = held.get(n, 0) + len(ids)
    assert held == sizes


def test_all_relations_are_matched(spark, tmp_path):
    kinds = [(p, s) for p in "12345" for s in "FO"]
    orders = [(5 * i + 1, c, p, s) for c in (1, 2) for i, (p, s) in enumerate(kinds)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1), (2, 1)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = []

    def score(pairs):
        got.extend(pairs.collect())
        return pairs

    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph_queries.detectors, "structure_scores", score)
        graph_queries.structure_scores(spark, str(tmp_path))
    assert [(r.query_id, r.cand_id) for r in got] == [(1, 2)]
    for rels in (got[0].a, got[0].b):
        assert sorted((r.dst, r.type) for r in rels) == kinds


def test_production_parameters(spark, citing, tmp_path):
    edges = graph_queries.edges(spark, citing)
    want = {r.id: r.pagerank for r in graph_queries.graph.pagerank(edges, graph_queries.nodes(spark, citing), 50).collect()}
    got = {r.id: r.pagerank for r in graph_queries.graph_metrics(spark, citing).collect()}
    assert got == {i: pytest.approx(x, abs=1e-6) for i, x in want.items()}
    text = "a" * 2999 + "\n" + "b" * 3001
    spark.createDataFrame([(1, text, "en", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = {"abstract": "a" * 2999, "introduction": "b" * 3000 + "[truncated]"}
    want = "\n\n".join(f"## {k}\n{parts.get(k, '[EMPTY]')}" for k in corpus_queries.SECTIONS)
    assert lookup_queries.prompt_lengths(spark, str(tmp_path)).first().prompt_sha == hashlib.sha256(want.encode()).hexdigest()
    spark.createDataFrame([(i, 1) for i in range(9)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = {r.id: (r.x, r.y) for r in graph_queries.layout.layouts(graph_queries.ladder_graphs(spark, str(tmp_path)), 300).collect()}
    assert {r.id: (r.x, r.y) for r in graph_queries.force_layout(spark, str(tmp_path)).collect()} == {i: pytest.approx(p, abs=1e-3) for i, p in want.items()}


def test_long_part_keys(spark, tmp_path):
    """Six-digit keys share ids by SQL, and no part is lost by that."""
    import duckdb

    from litforge.plans import registry, source_queries

    keys = [4, 5, 10000, 10001, 10002, 100000, 100001, 100002, 100003, 100004]
    parts = [(k, f"n{k}", "b", "t", 1 + k % 2) for k in keys]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("local_source", "catalog_papers"):
        found = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        got = registry.queries()[name](spark, str(tmp_path))
        assert dict(got.dtypes)[columns[-1]] == "bigint"
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())
