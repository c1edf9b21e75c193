"""Graph queries over the citation graph of parts, and detectors over small graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.functions import text as T
from litforge.operators import corpus, detectors, graph, layout, queue, relational
from litforge.plans import corpus_queries, table_queries
from litforge.plans.registry import register
from litforge.session import shared_dir, table

R = T.rounded
CITES_SQL = table_queries.CITES_SQL
r_sql = table_queries.r_sql


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table_queries.citations(spark, d).select("src", "dst")


@register("bfs_depth", f"WITH RECURSIVE {CITES_SQL}, e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM cites UNION ALL SELECT dst, src FROM cites)), r(id, depth) USING KEY (id) AS (SELECT (SELECT min(src) FROM cites) AS id, 0 AS depth UNION SELECT e.dst, min(r.depth) + 1 FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r AS seen ON seen.id = e.dst WHERE seen.id IS NULL GROUP BY e.dst) SELECT id, depth::INTEGER AS depth FROM r")
def bfs_depth(spark, d):
    e = edges(spark, d)
    return graph.bfs(e, e.agg(F.min("src").alias("id")), directed=False)


@register("bfs_citations", f"WITH RECURSIVE {CITES_SQL}, e AS (SELECT DISTINCT src, dst FROM cites), r AS (SELECT (SELECT min(src) FROM cites) AS id, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT DISTINCT src, dst FROM cites JOIN m ON m.id = src WHERE depth < 3")
def bfs_citations(spark, d):
    e = edges(spark, d)
    reached = graph.bfs(e, e.agg(F.min("src").alias("id")), 3)
    return graph.bfs_edges(e.distinct(), reached, 3)


COMPONENTS_SQL = "e AS (SELECT src, dst FROM cites UNION SELECT dst, src FROM cites), r(id, c) USING KEY (id) AS (SELECT p_partkey AS id, p_partkey AS c FROM part UNION SELECT e.dst AS id, min(r.c) AS c FROM r JOIN e ON e.src = r.id JOIN recurring.r AS old ON old.id = e.dst WHERE r.c < old.c GROUP BY e.dst)"


@register("connected_components", f"WITH RECURSIVE {CITES_SQL}, {COMPONENTS_SQL} SELECT id, c AS component FROM r")
def connected_components(spark, d):
    return graph.connected_components(edges(spark, d), nodes(spark, d))


@register("component_report", f"WITH RECURSIVE {CITES_SQL}, {COMPONENTS_SQL}, s AS (SELECT c, count(*) AS size FROM r GROUP BY c), m AS (SELECT count(*) AS m FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM cites WHERE src <> dst)) SELECT count(*) AS n_cc, max(size) AS largest, count(*) FILTER (size = 1) AS isolated, {r_sql('2.0 * (SELECT m FROM m) / sum(size)')} AS mean_degree, count(*) / sum(size) <= 0.05 AS passes FROM s")
def component_report(spark, d):
    e = edges(spark, d)
    out = graph.component_report(graph.connected_components(e, nodes(spark, d)), e)
    return out.withColumn("mean_degree", R(F.col("mean_degree")))


@register("giant_component", f"WITH RECURSIVE {CITES_SQL}, {COMPONENTS_SQL} SELECT id FROM r WHERE c = (SELECT c FROM r GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)")
def giant_component(spark, d):
    return graph.giant_component(graph.connected_components(edges(spark, d), nodes(spark, d)))


PAGERANK_SQL = (
    f"WITH RECURSIVE {CITES_SQL}, e AS (SELECT DISTINCT src, dst FROM cites), o AS (SELECT src, count(*) AS out FROM e GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM part), "
    "p(i, id, r) AS (SELECT 0, p_partkey, 1 / n FROM part, n UNION ALL SELECT i + 1, id, r FROM (SELECT c.i, c.id, 0.15 / n + 0.85 * (coalesce(g.s, 0) + l.lost / n) AS r FROM p c, n, "
    "(SELECT coalesce(sum(q.r), 0) AS lost FROM p q ANTI JOIN o ON o.src = q.id) l LEFT JOIN (SELECT e.dst, sum(q.r / o.out) AS s FROM p q JOIN e ON e.src = q.id JOIN o ON o.src = e.src GROUP BY e.dst) g ON g.dst = c.id WHERE c.i < 50))"
)


@register("pagerank", PAGERANK_SQL + f" SELECT id, {r_sql('1000 * r')} AS pagerank FROM p WHERE i = 50")
def pagerank(spark, d):
    return graph.pagerank(edges(spark, d), nodes(spark, d)).select("id", R(1000 * F.col("pagerank")).alias("pagerank"))


@register("betweenness", None)
def betweenness(spark, d):
    return graph.betweenness(edges(spark, d), nodes(spark, d)).select("id", R(F.col("betweenness")).alias("betweenness"))


@register("communities", None)
def communities(spark, d):
    return graph.communities(edges(spark, d), nodes(spark, d))


MEMBERS_SQL = "m AS (SELECT p_partkey AS id, p_partkey % 7 AS community_id FROM part)"


def members(spark, d):
    return nodes(spark, d).withColumn("community_id", F.col("id") % 7)


@register("inner_degree", f"WITH {CITES_SQL}, {MEMBERS_SQL}, s AS (SELECT src, dst FROM cites JOIN m x ON x.id = src JOIN m y ON y.id = dst WHERE x.community_id = y.community_id), n AS (SELECT id, count(*) AS intra FROM (SELECT src AS id FROM s UNION ALL SELECT dst FROM s) GROUP BY id) SELECT m.id, coalesce(intra, 0) AS intra FROM m LEFT JOIN n USING (id)")
def inner_degree(spark, d):
    return graph.inner_degree(edges(spark, d), members(spark, d))


@register("community_sizes", "SELECT source AS community, count(*) AS size, count(*) < 3 AS merged, (row_number() OVER (ORDER BY count(*) DESC, source) - 1)::INTEGER AS color_index FROM documents GROUP BY source")
def community_sizes(spark, d):
    sizes = table(spark, d, "documents").groupBy(F.col("source").alias("community")).agg(F.count("*").alias("size"))
    return sizes.select("community", "size", (F.col("size") < 3).alias("merged"), (F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1).alias("color_index"))


@register("shared_in_community", f"WITH {corpus_queries.TF_SQL}, h AS (SELECT source, term, count(*) AS m FROM weights JOIN documents USING (doc_id) WHERE weight >= 0.05 GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, m * (m - 1) // 2 AS pairs, row_number() OVER (PARTITION BY source ORDER BY m DESC, term) AS rank FROM h) SELECT source, rank::INTEGER AS rank, term, pairs FROM r WHERE rank <= 8")
def shared_in_community(spark, d):
    m = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("community_id"))
    return graph.shared_in_community(corpus_queries.weights(spark, d), m).withColumnRenamed("community_id", "source")


def small_parts(spark, d):
    """Sections and edges of documents, linked to half their id."""
    s = corpus_queries.sections(spark, d)
    e = s.select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))
    return s, e, s.select(F.col("doc_id").alias("id"))


def source_members(s: DataFrame) -> DataFrame:
    """Six communities by the number in the source's name."""
    return s.select(F.col("doc_id").alias("id"), F.coalesce(F.substring("source", 4, 9).try_cast("bigint") % 6, F.lit(0)).cast("bigint").alias("community_id"))


TREE_SQL = (
    "e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents), m AS (SELECT doc_id, coalesce(try_cast(substr(source, 4, 9) AS BIGINT) % 6, 0) AS community_id FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents), "
    "p(i, id, r) AS (SELECT 0, doc_id, 1 / n FROM documents, n UNION ALL SELECT i + 1, id, 0.15 / n + 0.85 * coalesce(g.s, 0) FROM p c CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(q.r) AS s FROM p q JOIN e ON e.src = q.id GROUP BY e.dst) g ON g.dst = c.id WHERE c.i < 50)"
)


@register(
    "community_summary",
    f"WITH RECURSIVE {corpus_queries.TF_SQL}, {TREE_SQL}, i AS (SELECT id, count(*) AS intra FROM (SELECT src AS id FROM e JOIN m x ON x.doc_id = src JOIN m y ON y.doc_id = dst WHERE x.community_id = y.community_id UNION ALL SELECT dst FROM e JOIN m x ON x.doc_id = src JOIN m y ON y.doc_id = dst WHERE x.community_id = y.community_id) GROUP BY 1), "
    "best AS (SELECT community_id, p.id, row_number() OVER (PARTITION BY community_id ORDER BY floor(r * (coalesce(intra, 0) + 1) * 1e12 + 0.5) DESC, p.id) AS rank FROM p JOIN m ON m.doc_id = p.id LEFT JOIN i ON i.id = p.id WHERE p.i = 50), "
    "sizes AS (SELECT community_id, count(*) AS size FROM m GROUP BY 1), s AS (SELECT community_id, term, sum(tf) AS s FROM tf JOIN m USING (doc_id) GROUP BY 1, 2), d2 AS (SELECT term, count(*) AS df FROM s GROUP BY 1), "
    "sc AS (SELECT community_id, term, row_number() OVER (PARTITION BY community_id ORDER BY floor(s / size * (ln((SELECT count(*) FROM sizes) / df::DOUBLE) + 1) * 1e9 + 0.5) DESC, term) AS rank FROM s JOIN sizes USING (community_id) JOIN d2 USING (term)), "
    "w AS (SELECT community_id, string_agg(term, ',' ORDER BY rank) AS keywords, string_agg(term, ' ' ORDER BY rank) FILTER (rank <= 2) AS label FROM sc WHERE rank <= 10 GROUP BY 1), t AS (SELECT community_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS top_papers FROM best WHERE rank <= 5 GROUP BY 1) "
    "SELECT community_id, (row_number() OVER (ORDER BY size DESC, community_id) - 1)::INTEGER AS color_index, size, label, keywords, top_papers FROM sizes JOIN w USING (community_id) JOIN t USING (community_id)",
)
def community_summary(spark, d):
    s, e, n = small_parts(spark, d)
    out = graph.community_summary(source_members(s), graph.pagerank(e, n), e, corpus.section_tf(s))
    return out.select("community_id", "color_index", "size", "label", F.array_join("keywords", ",").alias("keywords"), F.array_join(F.transform("top_papers", lambda x: x.cast("string")), ",").alias("top_papers"))


@register("graph_export", None)
def graph_export(spark, d):
    s, e, n = small_parts(spark, d)
    return graph.export_graph(source_members(s), corpus.top_terms(corpus_queries.weights(spark, d, top=5), 5), e, "corpus")


@register("graph_metrics", None)
def graph_metrics(spark, d):
    out = graph.metrics(edges(spark, d), nodes(spark, d))
    return out.select("id", R(F.col("pagerank")).alias("pagerank"), R(F.col("betweenness")).alias("betweenness"))


def ladder_graphs(spark, d):
    """Small graphs of all customers: those of a nation in blocks of up to forty, each in two rings with one bridge.

    A customer who is the only one of a nation has no edge and so stands in no graph.
    """
    nation = Window.partitionBy("c_nationkey")
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    c = c.withColumn("n", F.row_number().over(nation.orderBy("c_custkey")) - 1).withColumn("all", F.count("*").over(nation))
    blocks = F.ceil(F.col("all") / 40)
    c = c.select(F.concat_ws("/", "c_nationkey", (F.col("n") % blocks).cast("string")).alias("graph"), F.floor(F.col("n") / blocks).alias("n"))
    c = c.withColumn("size", F.count("*").over(Window.partitionBy("graph"))).withColumn("half", F.floor(F.col("size") / 2))
    first = F.when(F.col("n") < F.col("half"), F.lit(0)).otherwise(F.col("half"))
    length = F.when(F.col("n") < F.col("half"), F.col("half")).otherwise(F.col("size") - F.col("half"))
    ring = c.select("graph", F.col("n").alias("src"), first.alias("first"), length.alias("length"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    ring = ring.select("graph", "src", (F.col("first") + (F.col("src") - F.col("first") + F.col("k")) % F.col("length")).alias("dst")).filter("src <> dst").distinct()
    bridge = c.filter("n = 0 AND half > 0").select("graph", F.lit(0).cast("bigint").alias("src"), F.col("half").alias("dst"))
    return ring.unionByName(bridge)


@register("kuramoto_bridges", None)
def kuramoto_bridges(spark, d):
    return detectors.kuramoto_bridges(ladder_graphs(spark, d), coupling=8.0).withColumn("gap", R(F.col("gap"), 4)).withColumn("order_parameter", R(F.col("order_parameter"), 4))


@register("sheaf_bridges", None)
def sheaf_bridges(spark, d):
    e = ladder_graphs(spark, d)
    ids = e.select("graph", F.explode(F.array("src", "dst")).alias("id")).distinct()
    terms = ids.select("graph", "id", F.explode(F.array((F.col("id") % 3).cast("string"), F.lit("common"))).alias("term"))
    return detectors.sheaf_bridges(terms, e).withColumn("score", R(F.col("score"), 4))


def reactions(spark, d):
    """Reactions of each nation's customers: two chains that begin with food, one reaction that needs both, and one without a catalyst."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("source")).agg(F.count("*").alias("n"))
    name = lambda *x: F.concat("source", F.lit("/"), *[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    steps = c.select("source", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"), F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(6)).cast("int"))).alias("k"))
    side, k = F.col("side"), F.col("k")
    chain = steps.select(name("r", side, k).alias("id"), F.array(F.when(k == 0, F.lit("food")).otherwise(name(side, k))).alias("reactants"), F.array(F.when(k == 0, F.lit("food")).otherwise(name(side, F.lit("1")))).alias("catalysts"), F.array(name(side, k + 1)).alias("products"), "source")
    both = c.select(name("x").alias("id"), F.array(name("a2"), name("b2")).alias("reactants"), F.array(name("a1")).alias("catalysts"), F.array(name("y")).alias("products"), "source")
    none = c.select(name("z").alias("id"), F.array(F.lit("food")).alias("reactants"), F.array(F.lit("none")).alias("catalysts"), F.array(name("w")).alias("products"), "source")
    return chain.unionByName(both).unionByName(none)


SIDES_SQL = "c AS (SELECT c_nationkey::VARCHAR AS source, least(count(*), 6) AS n FROM customer GROUP BY 1), s AS (SELECT source, unnest(['a', 'b']) AS side, n FROM c), r AS (SELECT source, (side = 'b')::BIGINT AS raf, source || '/r' || side || k AS id FROM (SELECT source, side, unnest(range(0, n + 1)) AS k FROM s) UNION ALL SELECT source, (side = 'b')::BIGINT, source || '/x' FROM s)"


@register("raf_sets", f"WITH {SIDES_SQL} SELECT source, raf, id FROM r")
def raf_sets(spark, d):
    return detectors.raf_sets(reactions(spark, d), ["food"])


@register("raf_closure", f"WITH {SIDES_SQL} SELECT DISTINCT source, id FROM r")
def raf_closure(spark, d):
    return detectors.closed_reactions(reactions(spark, d), ["food"]).select("source", "id")


@register("raf_bridges", f"WITH {SIDES_SQL} SELECT source, id, '0,1' AS rafs FROM r GROUP BY source, id HAVING count(*) > 1")
def raf_bridges(spark, d):
    out = detectors.raf_bridges(detectors.raf_sets(reactions(spark, d), ["food"]))
    return out.select("source", "id", F.array_join(F.transform("rafs", lambda x: x.cast("string")), ",").alias("rafs"))


@register("raf_contractions", f"WITH {SIDES_SQL} SELECT source, source || '/x' AS id, raf, 1::BIGINT AS lost FROM r GROUP BY source, raf")
def raf_contractions(spark, d):
    return detectors.raf_contractions(reactions(spark, d), ["food"])


@register("structure_scores", None)
def structure_scores(spark, d):
    """Relations of customers' orders matched between customers of one nation that follow each other."""
    o = table(spark, d, "orders").select("o_custkey", F.struct(F.lit("c").alias("src"), F.col("o_orderpriority").alias("dst"), F.col("o_orderstatus").alias("type")).alias("rel"))
    rel = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("rel")).alias("a")).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    w = Window.partitionBy("c_nationkey").orderBy("o_custkey")
    pairs = rel.select(F.col("o_custkey").alias("query_id"), F.lead("o_custkey").over(w).alias("cand_id"), "a", F.lead("a").over(w).alias("b")).filter("b IS NOT NULL")
    roles = lambda c: F.map_from_entries(F.array_distinct(F.flatten(F.transform(c, lambda r: F.array(F.struct(r["src"].alias("k"), F.lit("customer").alias("v")), F.struct(r["dst"].alias("k"), F.lit("priority").alias("v")))))))
    return detectors.structure_scores(pairs.withColumns({"roles_a": roles("a"), "roles_b": roles("b")}))


@register("position_clusters", None)
def position_clusters(spark, d):
    return layout.clusters(table(spark, d, "customer").select(F.col("c_nationkey").alias("graph"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y")))


@register("force_layout", None)
def force_layout(spark, d):
    out = layout.layouts(ladder_graphs(spark, d))
    return out.select("graph", "id", R(F.col("x"), 3).alias("x"), R(F.col("y"), 3).alias("y"))


@register("crawl", f"WITH RECURSIVE {CITES_SQL}, e AS (SELECT DISTINCT src, dst FROM cites), r AS (SELECT min(src::VARCHAR)::BIGINT AS id, 0 AS depth FROM cites UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 4) SELECT id::VARCHAR AS paper_id, min(depth)::INTEGER AS depth_level, 'done' AS status, 0 AS retry_count FROM r GROUP BY id")
def crawl(spark, d):
    e = edges(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    seed = e.agg(F.min("src")).first()[0]
    return queue.crawl(e, nodes(spark, d).select(F.col("id").cast("string").alias("id")), seed, 3)[0].select("paper_id", "depth_level", "status", "retry_count")


@register("order_parameter", f"SELECT {r_sql('sqrt(pow(avg(cos(value)), 2) + pow(avg(sin(value)), 2))')} AS order_parameter FROM events")
def order_parameter(spark, d):
    return relational.order_parameter(table(spark, d, "events").select(F.col("value").alias("theta"))).select(R(F.col("order_parameter")).alias("order_parameter"))


@register("streamed_counts", f"SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, {r_sql('sum(value)')} AS value FROM events GROUP BY 1, 2")
def streamed_counts(spark, d):
    """The events table read as a stream until it is read up; windows by the hour."""
    import uuid

    from litforge.streaming import progress

    rows = progress.read_events(spark, f"{d}/events.parquet*", schema=table(spark, d, "events").schema)
    counts = progress.run_available(progress.windowed_counts(rows), f"{shared_dir(spark)}/litforge/stream-{uuid.uuid4().hex}")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", R(F.col("value")).alias("value"))
