"""Relational queries: parts are papers, lines of one order that follow each other cite; events are annotations and queue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.functions import text as T
from litforge.operators import queue, relational
from litforge.plans.registry import register
from litforge.session import table

R = T.rounded


def r_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Edges (src, dst, l_orderkey): the part on an order's line cites that on the next."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), "l_orderkey").filter("dst IS NOT NULL")


CITES_SQL = "cites AS (SELECT src, dst, l_orderkey FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst, l_orderkey FROM lineitem) WHERE dst IS NOT NULL)"


def papers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("citation_count"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


@register("cited_papers", f"WITH {CITES_SQL} SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (SELECT dst FROM cites WHERE src = (SELECT min(src) FROM cites))")
def cited_papers(spark, d):
    e = citations(spark, d)
    return relational.cited_by(papers(spark, d), e, e.agg(F.min("src")).first()[0]).select("id", "title")


@register("citing_papers", f"WITH {CITES_SQL} SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (SELECT src FROM cites WHERE dst = (SELECT min(dst) FROM cites))")
def citing_papers(spark, d):
    e = citations(spark, d)
    return relational.citing(papers(spark, d), e, e.agg(F.min("dst")).first()[0]).select("id", "title")


@register("resolved_edges", f"WITH {CITES_SQL}, known AS (SELECT p_partkey AS id FROM part WHERE p_size > 10) SELECT src, dst FROM cites WHERE src IN (FROM known) AND dst IN (FROM known)")
def resolved_edges(spark, d):
    from litforge.operators import graph

    return graph.resolved(citations(spark, d), papers(spark, d).filter("citation_count > 10")).select("src", "dst")


@register("undirected_edges", f"WITH {CITES_SQL} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM cites")
def undirected_edges(spark, d):
    from litforge.operators import graph

    return graph.undirected(citations(spark, d))


@register("inserted_edges", f"WITH {CITES_SQL} SELECT src, dst FROM cites WHERE l_orderkey % 2 = 0 UNION ALL SELECT src, dst FROM cites WHERE l_orderkey % 2 <> 0 AND dst IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def inserted_edges(spark, d):
    """Edges of even orders are stored already, those of odd ones come in."""
    e = citations(spark, d)
    old, new = e.filter("l_orderkey % 2 = 0").select("src", "dst"), e.filter("l_orderkey % 2 <> 0").select("src", "dst")
    return relational.insert_edges(old, new, papers(spark, d).filter("citation_count > 20"))


@register("translated_references", f"WITH {CITES_SQL}, names AS (SELECT p_partkey AS work, 'P' || p_partkey AS id FROM part WHERE p_partkey % 3 <> 0) SELECT x.id AS src, y.id AS dst FROM cites JOIN names x ON x.work = src JOIN names y ON y.work = dst")
def translated_references(spark, d):
    works = citations(spark, d).groupBy(F.col("src").alias("work")).agg(F.collect_list("dst").alias("references"))
    names = papers(spark, d).filter("id % 3 <> 0").select(F.col("id").alias("work"), F.concat(F.lit("P"), F.col("id")).alias("id"))
    return relational.translate_ids(works, names)


@register("first_rows", "SELECT c_nationkey AS nation, c_custkey AS first_customer, c_acctbal AS balance FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def first_rows(spark, d):
    c = table(spark, d, "customer")
    return relational.dedup_first(c, F.col("c_nationkey"), F.desc("c_acctbal"), "c_custkey").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("first_customer"), F.col("c_acctbal").alias("balance"))


@register("upserted_customers", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'updated' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -s_suppkey - 1 AS id, 'new' FROM supplier")
def upserted_customers(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = c.filter("id % 10 = 0").withColumn("segment", F.lit("updated")).unionByName(table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.lit("new").alias("segment")))
    return relational.upsert(c, new, "id")


@register("current_rows", "SELECT c_custkey AS id, c_mktsegment AS corpus_fingerprint FROM customer WHERE c_mktsegment = 'BUILDING'")
def current_rows(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("corpus_fingerprint"))
    return relational.delete_stale(c, "BUILDING")[0]


@register("orders_in_period", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-03-01' AND '1996-06-30'")
def orders_in_period(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))
    return relational.in_period(o, "1995-03-01", "1996-06-30")


@register("paper_detail", f"WITH {CITES_SQL}, refs AS (SELECT src, count(*) AS n FROM cites GROUP BY src), cited AS (SELECT dst, count(*) AS n FROM cites GROUP BY dst) SELECT p_partkey AS id, p_name AS title, r.n AS n_references, c.n AS n_citations, coalesce(substr(NULL, 1, 4), '') AS year FROM part LEFT JOIN refs r ON r.src = p_partkey LEFT JOIN cited c ON c.dst = p_partkey")
def paper_detail(spark, d):
    e = citations(spark, d)
    refs, cited = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_references")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_citations"))
    return papers(spark, d).join(refs, "id", "left").join(cited, "id", "left").select("id", "title", "n_references", "n_citations", T.year_of(F.lit(None).cast("string")).alias("year"))


@register("method_matrix", "WITH e AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT x.event_type AS a, y.event_type AS b, sum(CASE WHEN x.event_type = y.event_type THEN x.c * (x.c + 1) // 2 ELSE x.c * y.c END)::BIGINT AS n FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type <= y.event_type GROUP BY 1, 2")
def method_matrix(spark, d):
    return relational.method_matrix(table(spark, d, "events"), "user_id", "event_id", "event_type")


@register("method_drilldown", "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase')")
def method_drilldown(spark, d):
    held = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("categories"))
    return held.filter(F.array_contains("categories", "click") & F.array_contains("categories", "purchase")).select("user_id")


@register("problem_ranking", "SELECT json_extract_string(props, '$.k') AS problem, count(*) AS n FROM events GROUP BY 1")
def problem_ranking(spark, d):
    return relational.problem_ranking(table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("problem")))


@register("repeated_lines", "WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS problem FROM documents) SELECT problem, count(*) AS n FROM l WHERE problem <> '' GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("problem")).filter("problem <> ''")
    return relational.problem_ranking(lines).filter("n > 1")


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Findings from events: clicks are contradictions, others bridges; confidence from the value."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "contradiction").otherwise("abc_bridge")
    return e.select(F.col("event_id"), kind.alias("gap_type"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("paper_ids"), (F.pmod(F.col("event_id"), F.lit(101)) / 100.0).alias("confidence"), F.col("props").alias("justification"))


GAPS_SQL = "gaps AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'contradiction' ELSE 'abc_bridge' END AS gap_type, user_id, (event_id % 101) / 100.0::DOUBLE AS confidence, props FROM events)"


@register("gap_filter", f"WITH {GAPS_SQL} SELECT event_id, gap_type FROM gaps WHERE gap_type = 'contradiction' AND floor(confidence * 100 + 0.5) >= 75")
def gap_filter(spark, d):
    return relational.gap_filter(gaps(spark, d), ["contradiction"], 75).select("event_id", "gap_type")


@register("gap_summary", f"WITH {GAPS_SQL} SELECT count(*) FILTER (gap_type = 'contradiction') AS contradictions, count(*) FILTER (gap_type = 'abc_bridge') AS bridges, (SELECT count(DISTINCT p) FROM (SELECT unnest([user_id, user_id + 1]) AS p FROM gaps)) AS papers FROM gaps")
def gap_summary(spark, d):
    return relational.gap_summary(gaps(spark, d))


@register("gap_report", f"WITH {GAPS_SQL}, t AS (SELECT CASE WHEN gap_type = 'contradiction' THEN 'Contradictions' ELSE 'Bridges' END AS section, confidence, user_id || ', ' || (user_id + 1) AS ids, props || props || props || props || props || props AS j FROM gaps), l AS (SELECT section, confidence, ids, rpad(ids, greatest(30, length(ids))::INTEGER, ' ') || '  ' || printf('%5.1f', confidence * 100) || '%  ' || rpad('k, ' || ids, greatest(30, length('k, ' || ids))::INTEGER, ' ') || '  ' || CASE WHEN length(j) > 60 THEN substr(j, 1, 57) || '...' ELSE j END AS text FROM t) SELECT section, row_number() OVER (PARTITION BY section ORDER BY confidence DESC, ids, text) AS line, text FROM l")
def gap_report(spark, d):
    g = gaps(spark, d)
    terms = F.concat(F.array(F.lit("k")), F.transform("paper_ids", lambda x: x.cast("string")))
    return relational.gap_report(g.withColumns({"justification": F.repeat("justification", 6), "shared_terms": terms}))


@register("edge_overlay", f"WITH {CITES_SQL}, {GAPS_SQL} SELECT kind, count(*) AS n FROM (SELECT 'citation' AS kind FROM cites UNION ALL SELECT gap_type FROM gaps UNION ALL SELECT 'similarity' FROM (SELECT DISTINCT src, dst FROM cites WHERE src < dst AND (src % 100) / 100.0 >= 0.15)) GROUP BY kind")
def edge_overlay(spark, d):
    e = citations(spark, d)
    g = gaps(spark, d).select(F.get("paper_ids", F.lit(0)).alias("a"), F.get("paper_ids", F.lit(1)).alias("b"), "gap_type", "confidence")
    near = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("src") % 100 / 100.0).alias("score"))
    return relational.edge_overlay(e, g, near).groupBy("kind").agg(F.count("*").alias("n"))


@register("dashboard", f"WITH {GAPS_SQL} SELECT (SELECT count(*) FROM part) AS papers, count(*) FILTER (gap_type = 'contradiction') AS contradictions, count(*) FILTER (gap_type = 'abc_bridge') AS bridges, count(DISTINCT props) AS open_problems, {r_sql('100.0 * (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity = 50) / (SELECT count(*) FROM part)')} AS method_percent FROM gaps")
def dashboard(spark, d):
    g = gaps(spark, d)
    methods = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("id"))  # parts sold by the fifty stand for papers with methods
    out = relational.dashboard(papers(spark, d), g, g.select(F.col("justification").alias("problem")), methods)
    return out.withColumn("method_percent", R(F.col("method_percent")))


@register("heat_buckets", f"WITH {CITES_SQL}, n AS (SELECT p_partkey, count(dst) AS n FROM part LEFT JOIN cites ON dst = p_partkey GROUP BY 1) SELECT CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 1 WHEN n <= 9 THEN 2 ELSE 3 END AS bucket, count(*) AS papers FROM n GROUP BY 1")
def heat_buckets(spark, d):
    n = citations(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return papers(spark, d).join(n, "id", "left").groupBy(relational.heat(F.coalesce("n", F.lit(0))).alias("bucket")).agg(F.count("*").alias("papers"))


@register("out_degree_seed", f"WITH {CITES_SQL} SELECT src AS seed, count(*) AS out_degree FROM cites GROUP BY src ORDER BY 2 DESC, 1 LIMIT 1")
def out_degree_seed(spark, d):
    n = citations(spark, d).groupBy(F.col("src").alias("seed")).agg(F.count("*").alias("out_degree"))
    return n.orderBy(F.desc("out_degree"), "seed").limit(1)


@register("paper_table", "SELECT p_partkey AS id, lower(p_name) AS title, coalesce(p_size, 0) AS citations, CASE WHEN p_size IS NULL THEN 'Pending' ELSE 'Analyzed' END AS status FROM part")
def paper_table(spark, d):
    p = papers(spark, d)
    status = F.when(F.col("citation_count").isNotNull(), "Analyzed").otherwise("Pending")
    return p.select("id", F.lower("title").alias("title"), F.coalesce("citation_count", F.lit(0)).alias("citations"), status.alias("status")).orderBy("title", F.desc("citations"), "id")


@register("node_view", f"SELECT p_partkey AS id, {r_sql('least(18.0, greatest(4.0, 2.5 * sqrt(p_size + 1)))')} AS radius, p_partkey = 1 OR p_size % 6 <= 2 AS visible, {r_sql('least(1.0, greatest(0.35, 0.35 + 0.65 * (p_size / 50.0)))')} AS opacity, ['#1', '#2', '#3'][(p_size % 3 + 1)::INTEGER] AS colour FROM part")
def node_view(spark, d):
    size = F.col("citation_count")
    return papers(spark, d).select(
        "id", R(relational.node_radius(size)).alias("radius"), relational.is_visible(0.5, size % 6, F.col("id") == 1).alias("visible"),
        R(relational.keyword_opacity(size / 50.0)).alias("opacity"), relational.node_color("community", ["#1", "#2", "#3"], size).alias("colour"),
    )


@register("year_bounds", "SELECT min(y)::INTEGER AS low, max(y)::INTEGER AS high FROM (SELECT year(o_orderdate) AS y FROM orders)")
def year_bounds(spark, d):
    return relational.year_bounds(table(spark, d, "orders").select(T.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year")))


@register("arc_angles", f"WITH w AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey AS ring, c_mktsegment AS topic, {r_sql('2 * 3.141592653589793 * (sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - n) / sum(n) OVER (PARTITION BY c_nationkey)')} AS start, {r_sql('2 * 3.141592653589793 * sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) / sum(n) OVER (PARTITION BY c_nationkey)')} AS stop FROM w")
def arc_angles(spark, d):
    w = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("ring"), F.col("c_mktsegment").alias("topic")).agg(F.count("*").alias("n"))
    return relational.arc_angles(w, "ring", "topic", "n").select("ring", "topic", R(F.col("start")).alias("start"), R(F.col("end")).alias("stop"))


@register("viewport", "SELECT min(o_totalprice) - 5.0 AS \"left\", min(o_custkey)::DOUBLE - 5.0 AS top, max(o_totalprice) + 5.0 AS \"right\", max(o_custkey)::DOUBLE + 5.0 AS bottom FROM orders")
def viewport(spark, d):
    return relational.bounding_box(table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y")), 5.0)


def crawl_queue(spark: SparkSession, d: str) -> DataFrame:
    """Queue rows from events: the kind gives the status, the user the depth."""
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ["pending", "fetching", "done", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    text = lambda c: F.lit(c).cast("string")
    return e.select(F.col("event_id").cast("string").alias("paper_id"), F.lit("seed").alias("seed_paper_id"), (F.col("user_id") % 5).cast("int").alias("depth_level"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("retry_count"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), text(None).alias("claimed_at"), text(None).alias("completed_at"), text(None).alias("source"))


QUEUE_SQL = "q AS (SELECT event_id::VARCHAR AS paper_id, (user_id % 5)::INTEGER AS depth_level, ['pending', 'fetching', 'done', 'failed'][(event_id % 4 + 1)::INTEGER] AS status, (event_id % 3)::INTEGER AS retry_count, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events)"


@register("queue_counts", f"WITH {QUEUE_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'fetching') AS fetching, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM q")
def queue_counts(spark, d):
    return queue.counts(crawl_queue(spark, d))


@register("queue_claims", f"WITH {QUEUE_SQL} SELECT paper_id, depth_level, created_at FROM q WHERE status = 'pending' ORDER BY depth_level, created_at, paper_id LIMIT 50")
def queue_claims(spark, d):
    return queue.next_pending(crawl_queue(spark, d), 50).select("paper_id", "depth_level", "created_at")


@register("queue_recovered", f"WITH {QUEUE_SQL} SELECT paper_id, CASE WHEN status = 'fetching' OR (status = 'failed' AND retry_count <= 1) THEN 'pending' ELSE status END AS status FROM q")
def queue_recovered(spark, d):
    return queue.retry_failed(queue.reset_stale(crawl_queue(spark, d))).select("paper_id", "status")


@register("queue_enqueued", f"WITH {QUEUE_SQL} SELECT paper_id, status FROM q UNION ALL SELECT 'n' || p_partkey, 'pending' FROM part")
def queue_enqueued(spark, d):
    new = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("n"), F.col("p_partkey"), F.lit("v2")), F.concat(F.lit("n"), F.col("p_partkey")))).alias("paper_id"), F.lit("seed").alias("seed_paper_id"), F.lit(1).alias("depth_level"))
    return queue.enqueue_if_absent(crawl_queue(spark, d), new, "2024-01-01T00:00:00").select("paper_id", "status")


@register("queue_level_claimed", f"WITH {QUEUE_SQL}, m AS (SELECT min(depth_level) AS m FROM q WHERE status = 'pending') SELECT paper_id, CASE WHEN status = 'pending' AND depth_level = m THEN 'fetching' ELSE status END AS status FROM q, m")
def queue_level_claimed(spark, d):
    return queue.claim_level(crawl_queue(spark, d), "2024-01-01T00:00:00").select("paper_id", "status")


@register("uncached_papers", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def uncached_papers(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("id")).distinct()
    return papers(spark, d).join(done, "id", "left_anti").select("id")


@register("concept_names", "SELECT p_partkey AS id, CASE WHEN replace(lower(p_type), ' ', '-') = 'standard-tin' THEN 'tin' ELSE replace(lower(p_type), ' ', '-') END AS concept FROM part")
def concept_names(spark, d):
    """Lowered, blanks as hyphens, known aliases replaced."""
    alias = spark.createDataFrame([("standard-tin", "tin")], "concept string, canonical string")
    p = papers(spark, d).select("id", F.replace(F.lower("kind"), F.lit(" "), F.lit("-")).alias("concept"))
    return p.join(F.broadcast(alias), "concept", "left").select("id", F.coalesce("canonical", "concept").alias("concept"))
