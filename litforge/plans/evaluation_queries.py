"""Evaluation queries: labels against scores, embeddings as retrieval, events as annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.functions import text as T
from litforge.operators import evaluate
from litforge.plans.registry import register
from litforge.session import table

R = T.rounded


def r_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", "lang", F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"), "quality", "toxic")


AUC_SQL = "s AS (SELECT lang, n_chars AS score, quality = 1 AS positive, quality, toxic, doc_id FROM labels JOIN documents USING (doc_id))"


def auc_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"WITH {AUC_SQL}, r AS (SELECT {key}positive, avg(n) OVER (PARTITION BY {key}score) AS r FROM (SELECT *, row_number() OVER ({part}ORDER BY score) AS n FROM s)) SELECT {key}count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives, {r_sql('(sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / nullif(count(*) FILTER (positive) * count(*) FILTER (NOT positive), 0)')} AS auc FROM r{' GROUP BY ' + by if by else ''}"


@register("auc_quality", auc_sql(""))
def auc_quality(spark, d):
    return evaluate.auc(scored(spark, d)).withColumn("auc", R(F.col("auc")))


@register("auc_by_language", auc_sql("lang"))
def auc_by_language(spark, d):
    return evaluate.auc(scored(spark, d), ["lang"]).withColumn("auc", R(F.col("auc")))


@register("kappa_labels", f"WITH m AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels) SELECT n, {r_sql('(po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb)))')} AS kappa FROM m")
def kappa_labels(spark, d):
    pairs = table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return evaluate.kappa(pairs).withColumn("kappa", R(F.col("kappa")))


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of every twentieth vector to all others: a stated query set, in blocks."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda a, b: a + b)
    e = e.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).filter("norm > 0")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("v").alias("q"), F.col("norm").alias("qn"))
    pairs = evaluate.against_all(q, e).filter("vec_id <> query_id")
    return pairs.select("query_id", F.col("vec_id").alias("cand_id"), "query_label", "label", R(dot(F.col("v"), F.col("q")) / (F.col("norm") * F.col("qn"))).alias("score"))


DENSE_SQL = f"e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, q.label AS query_label, c.label AS label, {r_sql('list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))')} AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM pairs)"


@register("dense_ranking", f"WITH {DENSE_SQL} SELECT query_id, rank::INTEGER AS rank, cand_id, score FROM ranked WHERE rank <= 10")
def dense_ranking(spark, d):
    return evaluate.ranked(dense(spark, d)).filter("rank <= 10").select("query_id", "rank", "cand_id", "score")


@register("recall_and_mrr", f"WITH {DENSE_SQL}, t AS (SELECT query_id, cand_id, rank FROM ranked WHERE label = query_label AND cand_id % 10 = 1) SELECT count(*) AS pairs, {r_sql('avg((rank <= 1)::INT)')} AS recall_1, {r_sql('avg((rank <= 5)::INT)')} AS recall_5, {r_sql('avg((rank <= 10)::INT)')} AS recall_10, {r_sql('avg(1.0 / rank)')} AS mrr FROM t")
def recall_and_mrr(spark, d):
    r = evaluate.ranked(dense(spark, d))
    out = evaluate.recall_and_mrr(r, r.filter("label = query_label AND cand_id % 10 = 1").select("query_id", "cand_id"))
    return out.select("pairs", *[R(F.col(c)).alias(c) for c in out.columns[1:]])


@register("rank_percentiles", f"WITH {DENSE_SQL}, n AS (SELECT query_id, count(*) AS n FROM ranked GROUP BY 1) SELECT query_id, cand_id, {r_sql('100.0 * (rank - 1) / (n - 1)')} AS percentile FROM ranked JOIN n USING (query_id) WHERE rank <= 5")
def rank_percentiles(spark, d):
    r = evaluate.ranked(dense(spark, d)).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    return r.filter("rank <= 5").select("query_id", "cand_id", R(evaluate.rank_percentile(F.col("rank"), F.col("n"))).alias("percentile"))


@register("union_rerank", f"WITH {DENSE_SQL}, second AS (SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY cand_id) AS rank FROM pairs), u AS (SELECT query_id, cand_id, 0 AS s, rank FROM ranked WHERE rank <= 15 UNION ALL SELECT query_id, cand_id, 1, rank FROM second WHERE rank <= 15), f AS (SELECT query_id, cand_id, min(s * 1000 + rank) AS k FROM u GROUP BY 1, 2) SELECT query_id, cand_id, (row_number() OVER (PARTITION BY query_id ORDER BY k, cand_id))::INTEGER AS place FROM f")
def union_rerank(spark, d):
    p = dense(spark, d)
    return evaluate.union_rerank(evaluate.ranked(p), evaluate.ranked(p.withColumn("score", F.lit(0.0))))


@register("hidden_bridges", f"WITH {DENSE_SQL} SELECT query_id, cand_id FROM ranked WHERE rank <= 3 AND query_label <> label AND abs(query_id - cand_id) % 100 / 100.0 < 0.06 * 5 AND (query_id + cand_id) % 5 <> 0")
def hidden_bridges(spark, d):
    r = evaluate.ranked(dense(spark, d)).withColumn("lexical", F.abs(F.col("query_id") - F.col("cand_id")) % 100 / 100.0)
    r = r.withColumn("partner", (F.col("query_id") + F.col("cand_id")) % 5 == 0).withColumnsRenamed({"query_label": "query_field", "label": "cand_field"})
    return evaluate.hidden_bridges(r, 3, 0.3).select("query_id", "cand_id")


@register("hyde_scores", f"WITH {DENSE_SQL} SELECT (query_id // 100) AS query_id, cand_id, {r_sql('max(score) - 0.3 * (cand_id % 10) / 10.0')} AS score FROM pairs GROUP BY 1, 2")
def hyde_scores(spark, d):
    h = dense(spark, d).select(F.floor(F.col("query_id") / 100).alias("query_id"), "cand_id", F.col("score").alias("cosine"))
    base = h.select("query_id", "cand_id", (F.col("cand_id") % 10 / 10.0).alias("cosine")).distinct()
    return evaluate.hyde_scores(h, base, 0.3).withColumn("score", R(F.col("score")))


@register("first_seen_pairs", f"WITH {DENSE_SQL}, s AS (SELECT query_id, cand_id, rank, row_number() OVER (PARTITION BY least(query_id, cand_id), greatest(query_id, cand_id) ORDER BY rank, query_id) AS n FROM ranked WHERE rank <= 20) SELECT query_id, cand_id FROM s WHERE n = 1")
def first_seen_pairs(spark, d):
    return evaluate.first_seen_pairs(evaluate.ranked(dense(spark, d)).filter("rank <= 20"), "rank", "query_id").select("query_id", "cand_id")


@register("scorer_correlation", f"SELECT {r_sql('corr(n_chars, quality)')} AS r, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def scorer_correlation(spark, d):
    return scored(spark, d).agg(R(F.corr("score", "quality")).alias("r"), F.count("*").alias("n"))


@register("hash_selection", "WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('hard' || chr(31) || lang || chr(31) || doc_id), doc_id) AS place FROM documents) SELECT lang, place::INTEGER AS place, doc_id FROM s WHERE place <= 10")
def hash_selection(spark, d):
    return evaluate.hash_selection(table(spark, d, "documents").select("doc_id", "lang"), "hard", "lang", "doc_id", 10).select("lang", "place", "doc_id")


@register("round_robin", "WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) SELECT doc_id, source, nth::INTEGER AS nth FROM s ORDER BY nth, source LIMIT 50")
def round_robin(spark, d):
    return evaluate.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@register("stratified_budget", "WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents) SELECT lang, place::INTEGER AS place, doc_id FROM s WHERE place <= CASE lang WHEN 'en' THEN 12 WHEN 'de' THEN 5 ELSE 0 END")
def stratified_budget(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return evaluate.stratified_budget(rows, "lang", {"en": 12, "de": 5}, F.desc("n_chars"), "doc_id").select("lang", "place", "doc_id")


@register("stride_sample", "WITH s AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS at_place, count(*) OVER () AS n FROM benchmark) SELECT item_id FROM s WHERE at_place IN (SELECT (7 * i + 3) % (SELECT count(*) FROM benchmark) FROM range(12) t(i))")
def stride_sample(spark, d):
    return evaluate.stride_sample(table(spark, d, "benchmark").select("item_id"), "item_id", 12)


@register("temporal_split", "WITH o AS (SELECT o_custkey AS c, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last FROM orders GROUP BY 1) SELECT c AS customer, first <= 1995 AND last > 1995 AS positive FROM o WHERE first <= 1995")
def temporal_split(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"))
    return o.filter("first <= 1995").select("customer", ((F.greatest("first", F.lit(0)) <= 1995) & (F.col("last") > 1995)).alias("positive"))


DEGREE_SQL = "deg AS (SELECT l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), s AS (SELECT a, b, x.degree + y.degree AS degree_sum FROM p JOIN deg x ON x.id = a JOIN deg y ON y.id = b)"


@register("degree_strata", f"WITH {DEGREE_SQL} SELECT degree_sum > (SELECT median(degree_sum) FROM s) AS rich, count(*) AS n, sum(degree_sum)::BIGINT AS total FROM s GROUP BY 1")
def degree_strata(spark, d):
    lines = table(spark, d, "lineitem")
    degrees = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("degree"))
    pairs = lines.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return evaluate.degree_strata(pairs, degrees).groupBy("rich").agg(F.count("*").alias("n"), F.sum("degree_sum").alias("total"))


@register("bootstrap_means", None)
def bootstrap_means(spark, d):
    e = table(spark, d, "events").select("event_type", R(F.col("value"), 1).alias("value"))
    out = evaluate.bootstrap_ci(e, "event_type", 500)
    return out.select("event_type", "n", *[R(F.col(c), 4).alias(c) for c in ("mean", "low", "high")])


@register("verdicts", "WITH u AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN n < 5 THEN 'WEAK' WHEN m > 50 THEN 'PASS' ELSE 'KILL' END AS verdict FROM u")
def verdicts(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return u.select("user_id", evaluate.verdict([(F.col("n") < 5, "WEAK"), (F.col("m") > 50, "PASS")], "KILL").alias("verdict"))


@register("cascade_prune", "WITH u AS (SELECT user_id, count(*) AS candidates, count(*) FILTER (event_type = 'click' AND value < 15) AS pruned FROM events GROUP BY 1) SELECT user_id, candidates, pruned, pruned >= 2 AS enough FROM u")
def cascade_prune(spark, d):
    e = table(spark, d, "events")
    out = e.groupBy("user_id").agg(F.count("*").alias("candidates"), F.count_if((F.col("event_type") == "click") & (F.col("value") < 15)).alias("pruned"))
    return out.withColumn("enough", F.col("pruned") >= 2)


@register("audit_agreement", "WITH e AS (SELECT user_id, event_type IN ('click', 'purchase') AS a, value > 50 AS b FROM events) SELECT count(*) FILTER (a AND NOT b) AS over_pruned, count(*) FILTER (b AND NOT a) AS under_pruned, count(*) FILTER (a = b) AS agreed FROM e")
def audit_agreement(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").isin("click", "purchase").alias("a"), (F.col("value") > 50).alias("b"))
    return e.agg(F.count_if(F.col("a") & ~F.col("b")).alias("over_pruned"), F.count_if(F.col("b") & ~F.col("a")).alias("under_pruned"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))


@register("exclusion_sample", "WITH p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents), c AS (SELECT a, b FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.lang <> y.lang), s AS (SELECT a, b FROM c ANTI JOIN (SELECT doc_id AS a FROM labels) l USING (a)) SELECT a, b FROM s ORDER BY sha256('seed' || chr(31) || a || chr(31) || b), a LIMIT 80")
def exclusion_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    pairs = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.col("lang").alias("la")).join(docs.select(F.col("doc_id").alias("b"), F.col("lang").alias("lb")), "b").filter("la <> lb")
    pairs = pairs.join(table(spark, d, "labels").select(F.col("doc_id").alias("a")), "a", "left_anti")
    order = F.sha2(F.concat_ws("\x1f", F.lit("seed"), F.col("a").cast("string"), F.col("b").cast("string")), 256)
    return pairs.orderBy(order, "a").limit(80).select("a", "b")
