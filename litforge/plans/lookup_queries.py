"""Lookups, stored lists, contexts, gates and tests of significance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.functions import text as T
from litforge.operators import corpus, evaluate, graph, relational
from litforge.plans import corpus_queries, evaluation_queries, graph_queries, table_queries
from litforge.plans.corpus_queries import TF_SQL, TOP_SQL, docs, weights
from litforge.plans.registry import register
from litforge.plans.table_queries import CITES_SQL, citations, papers, r_sql
from litforge.session import table

R = T.rounded


# Stored assignments: parts are papers, their brands the fingerprints of corpora.

ASSIGNED_SQL = "m AS (SELECT p_partkey AS id, CASE WHEN p_size < 5 THEN 4294967294 ELSE p_partkey % 7 END AS community_id, p_brand AS corpus_fingerprint FROM part)"


def assigned(spark: SparkSession, d: str) -> DataFrame:
    community = F.when(F.col("p_size") < 5, F.lit(graph.OTHER)).otherwise(F.col("p_partkey") % 7)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), community.alias("community_id"), F.col("p_brand").alias("corpus_fingerprint"))


@register("communities_by_fingerprint", f"WITH {ASSIGNED_SQL} SELECT id, community_id FROM m WHERE corpus_fingerprint = 'Brand#3'")
def communities_by_fingerprint(spark, d):
    return graph.communities_of(assigned(spark, d), "Brand#3").select("id", "community_id")


@register("community_of_paper", f"WITH {ASSIGNED_SQL} SELECT id, community_id FROM m WHERE corpus_fingerprint = 'Brand#3' AND id = (SELECT min(id) FROM m WHERE corpus_fingerprint = 'Brand#3')")
def community_of_paper(spark, d):
    m = assigned(spark, d)
    one = m.filter("corpus_fingerprint = 'Brand#3'").agg(F.min("id")).first()[0]
    return graph.communities_of(m, "Brand#3", paper_id=one).select("id", "community_id")


@register("papers_of_community", f"WITH {ASSIGNED_SQL} SELECT id FROM m WHERE corpus_fingerprint = 'Brand#3' AND community_id = 2")
def papers_of_community(spark, d):
    return graph.communities_of(assigned(spark, d), "Brand#3", community_id=2).select("id")


@register("community_status", f"WITH {ASSIGNED_SQL} SELECT bool_or(corpus_fingerprint = 'Brand#3') AS ready, count(DISTINCT community_id) FILTER (corpus_fingerprint = 'Brand#3' AND community_id <> 4294967294) AS communities FROM m")
def community_status(spark, d):
    return graph.community_status(assigned(spark, d), "Brand#3")


@register("replaced_communities", "WITH new AS (SELECT p_size AS paper, p_partkey AS member FROM part WHERE p_size <= 20 AND p_retailprice > 1000) SELECT p_size AS paper, p_partkey AS member FROM part WHERE p_size NOT IN (SELECT paper FROM new) UNION ALL SELECT paper, member FROM new")
def replaced_communities(spark, d):
    old = table(spark, d, "part").select(F.col("p_size").alias("paper"), F.col("p_partkey").alias("member"), "p_retailprice")
    new = old.filter("paper <= 20 AND p_retailprice > 1000").select("paper", "member")
    return relational.replace_keys(old.select("paper", "member"), new, "paper")


@register("inverse_edges", f"WITH {CITES_SQL} SELECT src, dst FROM cites WHERE l_orderkey % 2 = 0 UNION ALL SELECT dst, src FROM cites WHERE l_orderkey % 2 <> 0 AND dst IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def inverse_edges(spark, d):
    """Lists of citing papers come in for odd orders."""
    e = citations(spark, d)
    old, new = e.filter("l_orderkey % 2 = 0").select("src", "dst"), e.filter("l_orderkey % 2 <> 0").select("src", "dst")
    return relational.insert_edges(old, new, papers(spark, d).filter("citation_count > 20"), inverse=True)


@register("built_edges", f"WITH {CITES_SQL}, known AS (SELECT p_partkey AS id FROM part WHERE p_size > 10) SELECT src, dst FROM cites WHERE src IN (FROM known) AND dst IN (FROM known)")
def built_edges(spark, d):
    refs = citations(spark, d).groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("references"))
    return relational.built_edges(papers(spark, d).filter("citation_count > 10").select("id").join(refs, "id"))


@register("zipped_terms", "SELECT p_partkey AS id, 1 AS place, p_brand AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 2, p_type, p_retailprice FROM part")
def zipped_terms(spark, d):
    """Three names beside two values: the shorter array ends the list."""
    p = table(spark, d, "part")
    z = relational.zipped(F.array("p_brand", "p_type", "p_name"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")))
    return p.select(F.col("p_partkey").alias("id"), F.posexplode(z).alias("n", "z")).select("id", (F.col("n") + 1).alias("place"), "z.name", "z.value")


# Keyword vectors.


@register(
    "export_class_terms",
    f"WITH {TF_SQL}, {TOP_SQL}, m AS (SELECT doc_id, source FROM documents), sizes AS (SELECT source, count(*) AS size FROM m GROUP BY 1), s AS (SELECT source, term, sum(weight) AS s FROM top JOIN m USING (doc_id) GROUP BY 1, 2), d2 AS (SELECT term, count(*) AS df FROM s GROUP BY 1), sc AS (SELECT source, term, s / size * (ln((SELECT count(*) FROM sizes) / df::DOUBLE) + 1) AS weight FROM s JOIN sizes USING (source) JOIN d2 USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(weight * 1e9 + 0.5) DESC, term) AS rank FROM sc) SELECT source, rank::INTEGER AS rank, term, {r_sql('weight')} AS weight FROM r WHERE rank <= 10",
)
def export_class_terms(spark, d):
    members = docs(spark, d).select("doc_id", F.col("source").alias("community_id"))
    out = corpus.class_tfidf_export(weights(spark, d), members)
    return out.select(F.col("community_id").alias("source"), "rank", "term", R(F.col("weight")).alias("weight"))


@register(
    "similar_papers",
    f"WITH {TF_SQL}, {corpus_queries.PAIRS_SQL}, {corpus_queries.NEAR_SQL}, held AS (SELECT x.doc_id, coalesce(n, 0) AS n FROM documents x LEFT JOIN (SELECT a, count(*) AS n FROM near GROUP BY a) ON a = x.doc_id), "
    "filler AS (SELECT h.doc_id AS a, y.doc_id AS b, 0.0::DOUBLE AS score, h.n + row_number() OVER (PARTITION BY h.doc_id ORDER BY y.doc_id) AS rank FROM held h JOIN documents y ON y.doc_id <> h.doc_id ANTI JOIN near ON near.a = h.doc_id AND near.b = y.doc_id WHERE h.n < 10), "
    "lists AS (SELECT a, b, score, rank FROM near UNION ALL SELECT a, b, score, rank FROM filler WHERE rank <= 10), strong AS (SELECT doc_id, term FROM weights WHERE weight >= 0.05), "
    "sh AS (SELECT l.a, l.b, list_sort(list(x.term)) AS terms FROM lists l JOIN strong x ON x.doc_id = l.a JOIN strong y ON y.doc_id = l.b AND y.term = x.term GROUP BY 1, 2) "
    f"SELECT a AS doc_id, rank::INTEGER AS rank, b AS neighbour, {r_sql('score')} AS score, coalesce(array_to_string(terms[1:3], ','), '') AS shared FROM lists LEFT JOIN sh USING (a, b)",
)
def similar_papers(spark, d):
    s = corpus_queries.sections(spark, d)
    out = corpus.similar_papers(corpus.section_tf(s), s.count(), docs(spark, d).select("doc_id"))
    return out.withColumn("shared", F.array_join("shared", ","))


CLAIMS_SQL = "claims AS (SELECT doc_id, quality = 1 AS strong, quality = 0 AS weak, '  - [' || CASE quality WHEN 1 THEN 'strong' ELSE 'weak' END || '] ' || source AS line FROM labels JOIN documents USING (doc_id))"


@register(
    "contradiction_contexts",
    f"WITH {TF_SQL}, {corpus_queries.PAIRS_SQL}, {corpus_queries.SHARED_SQL}, {CLAIMS_SQL} SELECT p.a, p.b, sha256('Paper A (arxiv:' || p.a || '):' || chr(10) || 'Findings:' || chr(10) || x.line || chr(10) || chr(10) || 'Paper B (arxiv:' || p.b || '):' || chr(10) || 'Findings:' || chr(10) || y.line || chr(10) || chr(10) || 'Shared high-weight terms: ' || coalesce(array_to_string(terms, ', '), '')) AS context FROM pairs p JOIN claims x ON x.doc_id = p.a JOIN claims y ON y.doc_id = p.b LEFT JOIN shared s ON s.a = p.a AND s.b = p.b WHERE score >= 0.3 AND ((x.strong AND y.weak) OR (x.weak AND y.strong))",
)
def contradiction_contexts(spark, d):
    """What a model would be asked about each contradiction candidate, as a digest."""
    w = weights(spark, d)
    claims = table(spark, d, "labels").join(docs(spark, d), "doc_id").select("doc_id", F.array(F.struct(F.when(F.col("quality") == 1, "strong").otherwise("weak").alias("strength"), F.col("source").alias("text"))).alias("findings"))
    marks = claims.select("doc_id", *[F.array_contains(F.transform("findings", lambda f: T.strength(f["strength"])), s).alias(s) for s in ("strong", "weak")])
    found = corpus.contradictions(corpus.cosine_pairs(w, 0.3, marks), marks).select("a", "b")
    pairs = corpus.shared_by(found, w, 0.1)
    return corpus.contradiction_context(claims, pairs).select("a", "b", F.sha2("context", 256).alias("context"))


@register(
    "bridge_contexts",
    f"WITH {TF_SQL}, {corpus_queries.SHARED_SQL}, e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents)) SELECT a, b, sha256('Paper A (arxiv:' || a || '):' || chr(10) || 'Open problems: ' || x.lang || ', ' || x.source || chr(10) || chr(10) || 'Paper C (arxiv:' || b || '):' || chr(10) || 'Open problems: ' || y.lang || ', ' || y.source || chr(10) || chr(10) || 'Shared intermediary concepts (B): ' || array_to_string(terms, ', ')) AS context FROM shared ANTI JOIN e USING (a, b) JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE len(terms) >= 3",
)
def bridge_contexts(spark, d):
    edges = docs(spark, d).select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))
    pairs = corpus.bridges(corpus.shared_terms(weights(spark, d, least=0.1), 0.1, 3), edges).select("a", "b", "terms")
    problems = docs(spark, d).select("doc_id", F.array("lang", "source").alias("open_problems"))
    return corpus.bridge_context(problems, pairs).select("a", "b", F.sha2("context", 256).alias("context"))


@register("field_keys", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'community_id:' || source WHEN lang = 'de' THEN 'domain:' || lang WHEN lang = 'fr' THEN 'cat:hep-th' ELSE 'cat:' || doc_id END AS field FROM documents")
def field_keys(spark, d):
    lang = F.col("lang")
    blank = F.lit("")
    key = T.field_key(F.when(lang == "en", F.col("source")), F.when(lang == "de", lang).otherwise(blank), blank, F.when(lang == "fr", F.concat(F.lit("hep-th/"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".12"))))
    return docs(spark, d).select("doc_id", key.alias("field"))


# Rankings, gates and strata.

DENSE_SQL = evaluation_queries.DENSE_SQL


@register("surface_hard_pairs", f"WITH {DENSE_SQL} SELECT query_id, cand_id FROM ranked WHERE label = query_label AND cand_id % 10 = 1 AND rank > 10")
def surface_hard_pairs(spark, d):
    r = evaluate.ranked(evaluation_queries.dense(spark, d))
    return evaluate.surface_hard(r, r.filter("label = query_label AND cand_id % 10 = 1").select("query_id", "cand_id"))


@register("candidate_order", f"WITH {DENSE_SQL}, c AS (SELECT query_id, cand_id, rank, abs(query_id - cand_id) % 100 / 100.0 AS lexical FROM ranked WHERE rank <= 3) SELECT query_id, cand_id, (row_number() OVER (ORDER BY rank, lexical, query_id, cand_id))::INTEGER AS place FROM c ORDER BY place LIMIT 40")
def candidate_order(spark, d):
    r = evaluate.ranked(evaluation_queries.dense(spark, d)).filter("rank <= 3").withColumn("lexical", F.abs(F.col("query_id") - F.col("cand_id")) % 100 / 100.0)
    return evaluate.candidate_order(r, 40).select("query_id", "cand_id", "place")


def _area(score: str) -> str:
    return f"(SELECT (sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)) FROM (SELECT positive, avg(n) OVER (PARTITION BY s) AS r FROM (SELECT {score} AS s, positive, row_number() OVER (ORDER BY {score}) AS n FROM s)))"


@register("delta_auc", f"WITH s AS (SELECT n_chars AS method, doc_id % 97 AS sym, quality = 1 AS positive FROM labels JOIN documents USING (doc_id) WHERE length(source) = 4 AND doc_id % 97 > 0) SELECT count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives, {r_sql(_area('method'))} AS auc_method, {r_sql(_area('sym'))} AS auc_symmetric, {r_sql(_area('method') + ' - ' + _area('sym'))} AS delta FROM s")
def delta_auc(spark, d):
    """Long source names stand for like objects; a score of 0 for a missing one."""
    rows = evaluation_queries.scored(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    rows = rows.select(F.col("score").alias("method"), F.nullif(F.col("doc_id") % 97, F.lit(0)).alias("symmetric"), (F.length("source") - 4).alias("object"), "positive")
    out = evaluate.delta_auc(rows, 0.15)
    return out.select("positives", "negatives", *[R(F.col(c)).alias(c) for c in ("auc_method", "auc_symmetric", "delta")])


@register("tag_gate", f"WITH p AS (SELECT x.lang AS la, x.source AS sa, y.lang AS lb, y.source AS sb FROM documents x LEFT JOIN documents y ON y.doc_id = x.doc_id + 1) SELECT count(*) AS pairs, count(*) FILTER (la = lb OR sa = sb) AS hits, {r_sql('count(*) FILTER (la = lb OR sa = sb) / count(*)')} AS recall, count(*) FILTER (la = lb OR sa = sb) >= 100 AS passes FROM p")
def tag_gate(spark, d):
    t = docs(spark, d).select("doc_id", F.array("lang", "source").alias("tags"))
    pairs = t.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return evaluate.tag_gate(pairs, t, 100).withColumn("recall", R(F.col("recall")))


@register("best_null", f"WITH u AS (SELECT value AS lexical, CASE WHEN event_id % 3 > 0 THEN (event_id % 100)::DOUBLE END AS embedding, event_type <> 'click' AND value <= 50 AS clean, event_type AS a, props AS b FROM events) SELECT count(*) AS scored, count(*) FILTER (clean) AS clean, {r_sql('avg(clean::INT)')} AS clean_yield, count(DISTINCT a || ' || ' || b) FILTER (clean) AS field_pairs, {r_sql('avg(least(lexical, coalesce(embedding, lexical))) FILTER (clean)')} AS best_null FROM u")
def best_null(spark, d):
    e = table(spark, d, "events")
    clean = evaluate.clean_pair(F.col("event_type") == "click", F.lit(False), F.col("value") / 100)
    units = e.select(F.col("value").alias("lexical"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 100).cast("double")).alias("embedding"), clean.alias("clean"), F.col("event_type").alias("field_a"), F.col("props").alias("field_b"))
    out = evaluate.best_null(units)
    return out.withColumns({c: R(F.col(c)) for c in ("clean_yield", "best_null")})


@register("cas_checks", "WITH c AS (SELECT event_id, value > 30 AND user_id % 4 >= 2 AS method_coherence, (event_id % 100) / 100.0 < 0.15 AS object_difference FROM events) SELECT event_id, method_coherence, object_difference, NOT method_coherence AND NOT object_difference AS conservative, NOT method_coherence OR NOT object_difference AS aggressive, NOT method_coherence AS headline FROM c")
def cas_checks(spark, d):
    check = evaluate.cas_verify(F.col("value") - 30, F.col("user_id") % 4, F.col("event_id") % 100 / 100.0)
    e = table(spark, d, "events").select("event_id", check.alias("c"))
    return e.select("event_id", "c.*", *[evaluate.pruned(F.col("c"), m).alias(m) for m in ("conservative", "aggressive", "headline")])


PRUNED_SQL = "p AS (SELECT user_id, event_id, value, NOT (value > 30) AS pruned, event_type = 'click' AS same FROM events)"


@register("prune_statistics", f"WITH {PRUNED_SQL} SELECT user_id AS query_id, count(*) AS candidates, count(*) FILTER (pruned) AS pruned, {r_sql('avg(same::INT)')} AS same_share FROM p GROUP BY 1")
def prune_statistics(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("value") <= 30).alias("pruned"), (F.col("event_type") == "click").alias("same_community"))
    return evaluate.prune_statistics(rows).withColumn("same_share", R(F.col("same_share")))


@register("cascade_recall", f"WITH {PRUNED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM p WHERE NOT pruned), t AS (SELECT user_id, event_id FROM p WHERE event_id % 5 = 0), s AS (SELECT avg((coalesce(a.r, 99) <= 10)::INT) AS ra, avg((coalesce(k.r, 99) <= 10)::INT) AS rk FROM t LEFT JOIN a USING (user_id, event_id) LEFT JOIN k USING (user_id, event_id)), l AS (SELECT min(n) AS n FROM (SELECT count(*) FILTER (pruned) AS n FROM p GROUP BY user_id)) SELECT {r_sql('ra')} AS recall_all, {r_sql('rk')} AS recall_pruned, n AS least_pruned, rk > 0.4 AND n >= 2 AS passes FROM s, l")
def cascade_recall(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("cand_id"), F.col("value").alias("score"), (F.col("value") <= 30).alias("pruned"))
    out = evaluate.cascade_recall(rows, rows.filter("cand_id % 5 = 0").select("query_id", "cand_id"))
    return out.withColumns({c: R(F.col(c)) for c in ("recall_all", "recall_pruned")})


@register("hyde_gates", "WITH u AS (SELECT user_id, avg((value > 40)::INT) AS recall, count(*) FILTER (event_type = 'click') AS missed, min(event_id % 30) AS anchor FROM events GROUP BY 1) SELECT user_id, recall > 0.5 AND missed >= 1 AND anchor <= 10 AS strict, recall >= 0.5 AND missed >= 1 AND anchor <= 10 AS loose FROM u")
def hyde_gates(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.avg((F.col("value") > 40).cast("int")).alias("recall"), F.count_if(F.col("event_type") == "click").alias("missed"), F.min(F.col("event_id") % 30).alias("anchor"))
    return u.select("user_id", *[evaluate.gate(F.col("recall"), F.col("missed"), F.col("anchor"), 0.5, s).alias(n) for n, s in (("strict", True), ("loose", False))])


CARDS_SQL = "p AS (SELECT user_id, event_id, value / 100 AS cosine, event_type = 'click' AS same, event_id % 11 = 0 AS truth FROM events)"


@register("objective_cards", f"WITH {CARDS_SQL}, f AS (SELECT user_id, median(cosine) FILTER (same AND NOT truth) AS middle, max(cosine) FILTER (truth) AS cosine, bool_or(truth AND NOT same) AS crosses FROM p GROUP BY 1) SELECT user_id AS query_id, {r_sql('middle')} AS middle, coalesce(crosses AND cosine > middle + 0.02, false) AS card FROM f")
def objective_cards(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("cand_id"), (F.col("value") / 100).alias("cosine"), (F.col("event_type") == "click").alias("same_field"), (F.col("event_id") % 11 == 0).alias("is_true"))
    return evaluate.objective_cards(rows).select("query_id", R(F.col("middle")).alias("middle"), "card")


@register("separability", f"SELECT count(*) FILTER (value > event_id % 100) AS pairs, {r_sql('avg(value / 100)')} AS within, count(*) FILTER (value > event_id % 100) >= 3 AND avg(value / 100) < 0.85 AS separable FROM events")
def separability(spark, d):
    e = table(spark, d, "events")
    out = evaluate.separability(e.select(F.col("value").alias("method_cosine"), (F.col("event_id") % 100).alias("object_cosine")), e.select((F.col("value") / 100).alias("cosine")))
    return out.select("pairs", R(F.col("within")).alias("within"), "separable")


@register("bridge_set_jaccard", f"WITH k AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY 1), n AS (SELECT user_id, s, lead(user_id) OVER (ORDER BY user_id) AS next, lead(s) OVER (ORDER BY user_id) AS t FROM k) SELECT user_id, {r_sql('len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t)))')} AS jaccard FROM n WHERE next IS NOT NULL")
def bridge_set_jaccard(spark, d):
    """Sets of events of users that follow each other, as bridge sets of couplings that do."""
    k = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    w = Window.orderBy("user_id")
    n = k.withColumn("t", F.lead("s").over(w)).filter("t IS NOT NULL")
    return n.select("user_id", R(relational.set_jaccard(F.col("s"), F.col("t"))).alias("jaccard"))


@register("mined_pairs", f"WITH RECURSIVE {CITES_SQL}, r AS (SELECT src AS bridge, p_brand AS field, dst AS paper FROM cites JOIN part ON p_partkey = dst WHERE p_size > 25), f AS (SELECT bridge, field, count(DISTINCT paper) AS n, min(paper) AS paper FROM r GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY bridge ORDER BY n DESC, field) AS place FROM f), p AS (SELECT row_number() OVER (ORDER BY x.bridge) AS k, x.bridge, x.paper AS side_a, y.paper AS side_b FROM t x JOIN t y ON x.bridge = y.bridge AND x.place = 1 AND y.place = 2), g(k, bridge, side_a, side_b, used, kept) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], false UNION ALL SELECT p.k, p.bridge, p.side_a, p.side_b, CASE WHEN list_contains(g.used, p.side_a) OR list_contains(g.used, p.side_b) THEN g.used ELSE list_concat(g.used, [p.side_a, p.side_b]) END, NOT (list_contains(g.used, p.side_a) OR list_contains(g.used, p.side_b)) FROM g JOIN p ON p.k = g.k + 1) SELECT bridge, side_a, side_b FROM g WHERE kept")
def mined_pairs(spark, d):
    p = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("paper"), F.col("p_brand").alias("field"))
    refs = citations(spark, d).select(F.col("src").alias("bridge"), F.col("dst").alias("paper")).join(p, "paper")
    return evaluate.mine_pairs(refs.select("bridge", "paper", "field"))


@register("tag_cosine", f"WITH t AS (SELECT DISTINCT user_id AS doc_id, event_type AS tag FROM events), n AS (SELECT count(DISTINCT doc_id) AS n FROM t), df AS (SELECT tag, count(*) AS df FROM t GROUP BY 1), w AS (SELECT doc_id, tag, ln((1.0 + n) / (1 + df)) + 1 AS w FROM t JOIN df USING (tag), n), u AS (SELECT doc_id, tag, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w) SELECT x.doc_id AS a, y.doc_id AS b, {r_sql('sum(x.u * y.u)')} AS score FROM u x JOIN u y ON x.tag = y.tag AND x.doc_id < y.doc_id GROUP BY 1, 2")
def tag_cosine(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("tag"))
    return corpus.set_cosine(t).select("a", "b", R(F.col("score")).alias("score"))


# Tests of significance: counts are few and go to the driver.


def tail_sql(z: str) -> str:
    """One-sided normal tail by its power series, within seven deviations."""
    series = f"list_sum(list_transform(range(0, 120), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - i * ln(2.0) - lgamma(i + 1)) / (2 * i + 1))) / sqrt(2 * pi())"
    return f"CASE WHEN {z} > 7 THEN 0.0 WHEN {z} < -7 THEN 1.0 ELSE 0.5 - sign({z}) * {series} END"


AREA_SQL = "(sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive))"


@register(
    "auc_significance",
    f"WITH {evaluation_queries.AUC_SQL}, r AS (SELECT positive, avg(n) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score) AS n FROM s)), a AS (SELECT count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives, {AREA_SQL} AS auc FROM r), z AS (SELECT *, (auc - 0.5) / sqrt((positives + negatives + 1) / (12.0 * positives * negatives)) AS z FROM a) SELECT positives, negatives, {r_sql(tail_sql('z'))} AS p FROM z",
)
def auc_significance(spark, d):
    a = evaluate.auc(evaluation_queries.scored(spark, d)).first()
    p = evaluate.mann_whitney_p(a["auc"], a["positives"], a["negatives"])
    return spark.createDataFrame([(a["positives"], a["negatives"], float(p))], "positives long, negatives long, p double").withColumn("p", R(F.col("p")))


CELLS_SQL = "c AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 1) AS a, count(*) FILTER (quality = 0 AND toxic = 0) AS b, count(*) FILTER (quality = 1 AND toxic = 1) AS c, count(*) FILTER (quality = 1 AND toxic = 0) AS d FROM labels JOIN documents USING (doc_id) GROUP BY lang)"
_choose = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))".format


@register("fisher_by_language", f"WITH {CELLS_SQL} SELECT lang, a, {r_sql('least(1.0, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda k: exp(' + _choose('(a + b)', 'k') + ' + ' + _choose('(c + d)', '(a + c - k)') + ' - ' + _choose('(a + b + c + d)', '(a + c)') + '))))')} AS p FROM c")
def fisher_by_language(spark, d):
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    cells = evaluation_queries.scored(spark, d).groupBy("lang").agg(F.count_if(low & toxic).alias("a"), F.count_if(low & ~toxic).alias("b"), F.count_if(~low & toxic).alias("c"), F.count_if(~low & ~toxic).alias("d"))
    rows = [(r.lang, r.a, evaluate.fisher_one_sided(r.a, r.b, r.c, r.d)) for r in cells.collect()]
    return spark.createDataFrame(rows, "lang string, a long, p double").withColumn("p", R(F.col("p")))


@register("binomial_by_language", f"WITH {CELLS_SQL} SELECT lang, a + b AS hits, {r_sql('least(1.0, list_sum(list_transform(range(a + b, a + b + c + d + 1), lambda i: exp(' + _choose('(a + b + c + d)', 'i') + ' + i * ln(0.15) + (a + b + c + d - i) * ln(0.85)))))')} AS p FROM c")
def binomial_by_language(spark, d):
    cells = evaluation_queries.scored(spark, d).groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("hits"), F.count("*").alias("n"))
    rows = [(r.lang, r.hits, evaluate.binomial_tail(r.hits, r.n, 0.15)) for r in cells.collect()]
    return spark.createDataFrame(rows, "lang string, hits long, p double").withColumn("p", R(F.col("p")))


@register("wilcoxon_nations", f"WITH x AS (SELECT c_nationkey AS k, avg(c_acctbal) AS c FROM customer GROUP BY 1), y AS (SELECT s_nationkey AS k, avg(s_acctbal) AS s FROM supplier GROUP BY 1), dif AS (SELECT c - s - 10 AS v FROM x JOIN y USING (k) WHERE c - s - 10 <> 0), rk AS (SELECT v, avg(n) OVER (PARTITION BY abs(v)) AS r FROM (SELECT v, row_number() OVER (ORDER BY abs(v)) AS n FROM dif)), t AS (SELECT sum(m * m * m - m) AS ties FROM (SELECT count(*) AS m FROM dif GROUP BY abs(v))), z AS (SELECT count(*) AS n, (sum(r) FILTER (v > 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - any_value(ties) / 48.0) AS z FROM rk, t) SELECT n, {r_sql(tail_sql('z'))} AS p FROM z")
def wilcoxon_nations(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("s"))
    v = [r[0] for r in c.join(s, "k").select(F.col("c") - F.col("s")).collect()]
    return spark.createDataFrame([(len(v), float(evaluate.wilcoxon_above(v, 10.0)))], "n long, p double").withColumn("p", R(F.col("p")))


# Ranks and summaries of the citation graph.


@register("community_labels", f"WITH {corpus_queries.TF_SQL}, m AS (SELECT doc_id, source FROM documents), sizes AS (SELECT source, count(*) AS size FROM m GROUP BY 1), s AS (SELECT source, term, sum(tf) AS s FROM tf JOIN m USING (doc_id) GROUP BY 1, 2), d2 AS (SELECT term, count(*) AS df FROM s GROUP BY 1), r AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY floor(s / size * (ln((SELECT count(*) FROM sizes) / df::DOUBLE) + 1) * 1e9 + 0.5) DESC, term) AS rank FROM s JOIN sizes USING (source) JOIN d2 USING (term)) SELECT source AS community_id, string_agg(term, ' ' ORDER BY rank) AS label FROM r WHERE rank <= 2 GROUP BY 1")
def community_labels(spark, d):
    s = corpus_queries.sections(spark, d)
    terms = corpus.class_tfidf(corpus.section_tf(s), s.select("doc_id", F.col("source").alias("community_id")), 10)
    return corpus.community_label(terms)


_prompt = " || chr(10) || chr(10) || ".join(f"'## {s}' || chr(10) || CASE WHEN {part} = '' THEN '[EMPTY]' WHEN length({part}) > 3000 THEN substr({part}, 1, 3000) || '[truncated]' ELSE {part} END" for s, part in zip(corpus_queries.SECTIONS, corpus_queries.SECTIONS_SQL, strict=True))


@register("prompt_lengths", f"WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT doc_id, sha256({_prompt}) AS prompt_sha FROM lines")
def prompt_lengths(spark, d):
    s = corpus_queries.sections(spark, d)
    return s.select("doc_id", F.sha2(T.prompt_sections({k: F.col(k) for k in corpus_queries.SECTIONS}), 256).alias("prompt_sha"))


@register("top_pagerank", graph_queries.PAGERANK_SQL + f", top AS (SELECT id, {r_sql('r')} AS pagerank FROM p WHERE i = 50) SELECT id, pagerank FROM top ORDER BY pagerank DESC, id LIMIT 20")
def top_pagerank(spark, d):
    return graph.pagerank(graph_queries.edges(spark, d), graph_queries.nodes(spark, d)).select("id", R(F.col("pagerank")).alias("pagerank")).orderBy(F.desc("pagerank"), "id").limit(20)


@register("one_community", f"WITH {table_queries.CITES_SQL}, m AS (SELECT p_partkey AS id, p_partkey % 7 AS community_id FROM part), i AS (SELECT id, count(*) AS intra FROM (SELECT src AS id FROM cites WHERE src % 7 = dst % 7 UNION ALL SELECT dst FROM cites WHERE src % 7 = dst % 7) GROUP BY 1), b AS (SELECT m.id, row_number() OVER (ORDER BY p_size / 1000.0 * (coalesce(intra, 0) + 1) DESC, m.id) AS rank FROM m JOIN part ON p_partkey = m.id LEFT JOIN i ON i.id = m.id WHERE community_id = 3), c AS (SELECT community_id, count(*) AS size, (row_number() OVER (ORDER BY count(*) DESC, community_id) - 1)::INTEGER AS color_index FROM m GROUP BY 1) SELECT community_id, color_index, size, (SELECT string_agg(id::VARCHAR, ',' ORDER BY rank) FROM b WHERE rank <= 5) AS top_papers FROM c WHERE community_id = 3")
def one_community(spark, d):
    """The summary of community 3 alone; part sizes stand for ranks."""
    ranks = papers(spark, d).select("id", (F.col("citation_count") / 1000.0).alias("pagerank"))
    tf = papers(spark, d).select(F.col("id").alias("doc_id"), F.col("brand").alias("term"), F.lit(1.0).alias("tf"))
    out = graph.community_summary(graph_queries.members(spark, d), ranks, graph_queries.edges(spark, d), tf, only=3)
    return out.select("community_id", "color_index", "size", F.array_join(F.transform("top_papers", lambda x: x.cast("string")), ",").alias("top_papers"))


@register("card_styles", f"SELECT event_id, CASE event_type WHEN 'click' THEN '#4e79a7' WHEN 'view' THEN '#f28e2b' ELSE '#9c9c9c' END AS colour, CASE WHEN value > 75 THEN 3.0 WHEN value > 50 THEN 2.0 WHEN value > 25 THEN 1.5 ELSE 1.0 END::DOUBLE AS multiplier, {r_sql('least(18.0, greatest(4.0, 50 * sqrt(value / 1000) + 4))')} AS radius, NOT list_contains([event_type], 'purchase') AS dimmed, user_id % 3000 = 0 OR user_id % 3000 BETWEEN 500 AND 2000 AS shown FROM events")
def card_styles(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "theoretical").when(F.col("event_type") == "view", "experimental").otherwise(F.col("event_type"))
    found = F.array(F.lit("weak"), F.when(F.col("value") > 75, "strong_evidence").when(F.col("value") > 50, "strong").when(F.col("value") > 25, "moderate").otherwise("none"))
    year = F.when(F.col("user_id") % 3000 != 0, (F.col("user_id") % 3000).cast("string")).otherwise("")
    return e.select("event_id", relational.paper_type_color(kind).alias("colour"), relational.strength_radius(found).alias("multiplier"), R(relational.radius_by_mode("pagerank", F.lit(1), F.col("value") / 1000, F.lit(0.0))).alias("radius"), relational.dimmed(F.array("event_type"), F.array(F.lit("purchase"))).alias("dimmed"), relational.in_years(year, 500, 2000).alias("shown"))
