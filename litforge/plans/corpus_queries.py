"""Text queries: documents are papers, their lines the sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.functions import text as T
from litforge.operators import corpus, relational
from litforge.plans.registry import register
from litforge.session import table

R = T.rounded
SECTIONS = ["abstract", "introduction", "methods", "results", "conclusion"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def sections(spark: SparkSession, d: str) -> DataFrame:
    """A line a section; the last holds all the rest of the text."""
    lines = docs(spark, d).select("doc_id", "source", F.split("text", "\n", 5).alias("l"))
    return lines.select("doc_id", "source", *[F.get("l", F.lit(i)).alias(s) for i, s in enumerate(SECTIONS)])


def weights(spark: SparkSession, d: str, top: int | None = None, least: float | None = None) -> DataFrame:
    s = sections(spark, d)
    return corpus.tfidf(corpus.section_tf(s), s.count(), top, least)


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TOKENS_SQL = r"list_transform(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda x: strlen(x) > 2), lambda x: lower(x))"
SECTIONS_SQL = [*(f"coalesce(l[{i}], '')" for i in range(1, 5)), "array_to_string(l[5:], chr(10))"]
TF_SQL = (
    "lines AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),\n"
    "sec AS (" + " UNION ALL ".join(f"SELECT doc_id, {T.SECTION_WEIGHTS[s]}::DOUBLE AS w, {part} AS t FROM lines" for s, part in zip(SECTIONS, SECTIONS_SQL, strict=True)) + "),\n"
    "tot AS (SELECT doc_id, sum(w) AS tot FROM sec WHERE t <> '' GROUP BY doc_id),\n"
    f"tok AS (SELECT doc_id, w, list_filter({TOKENS_SQL.format('t')}, lambda x: NOT list_contains({STOP_SQL}, x)) AS a FROM sec WHERE t <> ''),\n"
    "ex AS (SELECT doc_id, w, len(a) AS n, unnest(a) AS term FROM tok),\n"
    "tf AS (SELECT doc_id, term, sum(w / n) / first(tot) AS tf FROM ex JOIN tot USING (doc_id) GROUP BY doc_id, term),\n"
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),\n"
    "weights AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS weight FROM tf JOIN df USING (term))"
)
R_SQL = "floor({0} * 1e6 + 0.5) / 1e6"
r_sql = R_SQL.format
TOP_SQL = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY floor(weight * 1e9 + 0.5) DESC, term) AS rank FROM weights) WHERE rank <= 5)"


@register("tfidf_top_terms", f"WITH {TF_SQL}, {TOP_SQL} SELECT doc_id, rank::INTEGER AS rank, term, {r_sql('weight')} AS weight FROM top")
def tfidf_top_terms(spark, d):
    return corpus.top_terms(weights(spark, d, top=5), 5).select("doc_id", "rank", "term", R(F.col("weight")).alias("weight"))


@register("token_counts", f"WITH t AS (SELECT doc_id, {TOKENS_SQL.format('coalesce(text, chr(32))')} AS a FROM documents) SELECT doc_id, len(a) AS n_tokens, len(list_distinct(a)) AS n_distinct FROM t")
def token_counts(spark, d):
    t = docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("a"))
    return t.select("doc_id", F.size("a").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("a")).cast("bigint").alias("n_distinct"))


@register("document_frequency", f"WITH {TF_SQL} SELECT term, df FROM df")
def document_frequency(spark, d):
    return corpus.section_tf(sections(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@register("corpus_top_terms", f"WITH {TF_SQL} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 10")
def corpus_top_terms(spark, d):
    return document_frequency(spark, d).orderBy(F.desc("df"), "term").limit(10)


@register("corpus_fingerprint", "SELECT sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS fingerprint, count(*) AS papers FROM documents")
def corpus_fingerprint(spark, d):
    return docs(spark, d).agg(T.fingerprint(F.col("doc_id").cast("string")).alias("fingerprint"), F.count("*").alias("papers"))


IDS_SQL = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN printf('2301.%05d', doc_id) WHEN 1 THEN printf('2301.%05dv%d', doc_id, doc_id % 7) WHEN 2 THEN printf('hep-th/%07d', doc_id) ELSE printf('conf%d', doc_id) END AS raw FROM documents"


def paper_ids(spark, d):
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, F.format_string("2301.%05d", i)).when(i % 4 == 1, F.format_string("2301.%05dv%d", i, i % 7)).when(i % 4 == 2, F.format_string("hep-th/%07d", i)).otherwise(F.format_string("conf%d", i))
    return docs(spark, d).select("doc_id", raw.alias("raw"))


@register("canonical_ids", rf"WITH p AS ({IDS_SQL}) SELECT doc_id, regexp_replace(raw, 'v[0-9]+$', '') AS paper_id, coalesce((NOT contains(raw, 'v') OR regexp_matches(raw, '^[^v]*v[0-9]+$')) AND (regexp_matches(split_part(raw, 'v', 1), '^[0-9]{{4}}\.[0-9]{{4,5}}$') OR contains(split_part(raw, 'v', 1), '/')), false) AS valid FROM p")
def canonical_ids(spark, d):
    return paper_ids(spark, d).select("doc_id", T.strip_version(F.col("raw")).alias("paper_id"), T.is_paper_id(F.col("raw")).alias("valid"))


@register("mined_ids", rf"WITH p AS ({IDS_SQL}) SELECT doc_id, list_distinct(regexp_extract_all('see ' || raw || ', doi 10.1000/x' || doc_id || ').', '\b((?:0[0-9]|1[0-9]|2[0-9])\d{{2}}\.\d{{4,5}}(?:v\d+)?)\b', 1) || regexp_extract_all('see ' || raw || ', doi', '\b([a-zA-Z][a-zA-Z0-9\-]+/\d{{7}}(?:v\d+)?)\b', 1))[1] AS first_id, '10.1000/x' || doc_id AS doi FROM p")
def mined_ids(spark, d):
    text = F.concat(F.lit("see "), F.col("raw"), F.lit(", doi 10.1000/x"), F.col("doc_id"), F.lit(")."))
    return paper_ids(spark, d).select("doc_id", F.get(T.mined_ids(text), F.lit(0)).alias("first_id"), T.mined_doi(text).alias("doi"))


RAW_SQL = r"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{pattern}')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS c FROM words {where} GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"""
LEXICAL = r"[a-z][a-z0-9\-]+"
_where = f"WHERE length(term) > 2 AND NOT list_contains({STOP_SQL}, term)"


@register(
    "lexical_tfidf_terms",
    f"WITH {RAW_SQL.format(pattern=LEXICAL, where=_where)}, w AS (SELECT doc_id, term, c * (ln((n + 1.0) / (df + 1)) + 1) AS w FROM counts JOIN dfs USING (term), n), weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w), {TOP_SQL} SELECT doc_id, rank::INTEGER AS rank, term, {r_sql('weight')} AS weight FROM top",
)
def lexical_tfidf_terms(spark, d):
    w = corpus.raw_tfidf(docs(spark, d), LEXICAL, True)
    return corpus.top_terms(w, 5).select("doc_id", "rank", "term", R(F.col("weight")).alias("weight"))


@register(
    "builder_tfidf_terms",
    f"WITH {RAW_SQL.format(pattern='[a-z]{3,}', where='')}, weights AS (SELECT doc_id, term, c / sum(c) OVER (PARTITION BY doc_id) * ln(n / (1.0 + df)) AS weight FROM counts JOIN dfs USING (term), n), {TOP_SQL.replace('<= 5', '<= 50')} SELECT doc_id, rank::INTEGER AS rank, term, {r_sql('weight')} AS weight FROM top",
)
def builder_tfidf_terms(spark, d):
    w = corpus.raw_tfidf(docs(spark, d), "[a-z]{3,}", False)
    return corpus.top_terms(w, 50).select("doc_id", "rank", "term", R(F.col("weight")).alias("weight"))


BM25_WORDS = ["the", "thion", "Érthe", "est", "réeau", "src1"]
BM25_FIELDS = {"title": 2.0, "summary": 1.5, "authors": 1.0}
_title = "string_split(coalesce(text, ''), chr(10))[1]"


def _bm25_sql() -> str:
    parts = []
    for field, weight in BM25_FIELDS.items():
        per = " UNION ALL ".join(
            f"SELECT doc_id, {weight} * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM (SELECT doc_id, len(list_filter(t, lambda x: x = strip_accents('{w.lower()}'))) AS tf, len(t) AS dl, count(*) OVER () AS n, avg(len(t)) OVER () AS avgdl, sum((list_contains(t, strip_accents('{w.lower()}')))::INT) OVER () AS df FROM f_{field}) WHERE tf > 0"
            for w in BM25_WORDS
        )
        parts.append(per)
    base = {"title": _title, "summary": "coalesce(text, '')", "authors": "coalesce(source, '')"}
    ctes = ", ".join(f"f_{f} AS (SELECT doc_id, regexp_extract_all(strip_accents(lower({base[f]})), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)" for f in BM25_FIELDS)
    return f"{ctes}, s AS ({' UNION ALL '.join(parts)}), found AS (SELECT doc_id, score, row_number() OVER (ORDER BY floor(score * 1e9 + 0.5) DESC, doc_id) AS rank FROM (SELECT doc_id, sum(s) AS score FROM s GROUP BY doc_id))"


BM25_SQL = _bm25_sql()


def bm25_rows(spark, d):
    return docs(spark, d).select("doc_id", F.get(F.split("text", "\n", 2), F.lit(0)).alias("title"), F.col("text").alias("summary"), F.col("source").alias("authors"))


@register("bm25_search", f"WITH {BM25_SQL} SELECT doc_id, rank::INTEGER AS rank, {r_sql('score')} AS score FROM found WHERE rank <= 20")
def bm25_search(spark, d):
    return corpus.bm25(bm25_rows(spark, d), " ".join(BM25_WORDS), BM25_FIELDS, limit=20).select("doc_id", "rank", R(F.col("score")).alias("score"))


@register("searched_papers", f"WITH {BM25_SQL} SELECT doc_id, lang, length(coalesce(text, '')) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM found WHERE rank <= 100)")
def searched_papers(spark, d):
    """The paper table filtered by a search: its hundred best rows."""
    papers = docs(spark, d).select("doc_id", "lang", F.length("text").cast("bigint").alias("n"))
    return corpus.searched(papers, bm25_rows(spark, d), " ".join(BM25_WORDS), BM25_FIELDS)


PAIRS_SQL = "norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY doc_id), unit AS (SELECT doc_id, term, weight / norm AS u FROM weights JOIN norms USING (doc_id) WHERE norm > 0), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.u * y.u) AS score FROM unit x JOIN unit y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2)"


@register("cosine_pairs", f"WITH {TF_SQL}, {PAIRS_SQL} SELECT a, b, {r_sql('score')} AS score FROM pairs WHERE score >= 0.3")
def cosine_pairs(spark, d):
    return corpus.cosine_pairs(weights(spark, d), 0.3).select("a", "b", R(F.col("score")).alias("score"))


NEAR_SQL = "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY floor(score * 1e6 + 0.5) DESC, b) AS rank FROM (SELECT a, b, score FROM pairs UNION ALL SELECT b, a, score FROM pairs)) WHERE rank <= 10)"


@register("top_neighbours", f"WITH {TF_SQL}, {PAIRS_SQL}, {NEAR_SQL} SELECT a AS doc_id, rank::INTEGER AS rank, b AS neighbour, {r_sql('score')} AS score FROM near")
def top_neighbours(spark, d):
    s = sections(spark, d)
    return corpus.nearest(corpus.section_tf(s), s.count(), 10)


SHARED_SQL = "strong AS (SELECT doc_id, term FROM weights WHERE weight >= 0.1), shared AS (SELECT x.doc_id AS a, y.doc_id AS b, list_sort(list(x.term)) AS terms FROM strong x JOIN strong y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2)"


@register("shared_terms", f"WITH {TF_SQL}, {SHARED_SQL} SELECT a, b, len(terms) AS n, array_to_string(terms[1:3], ',') AS first_terms FROM shared")
def shared_terms(spark, d):
    s = corpus.shared_terms(weights(spark, d, least=0.1), 0.1)
    return s.select("a", "b", F.size("terms").cast("bigint").alias("n"), F.array_join(F.slice("terms", 1, 3), ",").alias("first_terms"))


@register("contradiction_candidates", f"WITH {TF_SQL}, {PAIRS_SQL}, s AS (SELECT doc_id, quality = 1 AS strong, quality = 0 AS weak FROM labels) SELECT a, b, {r_sql('score')} AS confidence FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE score >= 0.3 AND ((x.strong AND y.weak) OR (x.weak AND y.strong))")
def contradiction_candidates(spark, d):
    s = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("strong"), (F.col("quality") == 0).alias("weak"))
    return corpus.contradictions(corpus.cosine_pairs(weights(spark, d), 0.3, s), s).select("a", "b", R(F.col("confidence")).alias("confidence"))


@register("bridge_candidates", f"WITH {TF_SQL}, {SHARED_SQL}, e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents)) SELECT a, b, len(terms) AS n, least(1.0, len(terms) / 10.0)::DOUBLE AS confidence FROM shared ANTI JOIN e USING (a, b) WHERE len(terms) >= 3")
def bridge_candidates(spark, d):
    edges = docs(spark, d).select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))
    out = corpus.bridges(corpus.shared_terms(weights(spark, d, least=0.1), 0.1, 3), edges)
    return out.select("a", "b", F.size("terms").cast("bigint").alias("n"), "confidence")


@register(
    "class_tfidf_terms",
    f"WITH {TF_SQL}, m AS (SELECT doc_id, source FROM documents), sizes AS (SELECT source, count(*) AS size FROM m GROUP BY 1), s AS (SELECT source, term, sum(tf) AS s FROM tf JOIN m USING (doc_id) GROUP BY 1, 2), d2 AS (SELECT term, count(*) AS df FROM s GROUP BY 1), sc AS (SELECT source, term, s / size * (ln((SELECT count(*) FROM sizes) / df::DOUBLE) + 1) AS weight FROM s JOIN sizes USING (source) JOIN d2 USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(weight * 1e9 + 0.5) DESC, term) AS rank FROM sc) SELECT source, rank::INTEGER AS rank, term, {r_sql('weight')} AS weight FROM r WHERE rank <= 10",
)
def class_tfidf_terms(spark, d):
    s = sections(spark, d)
    out = corpus.class_tfidf(corpus.section_tf(s), s.select("doc_id", F.col("source").alias("community_id")), 10)
    return out.select(F.col("community_id").alias("source"), "rank", "term", R(F.col("weight")).alias("weight"))


@register("section_profile", "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT doc_id, least(5, len(l)) AS n_sections, len(l) < 2 AS is_partial FROM l")
def section_profile(spark, d):
    s = sections(spark, d)
    n = sum((F.col(c).isNotNull().cast("bigint") for c in SECTIONS), F.lit(0))
    return s.select("doc_id", n.cast("bigint").alias("n_sections"), F.coalesce(*[F.col(c) for c in SECTIONS[1:]]).isNull().alias("is_partial"))


_ENGLISH = "[" + ", ".join(f"'{w}'" for w in T.ENGLISH_WORDS) + "]"


@register("english_heuristic", f"WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), s AS (SELECT doc_id, t, regexp_replace(t, '\\s', '', 'g') AS s FROM t) SELECT doc_id, length(s) > 0 AND length(s) - length(regexp_replace(s, '[a-z]', '', 'g')) >= 0.9 * length(s) AND len(list_intersect(list_distinct(regexp_split_to_array(t, '[^a-z]+')), {_ENGLISH})) >= 5 AS english FROM s")
def english_heuristic(spark, d):
    return docs(spark, d).select("doc_id", T.looks_english(F.col("text")).alias("english"))


PHRASES = ["of the", "in the", "and the", "de la", "der die"]


@register(
    "phrase_hits",
    "WITH t AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents), h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, t, instr(t, '{p}') AS place, {i} AS rank, '{p}' AS phrase FROM t" for i, p in enumerate(PHRASES))
    + ") SELECT doc_id, place, phrase, trim(regexp_extract(substr(t, 1, place - 1), '[^.!?]*$') || regexp_extract(substr(t, place), '^[^.!?]*[.!?]?')) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, rank) AS n FROM h WHERE place > 0) WHERE n = 1",
)
def phrase_hits(spark, d):
    hit = docs(spark, d).select("doc_id", T.first_phrase(F.col("text"), PHRASES).alias("h")).filter("h IS NOT NULL")
    return hit.select("doc_id", F.col("h.at").cast("bigint").alias("place"), "h.phrase", "h.snippet")


@register("keyword_palette", f"WITH {TF_SQL}, {TOP_SQL}, v AS (SELECT term, var_pop(weight) AS variance FROM top GROUP BY term HAVING count(*) >= 2) SELECT (row_number() OVER (ORDER BY floor(variance * 1e9 + 0.5) DESC, term) - 1)::INTEGER AS slot_index, term, {r_sql('variance')} AS variance FROM v ORDER BY 1 LIMIT 8")
def keyword_palette(spark, d):
    out = relational.keyword_variance(corpus.top_terms(weights(spark, d, top=5), 5))
    return out.select("slot_index", "term", R(F.col("variance")).alias("variance"))


@register("average_keywords", f"WITH {TF_SQL}, c AS (SELECT doc_id, count(*) AS n FROM tf GROUP BY doc_id) SELECT {r_sql('avg(least(n, 5))')} AS average FROM c")
def average_keywords(spark, d):
    c = corpus.section_tf(sections(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return c.agg(R(F.avg(F.least("n", F.lit(5)))).alias("average"))


@register("tag_signatures", "WITH t AS (SELECT DISTINCT doc_id, unnest([lang, source]) AS tag FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM t), df AS (SELECT tag, count(*) AS df FROM t GROUP BY tag) SELECT tag, df, floor((ln((1.0 + n) / (1 + df)) + 1) * 1e6 + 0.5) / 1e6 AS idf FROM df, n")
def tag_signatures(spark, d):
    t = docs(spark, d).select("doc_id", F.explode(F.array("lang", "source")).alias("tag")).distinct()
    n = t.select("doc_id").distinct().count()
    return t.groupBy("tag").agg(F.count("*").alias("df")).select("tag", "df", R(corpus.idf(F.col("df"), F.lit(n))).alias("idf"))


@register(
    "benchmark_lexical_rank",
    f"WITH i AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL.format('text')}) AS t FROM benchmark), o AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL.format('coalesce(text, chr(32))')}) AS t FROM documents), c AS (SELECT item_id, doc_id, count(*) AS shared FROM i JOIN o USING (t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM c) SELECT item_id, rank::INTEGER AS rank, doc_id, shared FROM r WHERE rank <= 3",
)
def benchmark_lexical_rank(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    words = docs(spark, d).select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    shared = items.join(words, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).withColumnRenamed("shared", "weight")
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("weight"), "doc_id")))
    return ranked.filter("rank <= 3").select("item_id", "rank", "doc_id", F.col("weight").alias("shared"))
