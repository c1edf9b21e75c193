r"""Quality rules with host verdicts.

Each document is measured in place by array functions over its words and lines,
and tried by four rules: base (too few words, or too many in repeated windows),
symbols, repeated lines and length of words.  The failures of each rule are
summed by host (the column ``source``).  For each rule a beta prior of the
failure rate is fitted to all hosts by moments, each host's rate is shrunk towards
the prior's mean, and a host is rejected where a shrunk rate is above the rule's
limit: SPREAD standard deviations above the prior's mean, within HOST_LIMITS.  So
hosts that fail alike, as they do where failures are the documents' own, all
stay, and one that fails far more than its peers goes.  A document is kept if it
fails no rule itself and its host isn't rejected.

Words are ``[^\x20\x09-\x0D]+``.  Cases: null or empty text has no words and
fails; a null host is a host of its own; repeated rows count once each; an empty
frame gives an empty frame; very long texts need memory for their word arrays
only, as one row is measured at a time; columns of clashing names are kept by ``keep_good``
and read by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.session import materialize, table

#: Production parameters.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Most symbols and repeated lines of a sound text, in per cent of its characters and lines, and its words' mean length.
MAX_SYMBOL_PERCENT = 5
MAX_DUP_LINE_PERCENT = 35
MIN_LINES = 4
WORD_LENGTH = (2, 15)
#: A host's shrunk rate may be so many standard deviations of the prior above its mean; the limit is within these bounds.
SPREAD = 4.0
HOST_LIMITS = (0.3, 0.8)
#: Up to so many hosts are broadcast (under 10 MB); beyond, hosts are joined by shuffle.
BROADCAST_HOSTS = 100_000
#: The prior weighs as much as this many documents at least and at most.
PRIOR_WEIGHT = (1.0, 10_000.0)

_REPEATED = """
transform(array(transform(sequence(0, size(w) - 3), i -> named_struct('k', xxhash64(w[i], w[i + 1], w[i + 2]), 'p', i))), t ->
  if(size(array_distinct(transform(t, x -> x.k))) = size(t), 0L,
    transform(array(sort_array(t)), s ->
      transform(array(sort_array(transform(filter(s, (x, j) -> x.k = get(s, j - 1).k OR x.k = get(s, j + 1).k), x -> x.p))), d ->
        aggregate(transform(d, (p, j) -> CAST(least(3, coalesce(get(d, j + 1), p + 3) - p) AS BIGINT)), 0L, (a, x) -> a + x))[0])[0]))[0]
"""

_METRICS = f"""
transform(array(coalesce(text, '')), t -> transform(array(translate(t, ' \\t\\n\\u000b\\u000c\\r', '')), packed ->
  transform(array(filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')), w ->
    transform(array(filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), lines -> named_struct(
      'n_words', CAST(size(w) AS BIGINT),
      'word_chars', CAST(length(packed) AS BIGINT),
      'n_symbols', CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT),
      'n_lines', CAST(size(lines) AS BIGINT),
      'n_dup_lines', CAST(size(lines) - size(array_distinct(lines)) AS BIGINT),
      'n_repeat_words', if(size(w) < 4, 0L, {_REPEATED})))[0])[0])[0])[0]
"""


RULES = {
    "base": f"m.n_words < {MIN_WORDS} OR 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words",
    "symbols": f"100 * m.n_symbols > {MAX_SYMBOL_PERCENT} * m.word_chars",
    "lines": f"m.n_lines >= {MIN_LINES} AND 100 * m.n_dup_lines > {MAX_DUP_LINE_PERCENT} * m.n_lines",
    "words": f"m.word_chars < {WORD_LENGTH[0]} * m.n_words OR m.word_chars > {WORD_LENGTH[1]} * m.n_words",
}


def measure(df: DataFrame) -> DataFrame:
    """``df`` with a struct ``m`` of the base measures and a struct ``failed`` of the rules."""
    failed = F.struct(*[F.expr(rule).alias(name) for name, rule in RULES.items()])
    return df.withColumn("m", F.expr(_METRICS)).withColumn("failed", failed)


def _prior(total: dict, rule: str, spread: float, limits: tuple[float, float]) -> tuple[float, float, float]:
    """Mean and weight of the prior, and the limit, from sums over hosts of n, f and f * f / n."""
    n, f, ff = float(total["n"] or 0), float(total[f"f_{rule}"] or 0), float(total[f"ff_{rule}"] or 0)
    if not n:
        return 0.0, PRIOR_WEIGHT[0], limits[0]
    mean = f / n
    between = ff / n - mean * mean
    weight = mean * (1 - mean) / between - 1 if between > 1e-12 else PRIOR_WEIGHT[1]
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    limit = mean + spread * (mean * (1 - mean) / (weight + 1)) ** 0.5
    return mean, weight, min(max(limit, limits[0]), limits[1])


def host_verdicts(measured: DataFrame, spread: float = SPREAD, limits: tuple[float, float] = HOST_LIMITS) -> DataFrame:
    """``host, n, host_ok`` and the shrunk rate of each rule, from ``host`` and ``failed`` of every document."""
    failures = [F.count_if(F.col("failed")[r]).alias(f"f_{r}") for r in RULES]
    hosts = materialize(measured.groupBy("host").agg(F.count("*").alias("n"), *failures), "quality-hosts")
    # One row: sums over hosts.
    sums = [x for r in RULES for x in (F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"ff_{r}"))]
    total = hosts.agg(F.sum("n").alias("n"), *sums).first().asDict()
    rates, ok = [], F.lit(True)
    for r in RULES:
        mean, weight, limit = _prior(total, r, spread, limits)
        rate = (F.col(f"f_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        rates.append(rate.alias(f"rate_{r}"))
        ok = ok & (rate <= F.lit(limit))
    verdicts = hosts.select("host", "n", *rates, ok.alias("host_ok"))
    return F.broadcast(verdicts) if hosts.count() <= BROADCAST_HOSTS else verdicts


def with_verdict(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``measured`` with ``kept``."""
    v = verdicts.select(F.col("host").alias("verdict_host"), "host_ok")
    joined = measured.join(v, measured["host"].eqNullSafe(v["verdict_host"]), "left").drop("verdict_host")
    sound = F.lit(True)
    for r in RULES:
        sound = sound & ~F.col("failed")[r]
    return joined.withColumn("kept", sound & F.coalesce(F.col("host_ok"), F.lit(True)))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    Each text is measured once: rows are written with what failed, and those that
    fail by themselves without their columns.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    rows = measure(packed.select("row", F.col(f"row.{host}").alias("host"), F.col("row.text").alias("text")))
    sound = F.lit(True)
    for r in RULES:
        sound = sound & ~F.col("failed")[r]
    rows = materialize(rows.select(F.when(sound, F.col("row")).alias("row"), "host", "failed"), "quality-rows")
    return with_verdict(rows, host_verdicts(rows)).filter("kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text")
    measured = materialize(measure(docs).select("doc_id", "host", "m.*", "failed"), "quality-measures")
    judged = with_verdict(measured, host_verdicts(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed")["base"].alias("base_failed"), "kept")


_FLAGS = {r: rule.replace("m.", "") for r, rule in RULES.items()}
_PRIOR_SQL = """prior_{r} AS (
  SELECT mean, weight, least(greatest(mean + {spread} * sqrt(mean * (1 - mean) / (weight + 1)), {low}), {high}) AS lim FROM (
    SELECT mean, least(greatest(CASE WHEN ff - mean * mean > 1e-12 THEN mean * (1 - mean) / (ff - mean * mean) - 1 ELSE {most} END, {least}), {most}) AS weight
    FROM (SELECT sum(f_{r}) / sum(n) AS mean, sum(f_{r} * f_{r} / n) / sum(n) AS ff FROM hosts)))"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {
    "op8_quality_rules": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
grams AS (
  SELECT r, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
counted AS (
  SELECT r, i, (w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w2, w3) > 1) AS twice FROM grams),
covered AS (
  SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit
  FROM counted WINDOW o AS (PARTITION BY r ORDER BY i)),
repeats AS (SELECT r, count(*) AS n_words, count(*) FILTER (hit) AS n_repeat_words FROM covered GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, {", ".join(f"({rule}) AS bad_{r}" for r, rule in _FLAGS.items())} FROM measured),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"(count(*) FILTER (bad_{r}))::DOUBLE AS f_{r}" for r in RULES)} FROM judged GROUP BY source),
{", ".join(_PRIOR_SQL.format(r=r, spread=SPREAD, low=HOST_LIMITS[0], high=HOST_LIMITS[1], least=PRIOR_WEIGHT[0], most=PRIOR_WEIGHT[1]) for r in RULES)},
verdicts AS (
  SELECT source, {" AND ".join(f"(f_{r} + prior_{r}.mean * prior_{r}.weight) / (n + prior_{r}.weight) <= prior_{r}.lim" for r in RULES)} AS host_ok
  FROM hosts, {", ".join(f"prior_{r}" for r in RULES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad_base AS base_failed,
       NOT ({" OR ".join(f"bad_{r}" for r in RULES)}) AND host_ok AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
""",
}
