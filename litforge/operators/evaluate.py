"""Retrieval measures, rank statistics and tests of significance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.operators.ordered import running
from litforge.session import materialize, release


def ranked(scores: DataFrame) -> DataFrame:
    """``rank`` of candidates within a query: score falling, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    return scores.withColumn("rank", F.row_number().over(order))


def against_all(queries: DataFrame, rows: DataFrame, block: int = 500) -> DataFrame:
    """Every row beside every row of a stated set of queries.

    Both sides are cut into blocks of about ``block`` rows; each pair of blocks is
    a key of an equi-join, so the pairs are spread over tasks of a fixed size.
    """
    cuts = [max(1, -(-side.count() // block)) for side in (queries, rows)]
    own = [F.pmod(F.xxhash64(*[c for c, t in side.dtypes if not t.startswith(("array", "map", "struct"))]), F.lit(n)).cast("int") for side, n in zip((queries, rows), cuts, strict=True)]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in cuts]
    left = queries.select("*", own[0].alias("__i"), every[1].alias("__j"))
    right = rows.select("*", every[0].alias("__i"), own[1].alias("__j"))
    return left.join(right, ["__i", "__j"]).drop("__i", "__j")


def recall_and_mrr(ranks: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row over directed pairs ``truth(query_id, cand_id)``; a missing rank is a miss."""
    r = truth.join(ranks.select("query_id", "cand_id", "rank"), ["query_id", "cand_id"], "left")
    hits = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return r.agg(F.count("*").alias("pairs"), *hits, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the curve of ``(score, positive)`` by mid-ranks; a tie counts half.

    Counts per score come first, so the window sees distinct scores, not rows.
    """
    by = by or []
    counts = scored.groupBy(*by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    if by:
        below = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        parts = counts.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    else:
        parts = running(counts, ["score"], {"below": "n"})
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return parts.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.try_divide(wins, F.sum("p") * F.sum("n")).alias("auc"))


def delta_auc(rows: DataFrame, limit: float) -> DataFrame:
    """Areas of two scorers and their difference over rows off the diagonal: those whose objects are less alike than ``limit``.

    ``rows(method, symmetric, object, positive)``; rows without a symmetric score don't count.
    """
    kept = rows.filter((F.col("object") < limit) & F.col("symmetric").isNotNull())
    a = auc(kept.select(F.col("method").alias("score"), "positive")).withColumnRenamed("auc", "auc_method")
    b = auc(kept.select(F.col("symmetric").alias("score"), "positive")).select(F.col("auc").alias("auc_symmetric"))
    return a.join(b).withColumn("delta", F.col("auc_method") - F.col("auc_symmetric"))


def surface_hard(ranks: DataFrame, pairs: DataFrame, beyond: int = 10) -> DataFrame:
    """The ``pairs(query_id, cand_id)`` that the plain ranking finds only beyond this rank."""
    return pairs.join(ranks.filter(F.col("rank") > beyond).select("query_id", "cand_id"), ["query_id", "cand_id"], "left_semi")


def candidate_order(pairs: DataFrame, n: int) -> DataFrame:
    """The first n candidates by rank, then words shared, then ids, with their place."""
    order = [F.col(c) for c in ("rank", "lexical", "query_id", "cand_id")]
    best = pairs.orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def tag_gate(pairs: DataFrame, tags: DataFrame, bar: int) -> DataFrame:
    """How many of ``pairs(a, b)`` share a tag of ``tags(doc_id, tags)``, and whether that passes the bar."""
    sides = [tags.select(F.col("doc_id").alias(x), F.col("tags").alias(f"t_{x}")) for x in "ab"]
    shared = F.arrays_overlap("t_a", "t_b")
    rows = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
    out = rows.agg(F.count("*").alias("pairs"), F.count_if(F.coalesce(shared, F.lit(False))).alias("hits"))
    return out.withColumn("recall", F.when(F.col("pairs") > 0, F.col("hits") / F.col("pairs")).otherwise(0.0)).withColumn("passes", F.col("hits") >= bar)


def best_null(units: DataFrame) -> DataFrame:
    """Scores of the clean units: their number, yield, field pairs, and mean percentile of the better null.

    ``units(lexical, embedding, clean, field_a, field_b)``; the embedding's percentile may be missing.
    """
    better = F.least("lexical", "embedding")  # skips nulls
    fields = F.concat_ws(" || ", "field_a", "field_b")
    return units.agg(
        F.count("*").alias("scored"), F.count_if("clean").alias("clean"), F.avg(F.col("clean").cast("double")).alias("clean_yield"),
        F.countDistinct(F.when(F.col("clean"), fields)).alias("field_pairs"), F.avg(F.when(F.col("clean"), better)).alias("best_null"),
    )


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of two boolean annotations ``(a, b)``."""
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    m = pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select("n", F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_whitney_p(area: float, positives: int, negatives: int) -> float:
    """One-sided normal p of an area above one half."""
    if not positives or not negatives:
        return float("nan")
    sigma = math.sqrt((positives + negatives + 1) / (12.0 * positives * negatives))
    return normal_tail((area - 0.5) / sigma)


def fisher_one_sided(a: int, b: int, c: int, d: int) -> float:
    """Chance of ``a`` or more in the first cell of [[a, b], [c, d]]."""
    pick = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    n, row, col = a + b + c + d, a + b, a + c
    return min(1.0, sum(math.exp(pick(row, k) + pick(n - row, col - k) - pick(n, col)) for k in range(a, min(row, col) + 1) if col - k <= n - row))


def binomial_tail(k: int, n: int, p: float) -> float:
    if p <= 0:
        return 1.0 if k <= 0 else 0.0
    if p >= 1:
        return 1.0 if k <= n else 0.0
    pick = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    return min(1.0, sum(math.exp(pick(i) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(max(k, 0), n + 1)))


def wilcoxon_above(values: np.ndarray, delta: float = 0.0) -> float:
    """One-sided signed-rank p that values exceed ``delta``, by the normal approximation with tie correction."""
    d = np.asarray(values, float) - delta
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    _, ties = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return normal_tail((ranks[d > 0].sum() - n * (n + 1) / 4) / math.sqrt(var)) if var else 1.0


def bootstrap_ci(values: DataFrame, key: str | None = None, rounds: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Bootstrap interval of the mean of ``value`` (differences of pairs, say) in each group, seeded.

    Resampling is by counts of distinct values, so a group's task holds its
    distinct values and not its rows.
    """
    name = key or "all"
    counts = (values if key else values.withColumn(name, F.lit(0))).groupBy(name, "value").agg(F.count("*").alias("n"))
    kind = dict(counts.dtypes)[name]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("value")
        rng, n = np.random.default_rng(seed), int(g["n"].sum())
        draws = rng.multinomial(n, g["n"] / n, size=rounds) @ g["value"].to_numpy() / n
        low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([(g[name].iloc[0], n, float((g["value"] * g["n"]).sum() / n), float(low), float(high))])

    return counts.groupBy(name).applyInPandas(run, f"{name} {kind}, n long, mean double, low double, high double")


def degree_strata(pairs: DataFrame, degrees: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with the sum of both degrees and ``rich``: above the median sum."""
    d = degrees.select("id", "degree")
    sums = pairs.join(d.withColumnsRenamed({"id": "a", "degree": "da"}), "a").join(d.withColumnsRenamed({"id": "b", "degree": "db"}), "b")
    sums = sums.withColumn("degree_sum", F.col("da") + F.col("db")).drop("da", "db")
    middle = sums.agg(F.median("degree_sum").alias("middle"))
    return sums.join(F.broadcast(middle)).withColumn("rich", F.col("degree_sum") > F.col("middle")).drop("middle")


def repaired_ranking(ranking: Column, pool: Column) -> Column:
    """A model's ranking made whole: unknown ids and repeats dropped, missing ones appended in order."""
    known = F.array_distinct(F.filter(ranking, lambda x: F.array_contains(pool, x)))
    return F.concat(known, F.array_sort(F.array_except(pool, known)))


def rank_percentile(rank: Column, size: Column) -> Column:
    return F.when(size > 1, 100.0 * (rank - 1) / (size - 1)).otherwise(0.0)


def union_rerank(first: DataFrame, second: DataFrame, n: int = 15) -> DataFrame:
    """Union of the top n of two rankings per query, first seen first: ``(query_id, cand_id, place)``."""
    a = first.filter(F.col("rank") <= n).select("query_id", "cand_id", F.struct(F.lit(0).alias("source"), F.col("rank")).alias("seen"))
    b = second.filter(F.col("rank") <= n).select("query_id", "cand_id", F.struct(F.lit(1).alias("source"), F.col("rank")).alias("seen"))
    both = a.unionByName(b).groupBy("query_id", "cand_id").agg(F.min("seen").alias("seen"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "cand_id"))).drop("seen")


def first_seen_pairs(pairs: DataFrame, *order: Column | str) -> DataFrame:
    """One row of each unordered pair ``(query_id, cand_id)``: the first in the given order."""
    key = Window.partitionBy(F.least("query_id", "cand_id"), F.greatest("query_id", "cand_id")).orderBy(*order)
    return pairs.withColumn("nth", F.row_number().over(key)).filter("nth = 1").drop("nth")


def hidden_bridges(pairs: DataFrame, most_rank: int = 3, most_lexical: float = 0.06) -> DataFrame:
    """Candidates near in structure, far in words, of another field and no known partner."""
    return pairs.filter((F.col("rank") <= most_rank) & (F.col("lexical") < most_lexical) & (F.col("query_field") != F.col("cand_field")) & ~F.coalesce("partner", F.lit(False)))


def hyde_scores(hypotheses: DataFrame, base: DataFrame, penalty: float, how: str = "max") -> DataFrame:
    """Best (or mean) cosine of a query's hypotheses to a candidate, less ``penalty`` times its own."""
    best = hypotheses.groupBy("query_id", "cand_id").agg((F.max if how == "max" else F.avg)("cosine").alias("h"))
    own = base.select("query_id", "cand_id", F.col("cosine").alias("c"))
    return best.join(own, ["query_id", "cand_id"]).select("query_id", "cand_id", (F.col("h") - penalty * F.col("c")).alias("score"))


def clean_pair(recall_fired: Column, recognition_right: Column, confidence: Column) -> Column:
    return ~recall_fired & ~recognition_right & (confidence <= 0.5)


def gate(recall: Column, missed: Column, anchor_rank: Column, least: float, strict: bool) -> Column:
    """Recall over (or at) its bar, a pair that the null missed, and the anchor in the top ten."""
    bar = recall > least if strict else recall >= least
    return bar & (missed >= 1) & (anchor_rank <= 10)


def stratified_budget(rows: DataFrame, stratum: str, budgets: dict[str, int], *order: Column | str) -> DataFrame:
    """The first rows of each stratum, as many as its budget."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    most = F.coalesce(F.element_at(F.create_map(*[x for k, v in budgets.items() for x in (F.lit(k), F.lit(v))]), F.col(stratum)), F.lit(0))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def hash_selection(rows: DataFrame, domain: str, pair: str, item: str, k: int) -> DataFrame:
    """k items of each pair in the order of SHA-256(domain, pair, item), joined by unit separators."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(domain), F.col(pair).cast("string"), F.col(item).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(pair).orderBy(digest, item))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def round_robin(rows: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """Cycle over the sorted groups taking the next member of each, n in all."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(item))
    return rows.withColumn("nth", nth).orderBy("nth", group).limit(n)


def stride_sample(rows: DataFrame, key: str, n: int, stride: int = 7, offset: int = 3) -> DataFrame:
    """Rows at places stride * i + offset, modulo the count, of the order of ``key``."""
    placed = running(rows, [key]).withColumn("at", F.col("nth") - 1).drop("nth")
    total = rows.count()
    wanted = rows.sparkSession.range(min(n, total)).select(((F.col("id") * stride + offset) % max(total, 1)).alias("at")).distinct()
    return placed.join(F.broadcast(wanted), "at").drop("at")


def verdict(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """A total decision: the first rule that holds."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(otherwise)


def cas_verify(hyde: Column, shared_tokens: Column, cosine: Column) -> Column:
    """Struct of whether a candidate's method coheres and its object differs."""
    return F.struct(((hyde > 0) & (shared_tokens >= 2)).alias("method_coherence"), (cosine < 0.15).alias("object_difference"))


def pruned(checks: Column, mode: str) -> Column:
    """Whether a candidate goes: neither holds (conservative), either fails (aggressive), or the method fails (headline)."""
    method, differs = checks["method_coherence"], checks["object_difference"]
    return {"conservative": ~method & ~differs, "aggressive": ~method | ~differs, "headline": ~method}[mode]


def prune_statistics(candidates: DataFrame) -> DataFrame:
    """Per query: candidates, those pruned, and the share of one community; ``(query_id, pruned, same_community)``."""
    return candidates.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if("pruned").alias("pruned"), F.avg(F.col("same_community").cast("double")).alias("same_share"))


def cascade_recall(scores: DataFrame, truth: DataFrame, bar: float = 0.40) -> DataFrame:
    """Recall at ten of all candidates and of those that pruning leaves, and whether the latter passes its bar.

    ``scores(query_id, cand_id, score, pruned)``; a pruned truth is a miss.
    """
    whole = recall_and_mrr(ranked(scores), truth, (10,)).select(F.col("recall_10").alias("recall_all"))
    left = recall_and_mrr(ranked(scores.filter("NOT pruned")), truth, (10,)).select(F.col("recall_10").alias("recall_pruned"))
    depth = scores.groupBy("query_id").agg(F.count_if("pruned").alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("least_pruned"))
    out = whole.join(left).join(depth)
    return out.withColumn("passes", (F.col("recall_pruned") > bar) & (F.col("least_pruned") >= 2))


def objective_cards(pairs: DataFrame) -> DataFrame:
    """Queries whose true partner of another field beats the median of their own field by more than 0.02.

    ``pairs(query_id, cand_id, cosine, same_field, is_true)``.
    """
    facts = pairs.groupBy("query_id").agg(F.median(F.when(F.col("same_field") & ~F.col("is_true"), F.col("cosine"))).alias("middle"), F.max(F.when(F.col("is_true"), F.col("cosine"))).alias("cosine"), F.bool_or(F.col("is_true") & ~F.col("same_field")).alias("crosses"))
    return facts.withColumn("card", F.coalesce(F.col("crosses") & (F.col("cosine") > F.col("middle") + 0.02), F.lit(False)))


def separability(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """Whether methods and objects come apart: ``pairs(method_cosine, object_cosine)``, ``papers(cosine)`` within each."""
    n = pairs.agg(F.count_if(F.col("method_cosine") > F.col("object_cosine")).alias("pairs"))
    m = papers.agg(F.avg("cosine").alias("within"))
    return n.join(m).withColumn("separable", (F.col("pairs") >= 3) & (F.col("within") < 0.85))


def mine_pairs(references: DataFrame) -> DataFrame:
    """A pair of papers of the two most cited fields of each bridge paper.

    ``references(bridge, paper, field)``: fields by count then name, the first
    paper by id for each.  No paper is used twice: pairs are taken greedily in
    order of bridge.  A round takes every pair that comes first for both of its
    papers, as the greedy walk would, and drops those that share a paper with it.
    """
    fields = references.groupBy("bridge", "field").agg(F.countDistinct("paper").alias("n"), F.min("paper").alias("paper"))
    order = Window.partitionBy("bridge").orderBy(F.desc("n"), "field")
    two = fields.withColumn("place", F.row_number().over(order)).filter("place <= 2")
    pairs = two.groupBy("bridge").agg(F.min_by("paper", "place").alias("side_a"), F.max_by("paper", "place").alias("side_b"), F.count("*").alias("n")).filter("n = 2").drop("n")
    left, taken = materialize(pairs, "mined-0"), []
    while not left.isEmpty():
        first = left.select("bridge", F.explode(F.array("side_a", "side_b")).alias("paper")).groupBy("paper").agg(F.min("bridge").alias("first"))
        sides = [first.select(F.col("paper").alias(side), F.col("first").alias(f"first_{side}")) for side in ("side_a", "side_b")]
        won = left.join(sides[0], "side_a").join(sides[1], "side_b").filter("first_side_a = bridge AND first_side_b = bridge")
        won = materialize(won.select(*pairs.columns), "mined-won")
        used = won.select(F.explode(F.array("side_a", "side_b")).alias("paper")).distinct()
        rest = left.join(used.withColumnRenamed("paper", "side_a"), "side_a", "left_anti").join(used.withColumnRenamed("paper", "side_b"), "side_b", "left_anti")
        older, left = left, materialize(rest.select(*pairs.columns), "mined-left")
        release(older)
        taken.append(won)
    out = pairs.limit(0)
    for won in taken:
        out = out.unionByName(won)
    return out
