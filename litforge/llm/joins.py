"""Joins by a key that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.0005


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The hot ones of ``counts(key, n)``, which names every key once with its rows: at most 1 / HOT_SHARE."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(key).isNotNull() & (F.col(n) > max(1, HOT_SHARE * total))).select(key)


def with_facts(rows: DataFrame, facts: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has a key once.

    The facts of hot keys are broadcast, so these rows stay where they are; the
    others are shuffled.  Rows without a key have no facts and stay too.
    """
    nothing = [F.lit(None).cast(t).alias(c) for c, t in facts.dtypes if c != key]
    few = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    known = rows.filter(F.col(key).isNotNull())
    out = known.join(F.broadcast(hot), key, "left_semi").join(few, key, "left")
    out = out.unionByName(known.join(F.broadcast(hot), key, "left_anti").join(facts, key, "left"))
    return out.unionByName(rows.filter(F.col(key).isNull()).select("*", *nothing))
