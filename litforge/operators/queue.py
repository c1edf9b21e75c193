"""The crawl queue as a table, and the crawl as supersteps over stored references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.functions.text import strip_version
from litforge.operators.relational import dedup_first
from litforge.session import materialize

SCHEMA = "paper_id string, seed_paper_id string, depth_level int, status string, retry_count int, created_at string, claimed_at string, completed_at string, source string"
PENDING, FETCHING, DONE, FAILED = "pending", "fetching", "done", "failed"


def enqueue_if_absent(queue: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """``new(paper_id, seed_paper_id, depth_level)`` joins as pending unless its pair is there; the shallowest of repeats."""
    rows = dedup_first(new.withColumn("paper_id", strip_version(F.col("paper_id"))), F.struct("paper_id", "seed_paper_id"), "depth_level")
    rows = rows.join(queue.select("paper_id", "seed_paper_id"), ["paper_id", "seed_paper_id"], "left_anti")
    nothing = F.lit(None).cast("string")
    rows = rows.select("paper_id", "seed_paper_id", F.col("depth_level").cast("int"), F.lit(PENDING).alias("status"), F.lit(0).alias("retry_count"), F.lit(now).alias("created_at"), nothing.alias("claimed_at"), nothing.alias("completed_at"), nothing.alias("source"))
    return queue.unionByName(rows)


def next_pending(queue: DataFrame, n: int = 1) -> DataFrame:
    """The shallowest, then oldest."""
    return queue.filter(F.col("status") == PENDING).orderBy("depth_level", "created_at", "paper_id").limit(n)


def claim_level(queue: DataFrame, now: str) -> DataFrame:
    """The queue with all pending rows of the shallowest level being fetched."""
    level = queue.filter(F.col("status") == PENDING).agg(F.min("depth_level")).first()[0]
    chosen = (F.col("status") == PENDING) & (F.col("depth_level") == F.lit(level))
    return _set(queue, F.coalesce(chosen, F.lit(False)), FETCHING, claimed_at=F.lit(now))


def _set(queue: DataFrame, where, status: str, **columns) -> DataFrame:
    columns["status"] = F.lit(status)
    return queue.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in columns.items()})


def mark_done(queue: DataFrame, ids: DataFrame, now: str, source: str | None = None) -> DataFrame:
    return _mark(queue, ids, DONE, completed_at=F.lit(now), source=F.lit(source).cast("string"))


def mark_failed(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return _mark(queue, ids, FAILED, retry_count=F.col("retry_count") + 1)


def _mark(queue: DataFrame, ids: DataFrame, status: str, **columns) -> DataFrame:
    hit = ids.select("paper_id", "seed_paper_id").distinct().withColumn("__hit", F.lit(True))
    joined = queue.join(hit, ["paper_id", "seed_paper_id"], "left")
    return _set(joined, F.col("__hit").isNotNull(), status, **columns).select(*queue.columns)


def reset_stale(queue: DataFrame) -> DataFrame:
    return _set(queue, F.col("status") == FETCHING, PENDING, claimed_at=F.lit(None).cast("string"))


def retry_failed(queue: DataFrame, most: int = 1) -> DataFrame:
    return _set(queue, (F.col("status") == FAILED) & (F.col("retry_count") <= most), PENDING)


def clear(queue: DataFrame, seed: str | None = None) -> DataFrame:
    return queue.filter(F.lit(False) if seed is None else F.col("seed_paper_id") != seed)


def counts(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in (PENDING, FETCHING, DONE, FAILED)])


def has_completed(queue: DataFrame, seed: str) -> bool:
    mine = queue.filter(F.col("seed_paper_id") == seed)
    return not mine.isEmpty() and mine.filter(F.col("status").isin(PENDING, FETCHING)).isEmpty()


def crawl(references: DataFrame, known: DataFrame, seed: str, max_depth: int, now: str = "1970-01-01T00:00:00+00:00") -> tuple[DataFrame, DataFrame]:
    """Crawl stored ``references(src, dst)`` of ``known(id)`` papers: the final queue and the edges found.

    A level is claimed at once.  Papers beyond the depth are done without being
    fetched, unknown ones fail and are retried once; all edges are kept, and
    readers filter by existence.
    """
    spark = references.sparkSession
    queue = enqueue_if_absent(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(seed, seed, 0)], "paper_id string, seed_paper_id string, depth_level int"), now)
    edges = materialize(references.select("src", "dst").limit(0), "crawl-edges")
    retried = False
    for step in range(4 * (max_depth + 2)):
        queue = materialize(claim_level(queue, now), f"crawl-{step}")
        batch = queue.filter(F.col("status") == FETCHING)
        if batch.isEmpty():
            failed = queue.filter((F.col("status") == FAILED) & (F.col("retry_count") <= 1))
            if retried or failed.isEmpty():
                return queue, edges
            retried, queue = True, retry_failed(queue)
            continue
        deep = batch.filter(F.col("depth_level") > max_depth)
        near = batch.filter(F.col("depth_level") <= max_depth).join(known.select(F.col("id").alias("paper_id")).distinct(), "paper_id", "left_semi")
        found = materialize(references.join(near.select(F.col("paper_id").alias("src"), "seed_paper_id", "depth_level"), "src"), f"crawl-found-{step}")
        edges = edges.unionByName(found.select("src", "dst"))
        done = near.select("paper_id", "seed_paper_id").unionByName(deep.select("paper_id", "seed_paper_id"))
        queue = mark_done(queue, done, now, "local")
        queue = mark_failed(queue, queue.filter(F.col("status") == FETCHING))
        queue = enqueue_if_absent(queue, found.select(F.col("dst").alias("paper_id"), "seed_paper_id", (F.col("depth_level") + 1).alias("depth_level")), now)
    return queue, edges
