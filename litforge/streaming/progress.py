"""Progress events as a stream: counts by kind, and the crawl queue kept by micro-batches.

Windows and watermarks are an extension of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1, schema: str = EVENT) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and kind; later ones than the watermark are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def run_available(counts: DataFrame, folder: str) -> DataFrame:
    """The whole result when the source is read up.

    Every micro-batch writes its state of the result to a folder of its own, so a
    batch that is repeated writes the same again; the last one is read.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result-{number}")
        done.append(number)

    query = counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(f"{folder}/result-{done[-1]}") if done else counts.sparkSession.createDataFrame([], counts.schema)


def upsert_stream(rows: DataFrame, catalog, name: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch is upserted into a catalog table; repeating a batch changes nothing."""
    query = rows.writeStream.foreachBatch(lambda batch, _: catalog.upsert(name, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
