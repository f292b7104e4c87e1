"""Documents as a stream: micro-batches run the batch expressions and insert what a table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.speak import normalize_all
from ..sources import cache


def normalized(docs: DataFrame) -> DataFrame:
    """(key, value): the speakable text under the hash of the source text."""
    return docs.select(cache.cache_key("normalize.", F.col("text")).alias("key"), normalize_all(F.coalesce("text", F.lit(""))).cast("binary").alias("value"))


def start(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files of source once and appends to the cache table; a replayed batch adds nothing."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, _: int) -> None:
        cache.put(rows.sparkSession, normalized(rows), table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling hours of events(ts, event_type); late rows within the watermark count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
