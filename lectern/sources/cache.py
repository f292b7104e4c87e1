"""A content-addressed cache as a table: (prefix, key, value), partitioned by the key's first two characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value binary, prefix string"


def cache_key(prefix: str, *parts: Column) -> Column:
    """prefix and the SHA-256 of the parts, a line each."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\n", *parts), 256))


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if _path(spark, path) else spark.createDataFrame([], SCHEMA)


def get(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """keys(key, ...) with their cached value, or null. A key that two writers have put at a time counts once."""
    return keys.join(cache.select("key", "value").dropDuplicates(["key"]), "key", "left")


def put(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append rows(key, value) that the cache lacks; empty values are never kept."""
    new = rows.where("value is not null and length(value) > 0").dropDuplicates(["key"]).join(read(spark, path).select("key"), "key", "left_anti")
    new.withColumn("prefix", F.substring("key", 1, 2)).select("key", "value", "prefix").write.mode("append").partitionBy("prefix").parquet(path)
