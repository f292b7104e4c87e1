"""An evaluation corpus: a folder an item with labels.json, result.json and script.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "thesis_id string, title string, fields array<string>, expected_chapters array<string>, must_be_absent array<string>, must_be_present array<string>, notes string"
RESULT = "chapters_detected int, backmatter_skipped_blocks int"


def _folder():
    return F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(item, script, detected, expected, must_be_absent, must_be_present), joined by folder."""
    read = lambda schema, name: spark.read.schema(schema).option("multiLine", True).json(f"{path}/*/{name}").withColumn("item", _folder())
    labels, result = read(LABELS, "labels.json"), read(RESULT, "result.json")
    scripts = spark.read.text(f"{path}/*/script.md", wholetext=True).select(_folder().alias("item"), F.col("value").alias("script"))
    none = F.array().cast("array<string>")
    return labels.join(result, "item").join(scripts, "item").select(
        "item", "script", F.coalesce("chapters_detected", F.lit(0)).alias("detected"), F.size(F.coalesce("expected_chapters", none)).alias("expected"),
        F.coalesce("must_be_absent", none).alias("must_be_absent"), F.coalesce("must_be_present", none).alias("must_be_present"),
    )
