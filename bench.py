"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import importlib
import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "chunk_plan", "text_normalized", "word_classes", "running_artifacts", "chapter_islands", "provenance_timeline", "blocks_at_time",
    "regions_applied", "pages_assigned", "integer_words", "section_words", "raw_token_leaks", "document_fingerprint",
]


def main() -> None:
    shared = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    names = [n for n in HEADLINE if n in queries] + sorted((n for n in queries if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for n in names:
        start = time.time()
        queries[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
