"""Documents to packed training sequences: five stages, each written and read again.

(name, function) in STAGES; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return documents(doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard, mixing, packing, quality, queries, secrets
from lectern.llm.common import Scratch, text_of
from lectern.llm.encoding import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame, text) -> DataFrame:
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, Scratch]:
    """docs with a row number, written, so that rows with equal or null ids are told apart."""
    scratch = Scratch(spark, name)
    return scratch.save(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered"), scratch


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that the quality rules reject.

    Null and empty texts are rejected. Every row is judged by itself, so repeated rows share a verdict, not a row.
    """
    return _documents(quality.keep_clean(docs.select(*COLUMNS)), F.col("text"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays: that with the smallest id, null ids last.

    Rows without words have no copies and stay. Of equal ids in a group, repeated rows included, one row stays.
    """
    docs, scratch = _numbered(spark, docs, "near-copies")
    classes = jaccard.jaccard_components(spark, docs.select(F.col("_row").alias("doc_id"), "text"), scratch, words=5, percent=80)
    named = docs.select("_row", "doc_id").join(classes.select(F.col("doc_id").alias("_row"), "component_id").hint("shuffle_hash"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    stays = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return docs.join(stays.hint("shuffle_hash"), "_row").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays. Null texts become empty."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    found, _ = secrets.run_ledger(spark, versions, None)
    hit = found.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), "spans").groupBy("_blob").agg(F.first("spans").alias("spans"))
    met = docs.select(*COLUMNS).join(hit.hint("shuffle_hash"), secrets.blob_of(text_of()) == F.col("_blob"), "left")
    return _documents(met, F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redact(text_of(), F.col("spans"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows with equal ids are drawn each for itself. Texts without words add nothing to a target; they are repeated with
    the whole epochs of their source.
    """
    docs, scratch = _numbered(spark, docs, "mix")
    own = scratch.save(queries.sized(spark, docs, sf_dir), "sized")
    takes = mixing.mix(own).where("copies > 0").select(F.col("_row").alias("_of"), "copies")
    met = docs.join(takes.hint("shuffle_hash"), F.col("_row") == F.col("_of"))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a null text is its end id alone, and every copy of a row is packed."""
    return packing.pack(spark, docs, Scratch(spark, "pack"), tokenizer_path(queries.WORD_BPE))


STAGES = [("quality rules", clean), ("n-gram Jaccard join", deduplicate), ("secret scans", redact), ("mixing", mix), ("packing", pack)]
#: Shingle similarity, regular expression offsets and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
