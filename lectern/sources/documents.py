"""Sources: markdown, page text and document JSON as block tables, all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import split_display_math
from ..functions.text import LEXICON, Entry, classify_block

DOCUMENT = """
meta STRUCT<title STRING, author STRING, degree_date STRING, profile STRING>,
blocks ARRAY<STRUCT<id STRING, type STRING, chapter INT, section STRING, page INT, text STRING, spoken STRING, keep BOOLEAN,
  handling STRING, refs ARRAY<STRING>, latex STRING, confidence DOUBLE, notes ARRAY<STRING>>>,
figures MAP<STRING, STRUCT<id STRING, caption STRING, ref_points ARRAY<STRING>, page INT, spoken STRING>>,
equations MAP<STRING, STRUCT<id STRING, latex STRING, gloss STRING>>, tables MAP<STRING, STRUCT<id STRING, raw STRING, summary STRING>>,
script STRING, chunks ARRAY<STRUCT<id STRING, text STRING, chapter INT, block_ids ARRAY<STRING>, prev_id STRING, next_id STRING>>
"""


def by_doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, 0)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row a file; its path is the id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_document_json(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of document JSON files, with the defaults of absent fields."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("doc_id", F.input_file_name())
    rows = docs.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", F.col("b.id").alias("block_id"), "b.*").drop("id")
    return rows.fillna({"keep": True, "handling": "speak", "confidence": 1.0})


def is_table(chunk: Column) -> Column:
    """Two lines or more with text, all starting with a bar."""
    lines = F.filter(F.transform(F.split(chunk, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith("|"))


def clean_title(text: Column) -> Column:
    """White space collapsed; an all-capitals title in sentence case."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((F.upper(t) == t) & (F.lower(t) != t), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))).otherwise(t)


def looks_like_name(text: Column) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.size(words).between(2, 4) & ~text.rlike(r"\d") & F.get(words, F.lit(0)).rlike(r"^\p{Lu}") & F.element_at(words, -1).rlike(r"^\p{Lu}")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) in markdown as typed blocks, with running chapter, section and page.

    Chunks are separated by blank lines. Headings '# ...' may carry CHAPTER n or a dotted number; page anchors
    '{n}---' set the page; after an appendix heading nothing counts as a chapter.
    """
    chunks = docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    head = F.regexp_extract("raw", r"^#{1,6}\s+(.*)$", 1)
    bare = F.trim(F.regexp_replace(head, r"[*_]+", ""))
    latex = split_display_math(F.col("raw"))
    kind = (
        F.when(F.col("raw").rlike(r"^\{\d+\}-{3,}$"), "page_anchor")
        .when(head != "", "heading")
        .when(latex.isNotNull(), "equation_display")
        .when(F.col("raw").rlike(r"^!\[[^\]]*\]\([^)]*\)\s*$"), "image")
        .when(is_table(F.col("raw")), "table")
        .otherwise(classify_block(F.col("raw")))
    )
    rows = chunks.withColumn("type", kind).withColumn("latex", latex).withColumn("title", F.when(head != "", bare).when(F.col("type") == "heading", F.trim("raw")))
    chapter = F.regexp_extract("title", r"(?i)^CHAPTER\s+(\d+)", 1).try_cast("int")
    number = F.nullif(F.regexp_extract("title", r"^(\d+(?:\.\d+)+)\s", 1), F.lit(""))
    rows = rows.withColumn("_appendix", F.max(F.coalesce(F.col("title").rlike(r"(?i)^APPENDI(X|CES)\b"), F.lit(False)).cast("int")).over(so_far()) == 1)
    rows = rows.withColumn("chapter", F.last(F.when(~F.col("_appendix"), chapter), ignorenulls=True).over(so_far()))
    rows = rows.withColumn("page", F.last(F.regexp_extract("raw", r"^\{(\d+)\}-{3,}$", 1).try_cast("int") + 1, ignorenulls=True).over(so_far()))
    rows = rows.withColumn("section", F.when(F.col("type") == "heading", number)).where("type not in ('page_anchor', 'image')")
    text = F.when(F.col("title").isNotNull(), F.trim(F.regexp_replace("title", r"^\d+(?:\.\d+)+\s+", ""))).otherwise(F.col("raw"))
    n = F.row_number().over(by_doc())
    return rows.select("doc_id", "pos", F.concat(F.lit("m"), n).alias("block_id"), F.when(F.col("_appendix"), "backmatter").otherwise(F.col("type")).alias("type"), "chapter", "section", "page", text.alias("text"), "latex")


def page_text_blocks(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) as extracted page text: pages end with form feeds, blocks are runs of lines.

    A blank line, a page end, a chapter line, a section line or a reference entry starts a new block; page
    numbers go. Islands are numbered by a running sum.
    """
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "body"))
    lines = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where(~F.col("line").rlike(r"^\s*\d{1,4}\s*$"))
    lines = lines.withColumn("pos", F.col("page").cast("long") * (1 << 32) + F.col("line_no"))
    blank = F.trim("line") == ""
    opens = F.col("line").rlike(r"(?i)^\s*CHAPTER\s+\d+\s*$") | F.col("line").rlike(r"^\s*\d+(\.\d+)+(\s+\S.*)?$") | F.col("line").rlike(r"^\s*\[\d+\]\s")
    after = F.lag(blank | F.col("line").rlike(r"(?i)^\s*CHAPTER\s+\d+\s*$") | F.col("line").rlike(r"^\s*\d+(\.\d+)+(\s+\S.*)?$")).over(by_doc())
    cut = (opens | F.coalesce(after, F.lit(True)) | (F.col("line_no") == 0)).cast("int")
    rows = lines.withColumn("island", F.sum(cut).over(so_far())).where(~blank)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    made = rows.groupBy("doc_id", "island").agg(F.min("page").alias("page"), F.min("pos").alias("pos"), body.alias("text"))
    chapter = F.last(F.regexp_extract(F.trim("text"), r"(?i)^CHAPTER\s+(\d+)$", 1).try_cast("int"), ignorenulls=True).over(so_far())
    section = F.nullif(F.regexp_extract(F.trim("text"), r"^(\d+(?:\.\d+)+)\b", 1), F.lit(""))
    typed = made.withColumn("type", classify_block(F.col("text"))).withColumn("chapter", chapter)
    return typed.select("doc_id", "pos", F.concat(F.lit("p"), F.row_number().over(by_doc())).alias("block_id"), "type", "chapter", F.when(F.col("type") == "heading", section).alias("section"), "page", "text")


def lexicon_table(spark: SparkSession, lexicon: list[Entry] = LEXICON) -> DataFrame:
    return spark.createDataFrame([(e.grapheme, e.spoken, e.category, e.case_sensitive, e.word_boundaries) for e in lexicon], "grapheme string, spoken string, category string, case_sensitive boolean, word_boundaries boolean")
