"""What a document says about itself: author, title, pages; and the batches in which its pages are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import structure_prompt
from ..functions.replies import sections
from ..sources.documents import looks_like_name
from .blocks import by_doc, merge_section_maps

#: Pages a vision request takes, and blocks of a document that may hold its copyright line.
BATCH, OPENING = 50, 20
# A copyright line, and what ends the name in it.
COPYRIGHT = r"(?i)(?:©|\(c\)|copyright)\s*\d{4}\s+(.+)"
RIGHTS = r"(?i)\s+all rights.*$"


def derive_author(blocks: DataFrame) -> DataFrame:
    """(doc_id, author): the name after a line 'by', else that of an early copyright line; documents without one are absent."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    after = F.lead(F.trim("text")).over(by_doc())
    name = lambda c: F.when(looks_like_name(c), c)
    rows = blocks.withColumn("_n", F.row_number().over(by_doc())).withColumn("_by", F.when(F.lower(F.trim("text")) == "by", name(after)))
    line = F.trim(F.regexp_replace(F.regexp_extract(text, COPYRIGHT, 1), RIGHTS, ""))
    rows = rows.withColumn("_c", F.when((F.col("_n") <= OPENING) & text.rlike(COPYRIGHT), name(line)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    return rows.groupBy("doc_id").agg(F.coalesce(first("_by"), first("_c")).alias("author")).where("author is not null")


def adopt_metadata(meta: DataFrame, proposed: DataFrame, blocks: DataFrame) -> DataFrame:
    """meta(doc_id, title, author) with proposals that stand verbatim in the document; adds refused, the fields that don't."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    body = blocks.groupBy("doc_id").agg(fold(F.array_join(texts, " ")).alias("_body"))
    new = proposed.select("doc_id", *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(f"_{c}") for c in ("title", "author")])
    met = meta.join(new, "doc_id", "left").join(body, "doc_id", "left")
    there = lambda c: F.contains(F.coalesce("_body", F.lit("")), fold(F.col(f"_{c}")))
    refused = F.array_compact(F.array(*[F.when(F.col(f"_{c}").isNotNull() & ~there(c), c) for c in ("title", "author")]))
    taken = [F.when(F.col(f"_{c}").isNotNull() & there(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "author")]
    return met.withColumn("refused", refused).select("doc_id", *taken, "refused")


def page_span(first: Column, last: Column) -> Column:
    """p3, p3-5, or p? without pages."""
    return F.when(first.isNull(), "p?").when(first == last, F.concat(F.lit("p"), first)).otherwise(F.concat(F.lit("p"), first, F.lit("-"), last))


def page_batches(pages: DataFrame, batch: int = BATCH) -> DataFrame:
    """(doc_id, batch, first, last, prompt): pages(doc_id, page) in requests of `batch` pages."""
    rows = pages.select("doc_id", "page", F.floor((F.col("page") - 1) / batch).cast("int").alias("batch")).groupBy("doc_id", "batch").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    return rows.withColumn("prompt", structure_prompt(F.col("first"), F.col("last")))


def collect_structure(pages: DataFrame, look, batch: int = BATCH) -> DataFrame:
    """Sections of every document from one reply for each batch of pages, merged."""
    told = look(page_batches(pages, batch)).select("doc_id", "batch", F.posexplode(sections(F.coalesce("reply", F.lit("")))).alias("n", "s"))
    return merge_section_maps(told.select("doc_id", "batch", "n", "s.*"))


def chapters_detected(sections_of: DataFrame) -> DataFrame:
    return sections_of.groupBy("doc_id").agg(F.count_if(F.lower(F.trim("kind")) == "body_chapter").alias("chapters"))
