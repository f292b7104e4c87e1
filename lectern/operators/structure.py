"""Triage of mistyped blocks and the outline that a labeller reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify_block
from .blocks import SO_FAR, SPOKEN_REGIONS, by_doc

HEAD, TAIL = 8, 1
# Signs of code or notation, of which two are enough.
WEAK = [
    r"[A-Za-z_]\w*\(", r"\b\w+\.\w+\(", r"\w\s*=\s*\w", r"<-|=>|->|<=|>=|&&|\|\||::|!=|\+=|-=|\*=", r"[{}]|;.*;", r"\$\w+|\$\{", r"(?:^|\s)--?[A-Za-z]\w*\b",
    r" \| |\s>>?\s|\s<\s|2>", r"https?://|www\.|/\w+/\w+", r'"\w+"\s*:', r"(?i)\bSELECT\b.+\bFROM\b",
]
CODE = r"(?m)^\s*(?:import|from)\s+\w|\bimport \w+ as |\bfrom \w+ import\b|\bdef \w+\(|\bprint\(|\bfunction \w+\("
SPACED = r"\b\w(?: \w){3,}"
# A line of settings.
SETTING = r"(?m)^\s*[\w.\-]+\s*[:=]\s*\S"


def is_blob(text: Column) -> Column:
    """One opaque token, or a comma stream nearly without spaces."""
    t = F.trim(text)
    commas, spaces = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))), F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(spaces == 0, (F.length(t) >= 24) & t.rlike(r"\p{L}")).otherwise((commas >= 4) & (spaces <= F.floor(commas / 2)))


def looks_non_prose(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    prose = F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike(r"\p{L}"))
    signs = sum((text.rlike(p).cast("int") for p in WEAK), F.lit(0))
    config = F.regexp_count(text, F.lit(SETTING))
    return F.contains(text, F.lit("```")) | text.rlike(SPACED) | is_blob(text) | text.rlike(CODE) | (config >= 2) | (signs >= 2) | ((F.size(words) >= 4) & (F.size(prose) < 0.4 * F.size(words)))


def suspicious_blocks(blocks: DataFrame) -> DataFrame:
    """Paragraphs that look mistyped: only these are worth a labeller's call."""
    return blocks.where((F.col("type") == "paragraph") & looks_non_prose(F.col("text")))


def outline_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, line): headings, and runs of one class with their first 8 and last block and the rest summed up.

    page, chapter and section are shown where blocks have them.
    """
    for c, kind in (("page", "int"), ("chapter", "int"), ("section", "string")):
        blocks = blocks if c in blocks.columns else blocks.withColumn(c, F.lit(None).cast(kind))
    kind = F.when(F.col("type").isin("backmatter", "frontmatter"), classify_block(F.col("text"))).otherwise(F.col("type"))
    rows = blocks.withColumn("kind", kind).withColumn("cls", F.when(F.col("kind") == "heading", "heading").when(F.col("kind") == "reference_list", "ref").otherwise("body"))
    new = ((F.col("cls") == "heading") | ~F.col("cls").eqNullSafe(F.lag("cls").over(by_doc()))).cast("int")
    rows = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(by_doc(*SO_FAR)))
    run = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("k", F.row_number().over(run.orderBy("pos"))).withColumn("size", F.count(F.lit(1)).over(run))
    middle = (F.col("size") > HEAD + TAIL + 1) & (F.col("k") > HEAD) & (F.col("k") <= F.col("size") - TAIL)
    kinds = F.sort_array(F.collect_list(F.when(middle, F.col("kind"))).over(run))
    counted = F.array_join(F.transform(F.array_distinct(kinds), lambda t: F.concat(t, F.lit("x"), F.size(F.filter(kinds, lambda x: x == t)))), ",")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    place = F.concat(F.lit("p"), F.coalesce(F.col("page").cast("string"), F.lit("?")))
    shown = lambda name, c: F.concat(F.lit(name), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    line = (
        F.when(F.col("cls") == "heading", F.concat_ws(" | ", "block_id", place, "kind", shown("ch", "chapter"), shown("sec:", "section"), F.substring(text, 1, 120)))
        .when(middle, F.concat(F.lit("  ...(+"), F.size(kinds).cast("string"), F.lit(" more blocks: "), counted, F.lit(")")))
        .otherwise(F.concat_ws(" | ", "block_id", place, "kind", F.substring(text, 1, 100)))
    )
    return rows.withColumn("line", line).where(~middle | (F.col("k") == HEAD + 1)).select("doc_id", "pos", "line")


def outline(blocks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(doc_id, outline): lines in order, under title and author where meta(doc_id, title, author) is given."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    made = outline_rows(blocks).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("outline"))
    if meta is None:
        return made
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    head = F.concat(F.lit("TITLE: "), flat("title"), F.lit(" | AUTHOR: "), flat("author"), F.lit("\n"))
    return made.join(meta.select("doc_id", "title", "author"), "doc_id").select("doc_id", F.concat(head, "outline").alias("outline"))


def region_warnings(regions: DataFrame, least: float = 0.85) -> DataFrame:
    """(doc_id, n, reason, score): up to six warnings a region."""
    low = F.least("kind_confidence", "decision_confidence")
    kind = F.col("kind")
    warn = lambda when, reason, score: F.when(when, F.struct(reason.alias("reason"), score.alias("score")))
    all_ = F.array(
        warn(kind == "unknown", F.format_string("unclassified region (label '%s'); review", F.col("label")), low),
        warn(F.col("decision") == "review", F.format_string("%s flagged for review - %s", kind, F.col("rationale")), low),
        warn(F.col("kind_confidence") < least, F.format_string("low confidence on %s (%.2f)", kind, F.col("kind_confidence")), F.col("kind_confidence")),
        warn(kind.isin(SPOKEN_REGIONS) & ~F.col("heading_anchored"), F.format_string("kept %s on an UNLABELED span (boundary unverifiable)", kind), F.col("kind_confidence")),
        warn(F.col("duplicate_of").isNotNull(), F.format_string("%s looks like a duplicate of %s", kind, F.col("duplicate_of")), low),
        warn(F.col("language").isNotNull(), F.format_string("%s appears to be in '%s' (non-primary)", kind, F.col("language")), low),
    )
    return regions.select("doc_id", "n", F.inline(F.filter(all_, lambda w: w.isNotNull())))
