"""Guarded edits: filtering proposals, applying them to chunks or markdown, and logs of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import verify

MAX_SPAN = 400
GUARDED = ["typo", "grammar", "spacing", "extraction_artifact"]
# Symbols whose count an artifact repair keeps.
VALUE_SYMBOLS = "±°%×÷=/-−"


def is_faithful_artifact(broken: Column, fixed: Column) -> Column:
    """Tags apart: equal digits in order, equal counts of value symbols, no new letters."""
    bare = lambda t: F.regexp_replace(t, "<[^>]*>", "")
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    letters = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}"), F.lit(0)))
    a, b = bare(broken), bare(fixed)
    same = verify.digits(a) == verify.digits(b)
    for c in VALUE_SYMBOLS:
        same = same & (count(a, c) == count(b, c))
    return (broken != "") & (broken != fixed) & (F.length(broken) <= MAX_SPAN) & same & (F.size(F.array_except(letters(b), letters(a))) == 0)


def is_safe_repair(broken: Column, fixed: Column) -> Column:
    """Word tokens and their case are kept in order; there is one at least."""
    tokens = lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return (broken != fixed) & (F.length(broken) <= MAX_SPAN) & (F.size(tokens(broken)) > 0) & (tokens(broken) == tokens(fixed))


def candidate_repairs(edits: DataFrame, scripts: DataFrame, copyedit: bool = False, counted: bool = False) -> DataFrame:
    """edits(doc_id, n, find, replace, kind) with why, null for those that may be applied to scripts(doc_id, script).

    counted: and with count, how often those are found in whole tokens.
    """
    met = edits.join(scripts.select("doc_id", "script"), "doc_id", "left")
    guarded = F.col("kind").isin(GUARDED)
    why = (
        F.when((F.trim("find") == "") | (F.col("find") == F.col("replace")) | (F.length("find") > MAX_SPAN), "empty, a no-op, or too long a span")
        .when(~F.coalesce(F.contains("script", F.col("find")), F.lit(False)), "not found in script")
        .when(F.col("kind") == "data", "data/claim - flag only, never auto-fixed")
        .when(guarded & F.lit(not copyedit), "copy-edit disabled (--as-written): only notation is fixed")
        .when(guarded & ~verify.copyedit_guard(F.col("find"), F.col("replace")), "copy-edit guard: would change a number, polarity, or claim")
    )
    judged = met.withColumn("why", why)
    if counted:
        judged = judged.withColumn("count", F.when(F.col("why").isNull(), F.regexp_count("script", whole_token(F.col("find")))))
    return judged.drop("script")


def ordered(edits: DataFrame, key: str) -> DataFrame:
    """(doc_id, edits): each document's edits, longest first, then as proposed."""
    rows = F.sort_array(F.collect_list(F.struct((-F.length(key)).alias("rank"), "n", key, F.col("replace" if key == "find" else "fixed").alias("to"))))
    return edits.groupBy("doc_id").agg(rows.alias("edits"))


def whole_token(find: Column) -> Column:
    """A regular expression for a literal between non-alphanumerics."""
    return F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(find, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))


def apply_to_chunks(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Whole-token replacements in every chunk; a fold over a document's few edits, in the JVM."""
    met = chunks.join(ordered(edits, "find"), "doc_id", "left")
    plain = lambda e: F.regexp_replace(e["to"], r"([\\$])", r"\\$1")
    done = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<rank:int,n:int,find:string,to:string>>")), F.col("text"), lambda t, e: F.regexp_replace(t, whole_token(e["find"]), plain(e)))
    return met.withColumn("text", done).drop("edits")


def apply_to_markdown(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs(doc_id, text) with all occurrences of each edit(doc_id, n, broken, fixed, kind) that its guard lets through."""
    good = edits.where(F.when(F.col("kind") == "artifact", is_faithful_artifact(F.col("broken"), F.col("fixed"))).otherwise(is_safe_repair(F.col("broken"), F.col("fixed"))))
    met = docs.join(ordered(good, "broken"), "doc_id", "left")
    done = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<rank:int,n:int,broken:string,to:string>>")), F.col("text"), lambda t, e: F.replace(t, e["broken"], e["to"]))
    return met.withColumn("text", done).drop("edits")


def report(issues: DataFrame) -> DataFrame:
    """(doc_id, report): issues(doc_id, n, severity, kind, detail) from high to low, a line each, after counts."""
    from ..functions.replies import severity_rank

    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("kind"), F.lit(": "), F.col("detail"))
    rows = F.sort_array(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "n", line.alias("line"))))
    head = F.format_string("%d high, %d medium, %d low", *[F.count_if(F.col("severity") == s) for s in ("high", "medium", "low")])
    return issues.groupBy("doc_id").agg(F.concat_ws("\n", head, F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("report"))


def first_use(mentions: DataFrame) -> DataFrame:
    """mentions(doc_id, pos, at, key) with first: whether none of the key comes before in the document."""
    return mentions.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos", "at")) == 1)
