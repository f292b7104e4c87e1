"""Rounds of proposed and guarded edits over a script, and over extracted markdown.

Proposals come from functions from rows with a text to edit or issue tables, as a model's parsed replies give them.
Rounds are a fixed few; a round without proposals changes nothing. What a round starts from is written, as several of
its steps read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import found_verbatim
from ..sources.stored import stored
from . import edits as E

Propose = Callable[[DataFrame], DataFrame]
ROUNDS = 3


def tidy_punctuation(text: Column) -> Column:
    """Doubled commas, commas at the edges of parentheses and double spaces, as edits may leave them."""
    for pattern, to in ((r"\s*,(?:\s*,)+", ", "), (r"\(\s*,\s*", "("), (r"\s*,\s*\)", ")"), (r"[ \t]{2,}", " ")):
        text = F.regexp_replace(text, pattern, to)
    return text


def scripts(chunks: DataFrame) -> DataFrame:
    """(doc_id, script): chunks in order, joined."""
    rows = F.sort_array(F.collect_list(F.struct("chunk_no", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("script"))


def applicable(chunks: DataFrame, proposed: DataFrame, copyedit: bool) -> tuple[DataFrame, DataFrame]:
    """Edits that may be applied, with how often they are found in whole tokens; and those that may not, with why.

    Both are read from one written table: chunks, logs and reports start from it, so their plans don't grow with rounds.
    """
    judged = stored(E.candidate_repairs(proposed, scripts(chunks), copyedit, counted=True), "judged")
    return judged.where("why is null").drop("why"), judged.where("why is not null").drop("count")


def repair_script(chunks: DataFrame, propose: Propose, copyedit: bool = False, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks after a few rounds of propose(scripts), edits that were applied, and rejected ones with why."""
    applied = rejected = None
    for k in range(rounds):
        chunks = stored(chunks, "script")
        good, bad = applicable(chunks, propose(scripts(chunks)), copyedit)
        chunks = E.apply_to_chunks(chunks, good)
        good, bad = good.where("count > 0").withColumn("round", F.lit(k)), bad.withColumn("round", F.lit(k))
        applied, rejected = (good, bad) if applied is None else (applied.unionByName(good), rejected.unionByName(bad))
    return chunks.withColumn("text", tidy_punctuation(F.col("text"))), applied, rejected


def locatable(issues: DataFrame, chunks: DataFrame) -> DataFrame:
    """Issues whose location is a quote of the script."""
    met = issues.join(scripts(chunks), "doc_id")
    return met.where(found_verbatim(F.col("location"), F.col("script"))).drop("script")


def check_script(chunks: DataFrame, audit: Propose, fix: Propose | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks after one pass of fixes for what an audit finds, and the issues that a second audit leaves.

    Without fix, the first audit's issues. Documents without a fix that applies keep their first issues.
    """
    chunks = stored(chunks, "script")
    issues = stored(locatable(audit(scripts(chunks)), chunks), "issues")
    if fix is None:
        return chunks, issues
    asked = scripts(chunks).join(issues.select("doc_id").distinct(), "doc_id", "left_semi")
    good = applicable(chunks, fix(asked), False)[0].where("count > 0")
    mended = E.apply_to_chunks(chunks, good)
    touched = good.select("doc_id").distinct()
    mended = mended.join(touched.withColumn("_t", F.lit(True)), "doc_id", "left").withColumn("text", F.when(F.col("_t"), tidy_punctuation(F.col("text"))).otherwise(F.col("text"))).drop("_t")
    again = locatable(audit(scripts(mended).join(touched, "doc_id", "left_semi")), mended)
    return mended, issues.join(touched, "doc_id", "left_anti").unionByName(again)


def repair_markdown(docs: DataFrame, propose: Propose, audit: Propose) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, text) with guarded edits applied; applied and rejected edits; and issues of a second look.

    An edit is rejected by its guard, or because its text isn't there.
    """
    judged = stored(propose(docs), "edits").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    safe = F.when(F.col("kind") == "artifact", E.is_faithful_artifact(F.col("broken"), F.col("fixed"))).otherwise(E.is_safe_repair(F.col("broken"), F.col("fixed")))
    count = F.when(F.col("broken") == "", 0).otherwise((F.length("_text") - F.length(F.replace(F.col("_text"), F.col("broken"), F.lit("")))) / F.greatest(F.length("broken"), F.lit(1))).cast("int")
    judged = judged.withColumn("count", count).withColumn("why", F.when(~safe, "guard: would change words or values").when(F.col("count") == 0, "not found")).drop("_text")
    good = judged.where("why is null").drop("why")
    cleaned = E.apply_to_markdown(docs, good)
    return cleaned, good, judged.where("why is not null"), audit(cleaned)
