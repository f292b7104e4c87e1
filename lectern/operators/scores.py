"""Scores of scripts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that may not reach a narrator.
FORBIDDEN = "%±^_<>[]µμ−"


def rate(passed: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(F.round(passed / total, 3))


def speech_text(script: Column) -> Column:
    """The script without speech control tags."""
    return F.regexp_replace(script, r"(?i)</?(?:break|emphasis|prosody|say-as|phoneme|sub|voice|p|s)\b[^>]*>", " ")


def fold(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(speech_text(text), r"\s+", " ")))


def present(pattern: Column, body: Column) -> Column:
    """A folded substring, or a regular expression after re:."""
    return F.when(pattern.startswith("re:"), F.regexp_like(body, F.concat(F.lit("(?i)"), F.substring(pattern, F.lit(4), F.length(pattern))))).otherwise(F.contains(body, fold(pattern)))


def structure_f1(detected: Column, expected: Column) -> Column:
    matched = F.least(detected, expected)
    precision, recall = F.when(detected == 0, 0.0).otherwise(matched / detected), matched / F.greatest(expected, F.lit(1))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(F.round(2 * precision * recall / (precision + recall), 3))
    return F.when(expected == 0, F.when(detected == 0, 1.0).otherwise(0.0)).otherwise(f1)


def leak_counts(script: Column) -> Column:
    """array<struct<char, n>> of forbidden characters, in order."""
    found = F.regexp_extract_all(speech_text(script), F.lit(r"[%±^_<>\[\]µμ−]"), F.lit(0))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda c: F.struct(c.alias("char"), F.size(F.filter(found, lambda x: x == c)).alias("n")))


def score(items: DataFrame) -> DataFrame:
    """One row an item and dimension of items(item, script, detected, expected, must_be_absent, must_be_present)."""
    body = fold(F.col("script"))
    leaked = F.filter("must_be_absent", lambda p: present(p, body))
    missing = F.filter("must_be_present", lambda p: ~present(p, body))
    leaks = leak_counts(F.col("script"))
    shown = F.transform(leaks, lambda x: F.concat(F.lit("'"), x["char"], F.lit("'x"), x["n"]))
    row = lambda name, passed, total, misses, value=None: F.struct(F.lit(name).alias("dimension"), passed.cast("long").alias("passed"), total.cast("long").alias("total"), (rate(passed, total) if value is None else value).alias("rate"), misses.alias("misses"))
    e, d = F.col("expected"), F.col("detected")
    off = F.when(d < e, F.array(F.format_string("detected %d/%d (missed %d)", d, e, e - d))).when(d > e, F.array(F.format_string("detected %d > %d expected (%d extra)", d, e, d - e))).otherwise(F.array().cast("array<string>"))
    rows = F.array(
        row("structure (chapters)", F.least(d, e), e, off, structure_f1(d, e)),
        row("citation/markup strip", F.size("must_be_absent") - F.size(leaked), F.size("must_be_absent"), leaked),
        row("value preservation", F.size("must_be_present") - F.size(missing), F.size("must_be_present"), missing),
        row("raw-token leak (clean=1)", F.when(F.size(leaks) > 0, 0).otherwise(1), F.lit(1), shown),
    )
    return items.select("item", F.inline(rows))


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """verdicts(item, ok) to passed, total and rate."""
    n = verdicts.groupBy("item").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("rate", rate(F.col("passed"), F.col("total")))


def review_gate(held: Column, reviewed: Column, narrated: Column, announced: Column, most: float = 0.15) -> Column:
    """Why a person should look first, or null."""
    total, flagged = held + reviewed + narrated + announced, held + reviewed
    text = F.format_string("%d/%d segments held or flagged for review (%.0f%%)", flagged, total, flagged * 100.0 / F.greatest(total, F.lit(1)))
    return F.when(total == 0, "nothing was narrated").when(flagged > total * most, text)
