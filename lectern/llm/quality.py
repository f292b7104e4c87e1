"""Line-first cleaning: rules per line, removal of failing lines, then rejection of documents that lose too much.

DataFrame functions only. Null or empty text: no words, base_failed, not kept, clean text empty. Repeated rows,
equal and null ids are judged each on their own; an empty table stays empty. Extra columns pass through; one that
is named like a column of the result (in any case) gives way to it. A document's arrays live in one row, so memory
is bounded by the longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

#: Phrases of site furniture in English, German, French and Spanish, lower case, fixed values.
PHRASES = [
    "all rights reserved", "cookie policy", "accept cookies", "uses cookies", "privacy policy", "terms of (use|service)", "enable javascript", "skip to (main )?content",
    "subscribe to our newsletter", "click here", "sign (in|up)", "log ?in to", "powered by", "back to top", "share (this|on)", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies (akzeptieren|zulassen)", "javascript aktivieren", "zum inhalt springen", "newsletter abonnieren", "hier klicken", "nach oben",
    "tous droits réservés", "politique de confidentialité", "conditions d.utilisation", "accepter les cookies", "activer javascript", "aller au contenu", "cliquez ici", "haut de page",
    "todos los derechos reservados", "política de privacidad", "términos de (uso|servicio)", "aceptar (las )?cookies", "activar javascript", "saltar al contenido", "haga clic aquí", "volver arriba",
]
BOILERPLATE = r"(^|[^\p{L}])(" + "|".join(PHRASES) + r")($|[^\p{L}])"
#: A document is rejected below MIN_WORDS words, above MAX_REPEAT_PCT percent of words in repeated 3-word
#: windows, or when its removed lines hold over MAX_LOST_PCT percent of its words.
MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST_PCT = 50, 50, 40
SYMBOLS = r"[#*$%&|<>]"
#: Up to so many repeated windows are looked up in a list; more are found by a sort of (window, position).
FEW = 64


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable isn't expanded again."""
    return F.transform(F.array(value), body)[0]


def _covered(positions: Column) -> Column:
    """Words under 3-word windows at ascending positions."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(positions, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])


def line_fails(line: Column) -> Column:
    """Why a line goes, or null: 'navigation', 'symbols', 'shouting', 'boilerplate', 'punctuation'."""
    return let(F.struct(line.alias("x"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.regexp_count(line, F.lit(r"[#*$%&|<>»·•]")).alias("marks")), _why)


def _why(of: Column) -> Column:
    line, words, marks = of["x"], of["words"], of["marks"]
    bars = F.regexp_count(line, F.lit(r"(?<=^|\s)[|>»·•](?=\s|$)"))
    return (
        F.when((marks >= 3) & (marks * 4 >= words) & (bars >= 3) & (bars * 4 >= words), "navigation")
        .when((marks * 3 >= words * 2) & (F.regexp_count(line, F.lit(SYMBOLS)) * 3 >= words * 2), "symbols")
        .when((words >= 4) & (F.upper(line) == line) & (F.lower(line) != line), "shouting")
        .when((words <= 25) & F.lower(line).rlike(BOILERPLATE), "boilerplate")
        .when((words <= 3) & ~line.rlike(r"[.!?…:;\"'”’»)\]。！？]\s*$"), "punctuation")
    )


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "clean_text"]


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds RESULT to the columns of docs.

    A line that equals an earlier line of its document stays in clean_text; it only counts in n_dup_lines.
    """
    own = "_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    words, windows, ordered, twice, lines, count = (own + x for x in ("words", "windows", "ordered", "twice", "lines", "count"))
    t = text_of(text)
    work = docs.drop(*[c for c in docs.columns if c.lower() in RESULT and c != text]).withColumn(words, F.array_remove(F.split(t, f"{SPACE}+"), ""))
    n = F.size(words)
    # windows as 64-bit hashes: equal windows have equal hashes, others differ but for a chance of n^2 / 2^64
    hashed = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col(words)[i], F.col(words)[i + 1], F.col(words)[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    work = work.withColumn(count, n.cast("long")).withColumn(windows, hashed).drop(words)
    work = work.withColumn(ordered, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(windows)))
    equal = F.filter(
        F.zip_with(ordered, F.slice(F.col(ordered), F.lit(2), F.size(ordered) - 1), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()
    )
    work = work.withColumn(twice, F.when(F.col(ordered).isNotNull(), F.array_distinct(equal))).drop(ordered)
    listed = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda x: x.isNotNull())
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ranked = let(pairs, lambda s: F.sort_array(F.filter(
        F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
        lambda x: x.isNotNull(),
    )))
    repeats = F.when(F.col(twice).isNull(), F.lit(0).cast("long")).when(F.size(twice) <= FEW, let(listed, _covered)).otherwise(let(ranked, _covered))
    work = work.withColumn("n_repeat_words", repeats).drop(windows, twice)

    judged = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), line_fails(x).alias("why"), x.rlike(r"[^\x20\x09-\x0D]").alias("has")))
    work = work.withColumn(lines, judged)
    with_word = F.transform(F.filter(lines, lambda x: x["has"]), lambda x: x["line"])
    # blank lines never fail (they have no words to lose)
    fails = lambda x: x["has"] & x["why"].isNotNull()
    lost = F.aggregate(F.filter(lines, fails), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x["line"], F.lit(r"[^\x20\x09-\x0D]+")))
    stays = F.array_join(F.transform(F.filter(lines, lambda x: ~fails(x)), lambda x: x["line"]), "\n")
    work = (
        work.withColumn("word_chars", (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", let(with_word, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"))
        .withColumn("lost_words", lost)
        .withColumn("clean_text", stays)
        .withColumnRenamed(count, "n_words")
        .drop(lines)
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    return work.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * MAX_LOST_PCT))


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their clean text in place, other columns as they were.

    A filter on kept would be pushed below the projections and pull copies of all their expressions into one;
    a generator's own output can't be pushed below it.
    """
    held = docs.select(F.struct(*docs.columns).alias("held"), F.col(text).alias("text"))
    judged = clean_lines(held).select("held", F.when(F.col("kept"), F.array("clean_text")).alias("texts"))
    kept = judged.select("held", F.explode_outer("texts").alias("text")).where(F.col("text").isNotNull())
    return kept.select(*[F.col("text").alias(c) if c == text else F.col("held")[c].alias(c) for c in docs.columns])
