"""Markdown reports as one text a document, and chapter metadata for audio containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_table(rows: DataFrame, title: str, order: str, columns: list[str], none: str = "Nothing to report.") -> DataFrame:
    """(doc_id, report): a heading with the row count and a table of columns, by order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda r: r["line"]), "\n")
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    made = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), body.alias("body"))
    return made.select("doc_id", F.concat(F.format_string(f"# {title} (%d)\n\n", F.col("n")), F.when(F.col("n") == 0, none).otherwise(F.concat(F.lit(head + "\n"), F.col("body"))), F.lit("\n")).alias("report"))


def ledger(sections: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, report): one report of several (doc_id, report) tables, in the order given."""
    parts = None
    for n, (name, rows) in enumerate(sections.items()):
        own = rows.select("doc_id", F.lit(n).alias("n"), F.concat(F.lit(f"## {name}\n\n"), "report").alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "part"))), lambda r: r["part"]), "\n")
    return parts.groupBy("doc_id").agg(joined.alias("report"))


def scorecard(scores: DataFrame) -> DataFrame:
    """(report): a row for each (item, dimension) of scores, misses cut at 80 characters."""
    line = F.concat_ws(" | ", cell(F.col("item")), cell(F.col("dimension")), F.concat_ws("/", "passed", "total"), F.col("rate").cast("string"), cell(F.substring(F.array_join("misses", ", "), 1, 80)))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("item", "dimension", F.concat(F.lit("| "), line, F.lit(" |")).alias("line")))), lambda r: r["line"])
    return scores.agg(F.concat(F.lit("# Scorecard\n\n| item | dimension | passed/total | rate | misses |\n|---|---|---|---|---|\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("report"))


def escape_metadata(value: Column) -> Column:
    """Backslashes before the characters that a metadata file reserves, and before line ends."""
    return F.regexp_replace(value, r"([\\=;#\n])", r"\\$1")


def chapter_metadata(chapters: DataFrame) -> DataFrame:
    """(doc_id, metadata): chapters(doc_id, index, title, seconds) as START and END in milliseconds, running sums of rounded spans."""
    span = F.round(F.col("seconds") * 1000).cast("long")
    w = Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    rows = chapters.withColumn("_ms", span).withColumn("_end", F.sum("_ms").over(w))
    part = F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s", F.col("_end") - F.col("_ms"), F.col("_end"), escape_metadata(F.col("title")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", part.alias("part")))), lambda r: r["part"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit(";FFMETADATA1\n"), joined, F.lit("\n")).alias("metadata"))


def _bullets(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def _rows(items: Column, *fields: str) -> Column:
    """Table rows of an array of structs."""
    return _bullets(items, lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(x[f]) for f in fields]), F.lit(" |")))


def _table_or(items: Column, header: list[str], fields: list[str], none: str) -> Column:
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header) + "\n"
    return F.when(F.size(items) == 0, none).otherwise(F.concat(F.lit(head), _rows(items, *fields)))


def structure_changes(blocks: DataFrame) -> DataFrame:
    """(doc_id, report): blocks that labels gave another type, after apply_labels."""
    snippet = F.substring(F.trim(F.regexp_replace(F.col("text"), r"\s+", " ")), 1, 80)
    entry = F.when(F.col("from_type").isNotNull(), F.struct("pos", "block_id", "from_type", F.col("type").alias("to_type"), snippet.alias("snippet")))
    made = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    body = _table_or(F.col("rows"), ["block", "from", "to", "snippet"], ["block_id", "from_type", "to_type", "snippet"], "None - the deterministic block types were left unchanged.")
    return made.select("doc_id", F.concat(F.format_string("# Structurer reclassifications (%d)\n\n", F.size("rows")), body, F.lit("\n")).alias("report"))


def structure_map(regions: DataFrame, decision: Column, least: float = 0.85) -> DataFrame:
    """(doc_id, report): regions(doc_id, n, kind, label, chapter, first_block_id, ...) with the decision that takes effect, and flags."""
    from .blocks import SPOKEN_REGIONS

    kind = F.col("kind")
    flag = lambda when, name: F.when(when, name)
    flags = F.array_compact(F.array(
        flag(F.col("decision") == "review", F.lit("review")), flag(F.col("kind_confidence") < least, F.lit("low-conf")), flag(F.col("duplicate_of").isNotNull(), F.lit("duplicate")),
        flag(F.col("language").isNotNull(), F.concat(F.lit("lang:"), "language")), flag(kind.isin(SPOKEN_REGIONS) & ~F.col("heading_anchored"), F.lit("unlabeled")), flag(kind == "unknown", F.lit("unknown")),
    ))
    two = lambda c: F.format_string("%.2f", F.col(c))
    named = F.concat(cell(kind), F.lit(" ("), cell(F.col("label")), F.lit(")"))
    span = F.concat(cell(F.col("first_block_id")), F.lit(".."), cell(F.col("last_block_id")))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", named, F.coalesce(F.col("chapter").cast("string"), F.lit("-")), decision, two("kind_confidence"), two("decision_confidence"), span, F.coalesce(F.nullif(F.array_join("_flags", ", "), F.lit("")), F.lit("-"))), F.lit(" |"))
    note = F.when(F.size("_flags") > 0, F.concat(F.lit("- **"), cell(kind), F.lit("** ("), cell(F.col("label")), F.lit("): "), cell(F.col("rationale"))))
    rows = regions.withColumn("_flags", flags).select("doc_id", F.struct("n", line.alias("line"), note.alias("note")).alias("r"))
    made = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    notes = F.filter("rows", lambda r: r["note"].isNotNull())
    head = "# Thesis structure map (LLM cartographer)\n\n| Region | Chapter | Decision | Kind-conf | Dec-conf | Blocks | Flags |\n|---|---|---|---|---|---|---|\n"
    review = F.when(F.size(notes) > 0, F.concat(F.lit("\n\n## Flagged for review\n\n"), _bullets(notes, lambda r: r["note"]))).otherwise("")
    return made.select("doc_id", F.concat(F.lit(head), _bullets(F.col("rows"), lambda r: r["line"]), review, F.lit("\n")).alias("report"))


def _collected(rows: DataFrame | None, key: str, order: list[str], fields: list[str], name: str, docs: DataFrame) -> DataFrame:
    """docs(doc_id, ...) with the rows of each as an array of structs."""
    if rows is None:
        return docs.withColumn(name, F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"))
    own = F.struct(*order, *[F.col(f).cast("string").alias(f) for f in fields if f not in order])
    made = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(own)).alias("_r")).withColumn(name, F.transform("_r", lambda x: F.struct(*[x[f].cast("string").alias(f) for f in fields]))).drop("_r")
    return docs.join(made, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")))


def script_repair_report(docs: DataFrame, applied: DataFrame, rejected: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(doc_id, report) for docs(doc_id): edits applied to a script, those that weren't, and what a model flagged."""
    rows = _collected(applied, "doc_id", ["round", "n"], ["find", "replace", "count", "reason"], "applied", docs.select("doc_id"))
    rows = _collected(rejected, "doc_id", ["round", "n"], ["find", "replace", "why"], "rejected", rows)
    rows = _collected(issues, "doc_id", ["n"], ["severity", "kind", "location", "detail"], "issues", rows)
    done = _table_or(F.col("applied"), ["find", "replace", "times", "reason"], ["find", "replace", "count", "reason"], "None.")
    not_done = _table_or(F.col("rejected"), ["find", "proposed replace", "why"], ["find", "replace", "why"], "None.")
    text = F.concat(
        F.format_string("# Script repair report (notation vocalization)\n\n## Applied repairs (%d)\n\n", F.size("applied")), done,
        F.format_string("\n\n## Not applied (%d) - could not be located in the script\n\n", F.size("rejected")), not_done,
        F.when(F.size("issues") > 0, F.concat(F.lit("\n\n## Flagged by the model (not edited)\n\n"), _issues(F.col("issues")))).otherwise(""), F.lit("\n"),
    )
    return rows.select("doc_id", text.alias("report"))


def _issues(items: Column) -> Column:
    return _bullets(items, lambda i: F.concat(F.lit("- **"), cell(i["severity"]), F.lit("/"), cell(i["kind"]), F.lit("** "), cell(i["location"]), F.lit(": "), cell(i["detail"])))


def markdown_repair_report(docs: DataFrame, applied: DataFrame, rejected: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """(doc_id, report) for docs(doc_id): guarded edits of extracted markdown and what a second look finds."""
    rows = _collected(applied, "doc_id", ["n"], ["kind", "broken", "fixed", "count", "reason"], "applied", docs.select("doc_id"))
    rows = _collected(rejected, "doc_id", ["n"], ["broken", "fixed", "why"], "rejected", rows)
    rows = _collected(residual, "doc_id", ["n"], ["severity", "kind", "location", "detail"], "issues", rows)
    text = F.concat(
        F.format_string("# Extraction repair report (two-pass, guarded)\n\n## Applied edits (%d)\n\n", F.size("applied")),
        _table_or(F.col("applied"), ["kind", "broken", "fixed", "times", "reason"], ["kind", "broken", "fixed", "count", "reason"], "None."),
        F.format_string("\n\n## Rejected edits (%d) - NOT applied (guard or not found)\n\n", F.size("rejected")),
        _table_or(F.col("rejected"), ["broken", "proposed fixed", "why rejected"], ["broken", "fixed", "why"], "None."),
        F.lit("\n\n## Pass 2 - residual issues on the CLEANED markdown\n\n"),
        F.when(F.size("issues") > 0, _issues(F.col("issues"))).otherwise("No residual issues flagged."), F.lit("\n"),
    )
    return rows.select("doc_id", text.alias("report"))


# Parts of the pronunciation report, by rule kind.
QA_PARTS = {
    "acronym": ("## Acronyms", ["acronym", "first use", "short form"], ["key", "spoken", "short_form"]),
    "term": ("## Terms", ["term", "spoken"], ["key", "spoken"]),
    "notation": ("## Notation", ["written", "spoken"], ["key", "spoken"]),
    "dehyphenation": ("## De-hyphenations", ["broken", "fixed"], ["key", "spoken"]),
}


def pronunciation_report(rules: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, report) of rules(doc_id, n, kind, key, spoken, short_form) for docs(doc_id)."""
    entry = F.struct("n", "key", "spoken", "short_form")
    made = rules.groupBy("doc_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in QA_PARTS])
    rows = docs.select("doc_id").join(made, "doc_id", "left")
    parts = [
        F.when(F.size(F.col(k)) > 0, F.concat(F.lit(f"{title}\n\n| {' | '.join(header)} |\n|{'---|' * len(header)}\n"), _rows(F.col(k), *fields), F.lit("\n")))
        for k, (title, header, fields) in QA_PARTS.items()
    ]
    body = F.coalesce(F.nullif(F.concat_ws("\n", *parts), F.lit("")), F.lit("Curator returned no entries (offline mock, or nothing to curate).\n"))
    return rows.select("doc_id", F.concat(F.lit("# Pronunciation QA (LLM curator)\n\n"), body).alias("report"))


def chapters(blocks: DataFrame) -> DataFrame:
    """(doc_id, chapter, title): the first heading without a section of each chapter."""
    heads = blocks.where("type = 'heading' and chapter is not null and section is null")
    return heads.groupBy("doc_id", "chapter").agg(F.min_by("text", "pos").alias("title"))


def titled(chapters_of: DataFrame, titles: DataFrame) -> DataFrame:
    """chapters_of(doc_id, chapter, ...) with title: its heading's, Chapter n, or Front matter."""
    from ..functions.numbers import int_to_words

    met = chapters_of.join(titles.select("doc_id", "chapter", F.col("title").alias("_title")), ["doc_id", "chapter"], "left")
    plain = F.when(F.col("chapter").isNull(), "Front matter").otherwise(F.concat(F.lit("Chapter "), int_to_words(F.col("chapter"))))
    return met.withColumn("title", F.coalesce("_title", plain)).drop("_title")
