"""Stage lists over block tables, with a schema check at every boundary, and the rules of the narration engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import naturalize_citations
from ..functions.combinators import regex_map
from ..functions.numbers import int_to_words, section_to_words
from ..functions.prompts import prompt
from ..functions.speak import normalize_all
from ..functions.text import strip_heading_enumerator
from ..functions.verify import verify_segment
from ..operators import blocks as B
from ..operators.chunks import plan_chunks
from ..operators.engine import TABLE_SHOWN, Model, announcement, narrate_document
from ..sources.stored import stored

# What stands between segments, and a pause.
GAP, BREAK = "\n\n", '<break time="0.8s"/>'
Stage = tuple[str, Callable[[DataFrame], DataFrame]]
CORE = ["doc_id", "pos", "block_id", "type", "chapter", "section", "page", "text", "latex", "spoken", "keep", "handling"]
_TYPES = {"chapter": "int", "section": "string", "page": "int", "latex": "string", "spoken": "string", "keep": "boolean", "handling": "string"}


def as_blocks(rows: DataFrame) -> DataFrame:
    """rows with the core columns, absent ones null."""
    for c, kind in _TYPES.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    return rows.select(*CORE)


def assert_core(rows: DataFrame, stage: str) -> DataFrame:
    missing = [c for c in CORE if c not in rows.columns]
    if missing:
        raise ValueError(f"{stage} drops {missing}")
    return rows


def _spoken(step) -> Callable[[DataFrame], DataFrame]:
    live = F.col("keep") & (F.col("handling") == "speak")
    return lambda rows: rows.withColumn("spoken", F.when(live, step(F.coalesce("spoken", "text"))).otherwise(F.col("spoken")))


def rule_stages(table_handling: str = "summarize", include_appendices: bool = False) -> list[Stage]:
    """Deterministic stages in order; label and region tables are applied between build_ir and select by their own operators."""
    return [
        ("build_ir", B.build_ir),
        ("select", lambda b: B.select_policy(b, table_handling, include_appendices)),
        ("math", B.announce_equations),
        ("figures", lambda b: number_tables(b, table_handling)),
        ("citations", _spoken(naturalize_citations)),
        ("normalize", _spoken(normalize_all)),
        ("signpost", (lambda b: b) if include_appendices else B.apply_signposts),
    ]


def run_stages(rows: DataFrame, stages: list[Stage], first: str | None = None, last: str | None = None) -> DataFrame:
    """Stages from first to last, both included."""
    names = [n for n, _ in stages]
    for n in (first, last):
        if n is not None and n not in names:
            raise ValueError(f"no stage {n}")
    lo, hi = names.index(first) if first else 0, names.index(last) + 1 if last else len(names)
    for name, stage in stages[lo:hi]:
        rows = assert_core(stage(rows), name)
    return rows


def heading_announcement(text, chapter, section):
    """Section n, title; Chapter n, title; or the title; enumerators dropped."""
    title = strip_heading_enumerator(text)
    said = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section "), section_to_words(section), F.lit(", "), title, F.lit(".")))
    return F.coalesce(said, F.when(chapter.isNotNull(), F.concat(F.lit("Chapter "), int_to_words(chapter), F.lit(". "), title, F.lit("."))), F.concat(title, F.lit(".")))


def number_tables(rows: DataFrame, table_handling: str = "summarize", summarize: Model | None = None) -> DataFrame:
    """Kept tables are spoken by their number and a summary, or said to be left out; their text is never read.

    Summaries are a model's; without one, the fixed sentence stands for them.
    """
    table = F.col("keep") & (F.col("type") == "table")
    rows = rows.withColumn("_table", F.coalesce(table, F.lit(False)))
    n = F.row_number().over(Window.partitionBy("doc_id", "_table").orderBy("pos"))
    label = F.concat(F.lit("Table "), int_to_words(n))
    if table_handling != "summarize":
        said = F.concat(label, F.lit(" is omitted from the audio."))
    elif summarize is None:
        said = F.concat(label, F.lit(f". {TABLE_SHOWN}"))
    else:
        rows = summarize(rows.withColumn("prompt", F.when(F.col("_table"), prompt("table_summary", F.col("text"))))).drop("prompt")
        rows = rows.withColumn("_said", normalize_all(F.coalesce("reply", F.lit("")))).drop("reply")
        said = F.concat(label, F.lit(". "), F.col("_said"))
    rows = rows.withColumn("spoken", F.when(F.col("_table"), said).otherwise(F.col("spoken")))
    return rows.withColumn("handling", F.when(F.col("_table"), table_handling if table_handling == "summarize" else "skip").otherwise(F.col("handling"))).drop("_table", "_said")


def speak_captions(figures: DataFrame) -> DataFrame:
    """figures(doc_id, id, caption, ...) with spoken."""
    return figures.withColumn("spoken", clean_caption(F.col("caption")))


def clean_caption(caption):
    """Fig. in full, panels by letter, then speakable."""
    panels = regex_map(F.regexp_replace(caption, r"(?i)\bFig\.\s*", "Figure "), r"\([A-Za-z]\)", lambda m: F.concat(F.lit("Panel "), F.upper(F.substring(m, 2, 1))))
    return normalize_all(panels)


def announce_nonprose(kind, latex):
    """Equations by number, tables by a fixed sentence, nothing else."""
    return announcement(kind, latex)


def script_segments(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, block_id, chapter, text) of what is spoken; blocks without words drop out."""
    said = F.coalesce("spoken", "text")
    line = F.when(F.col("type") == "heading", heading_announcement(said, F.col("chapter"), F.col("section"))).otherwise(said)
    kept = F.col("keep") & (F.col("handling") != "skip") & (F.trim(said) != "")
    # by a generator: a filter would be pushed down and copy what its columns are made of
    return rows.select("doc_id", "pos", "block_id", "chapter", F.explode(F.when(kept, F.array(F.concat(line, F.lit("\n\n"))))).alias("text"))


def supports_breaks(model: str) -> bool:
    """Whether a speech model honours pause tags."""
    return "v3" not in model


def assemble_script(rows: DataFrame, meta: DataFrame, figures: DataFrame | None = None, breaks: bool = True) -> DataFrame:
    """(doc_id, pos, block_id, chapter, text): the whole script of rows, between an opening and a closing sentence.

    meta(doc_id, title, author) has every document. figures(doc_id, n, ref, spoken) follow the block that refers to them
    first, those without such a block come last. With breaks, pauses follow the opening and headings.
    """
    parts = script_segments(rows).select("doc_id", F.lit(1).alias("part"), "pos", F.lit(0).alias("sub"), F.lit(0).alias("n"), "block_id", "chapter", "text")
    no_block, no_chapter = F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("int").alias("chapter")
    place = lambda part, sub: [F.lit(part).alias("part"), F.lit(0).alias("pos"), F.lit(sub).alias("sub"), F.lit(0).alias("n"), no_block, no_chapter]
    by = F.when(F.coalesce(F.col("author"), F.lit("")) != "", F.concat(F.lit(", by "), F.col("author"))).otherwise("")
    opening = normalize_all(F.concat(F.lit("An audiobook rendering of "), F.col("title"), by, F.lit(".")))
    script = parts.unionByName(meta.select("doc_id", *place(0, 0), F.concat(opening, F.lit(GAP)).alias("text")))
    script = script.unionByName(meta.select("doc_id", *place(3, 0), normalize_all(F.concat(F.lit("This concludes "), F.col("title"), F.lit("."))).alias("text")))
    if breaks:
        script = script.unionByName(meta.select("doc_id", *place(0, 1), F.lit(BREAK + GAP).alias("text")))
        heads = rows.where("type = 'heading'").select("doc_id", "pos")
        script = script.unionByName(parts.join(heads, ["doc_id", "pos"]).withColumn("sub", F.lit(1)).withColumn("block_id", F.lit(None).cast("string")).withColumn("text", F.lit(BREAK + GAP)))
    if figures is not None:
        shown = figures.where(F.coalesce(F.col("spoken"), F.lit("")) != "").select("doc_id", F.col("n").alias("_n"), "ref", F.concat("spoken", F.lit(GAP)).alias("_text"))
        there = parts.select("doc_id", F.col("block_id").alias("ref"), "pos", "chapter")
        met = shown.join(there, ["doc_id", "ref"], "left")
        placed = F.col("pos").isNotNull()
        script = script.unionByName(met.select("doc_id", F.when(placed, 1).otherwise(2).alias("part"), F.coalesce("pos", F.lit(0)).alias("pos"), F.lit(2).alias("sub"), F.col("_n").alias("n"), no_block, "chapter", F.col("_text").alias("text")))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "pos", "sub", "n"))
    return script.withColumn("_k", order).select("doc_id", F.col("_k").alias("pos"), "block_id", "chapter", "text")


def run_rules(rows: DataFrame, limit: int = 2000, **options) -> DataFrame:
    """Raw blocks to script chunks."""
    return plan_chunks(script_segments(run_stages(as_blocks(rows), rule_stages(**options))), limit)


def verified_pairs(pairs: DataFrame, check_values: bool = True) -> DataFrame:
    """pairs(source, spoken) with ok and violations."""
    return pairs.withColumn("_v", verify_segment(F.col("source"), F.col("spoken"), check_values)).select("*", "_v.*").drop("_v")


def narration_stages(sections: DataFrame, generate: Model, look: Model | None = None, pages: DataFrame | None = None) -> list[Stage]:
    """The second engine: structure from sections that were read off page images, then narration behind guards.

    pages(doc_id, page, text) align blocks that have no page, for the look at a page's image.
    """

    def align(rows: DataFrame) -> DataFrame:
        if pages is None:
            return rows
        found = B.assign_pages(rows, pages).withColumnRenamed("page", "_page")
        return rows.join(found, ["doc_id", "pos"], "left").withColumn("page", F.coalesce("page", F.col("_page").cast("int"))).drop("_page")

    def narrate(rows: DataFrame) -> DataFrame:
        return narrate_document(rows, sections, generate, look).withColumn("handling", F.when(F.col("keep"), "speak").otherwise("skip"))

    return [("build_ir", B.build_ir), ("page_align", align), ("narrate", narrate), ("signpost", B.apply_signposts)]


def run_narration(rows: DataFrame, sections: DataFrame, generate: Model, look: Model | None = None, pages: DataFrame | None = None, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Raw blocks to script chunks by the second engine, and the narrated blocks that outcome, flags and pairs are read from."""
    told = stored(run_stages(as_blocks(rows), narration_stages(sections, generate, look, pages)), "narrated")
    return plan_chunks(script_segments(told), limit), told
