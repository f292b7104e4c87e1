"""Whole runs as functions: from documents to scripts, audio stand-ins and reports. Models are passed in; none is called offline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import joined_wavs, packed_duration, packed_silence, request_key, seconds_of
from ..functions.prompts import dictionary_locator
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import edits as E
from ..operators import engine, reports, rounds
from ..sources import cache
from ..sources.documents import markdown_blocks
from ..sources.stored import stored
from . import pipeline


def parse(docs: DataFrame) -> DataFrame:
    """(doc_id, histogram) of markdown documents(doc_id, text) after building."""
    return B.type_histogram(B.build_ir(pipeline.as_blocks(markdown_blocks(docs))))


def check_extraction(docs: DataFrame, audit: rounds.Propose) -> tuple[DataFrame, DataFrame]:
    """Issues that an audit of documents(doc_id, text) finds, and (doc_id, report) from high to low severity."""
    issues = audit(docs)
    return issues, E.report(issues)


def repair_extraction(docs: DataFrame, propose: rounds.Propose, audit: rounds.Propose) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, text) with guarded edits, and (doc_id, report) of both passes."""
    cleaned, applied, rejected, residual = rounds.repair_markdown(docs, propose, audit)
    return cleaned, reports.markdown_repair_report(docs, applied, rejected, residual)


def run_v1(rows: DataFrame, propose: rounds.Propose | None = None, limit: int = 2000, preview: bool = False, copyedit: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Raw blocks to script chunks by the rules, with rounds of script repair if edits are proposed; and (doc_id, report)."""
    chunks = stored(pipeline.run_rules(rows, limit, **options), "chunks")
    report = chunks.select("doc_id").distinct().withColumn("report", F.lit(None).cast("string"))
    if propose is not None:
        docs = chunks.select("doc_id").distinct()
        chunks, applied, rejected = rounds.repair_script(chunks, propose, copyedit)
        report = reports.script_repair_report(docs, applied, rejected)
    return C.preview_chunks(chunks) if preview else chunks, report


def run(rows: DataFrame, sections: DataFrame, generate: engine.Model, look: engine.Model | None = None, pages: DataFrame | None = None, limit: int = 2000) -> dict[str, DataFrame]:
    """The second engine on raw blocks: chunks, outcome with the review gate, flagged segments and narration pairs."""
    chunks, told = pipeline.run_narration(rows, sections, generate, look, pages, limit)
    return {"chunks": chunks, "outcome": engine.outcome(told), "flagged": engine.flagged(told), "pairs": engine.pairs(told)}


def synthesize(chunks: DataFrame, store: str | None = None, version: str = "0", **voice: str) -> DataFrame:
    """chunks(doc_id, chunk_no, text, ...) with key, hit, wav (a packed wave file, silence of the text's length) and seconds.

    A request is a text with its neighbours' texts, the voice's settings, the version of the pronunciation dictionary
    and the backend. Audio that the cache table at `store` has is taken from there; the rest is made and put there.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    near = {"previous_text": F.lag("text").over(w), "next_text": F.lead("text").over(w)}
    fixed = {k: F.lit(v) for k, v in {"backend": "offline", "form": "packed", "dict_version": version, **voice}.items()}
    rows = chunks.withColumn("key", F.concat(F.lit("tts."), request_key(text=F.col("text"), **near, **fixed)))
    made = packed_silence(seconds_of(F.col("text")))
    if store is None:
        rows = rows.withColumn("hit", F.lit(False)).withColumn("wav", made)
    else:
        spark = chunks.sparkSession
        rows = stored(cache.get(rows, cache.read(spark, store)).withColumn("hit", F.col("value").isNotNull()).withColumn("wav", F.coalesce("value", made)).drop("value"), "speech")
        cache.put(spark, rows.select("key", F.col("wav").alias("value")), store)
    return rows.withColumn("seconds", packed_duration(F.col("wav")))


def publish(rules: DataFrame, name: str) -> DataFrame:
    """(name, locator) of a pronunciation dictionary of rules(grapheme, spoken), by the offline publisher; empty without rules."""
    listed = F.sort_array(F.collect_list(F.struct("grapheme", "spoken")))
    made = rules.agg(listed.alias("rules")).where(F.size("rules") > 0)
    return made.select(F.lit(name).alias("name"), dictionary_locator(F.lit(name), F.col("rules")).alias("locator"))


def assemble(spoken: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, audio, chapters, seconds, metadata): a document's audio in order, and its chapters' metadata.

    A document's audio is its packed wave files in order (audio.joined_wavs), so silence takes no room on the way.
    """
    islands = C.chapter_islands(spoken).select("doc_id", "index", "chapter", "first_chunk", "last_chunk")
    part = spoken.select(F.col("doc_id").alias("_doc"), "chunk_no", F.col("seconds").alias("_s"))
    timed = islands.join(part, (F.col("doc_id") == F.col("_doc")) & F.col("chunk_no").between(F.col("first_chunk"), F.col("last_chunk"))).groupBy("doc_id", "index", "chapter").agg(F.sum("_s").alias("seconds"))
    marks = reports.chapter_metadata(reports.titled(timed, titles))
    whole = spoken.groupBy("doc_id").agg(joined_wavs(F.col("chunk_no"), F.col("wav")).alias("audio"), F.sum("seconds").alias("seconds"))
    n = islands.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters"))
    return whole.join(n, "doc_id").join(marks, "doc_id").select("doc_id", "audio", "chapters", "seconds", "metadata")
