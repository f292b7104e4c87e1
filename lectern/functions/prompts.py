"""Prompts for the model-driven steps, as string projections, and offline stand-ins for their replies.

Our own wording; the reply shapes are those that replies.py parses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .citations import GENERIC

TASKS = {
    "structurer": 'Each line is a block id, its current type and a snippet. Name the true kind of each. Reply with JSON {"labels": [{"id": ..., "kind": ...}]} only.',
    "cartographer": 'Divide the outlined document into regions by first and last block id and classify each. Reply with JSON {"title": ..., "author": ..., "regions": [...]} only.',
    "curate": 'List acronyms, terms, notation and broken words of this document with their spoken forms. Reply with JSON {"acronyms": [], "terms": [], "notation": [], "dehyphenations": [], "notes": []} only.',
    "script_repair": 'Propose literal edits of this script that make notation speakable. Reply with JSON {"repairs": [{"find": ..., "replace": ..., "reason": ..., "kind": ...}], "issues": []} only.',
    "script_copyedit": 'Propose literal edits of this script: notation, typing errors, spacing and grammar, never values or claims. Reply with JSON {"repairs": [...], "issues": []} only.',
    "script_qc": 'Quote what a listener would stumble over in this script, with a severity. Reply with JSON {"summary": ..., "issues": [...]} only.',
    "qc_fix": 'Propose literal edits for the flags below, each a quote of the script. Reply with JSON {"repairs": [...], "issues": []} only.',
    "markdown_qc": 'List extraction faults in this markdown, with a severity. Reply with JSON {"summary": ..., "issues": [...]} only.',
    "markdown_repair": 'Propose literal repairs of extraction faults that keep every word and value. Reply with JSON {"repairs": [{"broken": ..., "fixed": ..., "reason": ..., "kind": ...}], "issues": []} only.',
    "narrate": "Rewrite this passage for the ear. Keep every value, negation and finding; spell numbers and symbols out; drop citations.",
    "revise": "Your narration broke the rules listed. Write it again.",
    "table_summary": "Say in one or two sentences what this table shows, without reading its cells.",
}


def prompt(task: str, *parts: Column) -> Column:
    """The task, then its inputs under a line each."""
    return F.concat_ws("\n\n", F.lit(TASKS[task]), *parts)


def genericize_prompt(mentions: Column) -> Column:
    head = F.lit("Choose for each author mention one of: " + ", ".join(sorted(GENERIC)) + ". Reply with a JSON object from mention to phrase only.")
    return F.concat_ws("\n\n", head, F.to_json(mentions))


def structure_prompt(first: Column, last: Column) -> Column:
    text = 'Pages %d to %d follow. List the top-level divisions that begin on them. Reply with JSON {"sections": [{"number": ..., "title": ..., "start_page": ..., "kind": ...}]} only.'
    return F.format_string(text, first, last)


def revision_prompt(source: Column, previous: Column, violations: Column) -> Column:
    rules = F.array_join(F.transform(violations, lambda v: F.concat(F.lit("- "), v["kind"], F.lit(": "), v["detail"])), "\n")
    return prompt("revise", rules, previous, source)


def offline_reply(asked: Column) -> Column:
    """A deterministic reply that no parser accepts, so every model-driven step is a no-op."""
    return F.concat(F.lit("[offline "), F.substring(F.sha2(asked, 256), 1, 12), F.lit("]"))


def dictionary_locator(name: Column, rules: Column) -> Column:
    return F.concat(F.lit("offline-"), F.substring(F.sha2(F.concat_ws("\n", name, F.to_json(rules)), 256), 1, 16))


def dictionary_payload(rules: Column) -> Column:
    """Alias rules array<struct<grapheme, spoken>> as the JSON of a publishing request."""
    return F.to_json(F.transform(rules, lambda r: F.struct(F.lit("alias").alias("type"), r["grapheme"].alias("string_to_replace"), r["spoken"].alias("alias"))))
