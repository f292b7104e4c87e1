"""Model replies to typed columns; any failure gives the empty value, so offline replies change nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT = "struct<find:string,replace:string,reason:string,kind:string>"
ISSUE = "struct<kind:string,severity:string,location:string,detail:string,suggestion:string>"
# Reply shapes.
SHAPES = {
    "labels": "labels array<struct<id:string,kind:string>>",
    "regions": "title string, author string, regions array<struct<kind:string,decision:string,first_block_id:string,last_block_id:string,chapter:int,label:string,"
    "heading_anchored:boolean,kind_confidence:double,decision_confidence:double,rationale:string,duplicate_of:string,language:string>>",
    "pronunciations": "acronyms array<struct<acronym:string,first_use:string,short_form:string>>, terms array<struct<term:string,spoken:string>>,"
    "notation array<struct<written:string,spoken:string>>, dehyphenations array<struct<broken:string,fixed:string>>, notes array<string>",
    "script_repair": f"repairs array<{EDIT}>, issues array<{ISSUE}>",
    "markdown_repair": f"repairs array<struct<broken:string,fixed:string,reason:string,kind:string>>, issues array<{ISSUE}>",
    "audit": f"summary string, issues array<{ISSUE}>",
    "sections": "sections array<struct<number:string,title:string,start_page:int,kind:string>>",
}


def json_body(raw: Column) -> Column:
    """The outermost braces of a reply, code fences gone; empty if there are none."""
    return F.regexp_extract(F.regexp_replace(raw, "```(?:json)?", ""), r"(?s)\{.*\}", 0)


def parse(raw: Column, shape: str) -> Column:
    """A reply in a shape of SHAPES, or null."""
    return F.from_json(F.nullif(json_body(raw), F.lit("")), SHAPES[shape], {"mode": "PERMISSIVE"})


def sections(raw: Column) -> Column:
    """Lenient: items without number and title go, kinds are folded, absent ones unknown."""
    fold = lambda c: F.trim(F.coalesce(c, F.lit("")))
    found = F.transform(parse(raw, "sections")["sections"], lambda s: F.struct(fold(s["number"]).alias("number"), fold(s["title"]).alias("title"), s["start_page"].alias("start_page"), F.coalesce(F.nullif(F.lower(fold(s["kind"])), F.lit("")), F.lit("unknown")).alias("kind")))
    kept = F.filter(found, lambda s: (s["number"] != "") | (s["title"] != ""))
    return F.coalesce(kept, F.array().cast("array<struct<number:string,title:string,start_page:int,kind:string>>"))


def narration(raw: Column) -> Column:
    """A spoken reply without fences and one pair of wrapping quotes."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?m)^```\w*\s*$", ""), r"^\s+|\s+$", "")
    return F.when((F.length(bare) >= 2) & bare.rlike('^(?s)".*"$|^“(?s).*”$'), F.trim(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def is_audit(raw: Column) -> Column:
    """A JSON object with a list of issues."""
    return F.coalesce(F.get_json_object(json_body(raw), "$.issues").startswith("["), F.lit(False))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def visible(text: Column) -> Column:
    """Folded for verbatim tests: quotes, dashes, zero-width characters, white space and case."""
    plain = F.translate(text, "‘’“”–—−‑​‌﻿", "''\"\"----")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def found_verbatim(quote: Column, script: Column) -> Column:
    """A folded substring; failing that, without any white space."""
    q, s = visible(quote), visible(script)
    none = lambda c: F.regexp_replace(c, " ", "")
    return (q != "") & (F.contains(s, q) | F.contains(none(s), none(q)))


def reply_text(content: Column) -> Column:
    """The text parts of a reply's content array<struct<type, text>>, joined; other parts and null texts are left out."""
    parts = F.filter(content, lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), ""))
