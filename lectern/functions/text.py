"""Cleaning and normalising scalars over text columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .combinators import chain, let, literals, quote, regex_map

# Units and chemistry in the order of replacement.
UNITS = [
    ("µmol m^-2 s^-1", "micromoles per meter squared per second"), ("umol m^-2 s^-1", "micromoles per meter squared per second"),
    ("μmol m⁻² s⁻¹", "micromoles per meter squared per second"), ("µmol m⁻² s⁻¹", "micromoles per meter squared per second"),
    ("mol m^-2 s^-1", "moles per meter squared per second"), ("m^-2 s^-1", "per meter squared per second"), ("m⁻² s⁻¹", "per meter squared per second"),
    ("H2O2", "hydrogen peroxide"), ("H₂O₂", "hydrogen peroxide"), ("Ca2+", "calcium ion"), ("Ca²⁺", "calcium ion"), ("Na+", "sodium ion"), ("K+", "potassium ion"),
    ("Cl-", "chloride ion"), ("Cl−", "chloride ion"), ("CO2", "C O two"), ("CO₂", "C O two"), ("O2", "O two"), ("H2O", "water"), ("H₂O", "water"),
    ("MPa", "megapascals"), ("kPa", "kilopascals"), ("°C", "degrees Celsius"), ("µM", "micromolar"), ("μM", "micromolar"), ("mM", "millimolar"),
    ("µm", "micrometers"), ("μm", "micrometers"), ("µg", "micrograms"), ("μg", "micrograms"), ("µL", "microliters"), ("μL", "microliters"),
    ("s^-1", "per second"), ("s⁻¹", "per second"), ("m^-2", "per meter squared"), ("m⁻²", "per meter squared"), ("µmol", "micromoles"), ("μmol", "micromoles"),
]
# Greek letters and their names.
GREEK = dict(
    α="alpha", β="beta", γ="gamma", δ="delta", ε="epsilon", ζ="zeta", η="eta", θ="theta", ι="iota", κ="kappa", λ="lambda", ν="nu", ξ="xi", π="pi", ρ="rho", σ="sigma", ς="sigma",
    τ="tau", υ="upsilon", φ="phi", χ="chi", ψ="psi", ω="omega", Δ="delta", Φ="phi", Ψ="psi", Σ="sigma", Ω="omega", Θ="theta", Λ="lambda", Π="pi", Γ="gamma",
) | {"μ": "mu", "µ": "mu", "ϕ": "phi", "ϑ": "theta", "ϵ": "epsilon", "ϱ": "rho", "ϖ": "pi", "ϰ": "kappa", "ϐ": "beta"}
# Operators in the order of replacement.
OPERATORS = [
    ("≤", " less than or equal to "), ("≥", " greater than or equal to "), ("≈", " approximately "), ("±", ", plus or minus, "), ("×", " times "), ("·", " times "),
    ("*", " asterisk "), ("<", " less than "), (">", " greater than "), ("=", " equals "), ("/", " over "),
]
# Characters that may not survive, and what they become.
SWEEP = [("%", " percent "), ("±", " plus or minus "), ("^", " to the power "), ("_", " "), ("<", " less than "), (">", " greater than "), ("[", " "), ("]", " "), ("µ", " mu "), ("μ", " mu "), ("−", " minus ")]
DASHES = "−‒–—―‐‑"
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"), (" ", " "), ("​", ""), ("﻿", "")]
# Tokens that extraction splits.
REJOIN = [
    (r"\bg\s+s\b", "gs"), (r"\bg\s+oxz\b", "goxz"), (r"\bH2\s+O2\b", "H2O2"), (r"\bH2\s+O\b", "H2O"), (r"\bC\s+O2\b", "CO2"), (r"\bV\s+PD\b", "VPD"),
    (r"ψ\s+xyl", "ψ_xyl"), (r"ψ\s+ssc", "ψ_ssc"), (r"\bOZX\b", "OXZ"),
]
ABBREVIATIONS = ["et al.", "e.g.", "i.e.", "fig.", "vs.", "approx.", "cf.", "eq.", "sec.", "no.", "dr.", "st.", "al.", "spp.", "ca."]
# What a link is, what closes a sentence after it, and how it is read.
URL = r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|io|edu|gov|ai|co|dev|app|info|me|xyz)/\S+"
URL_HINT = r"https?://|www\.|\.(?:com|org|net|io|edu|gov|ai|co|dev|app|info|me|xyz)/"
URL_CLOSING = ").,;:]'\""
LINK = "the link in the text"
# A phrase and a gloss in parentheses after it.
GLOSS = r"([A-Za-z][\w-]*(?:[ \t][\w-]+)*)[ \t]*\(([A-Za-z][\w \t-]*?)\)"


@dataclass(frozen=True)
class Entry:
    """A lexicon row."""

    grapheme: str
    spoken: str
    category: str
    case_sensitive: bool = True
    word_boundaries: bool = True


def _entries() -> list[Entry]:
    # The default lexicon.
    rows = {
        "symbol": [("gs", "stomatal conductance"), ("g_s", "stomatal conductance"), ("goxz", "outside-xylem conductance"), ("g_oxz", "outside-xylem conductance"), ("A_n", "net assimilation rate"), ("WUE", "water use efficiency")],
        "greek": [
            ("psi_xyl", "xylem water potential"), ("psixyl", "xylem water potential"), ("ψ_xyl", "xylem water potential"), ("ψxyl", "xylem water potential"),
            ("psi_ssc^apo", "apoplastic subsidiary-cell water potential"), ("ψ_ssc^apo", "apoplastic subsidiary-cell water potential"), ("ψssc^apo", "apoplastic subsidiary-cell water potential"),
            ("psi_ssc", "subsidiary-cell water potential"), ("ψ_ssc", "subsidiary-cell water potential"),
        ],
        "gene": [
            ("GhSLAC1", "G H slac one"), ("SLAC1", "slac one"), ("slac1", "slac one"), ("OSCA1", "osca one"), ("osca1", "osca one"), ("OST1", "O S T one"), ("ost1", "O S T one"),
            ("CPK", "C P K"), ("cpk", "C P K"), ("aao3", "A A O three"),
        ],
        "acronym": [
            ("ABA", "abscisic acid"), ("ROS", "reactive oxygen species"), ("OXZ", "outside xylem"), ("SPAC", "soil plant atmosphere continuum"), ("VPD", "vapor pressure deficit"), ("FDR", "false discovery rate"),
            ("WT", "wild type"), ("SSC", "subsidiary cell"), ("MCMC", "M C M C"), ("ODE", "O D E"), ("PYR-PP2C-OST1-SLAC1", "P Y R, P P two C, O S T one, slac one"),
            ("PYR–PP2C–OST1–SLAC1", "P Y R, P P two C, O S T one, slac one"), ("HP-HA", "hydropassive hydroactive"), ("HP–HA", "hydropassive hydroactive"), ("PP2C", "P P two C"), ("PYR", "P Y R"),
        ],
    }
    made = [Entry(g, s, c) for c, pairs in rows.items() for g, s in pairs]
    return made + [Entry("billons", "billion", "errata", False), Entry("millons", "million", "errata", False)]


LEXICON = _entries()


def by_category(lexicon: list[Entry], *categories: str) -> list[Entry]:
    return [e for e in lexicon if e.category in categories]


def alias_entries(lexicon: list[Entry]) -> list[Entry]:
    """Longest grapheme first, stable."""
    return sorted(by_category(lexicon, "symbol", "gene", "acronym", "greek", "errata"), key=lambda e: -len(e.grapheme))


def apply_entries(text: Column, entries: list[Entry]) -> Column:
    """Ordered replacement, whole tokens where an entry asks for it."""
    for e in entries:
        edge = (r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])") if e.word_boundaries else ("", "")
        text = F.regexp_replace(text, ("" if e.case_sensitive else "(?i)") + edge[0] + quote(e.grapheme) + edge[1], e.spoken)
    return text


def apply_lexicon(text: Column, lexicon: list[Entry] = LEXICON) -> Column:
    return apply_entries(text, alias_entries(lexicon))


def expand_acronyms(text: Column, lexicon: list[Entry] = LEXICON) -> Column:
    return apply_entries(text, sorted(by_category(lexicon, "acronym"), key=lambda e: -len(e.grapheme)))


def normalize_units(text: Column) -> Column:
    return apply_entries(text, [Entry(raw, spoken, "unit") for raw, spoken in UNITS])


def expand_greek_letters(text: Column) -> Column:
    return regex_map(text, "[" + "".join(GREEK) + "]", lambda m: F.concat(F.lit(" "), F.element_at(F.create_map(*[F.lit(x) for kv in GREEK.items() for x in kv]), m), F.lit(" ")))


def expand_greek(text: Column, lexicon: list[Entry] = LEXICON) -> Column:
    return expand_greek_letters(apply_entries(text, sorted(by_category(lexicon, "greek"), key=lambda e: -len(e.grapheme))))


def normalize_stats(text: Column) -> Column:
    return literals(text, OPERATORS)


def replace_urls(text: Column) -> Column:
    """Links become a phrase; closing punctuation stays."""
    return regex_map(text, URL, lambda m: F.concat(F.lit(f" {LINK} "), F.regexp_extract(m, "[" + quote(URL_CLOSING) + "]*$", 0)))


def collapse_links(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?:{LINK}[\s.,;]*){{2,}}", f"{LINK} ")


def normalize_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def sweep_forbidden(text: Column) -> Column:
    return literals(text, SWEEP)


def paren_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s_-]+", " ")))


def collapse_redundant_parenthetical_once(text: Column) -> Column:
    """A phrase followed by itself in parentheses loses the copy, if that has several words."""

    def one(m: Column) -> Column:
        before, inside = F.regexp_extract(m, GLOSS, 1), paren_key(F.regexp_extract(m, GLOSS, 2))
        return F.when(F.contains(inside, F.lit(" ")) & F.endswith(paren_key(before), inside), before).otherwise(m)

    return regex_map(text, GLOSS, one)


def without_repeated_gloss(text: str) -> str:
    """The same for a Python string, up to four times."""
    key = lambda phrase: " ".join(re.split(r"[\s_-]+", phrase)).strip().lower()
    for _ in range(4):
        before, text = text, re.sub(GLOSS, lambda m: m[1] if " " in key(m[2]) and key(m[1]).endswith(key(m[2])) else m[0], text)
        if text == before:
            break
    return text


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s+([,.;:!?])", "$1"))


def apply_steps(rows: DataFrame, column: str, steps: list) -> DataFrame:
    """Steps as one projection each: a value used several times by the next is then computed once."""
    for step in steps:
        rows = rows.withColumn(column, step(F.col(column)))
    return rows


def fix_mojibake(text: Column) -> Column:
    """Detached diacritics go; text without any is left alone."""
    marks = "¨´ˆ˜̀-ͯ"
    fixed = F.regexp_replace(F.regexp_replace(text, rf"(?<=\w)-\s*[{marks}]+\s*(?=\w)", ""), rf"\s+[{marks}]+(?=\s|$|[^\w{marks}])", "")
    return F.when(text.rlike(f"[{marks}]"), F.trim(F.regexp_replace(fixed, r"\s+", " "))).otherwise(text)


def normalize_ligatures(text: Column) -> Column:
    return literals(text, LIGATURES)


def dehyphenate(text: Column) -> Column:
    """Words split at a line end are joined, lines flattened, dash compounds rejoined."""
    for pattern, to in ((r"(\w)[-­]\n(\w)", "$1$2"), (r"\s*\n\s*", " "), (r"(\w[–—])\s+(\w)", "$1$2"), (r"[ \t]{2,}", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def rejoin_split_tokens(text: Column) -> Column:
    for pattern, to in REJOIN:
        text = F.regexp_replace(text, pattern, to)
    return text


def segment(text: Column) -> Column:
    """Sentences as a partition of text: concatenated they give it back. Abbreviations and links don't end one.

    Protected stops are hidden behind a private-use character while the text is cut.
    """
    hidden = {".": "", "!": "", "?": ""}
    # longest first, so that an abbreviation inside another one is covered by it
    protected = r"https?://\S+|www\.\S+|(?i:" + "|".join(quote(a) for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + ")"
    safe = regex_map(text, protected, lambda m: F.translate(m, ".!?", "".join(hidden.values())))
    parts = let(safe, lambda t: F.regexp_extract_all(t, F.lit(r"(?s).*?[.!?]+\s*|(?s).+"), F.lit(0)))
    return F.filter(F.transform(parts, lambda p: F.translate(p, "".join(hidden.values()), ".!?")), lambda p: p != "")


def ends_hyphenated(text: Column) -> Column:
    return F.trim(text).rlike("[a-z][-­]$")


def ends_sentence(text: Column) -> Column:
    return F.regexp_replace(F.rtrim(text), "[”\"']+$", "").rlike("[.!?]$")


def keeps_hyphen(text: Column) -> Column:
    return F.length(F.regexp_extract(F.trim(text), "(\\w+)[-­]$", 1)) >= 3


def is_title_spillover(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) > 0) & (F.length(t) <= 60) & t.rlike(r"(?i)^(and|with|or|of|the|for|to|in|via)\b") & ~t.rlike("[.!?:]$")


def looks_like_page_number(text: Column) -> Column:
    return text.rlike(r"^\s*\d{1,4}\s*$")


def is_reference_entry(text: Column) -> Column:
    return text.rlike(r"^\s*[-*•]?\s*\[(\d+)\]\s")


def classify_block(text: Column) -> Column:
    """reference_list, figure_caption, heading or paragraph; the first that fits."""
    t = F.trim(text)
    return (
        F.when(t == "", "paragraph")
        .when(is_reference_entry(t), "reference_list")
        .when(t.rlike(r"(?i)^\s*(?:Figure|Fig\.?|Table|Scheme)\s+(?:[A-Z]\.)?\d+(?:\.\d+)*\s*:"), "figure_caption")
        .when(t.rlike(r"(?i)^\s*CHAPTER\s+(\d+)\s*$") | t.rlike(r"^\s*(\d+(?:\.\d+)+)\s+(.*\S)\s*$"), "heading")
        .otherwise("paragraph")
    )


def slugify(text: Column, default: str = "untitled") -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(slug == "", default).otherwise(slug)


def strip_heading_enumerator(text: Column) -> Column:
    """Title words without a leading roman or arabic enumerator, unless nothing else is there."""
    bare = F.trim(F.regexp_replace(text, r"^(?:[IVXLCDM]+|\d+)(?:\.[A-Za-z0-9]+)*\.?\s+", ""))
    return F.when(bare == "", text).otherwise(bare)


def heading_key(text: Column) -> Column:
    """Equal for headings with equal titles, whatever their numbers, case and punctuation."""
    return F.trim(F.regexp_replace(F.lower(strip_heading_enumerator(text)), "[^a-z0-9]+", " "))


def collapse_periodic(words: Column) -> Column:
    """Runs of a unit of 1-8 words, four times or more and eight words or more, become one copy.

    A backreference finds the shortest unit at each place; words hold no white space.
    """
    text = F.array_join(words, "\n")
    for least, most in ((8, 1), (4, 8)):
        unit = r"((?:[^\n]+\n){1}?)" if most == 1 else r"((?:[^\n]+\n){2,8}?)"
        text = F.regexp_replace(F.concat(text, F.lit("\n")), rf"(?<=^|\n){unit}(?:\1){{{least - 1},}}", "$1")
        text = F.regexp_replace(text, "\n+$", "")
    return F.split(text, "\n")


def truncate_low_diversity(words: Column) -> Column:
    """In texts of 30 words or more, all from the first 10-word window with at most 3 distinct words goes."""
    n = F.size(words)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - 9, F.lit(1))), lambda i: F.size(F.array_distinct(F.slice(words, i, 10))) <= 3)
    return F.when((n < 30) | (F.size(starts) == 0), words).otherwise(F.slice(words, F.lit(1), F.greatest(F.coalesce(F.get(starts, F.lit(0)) - 1, F.lit(0)), F.lit(0))))


def collapse_repetition(text: Column) -> Column:
    """struct(text, removed): loops of an extraction model cut out, with the count of words that went."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def done(before: Column) -> Column:
        return let(chain(before, truncate_low_diversity, lambda w: F.when(F.size(w) > 0, collapse_periodic(w)).otherwise(w)), lambda after: F.when(
            (F.size(before) < 8) | (F.size(after) == F.size(before)), F.struct(text.alias("text"), F.lit(0).alias("removed"))
        ).otherwise(F.struct(F.array_join(after, " ").alias("text"), (F.size(before) - F.size(after)).alias("removed"))))

    return let(words, done)
