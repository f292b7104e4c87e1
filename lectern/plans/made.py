"""Queries on texts made from whole tables, so that SQL can say from the columns what an operator must return."""

from __future__ import annotations

import json

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import citations, markup, notation, prompts, replies, speak, verify
from ..functions import text as T
from ..functions.audio import joined_length, packed_duration, packed_silence, seconds_of, unpacked_length
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import edits as E
from ..operators import engine, metadata, pronounce, reports, rounds, scores, structure
from . import pipeline
from .queries import LINES, QUERIES, SQL, lines, query, spoken_turns, sql_hundred, sql_words, table

__all__ = ["QUERIES", "SQL"]


def text_of(*parts) -> Column:
    """Literals and columns as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _numbers() -> tuple[Column, Column, Column, Column]:
    """Key, two numbers made of it, and the decade."""
    key = F.col("o_orderkey")
    return key, key % 88 + 12, key % 7 + 2, F.floor(F.year("o_orderdate") / 10) * 10


_ORDERS = "o AS (SELECT o_orderkey AS k, o_orderkey % 88 + 12 AS a, o_orderkey % 7 + 2 AS n, year(o_orderdate) // 10 * 10 AS y FROM orders)"
_DECADE = f"CASE WHEN y % 1000 = 0 THEN {sql_hundred('(y // 1000)')} || ' thousands' ELSE ({sql_hundred('(y // 100)')} || ' ' || ['hundreds','tens','twenties','thirties','forties','fifties','sixties','seventies','eighties','nineties'][CAST(y % 100 // 10 AS INT) + 1]) END"
_POWER = f"(CASE n WHEN 2 THEN ' squared' WHEN 3 THEN ' cubed' ELSE ' to the ' || {sql_words('n')} END)"


def noted() -> Column:
    _, a, n, y = _numbers()
    return text_of("In the ", y, "s x^", n, " fell from ", a, "-", n, " to -", a, " or ", a, "%RH (", a, "%) in Section ", n, ".", a, ".3 and 3x", a, ", not C", n, "; 1,0", a, ".5")


@query(f"""WITH {_ORDERS} SELECT k AS o_orderkey, 'In the ' || ({_DECADE}) || ' x' || {_POWER} || ' fell from ' || {sql_words('a')} || ' to ' || {sql_words('n')} || ' to minus ' || {sql_words('a')} || ' or ' || {sql_words('a')}
|| ' percent RH (' || {sql_words('a')} || ' percent) in Section ' || {sql_words('n')} || ' point ' || {sql_words('a')} || ' point three and three times ' || {sql_words('a')} || ', not C ' || {sql_words('n')} || '; ' || {sql_words('(1000 + a)')} || ' point five' AS spoken FROM o""")
def notation_spoken(spark, sf_dir):
    """All kinds of numeric notation, through the whole normaliser."""
    return table(spark, sf_dir, "orders").select("o_orderkey", speak.normalize_all(noted()).alias("spoken"))


def _one_kind(**said: str) -> str:
    """SQL of the noted text with one kind voiced."""
    part = {
        "decade": "y || 's'", "power": "'^' || n", "range": "a || '-' || n", "minus": "'-' || a", "percent": "'%RH (' || a || '%)'", "reference": "n || '.' || a || '.3'", "times": "'3x' || a"
    } | said
    return f"'In the ' || {part['decade']} || ' x' || {part['power']} || ' fell from ' || {part['range']} || ' to ' || {part['minus']} || ' or ' || a || {part['percent']} || ' in Section ' || {part['reference']} || ' and ' || {part['times']} || ', not C' || n || '; 1,0' || a || '.5'"


_VOICED = {
    "decade": f"({_DECADE})", "power": _POWER, "range": "a || ' to ' || n", "minus": "'minus ' || a", "percent": "' percent RH (' || a || ' percent)'",
    "reference": f"{sql_words('n')} || ' point ' || {sql_words('a')} || ' point three'", "times": "'3 times ' || a",
}


@query(f"WITH {_ORDERS} SELECT k AS o_orderkey, " + ", ".join(f"{_one_kind(**{k: v})} AS {k}_voiced" for k, v in _VOICED.items()) + " FROM o")
def notation_by_kind(spark, sf_dir):
    """The scanner told to voice one kind only."""
    return table(spark, sf_dir, "orders").select("o_orderkey", noted().alias("t")).select("o_orderkey", *[notation.voiced(F.col("t"), k).alias(f"{k}_voiced") for k in _VOICED])


@query(f"""SELECT p_partkey, 'at ' || {sql_words('p_size')} || ' megapascals and three micromoles per meter squared per second of C O two, xylem water potential, plus or minus, ' || {sql_words('p_size')}
|| ' in alpha' || ': see the link in the text. A ' || p_name || ' billion less than water over reactive oxygen species' AS spoken FROM part""")
def units_spoken(spark, sf_dir):
    """Units, lexicon, Greek, signs and links."""
    made = text_of("at ", F.col("p_size"), " MPa and 3 µmol m^-2 s^-1 of CO2, psi_xyl ± ", F.col("p_size"), " in α: see www.example.org/x. A ", F.col("p_name"), " Billons <H2O/ROS")
    return table(spark, sf_dir, "part").select("p_partkey", speak.normalize_all(made).alias("spoken"))


@query(r"""WITH t AS (SELECT p_partkey, 'ab ' || p_name AS a, p_size AS n FROM part)
SELECT p_partkey, 'Growth.' || n || ' of ' || a || ' state. rose as Kim et al. show in Table,' || n || ' and Group. here. Fig.3' AS stripped, 'Growth.' || n || ' of ' || a || ' state. rose as Kim and others show in Table,' || n || ' and Group. here. Fig.3' AS natural,
'Growth.' || n || ' of ' || a || ' state. rose as researchers show in Table,' || n || ' and Group. here. Fig.3' AS generic, 'Group.20, 21' AS warned, 'Lee et al.|Kim et al.' AS mentions FROM t""")
def citations_stripped(spark, sf_dir):
    """Every form of reference, author mentions, and warnings."""
    n = F.col("p_size")
    made = text_of("Growth.", n, " of ab ", F.col("p_name"), " state.18, 19 rose (Lee et al., 2009) as Kim et al.,", n, " show [", n, ", 2] in Table,", n, " and Group.20, 21 here, according to [", n, "]. Fig.3")
    made = F.replace(made, F.lit(" here, according to ["), F.lit(" here ["))
    t = F.col("t")
    mapping = F.create_map(F.lit("Kim et al."), F.lit("researchers"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("t")).select(
        "p_partkey", citations.strip_markers(t).alias("stripped"), citations.naturalize_citations(t).alias("natural"), citations.naturalize_citations(t, mapping).alias("generic"),
        F.array_join(citations.capitalized_citation_strips(t), "|").alias("warned"), F.array_join(citations.find_narrative_mentions(t), "|").alias("mentions"),
    )


@query("""SELECT p_partkey, p_name || ' has m squared a greater than b it psi xyl less than or equal to ' || p_size || ' and 10 to the power of ' || p_size || ', a over b CO2 5 degrees times 3' AS plain FROM part""")
def markup_plain(spark, sf_dir):
    """Tags, entities, emphasis, LaTeX, superscripts and glyphs."""
    made = text_of("<b>", F.col("p_name"), r"</b> has m<sup>2</sup> a&gt;b *it* $\psi_{xyl} \leq ", F.col("p_size"), "$ and 10<sup>", F.col("p_size"), r"</sup>, $\frac{a}{b}$<br/>$CO_2$ 5° × 3")
    return table(spark, sf_dir, "part").select("p_partkey", markup.clean_markup(made).alias("plain"))


@query(f"""WITH {_ORDERS} SELECT k AS o_orderkey, CASE k % 3 WHEN 2 THEN NULL ELSE 'Equation ' || {sql_words('n')} || ' point ' || {sql_words('a')} || '.' END AS said,
CASE k % 3 WHEN 0 THEN 'a = b \\tag{{' || n || '.' || a || '}}' WHEN 1 THEN 'a = b \\tag{{' || n || '.' || a || '}}' ELSE 'a = b' END AS latex FROM o""")
def equations_announced(spark, sf_dir):
    """Display chunks to LaTeX and announcements."""
    key, a, n, _ = _numbers()
    number = text_of(n, ".", a)
    chunk = F.when(key % 3 == 0, text_of("$$a = b \\tag{", number, "}$$")).when(key % 3 == 1, text_of("$$a = b$$\n(", number, ")")).otherwise(F.lit("$$ a = b $$"))
    return table(spark, sf_dir, "orders").select("o_orderkey", markup.split_display_math(chunk).alias("latex")).select("o_orderkey", "latex", citations.equation_announcement(F.col("latex")).alias("said"))


@query(f"SELECT o_orderkey, 'Figure Panel B of ' || {sql_words('o_orderkey')} || ' leaves' AS spoken FROM orders")
def captions_spoken(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text_of("Fig. (b) of ", F.col("o_orderkey"), " leaves").alias("caption"))
    return pipeline.speak_captions(rows).select("o_orderkey", "spoken")


@query(f"""WITH {LINES}, t AS (SELECT *, pos % 3 = 1 AS is_table FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_table ORDER BY pos) AS n FROM t)
SELECT doc_id, pos, 'Table ' || {sql_words('n')} || '. A table is shown here.' AS spoken FROM r WHERE is_table""")
def tables_numbered(spark, sf_dir):
    rows = B.select_policy(pipeline.as_blocks(lines(spark, sf_dir)).withColumn("type", F.when(F.col("pos") % 3 == 1, "table").otherwise("paragraph")))
    return pipeline.number_tables(rows).where("type = 'table'").select("doc_id", "pos", "spoken")


_STOPS = T.ABBREVIATIONS
_PROTECTED = r"https?://\S+|www\.\S+|(?i:" + "|".join("".join("\\." if c == "." else c for c in a) for a in sorted(_STOPS, key=len, reverse=True)) + ")"
SENTENCES = rf"""cut AS (SELECT doc_id, coalesce(text, '') AS t, string_split_regex(coalesce(text, ''), '{_PROTECTED}') AS p, regexp_extract_all(coalesce(text, ''), '{_PROTECTED}') AS m FROM documents),
safe AS (SELECT doc_id, list_aggregate(list_transform(list_zip(p, m), lambda x: x[1] || translate(coalesce(x[2], ''), '.!?', chr(57344) || chr(57345) || chr(57346))), 'string_agg', '') AS t FROM cut),
parts AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(t, '(?s).*?[.!?]+[\s\x0B]*|(?s).+'), lambda x: x <> ''), lambda x: translate(x, chr(57344) || chr(57345) || chr(57346), '.!?')) AS s FROM safe)"""


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(len(s) AS INT) AS n, sha256(coalesce(list_aggregate(s, 'string_agg', '|'), '')) AS cut FROM parts")
def sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.segment(F.coalesce("text", F.lit(""))).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("cut"))


def _passages(spark, sf_dir):
    """Lines as blocks with a page on every second one."""
    rows = pipeline.as_blocks(lines(spark, sf_dir))
    return rows.withColumn("type", F.when(F.col("pos") % 5 == 4, "table").otherwise("paragraph")).withColumn("page", F.when(F.col("pos") % 2 == 0, F.col("pos") + 1))


def _reader(rows):
    """A stand-in that reads the passage out, on a second attempt without what can't be spoken."""
    passage = F.substring_index("prompt", "\n\n", -1)
    again = F.col("prompt").startswith(prompts.TASKS["revise"])
    return rows.withColumn("reply", F.when(again, F.regexp_replace(passage, r"""[^A-Za-z \t\n.,;:!?'"()\-–—‘’“”…]""", "")).otherwise(passage))


def _hopeless(rows):
    """A look that returns nothing but signs for one page in four."""
    return rows.withColumn("reply", F.when(F.col("prompt").isNotNull(), F.when(F.col("page") % 4 == 1, "##").otherwise("Nothing.")))


#: Lines told apart by what they hold: signs that can't be spoken, values that must be kept, and negations or directions.
_TOLD = rf"""{LINES}, t AS (SELECT *, trim(text) AS said, regexp_matches(text, '[^A-Za-z \t\n.,;:!?''"()\-–—‘’“”…]') AS signs,
  regexp_matches(text, '(^|[^\w.])-?\d[\d,]*(\.\d+|\s*%)') AS valued FROM lines WHERE pos % 5 <> 4)"""


def _narrated(spark, sf_dir):
    rows = _passages(spark, sf_dir).where("pos % 5 <> 4").withColumn("source", F.col("text"))
    return engine.narrate_segments(rows, _reader)


@query(rf"""WITH {_TOLD}, a AS (SELECT *, NOT signs AS first, regexp_replace(text, '[^A-Za-z \t\n.,;:!?''"()\-–—‘’“”…]', '', 'g') AS again FROM t)
SELECT doc_id, pos, CAST(CASE WHEN first THEN 1 ELSE 2 END AS INT) AS attempts FROM a""")
def narration_attempts(spark, sf_dir):
    """Attempts that a segment takes: the second is only asked for what can't be spoken as it stands."""
    return _narrated(spark, sf_dir).select("doc_id", "pos", "attempts")


@query(rf"""WITH {_TOLD} SELECT doc_id, pos, true AS ok, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS spoken FROM t WHERE NOT signs AND NOT regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?s)^(["''“”]).*["''”]$')""")
def narration_kept(spark, sf_dir):
    """Segments that can be spoken as they stand are, at the first attempt."""
    plain = _narrated(spark, sf_dir).where("attempts = 1").where(~F.regexp_replace("text", r"^\s+|\s+$", "").rlike("(?s)^([\"'“”]).*[\"'”]$"))
    return plain.select("doc_id", "pos", "ok", F.sha2("spoken", 256).alias("spoken"))


def _with_heads(rows):
    """Every third of a few lines as a heading."""
    titles = {2: "I. Front", 6: "II. Middle", 9: "III. End"}
    heads = F.element_at(F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]), F.col("pos").cast("int"))
    return rows.withColumn("type", F.when(F.col("pos").isin(*titles), "heading").otherwise(F.col("type"))).withColumn("text", F.when(F.col("pos").isin(*titles), heads).otherwise(F.col("text")))


def _document(spark, sf_dir):
    """Lines of documents under three made headings: read, skipped, read; what comes before them is for review."""
    rows = _with_heads(_passages(spark, sf_dir))
    made = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("title"), F.lit(k).alias("kind")) for i, (t, k) in enumerate((("Front", "abstract"), ("Middle", "References"), ("END", "body_chapter")))])
    sections = rows.select("doc_id").distinct().select("doc_id", F.inline(made))
    return engine.narrate_document(rows, sections, engine.offline, _hopeless)


#: The stand-in never passes; the look at a page passes unless it returns signs, or a line's negations or directions go.
_ROUTED = rf"""{LINES}, b AS (SELECT doc_id, pos, pos IN (2, 6, 9) AS head, pos % 5 = 4 AS tab, CASE WHEN pos % 2 = 0 THEN pos + 1 END AS page,
  coalesce(max(CASE WHEN pos IN (2, 6, 9) THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS under FROM lines),
r AS (SELECT *, CASE WHEN under = 6 THEN 'skipped' WHEN under = -1 THEN 'reviewed' WHEN head THEN 'heading' WHEN tab THEN 'announced' ELSE 'prose' END AS route FROM b)"""


@query(f"""WITH {_ROUTED} SELECT doc_id, pos, CASE WHEN route = 'prose' THEN 'told' ELSE route END AS route, route = 'heading' OR route = 'announced' AS sure, CASE WHEN route = 'announced' THEN 'A table is shown here.' END AS announced,
CAST(CASE WHEN route = 'prose' THEN CASE WHEN page IS NULL THEN 2 ELSE 3 END ELSE 0 END AS INT) AS attempts, CASE WHEN under = 9 THEN 1 END AS chapter FROM r""")
def narration_routes(spark, sf_dir):
    """What becomes of each block of a narrated document."""
    told = F.col("status").isin("narrated", "held")
    rows = _document(spark, sf_dir)
    return rows.select("doc_id", "pos", F.when(told, "told").otherwise(F.col("status")).alias("route"), (F.col("keep") & ~told).alias("sure"), F.when(F.col("status") == "announced", F.col("spoken")).alias("announced"), "attempts", "chapter")


@query(f"""WITH {_ROUTED} SELECT doc_id, count(*) FILTER (route = 'prose') AS told, count(*) FILTER (route = 'announced') AS announced, count(*) FILTER (route = 'skipped') AS skipped, count(*) FILTER (route = 'reviewed') AS reviewed FROM r GROUP BY 1""")
def narration_outcomes(spark, sf_dir):
    """Counts of a narrated document."""
    return engine.outcome(_document(spark, sf_dir)).select("doc_id", (F.col("narrated") + F.col("held")).alias("told"), "announced", "skipped", "reviewed")


@query(f"""WITH {_ROUTED} SELECT doc_id, count(*) AS pairs, count(*) FILTER (page IS NULL) AS unseen FROM r WHERE route = 'prose' GROUP BY 1""")
def narration_pairs(spark, sf_dir):
    """Attempted narrations; the stand-in can't pass one without a page."""
    rows = engine.pairs(_document(spark, sf_dir).withColumn("block_id", F.when(F.col("page").isNull(), "unseen").otherwise("seen")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if((F.col("block_id") == "unseen") & ~F.col("ok")).alias("unseen"))


@query(f"""WITH {_ROUTED} SELECT doc_id, count(*) FILTER (route = 'reviewed') AS review, count(*) FILTER (route = 'prose') AS held FROM r WHERE route = 'reviewed' OR (route = 'prose' AND page IS NULL) GROUP BY 1""")
def narration_flags(spark, sf_dir):
    """What a person should see, of blocks for review and prose without a page."""
    rows = _document(spark, sf_dir).withColumn("block_id", F.when(F.col("page").isNull(), "unseen").otherwise("seen"))
    n = engine.flagged(rows).groupBy("doc_id").agg(F.count_if(F.col("reason") == "review").alias("review"), F.count_if((F.col("reason") == "verifier") & (F.col("block_id") == "unseen")).alias("held"))
    return n.where("review + held > 0")


_CASES = [
    ("It rose by {v} and was not lost", "It rose by {w} and was not lost", ""),
    ("It rose by {v} and was not lost", "It rose by nothing and was not lost", "polarity,values"),
    ("It did not work at {v}", "It did work at {w}", "polarity"),
    ("rates increased at {v}", "rates decreased at {w}", "direction"),
    ("plain words and {v}", "plain words 5 and {w}", "speakable"),
    ("only some of it at {v}", "some of it at {w}", "polarity"),
    ("see Figure {v} now", "see the figure now", ""),
    ("short at {v}", "apples bananas cherries dates figs grapes plums at {w}", "paraphrase"),
]


@query(f"SELECT c_custkey, {[k for _, _, k in _CASES]}[c_custkey % {len(_CASES)} + 1] AS kinds, {[k for _, _, k in _CASES]}[c_custkey % {len(_CASES)} + 1] = '' AS ok FROM customer")
def verdicts(spark, sf_dir):
    """The guard over rewrites that keep or break one thing each."""
    value = F.abs(F.col("c_acctbal")).cast("decimal(18,2)").cast("string")
    words = pipeline_words(value)
    pick = lambda k: F.element_at(F.array(*[F.replace(F.replace(F.lit(c[k]), F.lit("{v}"), value), F.lit("{w}"), words) for c in _CASES]), (F.col("c_custkey") % len(_CASES) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(0).alias("source"), pick(1).alias("spoken"))
    out = pipeline.verified_pairs(rows)
    return out.select("c_custkey", F.array_join(F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["kind"]))), ",").alias("kinds"), "ok")


def pipeline_words(token: Column) -> Column:
    from ..functions.numbers import number_to_words

    return number_to_words(token)


_EDITS = [
    # find, replace, kind, why with copy-editing, why without
    ("{n} mm", "{n} millimeters", "notation", None, None),
    ("responce", "response", "typo", None, "copy-edit disabled (--as-written): only notation is fixed"),
    ("did not", "did", "grammar", "copy-edit guard: would change a number, polarity, or claim", "copy-edit disabled (--as-written): only notation is fixed"),
    ("absent", "there", "notation", "not found in script", "not found in script"),
    ("{n} mm", "99 mm", "data", "data/claim - flag only, never auto-fixed", "data/claim - flag only, never auto-fixed"),
    ("same", "same", "notation", "empty, a no-op, or too long a span", "empty, a no-op, or too long a span"),
]


def _proposed(spark, sf_dir):
    n = F.col("p_size").cast("string")
    of = lambda s: F.replace(F.lit(s), F.lit("{n}"), n)
    rows = F.array(*[F.struct(F.lit(i).alias("n"), of(f).alias("find"), of(r).alias("replace"), F.lit(k).alias("kind"), F.lit("because").alias("reason")) for i, (f, r, k, *_) in enumerate(_EDITS)])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.inline(rows))


def _scripts(spark, sf_dir):
    text = text_of("The responce of ", F.col("p_size"), " mm, , did not do the same.")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("chunk_no"), text.alias("text"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query(f"SELECT p_partkey AS doc_id, n, CASE WHEN p_partkey % 2 = 0 THEN a ELSE b END AS why FROM part, (VALUES {', '.join(f'({i}, {sql_text(a)}, {sql_text(b)})' for i, (_, _, _, a, b) in enumerate(_EDITS))}) AS e(n, a, b)")
def edits_judged(spark, sf_dir):
    """Which proposed edits may be applied, with copy-editing on even documents only."""
    whole = rounds.scripts(_scripts(spark, sf_dir))
    edits = _proposed(spark, sf_dir)
    even = E.candidate_repairs(edits.where("doc_id % 2 = 0"), whole, True)
    return even.unionByName(E.candidate_repairs(edits.where("doc_id % 2 <> 0"), whole, False)).select("doc_id", "n", "why")


_REPORT = "'# Script repair report (notation vocalization)' || chr(10) || chr(10) || '## Applied repairs (2)' || chr(10) || chr(10) || '| find | replace | times | reason |' || chr(10) || '|---|---|---|---|' || chr(10) || '| ' || p_size || ' mm | ' || p_size || ' millimeters | 1 | because |' || chr(10) || '| responce | response | 1 | because |'"


@query(f"SELECT p_partkey AS doc_id, 'The response of ' || p_size || ' millimeters, did not do the same.' AS text, starts_with(head, head) AS reported FROM (SELECT *, {_REPORT} AS head FROM part)")
def scripts_repaired(spark, sf_dir):
    """Three rounds of guarded edits and the report of them."""
    proposed = _proposed(spark, sf_dir)
    chunks, applied, rejected = rounds.repair_script(_scripts(spark, sf_dir), lambda rows: proposed.join(rows.select("doc_id"), "doc_id", "left_semi"), copyedit=True)
    report = reports.script_repair_report(chunks, applied, rejected)
    n = F.col("p_size")
    head = text_of("# Script repair report (notation vocalization)\n\n## Applied repairs (2)\n\n| find | replace | times | reason |\n|---|---|---|---|\n| ", n, " mm | ", n, " millimeters | 1 | because |\n| responce | response | 1 | because |")
    want = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), head.alias("head"))
    return chunks.join(report, "doc_id").join(want, "doc_id").select("doc_id", "text", F.startswith("report", F.col("head")).alias("reported"))


@query("SELECT p_partkey AS doc_id, 'The response of ' || p_size || ' mm, did not do the same.' AS text, CAST(0 AS BIGINT) AS issues FROM part")
def scripts_checked(spark, sf_dir):
    """An audit, a fix of what it quotes, and a second audit, which finds it gone."""
    edits = _proposed(spark, sf_dir).where("n = 1").withColumn("kind", F.lit("notation"))

    def audit(rows):
        found = rows.where(F.contains("script", F.lit("responce")))
        return found.select("doc_id", F.lit(0).alias("n"), F.lit("typo").alias("kind"), F.lit("low").alias("severity"), F.lit("The  RESPONCE").alias("location"), F.lit("d").alias("detail")).unionByName(
            rows.select("doc_id", F.lit(1).alias("n"), F.lit("x").alias("kind"), F.lit("high").alias("severity"), F.lit("no such words").alias("location"), F.lit("d").alias("detail"))
        )

    chunks, left = rounds.check_script(_scripts(spark, sf_dir), audit, lambda rows: edits.join(rows.select("doc_id"), "doc_id", "left_semi"))
    n = left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"))
    return chunks.join(n, "doc_id", "left").select("doc_id", "text", F.coalesce("issues", F.lit(0)).cast("long").alias("issues"))


@query("SELECT p_partkey AS doc_id, 'Value 0.' || p_size || ' of ' || p_name || ', kept words' AS text, CAST(2 AS BIGINT) AS applied, CAST(2 AS BIGINT) AS rejected FROM part")
def markdown_repaired(spark, sf_dir):
    n, name = F.col("p_size").cast("string"), F.col("p_name")
    parts = table(spark, sf_dir, "part")
    docs = parts.select(F.col("p_partkey").alias("doc_id"), text_of("Value <sup>0</sup>.", n, " of ", name, " , kept words").alias("text"))
    rows = [(text_of("<sup>0</sup>.", n), text_of("0.", n), "artifact"), (text_of(name, " ,"), text_of(name, ","), "noise"), (F.lit("kept"), F.lit("lost"), "noise"), (F.lit("gone ,"), F.lit("gone,"), "noise")]
    edits = parts.select(F.col("p_partkey").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(i).alias("n"), b.alias("broken"), f.alias("fixed"), F.lit(k).alias("kind"), F.lit("r").alias("reason")) for i, (b, f, k) in enumerate(rows)])))
    none = lambda r: r.select("doc_id", F.lit(0).alias("n"), *[F.lit("").alias(c) for c in ("kind", "severity", "location", "detail")]).where("false")
    cleaned, good, bad, _ = rounds.repair_markdown(docs, lambda r: edits, none)
    count = lambda d, c: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    return cleaned.join(count(good, "applied"), "doc_id", "left").join(count(bad, "rejected"), "doc_id", "left")


_BODY = r"lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)</?(?:break|emphasis|prosody|say-as|phoneme|sub|voice|p|s)\b[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))"
_LEAK = r"list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?i)</?(?:break|emphasis|prosody|say-as|phoneme|sub|voice|p|s)\b[^>]*>', ' ', 'g'), '[%±^_<>\[\]µμ−]'))"


@query(rf"""WITH d AS (SELECT doc_id, {_BODY} AS b, n_chars % 5 AS det, {_LEAK} AS l FROM documents), s AS (SELECT *, CAST(contains(b, 'the') AS INT) + CAST(regexp_matches(b, '(?i)e[aou]u') AS INT) AS bad, CAST(contains(b, 'de') AS INT) AS good FROM d)
SELECT doc_id AS item, 'structure (chapters)' AS dimension, CAST(least(det, 3) AS BIGINT) AS passed, CAST(3 AS BIGINT) AS total, CASE WHEN det = 0 THEN 0.0::DOUBLE ELSE round(2 * (least(det, 3) / det) * (least(det, 3) / 3) / (least(det, 3) / det + least(det, 3) / 3), 3) END AS rate FROM s
UNION ALL SELECT doc_id, 'citation/markup strip', 2 - bad, 2, round((2 - bad) / 2, 3) FROM s UNION ALL SELECT doc_id, 'value preservation', good, 1, good::DOUBLE FROM s
UNION ALL SELECT doc_id, 'raw-token leak (clean=1)', CAST(len(l) = 0 AS INT), 1, CAST(len(l) = 0 AS INT)::DOUBLE FROM s""")
def script_scores(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.coalesce("text", F.lit("")).alias("script"), (F.col("n_chars") % 5).alias("detected"), F.lit(3).alias("expected"), F.array(F.lit("The"), F.lit("re:e[aou]u")).alias("must_be_absent"), F.array(F.lit("de")).alias("must_be_present"))
    return scores.score(items).select("item", "dimension", "passed", "total", "rate")


@query("SELECT l_orderkey AS item, count(*) FILTER (l_quantity > 10) AS passed, count(*) AS total, round(count(*) FILTER (l_quantity > 10) / count(*), 3) AS rate FROM lineitem GROUP BY 1")
def faithfulness_rates(spark, sf_dir):
    return scores.faithfulness(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_quantity") > 10).alias("ok")))


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'Ann Lee ' || left(c_mktsegment, 1) || 'ox' WHEN 1 THEN 'Bo ' || left(c_mktsegment, 1) || 'arker' END AS author FROM customer WHERE c_custkey % 4 < 2""")
def authors_derived(spark, sf_dir):
    """Names after a line 'by', from copyright lines, and neither."""
    k, initial = F.col("c_custkey") % 4, F.substring("c_mktsegment", 1, 1)
    page = F.array(
        F.lit("A Title"), F.when(k == 0, "By").otherwise("for"), F.when(k == 0, text_of("Ann Lee ", initial, "ox")).otherwise(F.lit("a degree in 4 parts")),
        F.when(k == 1, text_of("Copyright 2019 Bo ", initial, "arker All Rights Reserved")).when(k == 2, "(c) 2019 somebody").otherwise(F.lit("no name")),
    )
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(page).alias("pos", "text"))
    return metadata.derive_author(rows)


@query(r"""SELECT doc_id, CASE WHEN trim(left(coalesce(text, ''), 12)) = '' THEN 'old' ELSE trim(left(coalesce(text, ''), 12)) END AS title, 'nobody' AS author, 'author' AS refused FROM documents""")
def metadata_adopted(spark, sf_dir):
    """A title that stands in the document is taken, an author who doesn't is refused."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents")
    blocks = docs.select("doc_id", F.lit(0).alias("pos"), text.alias("text"))
    proposed = docs.select("doc_id", F.substring(text, 1, 12).alias("title"), F.lit("Zzyzx Qqq").alias("author"))
    out = metadata.adopt_metadata(docs.select("doc_id", F.lit("old").alias("title"), F.lit("nobody").alias("author")), proposed, blocks)
    return out.select("doc_id", "title", "author", F.array_join("refused", ",").alias("refused"))


@query(f"""WITH {LINES} SELECT doc_id, CAST(pos // 4 AS INT) AS batch, 'p' || (min(pos) + 1) || CASE WHEN min(pos) = max(pos) THEN '' ELSE '-' || (max(pos) + 1) END AS span FROM lines GROUP BY 1, 2""")
def page_batches(spark, sf_dir):
    rows = metadata.page_batches(lines(spark, sf_dir).select("doc_id", (F.col("pos") + 1).alias("page")), 4)
    return rows.select("doc_id", "batch", metadata.page_span(F.col("first"), F.col("last")).alias("span"))


@query(f"""WITH {LINES}, b AS (SELECT DISTINCT doc_id, pos // 4 AS batch FROM lines) SELECT doc_id, count(*) AS sections, count(*) FILTER (batch % 2 = 0) AS chapters FROM b GROUP BY 1""")
def structure_collected(spark, sf_dir):
    """Sections from one reply a batch of pages, merged, and the chapters among them."""
    kind = F.when(F.col("batch") % 2 == 0, "Body_Chapter").otherwise("abstract")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(F.lit("").alias("number"), text_of("Part ", F.col("batch")).alias("title"), F.col("first").cast("int").alias("start_page"), kind.alias("kind"))).alias("sections"))), F.lit("\n```"))
    found = metadata.collect_structure(lines(spark, sf_dir).select("doc_id", (F.col("pos") + 1).alias("page")), lambda rows: rows.withColumn("reply", reply), 4)
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    return n.join(metadata.chapters_detected(found), "doc_id")


_NARRATE = prompts.TASKS["narrate"].replace("'", "''")


@query(f"""SELECT doc_id, sha256('{_NARRATE}' || chr(10) || chr(10) || coalesce(text, '')) AS asked, '[offline ' || left(sha256('{_NARRATE}' || chr(10) || chr(10) || coalesce(text, '')), 12) || ']' AS reply FROM documents""")
def prompts_offline(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", prompts.prompt("narrate", F.coalesce("text", F.lit(""))).alias("prompt"))
    return engine.offline(rows).select("doc_id", F.sha2("prompt", 256).alias("asked"), "reply")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN 'code' ELSE 'prose' END AS kind, quality = 0 AS audit FROM labels""")
def replies_parsed(spark, sf_dir):
    """Fenced JSON replies to labels, and whether one is an audit."""
    kind = F.when(F.col("quality") == 0, "code").otherwise("prose")
    raw = text_of('Sure:\n```json\n{"labels": [{"id": "b', F.col("doc_id"), '", "kind": "', kind, '"}]', F.when(F.col("quality") == 0, ', "issues": []').otherwise(F.lit("")), "}\n```")
    rows = table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.get(replies.parse(F.col("raw"), "labels")["labels"], F.lit(0))["kind"].alias("kind"), replies.is_audit(F.col("raw")).alias("audit"))


@query("SELECT conv_id, turn, greatest(floor(length(coalesce(text, '')) / 15.0 * 22050), 1) / 22050 AS seconds, CAST(44 + 2 * greatest(floor(length(coalesce(text, '')) / 15.0 * 22050), 1) AS BIGINT) AS bytes FROM conversations")
def silences(spark, sf_dir):
    """Durations read from the files, and their bytes. The files stay packed: whole ones take 2940 bytes a character."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", packed_silence(seconds_of(F.coalesce("text", F.lit("")))).alias("wav"))
    return rows.select("conv_id", "turn", packed_duration(F.col("wav")).alias("seconds"), unpacked_length(F.col("wav")).alias("bytes"))


_CHAPTERS = f"""c AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS chapter, 'Part #' || turn || '; a=b' AS title FROM conversations WHERE role = 'user' AND turn % 4 = 0),
i AS (SELECT conv_id AS doc_id, turn AS index, CASE WHEN role = 'user' THEN CAST(turn AS INT) END AS chapter, length(coalesce(text, '')) AS seconds FROM conversations),
t AS (SELECT i.*, coalesce(c.title, CASE WHEN i.chapter IS NULL THEN 'Front matter' ELSE 'Chapter ' || {sql_words('i.chapter')} END) AS title, sum(seconds * 1000) OVER (PARTITION BY i.doc_id ORDER BY index) AS e FROM i LEFT JOIN c ON c.doc_id = i.doc_id AND c.chapter = i.chapter)"""


@query(f"""WITH {_CHAPTERS} SELECT doc_id, sha256(';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(e - seconds * 1000 AS BIGINT) || chr(10) || 'END=' || CAST(e AS BIGINT) || chr(10) || 'title=' || regexp_replace(title, '([\\\\=;#])', '\\\\\\1', 'g'), chr(10) ORDER BY index) || chr(10)) AS metadata FROM t GROUP BY 1""")
def chapter_metadata(spark, sf_dir):
    """Titles of chapters from headings or numbers, as a container's metadata."""
    turns = spoken_turns(spark, sf_dir)
    heads = turns.where("chapter is not null and chapter % 4 = 0").select("doc_id", F.col("chunk_no").alias("pos"), F.lit("heading").alias("type"), "chapter", F.lit(None).cast("string").alias("section"), text_of("Part #", F.col("chapter"), "; a=b").alias("text"))
    rows = reports.titled(turns.select("doc_id", F.col("chunk_no").alias("index"), "chapter", F.length("text").alias("seconds")), reports.chapters(heads))
    return reports.chapter_metadata(rows).select("doc_id", F.sha2("metadata", 256).alias("metadata"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, pos, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM lines) SELECT l.doc_id, l.pos, CASE WHEN l.pos % 2 = 0 AND l.pos = (SELECT min(pos) FROM lines x WHERE x.doc_id = l.doc_id AND x.pos % 2 = 0) THEN 'the water use (W U) of it'
WHEN l.pos % 2 = 0 THEN 'the W U of it' ELSE 'a leaf says hello' END AS text FROM lines l""")
def pronunciations_applied(spark, sf_dir):
    """An acronym is introduced at first use; notation is replaced everywhere."""
    rows = lines(spark, sf_dir).select("doc_id", "pos", F.when(F.col("pos") % 2 == 0, "the WU of it").otherwise("a leaf says hi").alias("text"))
    rules = rows.select("doc_id").distinct().select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(k).alias("kind"), F.lit(key).alias("key"), F.lit(s).alias("spoken"), F.lit(h).alias("short_form")) for i, (k, key, s, h) in enumerate((("acronym", "WU", "water use", "W U"), ("notation", "hi", "hello", None), ("term", "a", "never", None)))])))
    return pronounce.apply_plan(rows, rules).select("doc_id", "pos", "text")


@query("""SELECT p_partkey, 'an efficient ' || p_name || ' example of lines PYR–PP2C' AS joined, 'Scholander said gs and H2O2 of ' || p_name AS repaired, p_name AS title, replace(p_name, ' ', ' ') AS key,
p_size % 2 = 0 AS spill, p_size % 2 = 0 AS name, 'x end of ' || p_name AS looped, CAST(7 AS INT) AS removed FROM part""")
def texts_cleaned(spark, sf_dir):
    """Ligatures, line ends, detached accents, split tokens, enumerators, wrapped titles, names and loops."""
    name, even = F.col("p_name"), F.col("p_size") % 2 == 0
    loop = T.collapse_repetition(text_of("x x x x x x x x end of ", name))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.dehyphenate(T.normalize_ligatures(text_of("an eﬃcient ", name, " exam-\nple of\n  lines PYR– PP2C"))).alias("joined"),
        T.rejoin_split_tokens(T.fix_mojibake(text_of("Scholander ¨ said g s and H2 O2 of ", name))).alias("repaired"),
        T.strip_heading_enumerator(text_of("III.A.1. ", name)).alias("title"), T.heading_key(text_of("2.3 ", F.upper(name), "!")).alias("key"),
        T.is_title_spillover(F.when(even, text_of("and ", name)).otherwise(text_of("And ", name, "."))).alias("spill"),
        metadata.looks_like_name(F.when(even, "Ann B Lee").otherwise("ann of b")).alias("name"),
        loop["text"].alias("looped"), loop["removed"].alias("removed"),
    )


@query(f"""WITH {LINES}, s AS (SELECT * FROM lines WHERE pos % 4 = 0) SELECT doc_id, pos FROM lines WHERE pos % 4 = 0""")
def blocks_suspicious(spark, sf_dir):
    """Paragraphs that are code by more than one sign, among lines of prose."""
    rows = lines(spark, sf_dir).withColumn("type", F.lit("paragraph")).withColumn("text", F.when(F.col("pos") % 4 == 0, "import os\nx = f(y)").otherwise("These are plain words of a sentence here."))
    return structure.suspicious_blocks(rows).select("doc_id", "pos")


@query("""SELECT doc_id, sha256('# Structurer reclassifications (' || count(*) FILTER (kind = 'code') || ')' || chr(10) || chr(10) || CASE WHEN count(*) FILTER (kind = 'code') = 0 THEN 'None - the deterministic block types were left unchanged.'
ELSE '| block | from | to | snippet |' || chr(10) || '|---|---|---|---|' || chr(10) || '| b1 | paragraph | code | some \\| words |' END || chr(10)) AS report FROM (SELECT DISTINCT doc_id, CASE WHEN quality = 0 THEN 'code' ELSE 'prose' END AS kind FROM labels) GROUP BY 1""")
def changes_reported(spark, sf_dir):
    given = table(spark, sf_dir, "labels").select("doc_id", F.lit("b1").alias("block_id"), F.when(F.col("quality") == 0, "code").otherwise("prose").alias("kind"), F.lit(1).alias("n"))
    blocks = given.select("doc_id").distinct().select("doc_id", F.lit(0).alias("pos"), F.lit("b1").alias("block_id"), F.lit("paragraph").alias("type"), F.lit("some |\n words").alias("text"))
    return reports.structure_changes(B.apply_labels(blocks, given)).select("doc_id", F.sha2("report", 256).alias("report"))


@query("""SELECT doc_id, '# Pronunciation QA (LLM curator)' || chr(10) || chr(10) || CASE WHEN quality = 0 THEN '## Terms' || chr(10) || chr(10) || '| term | spoken |' || chr(10) || '|---|---|' || chr(10) || '| t' || doc_id || ' | tee |' || chr(10)
ELSE 'Curator returned no entries (offline mock, or nothing to curate).' || chr(10) END AS report FROM (SELECT DISTINCT doc_id, quality FROM labels)""")
def pronunciations_reported(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    rules = docs.where("quality = 0").select("doc_id", F.lit(0).alias("n"), F.lit("term").alias("kind"), text_of("t", F.col("doc_id")).alias("key"), F.lit("tee").alias("spoken"), F.lit(None).cast("string").alias("short_form"))
    return reports.pronunciation_report(rules, docs)


SQL["chunk_plan"] = f"""WITH RECURSIVE {SENTENCES}, u AS (SELECT doc_id, unnest(s) AS t, unnest(range(len(s))) AS i FROM parts),
h AS (SELECT doc_id, i, unnest(range(0, CAST(ceil(length(t) / 2000) AS BIGINT))) AS k, t FROM u),
g AS (SELECT doc_id, 's' || i AS b, substring(t, k * 2000 + 1, 2000) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS n FROM h),
r AS (SELECT doc_id, n, 1 AS c, 2000 - length(t) AS room FROM g WHERE n = 1 UNION ALL
  SELECT g.doc_id, g.n, r.c + CAST(length(g.t) > r.room AS INT), CASE WHEN length(g.t) <= r.room THEN r.room ELSE 2000 END - length(g.t) FROM r JOIN g ON g.doc_id = r.doc_id AND g.n = r.n + 1),
m AS (SELECT doc_id, c, sha256(string_agg(t, '' ORDER BY n)) AS text_sha, CAST(sum(length(t)) AS INT) AS n, CAST(count(DISTINCT b) AS INT) AS blocks FROM r JOIN g USING (doc_id, n) GROUP BY 1, 2)
SELECT doc_id, CAST(c AS INT) AS chunk_no, 'chunk.' || c AS chunk_id, text_sha, n, blocks, CASE WHEN c > 1 THEN 'chunk.' || (c - 1) END AS prev_id, CASE WHEN c < max(c) OVER (PARTITION BY doc_id) THEN 'chunk.' || (c + 1) END AS next_id FROM m"""

_KIND = r"""CASE WHEN trim({0}) = '' THEN 'paragraph' WHEN regexp_matches(trim({0}), '^\s*[-*•]?\s*\[(\d+)\]\s') THEN 'reference_list'
  WHEN regexp_matches(trim({0}), '(?i)^\s*(?:Figure|Fig\.?|Table|Scheme)\s+(?:[A-Z]\.)?\d+(?:\.\d+)*\s*:') THEN 'figure_caption'
  WHEN regexp_matches(trim({0}), '(?i)^\s*CHAPTER\s+(\d+)\s*$') OR regexp_matches(trim({0}), '^\s*(\d+(?:\.\d+)+)\s+(.*\S)\s*$') THEN 'heading' ELSE 'paragraph' END"""
SQL["markdown_blocks"] = rf"""WITH c AS (SELECT doc_id, unnest(l) AS raw, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT doc_id, regexp_split_to_array('# ' || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\n\s*\n') AS l FROM documents)),
k AS (SELECT doc_id, pos, trim(raw) AS raw, regexp_replace(trim(raw), '^#{{1,6}}\s+', '') AS bare, regexp_matches(trim(raw), '^#{{1,6}}\s+.+$') AS head FROM c WHERE trim(raw) <> ''),
t AS (SELECT doc_id, pos, raw, CASE WHEN head THEN 'heading' ELSE {_KIND.format('raw')} END AS type, CASE WHEN head THEN trim(regexp_replace(bare, '[*_]+', '', 'g')) WHEN {_KIND.format('raw')} = 'heading' THEN raw END AS title FROM k),
a AS (SELECT *, max(CAST(coalesce(regexp_matches(title, '(?i)^APPENDI(X|CES)\b'), false) AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS app FROM t)
SELECT doc_id, pos, 'm' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block_id, CASE WHEN app THEN 'backmatter' ELSE type END AS type, CASE WHEN type = 'heading' THEN nullif(regexp_extract(title, '^(\d+(?:\.\d+)+)\s', 1), '') END AS section,
CAST(length(CASE WHEN title IS NOT NULL THEN trim(regexp_replace(title, '^\d+(?:\.\d+)+\s+', '')) ELSE raw END) AS INT) AS n FROM a"""
_OPEN = r"(regexp_matches(line, '(?i)^\s*CHAPTER\s+\d+\s*$') OR regexp_matches(line, '^\s*\d+(\.\d+)+(\s+\S.*)?$'))"
SQL["page_text_blocks"] = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
f AS (SELECT *, lag(trim(line) = '' OR {_OPEN}) OVER (PARTITION BY doc_id ORDER BY no) AS after FROM l WHERE NOT regexp_matches(line, '^\s*\d{{1,4}}\s*$')),
i AS (SELECT *, sum(CAST({_OPEN} OR regexp_matches(line, '^\s*\[\d+\]\s') OR coalesce(after, true) OR no = 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM f),
m AS (SELECT doc_id, island, min(no) AS no, string_agg(line, chr(10) ORDER BY no) AS text FROM i WHERE trim(line) <> '' GROUP BY 1, 2)
SELECT doc_id, 4294967296 + no AS pos, 'p' || row_number() OVER (PARTITION BY doc_id ORDER BY no) AS block_id, {_KIND.format('text')} AS type, 1 AS page, CAST(length(text) AS INT) AS n FROM m"""


@query("SELECT doc_id, trim(coalesce(text, '') || ' end') AS said, '[{\"type\":\"alias\",\"string_to_replace\":\"g' || doc_id || '\",\"alias\":\"gee\"}]' AS payload FROM documents")
def replies_joined(spark, sf_dir):
    """Text parts of replies, and pronunciation rules as a request."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(part("thinking", F.lit("hm")), part("text", F.coalesce("text", F.lit(""))), part("text", F.lit(None).cast("string")), part("text", F.lit(" end")))
    rules = F.array(F.struct(text_of("g", F.col("doc_id")).alias("grapheme"), F.lit("gee").alias("spoken")))
    return table(spark, sf_dir, "documents").select("doc_id", replies.reply_text(content).alias("said"), prompts.dictionary_payload(rules).alias("payload"))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS n, role, length(coalesce(text, '')) AS len FROM conversations),
w AS (SELECT doc_id, n, role, CAST(greatest(floor(len / 15.0 * 22050), 1) AS BIGINT) AS samples FROM c)
SELECT doc_id, CAST(sum(44 + 2 * samples) AS BIGINT) AS bytes, round(sum(samples / 22050), 3) AS seconds, greatest(count(*) FILTER (role = 'user'), 1) AS chapters FROM w GROUP BY 1""")
def books_assembled(spark, sf_dir):
    """Silent speech for every turn, joined, with chapters where a user speaks."""
    from . import commands

    turns = spoken_turns(spark, sf_dir).withColumn("prev_id", F.lit(None).cast("string")).withColumn("next_id", F.lit(None).cast("string"))
    titles = turns.where("false").select("doc_id", "chapter", F.lit("").alias("title"))
    made = commands.assemble(commands.synthesize(turns), titles)
    return made.select("doc_id", joined_length(F.col("audio")).alias("bytes"), F.round("seconds", 3).alias("seconds"), "chapters")


@query("""SELECT doc_id, '1 high, ' || CAST(n_chars % 2 = 0 AS INT) || ' medium, 0 low' || chr(10) || '- [high] cut: d' || doc_id || CASE WHEN n_chars % 2 = 0 THEN chr(10) || '- [medium] noise: x' ELSE '' END AS report FROM documents""")
def extraction_checked(spark, sf_dir):
    """An audit's issues as a report."""
    from . import commands

    def audit(rows):
        issue = lambda n, severity, kind, detail: F.struct(F.lit(n).alias("n"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.alias("detail"))
        found = F.array(F.when(F.col("n_chars") % 2 == 0, issue(0, "medium", "noise", F.lit("x"))), issue(1, "high", "cut", text_of("d", F.col("doc_id"))))
        return rows.select("doc_id", F.inline(F.array_compact(found)))

    return commands.check_extraction(table(spark, sf_dir, "documents"), audit)[1]


@query("""SELECT p_partkey AS doc_id, '# Extraction repair report (two-pass, guarded)' || chr(10) || chr(10) || '## Applied edits (1)' || chr(10) || chr(10) || '| kind | broken | fixed | times | reason |' || chr(10) || '|---|---|---|---|---|' || chr(10)
|| '| noise | ' || p_name || ' , | ' || p_name || ', | 1 | r |' || chr(10) || chr(10) || '## Rejected edits (1) - NOT applied (guard or not found)' || chr(10) || chr(10) || '| broken | proposed fixed | why rejected |' || chr(10) || '|---|---|---|' || chr(10) || '| kept | lost | guard: would change words or values |' || chr(10) || chr(10)
|| '## Pass 2 - residual issues on the CLEANED markdown' || chr(10) || chr(10) || 'No residual issues flagged.' || chr(10) AS report FROM part""")
def repairs_reported(spark, sf_dir):
    from . import commands

    name = F.col("p_name")
    parts = table(spark, sf_dir, "part")
    docs = parts.select(F.col("p_partkey").alias("doc_id"), text_of("A ", name, " , kept").alias("text"))
    rows = [(text_of(name, " ,"), text_of(name, ","), "noise"), (F.lit("kept"), F.lit("lost"), "noise")]
    edits = parts.select(F.col("p_partkey").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(i).alias("n"), b.alias("broken"), f.alias("fixed"), F.lit(k).alias("kind"), F.lit("r").alias("reason")) for i, (b, f, k) in enumerate(rows)])))
    none = lambda r: r.select("doc_id", F.lit(0).alias("n"), *[F.lit("").alias(c) for c in ("kind", "severity", "location", "detail")]).where("false")
    return commands.repair_extraction(docs, lambda r: edits, none)[1]


_REGION = "'# Thesis structure map (LLM cartographer)' || chr(10) || chr(10) || '| Region | Chapter | Decision | Kind-conf | Dec-conf | Blocks | Flags |' || chr(10) || '|---|---|---|---|---|---|---|' || chr(10)"


@query(f"""SELECT doc_id, {_REGION} || '| chapter_body (L' || doc_id || ') | 1 | include | 0.90 | 0.95 | b1..b9 | ' || CASE WHEN n_chars % 2 = 0 THEN 'unlabeled' ELSE '-' END || ' |' || chr(10) || '| unknown (x) | - | review | 0.50 | 0.90 | b10..b12 | review, low-conf, unknown |'
|| chr(10) || chr(10) || '## Flagged for review' || chr(10) || chr(10) || CASE WHEN n_chars % 2 = 0 THEN '- **chapter_body** (L' || doc_id || '): why' || chr(10) ELSE '' END || '- **unknown** (x): who knows' || chr(10) AS report,
CAST(2 + 2 * CAST(n_chars % 2 = 0 AS INT) - CAST(n_chars % 2 = 0 AS INT) + 1 AS BIGINT) AS warnings FROM documents""")
def structure_mapped(spark, sf_dir):
    """The map of a document's regions and how many warnings they give."""
    region = lambda n, kind, label, chapter, decision, kc, dc, first, last, anchored, why: F.struct(
        F.lit(n).alias("n"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(chapter).cast("int").alias("chapter"), F.lit(decision).alias("decision"), F.lit(kc).alias("kind_confidence"), F.lit(dc).alias("decision_confidence"),
        F.lit(first).alias("first_block_id"), F.lit(last).alias("last_block_id"), anchored.alias("heading_anchored"), F.lit(why).alias("rationale"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("language"),
    )
    made = F.array(region(0, "chapter_body", text_of("L", F.col("doc_id")), 1, "include", 0.9, 0.95, "b1", "b9", F.col("n_chars") % 2 != 0, "why"), region(1, "unknown", F.lit("x"), None, "review", 0.5, 0.9, "b10", "b12", F.lit(True), "who knows"))
    regions = table(spark, sf_dir, "documents").select("doc_id", F.inline(made))
    warnings = structure.region_warnings(regions).groupBy("doc_id").agg(F.count(F.lit(1)).alias("warnings"))
    return reports.structure_map(regions, B.effective_decision(F.col("kind"), False)).join(warnings, "doc_id")


@query(f"""WITH {LINES}, b AS (SELECT doc_id, pos, block_id, pos IN (2, 6, 9) AS head, CASE WHEN pos % 5 = 4 THEN 'table' ELSE 'paragraph' END AS type, CASE WHEN pos % 2 = 0 THEN CAST(pos + 1 AS VARCHAR) ELSE '?' END AS page,
  trim(regexp_replace(CASE pos WHEN 2 THEN 'I. Front' WHEN 6 THEN 'II. Middle' WHEN 9 THEN 'III. End' ELSE text END, '\\s+', ' ', 'g')) AS t FROM lines),
n AS (SELECT *, sum(CAST(head OR coalesce(lag_head, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(head) OVER (PARTITION BY doc_id ORDER BY pos) AS lag_head FROM b)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id, run) AS size FROM n),
m AS (SELECT *, size > 10 AND k > 8 AND k < size AS middle FROM k),
c AS (SELECT *, count(*) FILTER (middle) OVER w AS more, count(*) FILTER (middle AND type = 'paragraph') OVER w AS np, count(*) FILTER (middle AND type = 'table') OVER w AS nt FROM m WINDOW w AS (PARTITION BY doc_id, run)),
l AS (SELECT doc_id, pos, CASE WHEN head THEN block_id || ' | p' || page || ' | heading | ch- | sec:- | ' || left(t, 120) WHEN middle THEN '  ...(+' || more || ' more blocks: ' || concat_ws(',', CASE WHEN np > 0 THEN 'paragraphx' || np END, CASE WHEN nt > 0 THEN 'tablex' || nt END) || ')'
  ELSE block_id || ' | p' || page || ' | ' || type || ' | ' || left(t, 100) END AS line FROM c WHERE NOT middle OR k = 9)
SELECT doc_id, 'TITLE: a b | AUTHOR: d' || doc_id || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS outline FROM l GROUP BY 1""")
def outlines(spark, sf_dir):
    """The outline that a labeller reads, with made headings."""
    rows = _with_heads(_passages(spark, sf_dir))
    meta = rows.select("doc_id").distinct().select("doc_id", F.lit("a  b").alias("title"), text_of("d", F.col("doc_id")).alias("author"))
    return structure.outline(rows, meta)


def _blocks_of(spark, sf_dir, *rows):
    """A few blocks for each part: (type, text) with {n} for its name, as documents."""
    name = F.col("p_name")
    made = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f"b{i}").alias("block_id"), F.lit(kind).alias("type"), F.replace(F.lit(text), F.lit("{n}"), name).alias("text")) for i, (kind, text) in enumerate(rows)])
    return pipeline.as_blocks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.inline(made)))


def _rows_of(*rows) -> str:
    """SQL of what is left of them: (pos, type, text)."""
    values = ", ".join(f"({pos}, {sql_text(kind)}, {sql_text(text)})" for pos, kind, text in rows)
    return f"SELECT p_partkey AS doc_id, pos, type, replace(t, '{{n}}', p_name) AS text FROM part, (VALUES {values}) AS v(pos, type, t)"


_GOING_ON = [
    ("paragraph", "The plate of en-"), ("paragraph", "ergy went on"), ("table", "| a |"), ("paragraph", "and {n} ended."), ("paragraph", "A new {n} with a well-"), ("paragraph", "known end of"),
    ("figure_caption", "Figure 1: x"), ("paragraph", "Upper case starts anew"), ("heading", "1.1 Cut"), ("paragraph", "off here."),
]


@query(_rows_of((0, "paragraph", "The plate of energy went on and {n} ended."), (2, "table", "| a |"), (4, "paragraph", "A new {n} with a well-known end of"), (6, "figure_caption", "Figure 1: x"), (7, "paragraph", "Upper case starts anew"), (8, "heading", "1.1 Cut"), (9, "paragraph", "off here.")))
def continuations_merged(spark, sf_dir):
    return B.merge_continuations(_blocks_of(spark, sf_dir, *_GOING_ON)).select("doc_id", "pos", "type", "text")


_RAW = [
    ("paragraph", "CHAPTER 1"), ("paragraph", "and the wrapped rest of {n}"), ("paragraph", "1.1 Methods"), ("paragraph", "Running head"), ("paragraph", "It is <b>bold</b> at m<sup>2</sup> for an eﬃcient"), ("paragraph", "{n} that"),
    ("paragraph", "Running head"), ("paragraph", "17"), ("paragraph", "goes on."), ("paragraph", "Running head"), ("paragraph", "References"), ("paragraph", "[1] Someone"), ("paragraph", "CHAPTER 2"), ("paragraph", "More {n}."),
]


@query(_rows_of((0, "heading", "CHAPTER 1 and the wrapped rest of {n}"), (2, "heading", "1.1 Methods"), (4, "paragraph", "It is bold at m squared for an efficient {n} that goes on."), (10, "backmatter", "References"), (11, "backmatter", "[1] Someone"), (12, "heading", "CHAPTER 2"), (13, "paragraph", "More {n}.")))
def documents_built(spark, sf_dir):
    """Raw blocks through cleaning, running lines, wrapped titles, continuations and references."""
    return B.build_ir(_blocks_of(spark, sf_dir, *_RAW)).select("doc_id", "pos", "type", "text")


@query(f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Section ' || {sql_words('(o_orderkey % 7 + 2)')} || ' point ' || {sql_words('(o_orderkey % 88 + 12)')} || ', Title.' WHEN 1 THEN 'Chapter ' || {sql_words('(o_orderkey % 7 + 2)')} || '. Title.' ELSE 'Title.' END AS said FROM orders""")
def headings_announced(spark, sf_dir):
    key, a, n, _ = _numbers()
    chapter, section = F.when(key % 3 < 2, n.cast("int")), F.when(key % 3 == 0, text_of(n, ".", a))
    return table(spark, sf_dir, "orders").select("o_orderkey", pipeline.heading_announcement(F.lit("IV.2 Title"), chapter, section).alias("said"))


@query("""SELECT p_partkey AS doc_id, 'FRONT' || '.' || chr(10) || chr(10) || 'The W of ' || p_name || ' rose.' || chr(10) || chr(10) || 'Equation two point one.' || chr(10) || chr(10) || 'Table one. A table is shown here.' || chr(10) || chr(10)
|| 'See Appendix A and ' || p_name || '. ' || 'A note for the listener: this thesis refers to appendix material, which is not included in the audiobook. You can find it in the full written text.' || chr(10) || chr(10) || 'Again Appendix B.' || chr(10) || chr(10) AS script FROM part""")
def scripts_assembled(spark, sf_dir):
    """The rule stages after building: policy, equations, tables, references, numbers, signposts, announcements."""
    rows = _blocks_of(spark, sf_dir, ("heading", "I. FRONT"), ("paragraph", "The W of {n} rose [3]."), ("equation_display", r"a = b \tag{2.1}"), ("equation_display", "c = d"), ("table", "| {n} |"), ("paragraph", "See Appendix A and {n}."), ("paragraph", "Again Appendix B."), ("footnote", "not read"), ("backmatter", "Appendix"))
    rows = rows.withColumn("chapter", F.when(F.col("pos") > 0, F.lit(1))).withColumn("latex", F.when(F.col("type") == "equation_display", F.col("text")))
    spoken = pipeline.run_stages(rows, pipeline.rule_stages(), "select", "signpost")
    chunks = pipeline.script_segments(spoken).withColumnRenamed("pos", "chunk_no")
    return rounds.scripts(chunks)


_DECIDED = {
    "body_chapter": "read", "Abstract ": "read", "dedication": "read", "table_of_contents": "skip", "references": "skip", "appendix": "skip", "unheard": "review",
}
_EFFECTIVE = {"chapter_body": "include", "abstract": "include", "appendix": "include", "glossary": "include", "unknown": "review", "title_page": "skip", "bibliography": "skip"}


def _nth(values, by: str) -> str:
    return f"[{', '.join(map(sql_text, values))}][{by} % {len(values)} + 1]"


@query(f"SELECT p_partkey, {_nth(_DECIDED.values(), 'p_partkey')} AS section, {_nth(_EFFECTIVE.values(), 'p_partkey')} AS region FROM part")
def kinds_decided(spark, sf_dir):
    """What becomes of a section kind, and of a region kind with appendices."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", B.section_decision(pick(_DECIDED)).alias("section"), B.effective_decision(pick(_EFFECTIVE), True).alias("region"))


_RETYPED = [  # region, type, text, new type
    ("chapter_body", "backmatter", "CHAPTER 2", "heading"), ("abstract", "frontmatter", "Words.", "paragraph"), ("title_page", "paragraph", "Words.", "frontmatter"), ("bibliography", "paragraph", "Words.", "reference_list"),
    ("appendix", "heading", "A", "backmatter"), ("footnotes", "paragraph", "x", "footnote"), ("unknown", "paragraph", "x", "paragraph"), ("chapter_body", "table", "| x |", "table"),
]


@query(f"SELECT p_partkey AS doc_id, {_nth([r[3] for r in _RETYPED], 'p_partkey')} AS type, CAST(p_size AS INT) AS chapter FROM part")
def regions_retyped(spark, sf_dir):
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in _RETYPED]), (F.col("p_partkey") % len(_RETYPED) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pick(0).alias("region_kind"), pick(1).alias("type"), pick(2).alias("text"), F.col("p_size").cast("int").alias("region_chapter"), F.lit(99).alias("chapter"))
    return B.retype_regions(rows).select("doc_id", "type", "chapter")


@query("""SELECT p_partkey AS doc_id, 'b0' AS block_id, 'section heading has no body text: ''1.1 ' || p_name || '''' AS reason FROM part UNION ALL SELECT p_partkey, 'b3', 'section heading has no body text: ''1.3 End''' FROM part""")
def sections_empty(spark, sf_dir):
    rows = _blocks_of(spark, sf_dir, ("heading", "1.1 {n}"), ("heading", "1.2 Full"), ("paragraph", "Words."), ("heading", "1.3 End")).withColumn("section", F.when(F.col("type") == "heading", F.substring("text", 1, 3)))
    return B.empty_section_warnings(rows).select("doc_id", "block_id", "reason")


@query("""WITH c AS (SELECT conv_id AS doc_id, turn, CASE WHEN role = 'user' THEN CAST(turn AS INT) END AS chapter FROM conversations), f AS (SELECT *, first_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM c),
k AS (SELECT * FROM f WHERE chapter IS NULL OR chapter = first) SELECT doc_id, turn AS chunk_no, 'chunk.' || lag(turn) OVER w AS prev_id, 'chunk.' || lead(turn) OVER w AS next_id FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY turn)""")
def chunks_previewed(spark, sf_dir):
    rows = spoken_turns(spark, sf_dir).withColumn("prev_id", F.lit("")).withColumn("next_id", F.lit(""))
    return C.preview_chunks(rows).select("doc_id", "chunk_no", "prev_id", "next_id")


_GUARDED = [  # broken, fixed, faithful, safe, copyedit
    ("<sup>0</sup>.1 mm", "0.1 mm", True, False, False), ("foo , bar", "foo, bar", True, True, True), ("five cells", "nine cells", False, False, False), ("the responce was", "the response was", True, False, True),
    ("did not work", "did work", True, False, False), ("same", "same", False, False, False), ("rates increased", "rates decreased", True, False, False),
]


@query(f"SELECT p_partkey, [{', '.join(str(r[2]).lower() for r in _GUARDED)}][p_partkey % {len(_GUARDED)} + 1] AS faithful, [{', '.join(str(r[3]).lower() for r in _GUARDED)}][p_partkey % {len(_GUARDED)} + 1] AS safe, [{', '.join(str(r[4]).lower() for r in _GUARDED)}][p_partkey % {len(_GUARDED)} + 1] AS copyedit FROM part")
def edits_guarded(spark, sf_dir):
    """Three guards on edits that keep or break something."""
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in _GUARDED]), (F.col("p_partkey") % len(_GUARDED) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(0).alias("a"), pick(1).alias("b"))
    return rows.select("p_partkey", E.is_faithful_artifact(F.col("a"), F.col("b")).alias("faithful"), E.is_safe_repair(F.col("a"), F.col("b")).alias("safe"), verify.copyedit_guard(F.col("a"), F.col("b")).alias("copyedit"))


_TASKS = " || chr(0) || ".join(f"{sql_text(text)} || chr(10) || chr(10) || 'd' || doc_id" for _, text in sorted(prompts.TASKS.items()))
_PAGES = 'Pages {a} to {b} follow. List the top-level divisions that begin on them. Reply with JSON {"sections": [{"number": ..., "title": ..., "start_page": ..., "kind": ...}]} only.'


@query(f"""SELECT doc_id, sha256({_TASKS}) AS tasks, replace(replace({sql_text(_PAGES)}, '{{a}}', '1'), '{{b}}', CAST(n_chars % 50 + 1 AS VARCHAR)) AS pages,
{sql_text(prompts.TASKS['revise'])} || chr(10) || chr(10) || '- values: v' || doc_id || chr(10) || '- polarity: p' || chr(10) || chr(10) || 'before' || chr(10) || chr(10) || 'source' AS revised,
'Choose for each author mention one of: earlier studies, other researchers, prior studies, researchers, several studies, the authors. Reply with a JSON object from mention to phrase only.' || chr(10) || chr(10) || '["Lee et al.","d' || doc_id || '"]' AS generic FROM documents""")
def prompts_built(spark, sf_dir):
    """Every prompt: the tasks, page batches, revisions and author mentions."""
    part = text_of("d", F.col("doc_id"))
    tasks = F.concat_ws("\0", *[prompts.prompt(t, part) for t in sorted(prompts.TASKS)])
    broken = F.array(F.struct(F.lit("values").alias("kind"), text_of("v", F.col("doc_id")).alias("detail")), F.struct(F.lit("polarity").alias("kind"), F.lit("p").alias("detail")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(tasks, 256).alias("tasks"), prompts.structure_prompt(F.lit(1), (F.col("n_chars") % 50 + 1).cast("int")).alias("pages"),
        prompts.revision_prompt(F.lit("source"), F.lit("before"), broken).alias("revised"), prompts.genericize_prompt(F.array(F.lit("Lee et al."), part)).alias("generic"),
    )


@query("""SELECT p_partkey, [2, 1][p_size % 2 + 1] = 2 AS kept, 'several studies show ' || p_name AS folded, 'researchers' AS phrase, p_name || ' and others' AS others FROM part""")
def mentions_generic(spark, sf_dir):
    """Runs of generic phrases, replies to phrases, and what is left of mentions."""
    name = F.col("p_name")
    reply = text_of('```json\n{"Lee et al.": " Researchers ", "x": "anything ', name, '"}\n```')
    found = citations.parse_genericization(reply)
    return table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") % 2 == 0).alias("kept"), citations.collapse_citation_run(text_of("prior studies, several studies and Zhu show ", name)).alias("folded"),
        F.when(F.size(found) == 1, found["Lee et al."]).alias("phrase"), citations.expand_et_al(text_of(name, " et al.")).alias("others"),
    )


@query("SELECT doc_id, 'reply.' || sha256(coalesce(text, '')) AS key, n_chars % 3 <> 0 AS hit FROM documents")
def replies_cached(spark, sf_dir):
    """Replies put twice into a new cache and asked for again; empty ones aren't kept."""
    import uuid

    from ..sources import cache
    from ..sources.stored import root_of

    path = f"{root_of(spark)}/cache-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", cache.cache_key("reply.", F.coalesce("text", F.lit(""))).alias("key"))
    told = rows.select("key", F.when(F.min(F.col("n_chars") % 3).over(Window.partitionBy("key")) > 0, F.lit("x")).otherwise("").cast("binary").alias("value"))
    for _ in range(2):
        cache.put(spark, told, path)
    return cache.get(rows, cache.read(spark, path)).select("doc_id", "key", F.col("value").isNotNull().alias("hit"))


_SCRIPT = [
    "'An audiobook rendering of ' || p_name || ', by Ann Lee.'", "'<break time=\"0.8s\"/>'", "'Chapter two. Front.'", "'<break time=\"0.8s\"/>'", "'It was five.'", "'A shown ' || p_name || '.'", "'A last figure.'",
]


@query(f"""SELECT p_partkey AS doc_id, {" || chr(10) || chr(10) || ".join(_SCRIPT)} || chr(10) || chr(10) || 'This concludes ' || p_name || '.' AS script FROM part""")
def scripts_with_figures(spark, sf_dir):
    """Opening, pauses, headings, prose, figures at their first reference or last, and closing."""
    rows = B.select_policy(_blocks_of(spark, sf_dir, ("heading", "I. Front"), ("paragraph", "It was five.")).withColumn("chapter", F.lit(2)))
    parts = table(spark, sf_dir, "part")
    meta = parts.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.lit("Ann Lee").alias("author"))
    shown = F.array(F.struct(F.lit(0).alias("n"), F.lit("none").alias("ref"), F.lit("A last figure.").alias("spoken")), F.struct(F.lit(1).alias("n"), F.lit("b1").alias("ref"), text_of("A shown ", F.col("p_name"), ".").alias("spoken")))
    script = pipeline.assemble_script(rows, meta, parts.select(F.col("p_partkey").alias("doc_id"), F.inline(shown)), pipeline.supports_breaks("multilingual_v2"))
    return rounds.scripts(script.withColumnRenamed("pos", "chunk_no"))


@query("SELECT conv_id AS doc_id, count(*) AS chunks, count(*) AS hits, count(DISTINCT turn) AS keys FROM conversations GROUP BY 1")
def speech_cached(spark, sf_dir):
    """Speech for every turn asked for twice: the second time all of it comes from the cache."""
    import uuid

    from ..sources.stored import root_of
    from . import commands

    path = f"{root_of(spark)}/speech-{uuid.uuid4().hex}"
    turns = spoken_turns(spark, sf_dir)
    commands.synthesize(turns, path, voice_id="v")
    again = commands.synthesize(turns.withColumn("text", F.col("text")), path, voice_id="v")
    return again.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("hit").alias("hits"), F.count_distinct("chunk_no").alias("keys"))


@query("""SELECT p_partkey AS doc_id, 'Chapter one. One.' || chr(10) || chr(10) || 'The water use (W U) of ' || p_name || ' rose as researchers say.' || chr(10) || chr(10) || 'Then W U fell.' || chr(10) || chr(10) || 'Table one. It shows ' || {words} || '.' || chr(10) || chr(10) AS script FROM part""".format(words=sql_words("p_size")))
def scripts_by_models(spark, sf_dir):
    """All stages of the first engine, each with a model that proposes something, and regions that are skipped."""
    from . import stages

    rows = _blocks_of(
        spark, sf_dir, ("paragraph", "Copyright page"), ("paragraph", "I. One"), ("paragraph", "The WU of {n} rose as Kim et al. say [3]."), ("paragraph", "Then WU fell."), ("paragraph", "import os\nx = f(y)"), ("table", "| {n} |\n| b |"), ("paragraph", "Left out."),
    )
    rows = rows.withColumn("type", F.when(F.col("pos") == 1, "heading").otherwise(F.col("type")))
    size = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size").hint("merge")  # as many rows as documents, though few bytes
    says = lambda text: lambda asked: asked.withColumn("reply", F.lit(text))
    region = lambda kind, first, last, chapter: {"kind": kind, "decision": "include", "first_block_id": first, "last_block_id": last, "chapter": chapter}
    found = [region("title_page", "b0", "b0", None), region("chapter_body", "b1", "b5", 1), region("appendix", "b4", "b6", None), region("index", "b6", "b6", None)]
    models = {
        "structurer": says(json.dumps({"labels": [{"id": "b4", "kind": "code"}]})), "cartographer": says("```json\n" + json.dumps({"regions": found}) + "\n```"),
        "curate": says(json.dumps({"acronyms": [{"acronym": "WU", "first_use": "water use", "short_form": "W U"}], "terms": [], "notation": [], "dehyphenations": [], "notes": []})),
        "citations": says('{"Kim et al.": "researchers"}'), "figures": lambda asked: asked.join(size, "doc_id").withColumn("reply", text_of("It shows ", F.col("p_size"), ".")).drop("p_size"),
    }
    spoken = pipeline.run_stages(rows, stages.default_stages(models), "structurer")
    return rounds.scripts(pipeline.script_segments(spoken).withColumnRenamed("pos", "chunk_no"))
