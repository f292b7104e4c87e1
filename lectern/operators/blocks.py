"""Ordered block tables: cleaning, typing, merging, sections, labels, regions, policies.

A block is (doc_id, pos, text, type, section, chapter, ...); windows are by document in pos order, so one hash
exchange on doc_id serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.citations import equation_announcement
from ..functions.markup import clean_markup

DOC = ["doc_id"]
# Kinds of regions and sections.
SPOKEN_TYPES, SKIPPED_TYPES = ["heading", "paragraph"], ["frontmatter", "reference_list", "footnote", "code", "figure_caption", "equation_inline"]
READ_SECTIONS = ["body_chapter", "abstract", "acknowledgements", "dedication", "biographical_sketch"]
SKIP_SECTIONS = ["table_of_contents", "list_of_figures", "list_of_tables", "references", "appendix"]
SPOKEN_REGIONS = ["abstract", "biographical_sketch", "dedication", "epigraph", "acknowledgments", "preface_or_foreword", "chapter_body", "chapter_abstract"]
FRONT_REGIONS = ["title_page", "copyright_page", "table_of_contents", "list_of_tables", "list_of_figures", "list_of_abbreviations", "chapter_front_note"]
REFERENCE_REGIONS = ["per_chapter_bibliography", "bibliography", "appendix_bibliography"]
BACK_REGIONS = ["appendix", "supplementary_information", "glossary", "index", "colophon_or_vita"]
LABEL_TYPES = {"prose": "paragraph", "heading": "heading", "equation": "equation_display", "code": "code", "figure": "figure_caption", "table": "table", "reference": "reference_list", "frontmatter": "frontmatter"}
SIGNPOST = "A note for the listener: this thesis refers to appendix material, which is not included in the audiobook. You can find it in the full written text."


def by_doc(*upto) -> Window:
    w = Window.partitionBy("doc_id").orderBy("pos")
    return w.rowsBetween(*upto) if upto else w


SO_FAR = (Window.unboundedPreceding, 0)


def line_blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks, one a line with text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")
    return lines.select("doc_id", "pos", F.concat(F.lit("b"), F.col("pos") + 1).alias("block_id"), "text", T.classify_block(F.col("text")).alias("type"))


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Detached accents, markup, ligatures, line ends, split tokens and loops; adds removed, the words that loops lost."""
    steps = [T.fix_mojibake, clean_markup, T.normalize_ligatures, T.dehyphenate, T.rejoin_split_tokens]
    cleaned = T.collapse_repetition(F.col("text"))
    return T.apply_steps(blocks, "text", steps).withColumn("_c", cleaned).withColumn("text", F.col("_c.text")).withColumn("removed", F.col("_c.removed")).drop("_c")


def detect_running_artifacts(blocks: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, line, n): lines of 1-60 characters that come up `least` times or more in a document."""
    line = F.trim("text")
    return blocks.where((F.length(line) > 0) & (F.length(line) <= 60)).groupBy("doc_id", line.alias("line")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def strip_artifacts(blocks: DataFrame) -> DataFrame:
    """Page numbers and running lines go."""
    running = detect_running_artifacts(blocks).select("doc_id", "line")
    left = blocks.where(~T.looks_like_page_number(F.trim("text"))).withColumn("line", F.trim("text"))
    return left.join(running, ["doc_id", "line"], "left_anti").drop("line")


def merge_title_spillovers(blocks: DataFrame) -> DataFrame:
    """Wrapped title lines are folded into the heading before them, in chains."""
    spill = (F.col("type") == "paragraph") & T.is_title_spillover(F.col("text"))
    marked = blocks.withColumn("_spill", spill)
    before = F.last(F.when(~F.col("_spill"), F.col("type")), ignorenulls=True).over(by_doc(*SO_FAR))
    marked = marked.withColumn("_joined", F.col("_spill") & F.coalesce(before == "heading", F.lit(False)))
    marked = marked.withColumn("_island", F.sum((~F.col("_joined")).cast("int")).over(by_doc(*SO_FAR)))
    island = Window.partitionBy("doc_id", "_island")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text")).over(island)), lambda x: x["text"])
    merged = F.when(F.count(F.lit(1)).over(island) > 1, F.trim(F.array_join(texts, " "))).otherwise(F.col("text"))
    return marked.withColumn("text", merged).where(~F.col("_joined")).drop("_spill", "_joined", "_island")


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """Unterminated paragraphs take in the one that continues them, past figures and tables.

    A paragraph joins the one before it (with no other kind of block between) by what stands between them:

    nothing   if that one ends in a hyphen or without a full stop
    figures   if that one ends without a full stop and this one begins in lower case

    "Figures" holds on through a chain of joins, so it is a recurrence: set where a figure stands, kept while the
    second rule holds. Both are running maxima, so windows of one exchange do it without a fold.
    """
    paragraph = F.col("type") == "paragraph"
    figure = F.col("type").isin("figure_caption", "table")
    so_far = by_doc(*SO_FAR)
    rows = blocks.withColumn("_wall", F.sum((~paragraph & ~figure).cast("int")).over(so_far)).withColumn("_figures", F.sum(figure.cast("int")).over(so_far))
    rows = rows.withColumn("_para", paragraph)
    line = Window.partitionBy("doc_id", "_para").orderBy("pos")
    before = F.lag(F.struct("_wall", "_figures", T.ends_hyphenated(F.col("text")).alias("hyphen"), T.ends_sentence(F.col("text")).alias("ended"))).over(line)
    rows = rows.withColumn("_before", F.when(F.col("_para"), before))
    met = F.col("_para") & F.coalesce(F.col("_before._wall") == F.col("_wall"), F.lit(False))
    low = F.substring("text", 1, 1).rlike(r"\p{Ll}")
    rows = rows.withColumn("_near", met & (F.col("_before.hyphen") | ~F.col("_before.ended"))).withColumn("_far", met & ~F.col("_before.ended") & low)
    apart = met & (F.col("_before._figures") < F.col("_figures"))
    # chained figures: the latest row with figures before it is not earlier than the latest that ends such a chain
    upto = line.rowsBetween(*SO_FAR)
    set_, reset = F.max(F.when(F.col("_far") & apart, F.col("pos"))).over(upto), F.max(F.when(~F.col("_far"), F.col("pos"))).over(upto)
    rows = rows.withColumn("_kept", F.col("_far") & F.coalesce(set_ > F.coalesce(reset, F.lit(-1)), F.lit(False)))
    figures = apart | (met & F.coalesce(F.lag("_kept").over(line), F.lit(False)))
    rows = rows.withColumn("_apart", figures).withColumn("_joins", F.when(F.col("_apart"), F.col("_far")).otherwise(F.col("_near")))
    rows = rows.withColumn("_chain", F.when(F.col("_para"), F.sum((~F.col("_joins")).cast("int")).over(upto)))
    # each piece gives up its end to the next one, and its leading space to the one before
    hyphen = lambda flag, apart: flag & ~apart
    own = T.ends_hyphenated(F.col("text"))
    after = F.lead(F.struct("_joins", "_apart")).over(line)
    rows = rows.withColumn("_after", F.when(F.col("_para") & after["_joins"], after))
    bare = F.regexp_replace("text", r"\s+$", "")
    end = F.when(F.col("_after").isNull(), F.col("text")).when(hyphen(own, F.col("_after._apart")) & ~T.keeps_hyphen(F.col("text")), F.expr("left(_bare, length(_bare) - 1)")).otherwise(F.col("_bare"))
    spaced = F.col("_joins") & ~hyphen(F.col("_before.hyphen"), F.col("_apart"))
    rows = rows.withColumn("_bare", bare).withColumn("_piece", end)
    rows = rows.withColumn("_piece", F.when(spaced, F.concat(F.lit(" "), F.regexp_replace("_piece", r"^\s+", ""))).otherwise(F.col("_piece")))
    chain = Window.partitionBy("doc_id", "_para", "_chain")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_piece")).over(chain)), lambda x: x["_piece"]), "")
    rows = rows.withColumn("_whole", F.when(F.col("_para") & (F.count(F.lit(1)).over(chain) > 1), whole).otherwise(F.col("text")))
    return rows.where(~F.col("_joins")).withColumn("text", F.col("_whole")).select(*blocks.columns)


def attach_sections(blocks: DataFrame) -> DataFrame:
    """Blocks without a section take that of the latest heading, which may be null."""
    latest = F.last(F.when(F.col("type") == "heading", F.struct("section")), ignorenulls=True).over(by_doc(*SO_FAR))
    return blocks.withColumn("section", F.when(F.col("type") == "heading", F.col("section")).otherwise(F.coalesce("section", latest["section"])))


def tag_references(blocks: DataFrame) -> DataFrame:
    """From a references title or entry to the next other heading, blocks are back matter."""
    title = F.lower(F.trim("text")).isin("references", "bibliography")
    event = F.when((F.col("type") == "heading") & ~title, F.lit(False)).when(title | (F.col("type") == "reference_list"), F.lit(True))
    on = F.coalesce(F.last(event, ignorenulls=True).over(by_doc(*SO_FAR)), F.lit(False))
    return blocks.withColumn("type", F.when(on, "backmatter").otherwise(F.col("type")))


def empty_section_warnings(blocks: DataFrame) -> DataFrame:
    """Numbered headings that another heading or the end follows."""
    after = F.lead("type").over(by_doc())
    marked = blocks.withColumn("_next", after).where((F.col("type") == "heading") & F.col("section").isNotNull() & (F.col("_next").isNull() | (F.col("_next") == "heading")))
    return marked.select("doc_id", "block_id", F.format_string("section heading has no body text: '%s'", F.col("text")).alias("reason"), F.lit(0.5).alias("score"))


def build_ir(blocks: DataFrame) -> DataFrame:
    """Raw blocks(doc_id, pos, block_id, type, section, text) to clean ones."""
    kept = strip_artifacts(clean_blocks(blocks))
    typed = kept.withColumn("type", F.when(F.col("type") == "paragraph", T.classify_block(F.col("text"))).otherwise(F.col("type")))
    return tag_references(attach_sections(merge_continuations(merge_title_spillovers(typed))))


def select_policy(blocks: DataFrame, table_handling: str = "summarize", include_appendices: bool = False) -> DataFrame:
    """keep and handling by type and profile."""
    kind = F.col("type")
    keep = F.when(kind.isin(*SPOKEN_TYPES, "table", "equation_display"), True).when(kind == "backmatter", include_appendices).otherwise(False)
    handling = (
        F.when(kind.isin(SPOKEN_TYPES), "speak")
        .when(kind == "table", "summarize" if table_handling == "summarize" else "skip")
        .when(kind == "equation_display", "announce")
        .when(kind == "backmatter", "speak" if include_appendices else "skip")
        .otherwise("skip")
    )
    return blocks.withColumn("keep", keep).withColumn("handling", handling)


def announce_equations(blocks: DataFrame) -> DataFrame:
    """Display equations are spoken by number; those without one are dropped."""
    said = equation_announcement(F.coalesce("latex", "text"))
    display = F.col("type") == "equation_display"
    return blocks.withColumn("spoken", F.when(display, said).otherwise(F.col("spoken"))).withColumn("keep", F.when(display, F.col("keep") & said.isNotNull()).otherwise(F.col("keep")))


def apply_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(doc_id, block_id, kind, n): of a block's known kinds the last by n sets its type; adds from_type where it changed."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in LABEL_TYPES.items() for x in kv]), F.lower(F.trim("kind")))
    last = labels.withColumn("to", known).where("to is not null").groupBy("doc_id", "block_id").agg(F.max_by("to", "n").alias("to"))
    met = blocks.join(last, ["doc_id", "block_id"], "left")
    changed = F.col("to").isNotNull() & (F.col("to") != F.col("type"))
    return met.withColumn("from_type", F.when(changed, F.col("type"))).withColumn("type", F.coalesce("to", "type")).drop("to")


def apply_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """regions(doc_id, first_pos, last_pos, kind, chapter, n): each block takes the first region by n that covers it.

    An interval join with an equality on doc_id; inverted spans cover nothing.
    """
    spans = regions.where("first_pos <= last_pos").withColumnRenamed("doc_id", "_doc")
    met = blocks.select("doc_id", "pos").join(spans, (F.col("doc_id") == F.col("_doc")) & F.col("pos").between(F.col("first_pos"), F.col("last_pos")))
    first = met.groupBy("doc_id", "pos").agg(F.min_by(F.struct("kind", F.col("chapter").alias("region_chapter")), "n").alias("r"))
    return blocks.join(first.select("doc_id", "pos", F.col("r.kind").alias("region_kind"), "r.region_chapter"), ["doc_id", "pos"], "left")


def disjoint_regions(regions: DataFrame) -> DataFrame:
    """regions(doc_id, n, first_pos, last_pos, kind, chapter) by first position, without those that begin in one that stays; a fold over a document's few."""
    entry = F.struct("first_pos", "n", "last_pos", "kind", "chapter")
    rows = regions.where("first_pos <= last_pos").groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    start = F.struct(F.lit(-1).cast("int").alias("upto"), F.filter("rows", lambda r: F.lit(False)).alias("kept"))

    def step(a: Column, r: Column) -> Column:
        free = r["first_pos"] > a["upto"]
        return F.struct(F.when(free, r["last_pos"]).otherwise(a["upto"]).cast("int").alias("upto"), F.when(free, F.concat(a["kept"], F.array(r))).otherwise(a["kept"]).alias("kept"))

    return rows.select("doc_id", F.inline(F.aggregate("rows", start, step, lambda a: a["kept"])))


def effective_decision(kind: Column, include_appendices: bool) -> Column:
    """What a region's kind and the profile make of it."""
    return F.when(kind.isin(SPOKEN_REGIONS), "include").when(kind.isin(BACK_REGIONS), "include" if include_appendices else "skip").when(kind == "unknown", "review").otherwise("skip")


def section_decision(kind: Column) -> Column:
    kind = F.lower(F.trim(kind))
    return F.when(kind.isin(READ_SECTIONS), "read").when(kind.isin(SKIP_SECTIONS), "skip").otherwise("review")


def retype_regions(blocks: DataFrame) -> DataFrame:
    """blocks after apply_regions: buried prose of spoken regions is typed from its text, prose of others by region; chapters are filled in."""
    kind, now = F.col("region_kind"), F.col("type")
    prose = now.isin(SPOKEN_TYPES)
    new = (
        F.when(kind.isin(SPOKEN_REGIONS) & now.isin("frontmatter", "backmatter"), T.classify_block(F.col("text")))
        .when(kind.isin(FRONT_REGIONS) & prose, "frontmatter")
        .when(kind.isin(REFERENCE_REGIONS) & prose, "reference_list")
        .when(kind.isin(BACK_REGIONS) & prose, "backmatter")
        .when((kind == "footnotes") & prose, "footnote")
        .otherwise(now)
    )
    return blocks.withColumn("type", new).withColumn("chapter", F.coalesce("region_chapter", "chapter"))


def map_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """blocks with decision, section_kind, section_chapter and section_head from sections(doc_id, pos, title, kind).

    Headings use up sections with their title from left to right, each once; a decision holds until the next
    match, and before the first it is review. Each match depends on the one before: a fold over a document's
    headings, by array lookups.
    """
    body = (F.lower(F.trim("kind")) == "body_chapter").cast("int")
    listed = sections.withColumn("chapter", F.when(body == 1, F.sum(body).over(by_doc(*SO_FAR)))).withColumn("key", T.heading_key(F.col("title"))).where("key <> ''")
    entry = F.struct("pos", "key", "kind", section_decision(F.col("kind")).alias("decision"), F.col("chapter").cast("int").alias("chapter"))
    plan = listed.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("plan")).withColumn("keys", F.transform("plan", lambda x: x["key"]))
    heads = blocks.where("type = 'heading'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", T.heading_key(F.col("text")).alias("key")))).alias("heads")).join(plan, "doc_id")
    # used: sections gone by; found: (heading, section) pairs
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pos:int,at:long>>").alias("found"))

    def step(a: Column, h: Column) -> Column:
        k = F.array_position(F.slice("keys", (a["used"] + 1).cast("int"), F.size("keys")), h["key"])
        pair = F.struct(h["pos"].cast("int").alias("pos"), (a["used"] + k).alias("at"))
        return F.struct((a["used"] + k).alias("used"), F.when(k > 0, F.concat(a["found"], F.array(pair))).otherwise(a["found"]).alias("found"))

    found = heads.select("doc_id", "plan", F.explode(F.aggregate("heads", start, step, lambda a: a["found"])).alias("f"))
    found = found.select("doc_id", F.col("f.pos").alias("pos"), F.element_at("plan", F.col("f.at").cast("int")).alias("s")).select("doc_id", "pos", "s.decision", "s.kind", "s.chapter")
    met = blocks.join(found.select("doc_id", "pos", F.struct("decision", "kind", F.col("chapter").cast("int").alias("chapter")).alias("_s")), ["doc_id", "pos"], "left")
    now = F.last("_s", ignorenulls=True).over(by_doc(*SO_FAR))
    met = met.withColumn("section_head", F.col("_s").isNotNull()).withColumn("_now", now)
    return met.select("*", F.coalesce("_now.decision", F.lit("review")).alias("decision"), F.coalesce("_now.kind", F.lit("unmapped")).alias("section_kind"), F.col("_now.chapter").alias("section_chapter")).drop("_s", "_now")


def merge_section_maps(sections: DataFrame) -> DataFrame:
    """sections(doc_id, batch, n, number, title, start_page, kind): the first of each number or title, by start page."""
    key = F.coalesce(F.nullif(F.upper(F.trim("number")), F.lit("")), F.lower(F.trim("title")))
    first = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("batch", "n"))
    kept = sections.withColumn("_r", first).where("_r = 1").drop("_r")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("start_page").asc_nulls_last(), "batch", "n")))


def apply_signposts(blocks: DataFrame) -> DataFrame:
    """The first kept spoken block of each chapter that names an appendix says where to find it."""
    said = F.coalesce("spoken", "text")
    hit = F.col("keep") & (F.col("handling") == "speak") & F.col("chapter").isNotNull() & said.rlike(r"\bAppendi(?:x|ces) [A-Z]\b")
    first = F.row_number().over(Window.partitionBy("doc_id", "chapter", hit).orderBy("pos"))
    return blocks.withColumn("spoken", F.when(hit & (first == 1), F.concat(said, F.lit(" " + SIGNPOST))).otherwise(F.col("spoken")))


def assign_pages(blocks: DataFrame, pages: DataFrame, share: float = 0.5, least: int = 4, opening: int = 25) -> DataFrame:
    """(doc_id, pos, page): the first page(doc_id, page, text) with `share` of the distinct opening words of a block."""
    words = lambda t: F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= least)
    own = blocks.select("doc_id", "pos", F.array_distinct(F.slice(words(F.col("text")), 1, opening)).alias("w")).where(F.size("w") >= least)
    own = own.select("doc_id", "pos", F.size("w").alias("n"), F.explode("w").alias("word"))
    there = pages.select("doc_id", "page", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    hits = own.join(there, ["doc_id", "word"]).groupBy("doc_id", "pos", "page").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"))
    return hits.where(F.col("hits") >= share * F.col("n")).groupBy("doc_id", "pos").agg(F.min("page").alias("page"))


def fingerprint(blocks: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): SHA-256 over the ordered ids, types and texts."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("\t", "block_id", "type", text).alias("line"))))
    return blocks.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("fingerprint"))


def type_histogram(blocks: DataFrame) -> DataFrame:
    """(doc_id, histogram): type x count, by name."""
    n = blocks.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("type", "n")))
    return n.groupBy("doc_id").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["type"], F.lit("x"), e["n"])), ",").alias("histogram"))
