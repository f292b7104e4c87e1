"""Registered queries of the narration engine, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, markup, numbers, speak, verify
from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import scores as S
from ..plans import pipeline
from ..sources import cache, documents

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.line_blocks(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


#: Lines of documents as typed blocks, in SQL.
LINES = r"""lines AS (
  SELECT doc_id, pos, 'b' || (pos + 1) AS block_id, text,
    CASE WHEN regexp_matches(trim(text), '^\s*[-*•]?\s*\[(\d+)\]\s') THEN 'reference_list'
      WHEN regexp_matches(trim(text), '(?i)^\s*(?:Figure|Fig\.?|Table|Scheme)\s+(?:[A-Z]\.)?\d+(?:\.\d+)*\s*:') THEN 'figure_caption'
      WHEN regexp_matches(trim(text), '(?i)^\s*CHAPTER\s+(\d+)\s*$') OR regexp_matches(trim(text), '^\s*(\d+(?:\.\d+)+)\s+(.*\S)\s*$') THEN 'heading'
      ELSE 'paragraph' END AS type
  FROM (SELECT doc_id, unnest(l) AS text, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
  WHERE trim(text) <> '')"""


@query(f"WITH {LINES} SELECT doc_id, pos, block_id, type, length(text) AS n FROM lines")
def block_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", "block_id", "type", F.length("text").cast("long").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, trim(text) AS line, count(*) AS n FROM lines WHERE length(trim(text)) BETWEEN 1 AND 60 GROUP BY 1, 2 HAVING count(*) >= 3")
def running_artifacts(spark, sf_dir):
    return B.detect_running_artifacts(lines(spark, sf_dir))


@query(f"""WITH {LINES}, run AS (SELECT doc_id, trim(text) AS line FROM lines WHERE length(trim(text)) BETWEEN 1 AND 60 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines l WHERE NOT regexp_matches(trim(text), '^\\s*\\d{{1,4}}\\s*$')
AND NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = l.doc_id AND r.line = trim(l.text)) GROUP BY 1""")
def artifacts_stripped(spark, sf_dir):
    return B.strip_artifacts(lines(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""WITH {LINES} SELECT doc_id, sha256(string_agg(block_id || chr(9) || type || chr(9) || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY pos)) AS fingerprint FROM lines GROUP BY 1""")
def document_fingerprint(spark, sf_dir):
    return B.fingerprint(lines(spark, sf_dir))


@query(f"WITH {LINES}, n AS (SELECT doc_id, type, count(*) AS n FROM lines GROUP BY 1, 2) SELECT doc_id, string_agg(type || 'x' || n, ',' ORDER BY type) AS histogram FROM n GROUP BY 1")
def type_histogram(spark, sf_dir):
    return B.type_histogram(lines(spark, sf_dir))


@query(f"""WITH {LINES} SELECT type, type IN ('heading', 'paragraph', 'table', 'equation_display') AS keep,
CASE WHEN type IN ('heading', 'paragraph') THEN 'speak' WHEN type = 'table' THEN 'summarize' WHEN type = 'equation_display' THEN 'announce' ELSE 'skip' END AS handling, count(*) AS n FROM lines GROUP BY ALL""")
def select_policy(spark, sf_dir):
    return B.select_policy(lines(spark, sf_dir)).groupBy("type", "keep", "handling").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'code' ELSE 'heading' END AS kind FROM labels),
d AS (SELECT doc_id, kind FROM k GROUP BY ALL)
SELECT l.doc_id, l.pos, CASE WHEN l.pos = 0 AND d.kind IS NOT NULL THEN d.kind ELSE l.type END AS type,
CASE WHEN l.pos = 0 AND d.kind IS NOT NULL AND d.kind <> l.type THEN l.type END AS from_type FROM lines l LEFT JOIN d USING (doc_id)""")
def labels_applied(spark, sf_dir):
    kind = F.when(F.col("quality") == 0, " Code").otherwise("heading")
    given = table(spark, sf_dir, "labels").select("doc_id", F.lit("b1").alias("block_id"), kind.alias("kind"), F.lit(1).alias("n"))
    return B.apply_labels(lines(spark, sf_dir), given).select("doc_id", "pos", "type", "from_type")


REGIONS = "SELECT doc_id, 1 AS first_pos, 3 AS last_pos, 'chapter_body' AS kind, 1 AS chapter, 2 AS n FROM documents UNION ALL SELECT doc_id, 3, 5, 'appendix', NULL, 1 FROM documents UNION ALL SELECT doc_id, 9, 2, 'unknown', 7, 0 FROM documents"


@query(f"""WITH {LINES}, r AS ({REGIONS}) SELECT l.doc_id, l.pos,
(SELECT min_by(kind, n) FROM r WHERE r.doc_id = l.doc_id AND l.pos BETWEEN first_pos AND last_pos) AS region_kind,
CASE WHEN l.pos BETWEEN 1 AND 2 THEN 1 END AS region_chapter FROM lines l""")
def regions_applied(spark, sf_dir):
    spans = F.array(*[F.struct(F.lit(a).alias("first_pos"), F.lit(b).alias("last_pos"), F.lit(k).alias("kind"), F.lit(c).cast("int").alias("chapter"), F.lit(n).alias("n")) for a, b, k, c, n in ((1, 3, "chapter_body", 1, 2), (3, 5, "appendix", None, 1), (9, 2, "unknown", 7, 0))])
    regions = table(spark, sf_dir, "documents").select("doc_id", F.inline(spans))
    return B.apply_regions(lines(spark, sf_dir), regions).select("doc_id", "pos", "region_kind", "region_chapter")


@query("""SELECT conv_id AS doc_id, turn AS pos, CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) ELSE (SELECT CAST(max(u.turn) AS VARCHAR) FROM conversations u WHERE u.conv_id = c.conv_id AND u.turn < c.turn AND u.role = 'user') END AS section FROM conversations c""")
def sections_attached(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("type"), F.when(F.col("role") == "user", F.col("turn").cast("string")).alias("section"))
    return B.attach_sections(rows).select("doc_id", "pos", "section")


def spoken_turns(spark, sf_dir):
    chapter = F.when(F.col("role") == "user", F.col("turn").cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), F.concat(F.lit("chunk."), "turn").alias("chunk_id"), chapter.alias("chapter"), F.coalesce("text", F.lit("")).alias("text"))


RESOLVED = """r AS (SELECT conv_id AS doc_id, turn AS chunk_no, coalesce(
  (SELECT max(u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.turn <= c.turn AND u.role = 'user'),
  (SELECT min(u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user')) AS chapter FROM conversations c)"""


@query(f"""WITH {RESOLVED}, s AS (SELECT *, CASE WHEN lag(chunk_no) OVER w IS NULL OR chapter IS DISTINCT FROM lag(chapter) OVER w THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS BIGINT) AS index FROM s)
SELECT doc_id, index, CAST(min(chapter) AS INT) AS chapter, min(chunk_no) AS first_chunk, max(chunk_no) AS last_chunk, count(*) AS n FROM i GROUP BY 1, 2""")
def chapter_islands(spark, sf_dir):
    return C.chapter_islands(spoken_turns(spark, sf_dir))


def timeline(spark, sf_dir):
    seconds = (F.length("text") / 15.0).cast("decimal(18,6)")
    return C.build_provenance(spoken_turns(spark, sf_dir).select("doc_id", "chunk_no", seconds.alias("seconds")))


TIMES = """t AS (SELECT conv_id AS doc_id, turn AS chunk_no, CAST(round(CAST(length(coalesce(text, '')) / 15.0 AS DECIMAL(18,6)), 3) AS DECIMAL(18,3)) AS d FROM conversations),
p AS (SELECT doc_id, chunk_no, sum(d) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS e, d FROM t)"""


@query(f"WITH {TIMES} SELECT doc_id, chunk_no, CAST(e - d AS DOUBLE) AS start_seconds, CAST(e AS DOUBLE) AS end_seconds FROM p")
def provenance_timeline(spark, sf_dir):
    return timeline(spark, sf_dir).select("doc_id", "chunk_no", F.col("start_seconds").cast("double").alias("start_seconds"), F.col("end_seconds").cast("double").alias("end_seconds"))


@query(f"""WITH {TIMES}, q AS (SELECT DISTINCT conv_id AS doc_id, unnest([0, 10, 60, 600]) AS at FROM conversations)
SELECT q.doc_id, q.at, p.chunk_no FROM q LEFT JOIN p ON p.doc_id = q.doc_id AND p.e - p.d <= q.at AND q.at < p.e""")
def blocks_at_time(spark, sf_dir):
    points = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("at", F.explode(F.array(*[F.lit(x) for x in (0, 10, 60, 600)])))
    return C.blocks_at(timeline(spark, sf_dir), points).select("doc_id", "at", "chunk_no")


@query()
def chunk_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    segments = docs.select("doc_id", F.posexplode(T.segment(F.coalesce("text", F.lit("")))).alias("pos", "text")).select("doc_id", "pos", "text", F.concat(F.lit("s"), "pos").alias("block_id"), F.lit(1).alias("chapter"))
    return C.plan_chunks(segments).select("doc_id", "chunk_no", "chunk_id", F.sha2("text", 256).alias("text_sha"), F.length("text").alias("n"), F.size("block_ids").alias("blocks"), "prev_id", "next_id")


@query("SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS characters, round(sum(length(text)) * 0.00003, 4) AS usd FROM documents WHERE length(text) > 0 GROUP BY 1")
def render_cost(spark, sf_dir):
    return C.estimate_cost(table(spark, sf_dir, "documents").where(F.length("text") > 0))


ONES = "['" + "','".join(numbers.ONES) + "']"
TENS = "['" + "','".join(numbers.TENS) + "']"


def sql_hundred(n: str) -> str:
    return f"(CASE WHEN {n} < 20 THEN {ONES}[CAST({n} AS INT) + 1] ELSE {TENS}[CAST({n} // 10 AS INT) + 1] || CASE WHEN {n} % 10 = 0 THEN '' ELSE '-' || {ONES}[CAST({n} % 10 AS INT) + 1] END END)"


def sql_thousand(n: str) -> str:
    return f"concat_ws(' ', CASE WHEN {n} >= 100 THEN {ONES}[CAST({n} // 100 AS INT) + 1] || ' hundred' END, CASE WHEN {n} % 100 <> 0 THEN {sql_hundred(f'({n} % 100)')} END)"


def sql_words(n: str) -> str:
    parts = [f"CASE WHEN {n} >= 1000000 THEN {sql_thousand(f'({n} // 1000000)')} || ' million' END", f"CASE WHEN {n} % 1000000 >= 1000 THEN {sql_thousand(f'({n} % 1000000 // 1000)')} || ' thousand' END", f"CASE WHEN {n} % 1000 <> 0 THEN {sql_thousand(f'({n} % 1000)')} END"]
    return f"(CASE WHEN {n} = 0 THEN 'zero' ELSE concat_ws(' ', {', '.join(parts)}) END)"


@query(f"SELECT o_orderkey, {sql_words('o_orderkey')} AS words FROM orders")
def integer_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.int_to_words(F.col("o_orderkey")).alias("words"))


@query(f"""WITH c AS (SELECT c_custkey, c_acctbal < 0 AS neg, CAST(floor(abs(CAST(c_acctbal AS DECIMAL(18,2)))) AS BIGINT) AS w, CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) * 100 AS BIGINT) % 100 AS f FROM customer)
SELECT c_custkey, CASE WHEN neg THEN 'minus ' ELSE '' END || {sql_words('w')} || ' point ' || {ONES}[CAST(f // 10 AS INT) + 1] || ' ' || {ONES}[CAST(f % 10 AS INT) + 1] AS words FROM c""")
def decimal_words(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.number_to_words(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("words"))


@query(f"""WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(y AS INT) AS year, n,
CASE WHEN y % 1000 = 0 THEN {sql_words('y')} WHEN y % 100 = 0 THEN {sql_hundred('(y // 100)')} || ' hundred' WHEN y BETWEEN 2000 AND 2009 THEN 'two thousand ' || {ONES}[CAST(y % 100 AS INT) + 1]
ELSE {sql_hundred('(y // 100)')} || ' ' || CASE WHEN y % 100 < 10 THEN 'oh ' || {ONES}[CAST(y % 10 AS INT) + 1] ELSE {sql_hundred('(y % 100)')} END END AS words FROM y""")
def year_words(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return years.withColumn("words", numbers.year_to_words(F.col("year")))


@query(f"SELECT l_quantity, count(*) AS n, {sql_words('CAST(l_quantity AS BIGINT)')} || ' point ' || {sql_words('l_linenumber')} AS words FROM lineitem GROUP BY l_quantity, l_linenumber")
def section_words(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_quantity", "n", numbers.section_to_words(F.concat_ws(".", F.col("l_quantity").cast("long"), "l_linenumber")).alias("words"))


@query(r"""SELECT p_partkey, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM part)""")
def part_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


def sql_list(words) -> str:
    return "['" + "','".join(sorted(set(words))) + "']"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(w, lambda x: list_contains({sql_list(verify.NEGATIONS + verify.SCOPE)}, x))) AS INT) AS polarity, CAST(len(list_filter(w, lambda x: list_contains({sql_list(verify.DIRECTION)}, x))) AS INT) AS direction,
CAST(len(list_filter(w, lambda x: list_contains({sql_list(verify.VALUES)}, x))) AS INT) AS value_words, CAST(len(list_filter(w, lambda x: NOT list_contains({sql_list(verify.FUNCTION + verify.NEGATIONS + verify.SCOPE + verify.VALUES + verify.DIRECTION)}, x))) AS INT) AS content FROM w""")
def word_classes(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    w = verify.words_of(t)
    return table(spark, sf_dir, "documents").select("doc_id", *[F.size(x).alias(k) for k, x in (("polarity", verify.only(w, verify.NEGATIONS + verify.SCOPE)), ("direction", verify.only(w, verify.DIRECTION)), ("value_words", verify.value_words(t)), ("content", verify.content_words(t)))])


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?i)</?(?:break|emphasis|prosody|say-as|phoneme|sub|voice|p|s)\b[^>]*>', ' ', 'g'), '[%±^_<>\[\]µμ−]')) AS ch FROM pages)
SELECT page_id, ch, CAST(count(*) AS INT) AS n FROM c GROUP BY 1, 2""")
def raw_token_leaks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.inline(S.leak_counts(F.col("html")))).withColumnRenamed("char", "ch")


@query("""SELECT quality, count(*) AS total, CASE WHEN count(*) = 0 THEN 'nothing was narrated' WHEN sum(toxic) > count(*) * 0.15
THEN sum(toxic) || '/' || count(*) || ' segments held or flagged for review (' || CAST(CAST(round(sum(toxic) * 100.0 / count(*), 0) AS INT) AS VARCHAR) || '%)' END AS reason FROM labels GROUP BY 1""")
def review_gate(spark, sf_dir):
    n = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("total"), F.sum("toxic").alias("held"))
    zero = F.lit(0).cast("long")
    return n.select("quality", "total", S.review_gate(F.col("held"), zero, F.col("total") - F.col("held"), zero).alias("reason"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS number, l_linestatus AS title, CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_quantity AS INT) END AS start_page FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN number = '' THEN lower(title) ELSE upper(number) END ORDER BY n, start_page NULLS FIRST) AS r FROM s)
SELECT doc_id, count(*) AS sections, count(start_page) AS paged FROM k WHERE r = 1 GROUP BY 1""")
def section_maps_merged(spark, sf_dir):
    page = F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("int"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("batch"), page.alias("n"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("number"), F.col("l_linestatus").alias("title"), page.alias("start_page"), F.lit("body_chapter").alias("kind"))
    return B.merge_section_maps(s).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.count("start_page").alias("paged"))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, pos, list_distinct(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4), 1, 25)) AS w FROM lines),
o AS (SELECT doc_id, pos, len(w) AS n, unnest(w) AS word FROM b WHERE len(w) >= 4), p AS (SELECT DISTINCT doc_id, pos // 4 AS page, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS word FROM lines),
h AS (SELECT o.doc_id, o.pos, p.page, count(*) AS hits, any_value(n) AS n FROM o JOIN p USING (doc_id, word) GROUP BY 1, 2, 3)
SELECT doc_id, pos, CAST(min(page) AS BIGINT) AS page FROM h WHERE hits >= 0.5 * n GROUP BY 1, 2""")
def pages_assigned(spark, sf_dir):
    rows = lines(spark, sf_dir)
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    pages = rows.groupBy("doc_id", F.floor(F.col("pos") / 4).alias("page")).agg(page.alias("text"))
    return B.assign_pages(rows, pages)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, 'normalize.' || sha256(coalesce(text, '') || chr(10) || coalesce(lang, '')) AS key FROM documents")
def cache_keys(spark, sf_dir):
    t = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", cache.cache_key("normalize.", t("text"), t("lang")).alias("key"))


@query()
def text_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", speak.normalize_all(F.coalesce("text", F.lit(""))).alias("spoken"))


@query()
def markup_stripped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.clean_markup(F.coalesce("html", F.lit(""))).alias("text"))


@query()
def citations_naturalized(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", citations.naturalize_citations(F.coalesce("html", F.lit(""))).alias("text"))


@query()
def verified_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"))
    pairs = docs.withColumn("spoken", speak.normalize_all(F.col("source")))
    out = pipeline.verified_pairs(pairs)
    return out.select("doc_id", "ok", F.array_join(F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["kind"]))), ",").alias("kinds"))


@query()
def script_chunks(spark, sf_dir):
    """The rule engine from raw blocks to chunks."""
    return pipeline.run_rules(lines(spark, sf_dir)).select("doc_id", "chunk_no", F.sha2("text", 256).alias("text_sha"), F.length("text").alias("n"), F.size("block_ids").alias("blocks"))


@query()
def markdown_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return documents.markdown_blocks(docs).select("doc_id", "pos", "block_id", "type", "section", F.length("text").alias("n"))


@query()
def page_text_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return documents.page_text_blocks(docs).select("doc_id", "pos", "block_id", "type", "page", F.length("text").alias("n"))
