"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, chat, jaccard, mixing, packing, quality, secrets, token_store, topk, warc
from .common import Scratch, n_words, table, text_of
from .encoding import tokenizer_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
PROBE = r"\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    scratch = Scratch(spark, "chat")
    messages = scratch.save(chat.linear_threads(rows), "messages")
    out = chat.format_paths(chat.reply_paths(spark, messages, scratch, branches=1), messages)
    back = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.substring_index("path", ":", 1).try_cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledger runs, as documents come in: English ones, then all others, whose copies of known blobs aren't scanned again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", F.col("lang").eqNullSafe("en").alias("early"))
    path = secrets.update_ledger(spark, docs.where("early"), None)
    secrets.update_ledger(spark, docs.where("not early"), path)
    found = secrets.findings(docs, secrets.read_ledger(spark, path))
    base = [r.name for r in secrets.RULES]
    count = lambda name: F.size(F.filter("spans", lambda s: s["rule"] == name)).cast("long")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")
    return found.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def sized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(id, source, size, quality) and a row number if there is one: words, and the labelled quality as a weight (good 2, bad 0.5, unknown 1)."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).withColumnRenamed("doc_id", "_id")
    number = [c for c in docs.columns if c == "_row"]
    own = docs.select(F.col("doc_id").alias("id"), "source", n_words(text_of()).alias("size"), *number)
    weight = F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0)
    return own.join(labels, F.col("id") == F.col("_id"), "left").select("id", "source", "size", weight.alias("quality"), *number)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Scratch(spark, "mixing").save(sized(spark, table(spark, sf_dir, "documents"), sf_dir), "sized")
    return mixing.mix(own).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(spark, docs, Scratch(spark, "jaccard"), words=3, percent=90)


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.read_digests(token_store.write_shards(docs, Scratch(spark, "token-store"), tokenizer_path(BYTE_BPE), _parts(spark)))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs).drop("text", "clean_text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(spark, docs, Scratch(spark, "packing"), tokenizer_path(WORD_BPE))


def op9_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return attribution.token_counts(docs, tokenizer_path(BYTE_BPE), ["source", "lang", "text"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return warc.read_archive(warc.archive(pages, Scratch(spark, "warc"))).drop("url")


QUERIES = {f.__name__: f for f in (op1_chat, op2_secrets, op3_mixing, op4_jaccard, op5_token_store, op6_topk, op7_quality, op8_packing, op9_attribution, op10_warc)}

_ESC = "replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '###', '\\h')"
_OP1 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.HEAD + chat.SEP + chat.END)} + length(replace({_ESC.format('role')}, ':', '\\c')) + length({_ESC.format('t')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_OP3 = f"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1),
d AS (SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CASE WHEN q = 1 THEN 2.0::DOUBLE WHEN q = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents d LEFT JOIN l USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([{', '.join(map(str, mixing.WEIGHTS))}])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INT) + 1] AS w FROM d GROUP BY 1),
c AS (SELECT *, source_size * {mixing.MAX_EPOCHS} AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left, sum(source_size) OVER () AS total FROM c),
v AS (SELECT *, (total::DOUBLE * {mixing.EPOCHS}::DOUBLE - filled::DOUBLE) / w_left::DOUBLE AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((max(level) FILTER (cap / w >= level) OVER ()) * w, cap::DOUBLE)) AS target FROM v),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS whole,
  -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / d.w AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p),
k AS (SELECT *, upto <= rest AND size > 0 AS pick FROM r),
g AS (SELECT *, rest - sum(CASE WHEN pick THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM k),
b AS (SELECT source, min(row(abs(gap - size), key, doc_id)) AS last FROM g WHERE NOT pick AND size > 0 AND abs(gap - size) < gap GROUP BY 1)
SELECT g.doc_id, g.source, g.size, g.source_size, g.target, CAST((whole + CASE WHEN pick OR row(abs(gap - size), key, g.doc_id) IS NOT DISTINCT FROM b.last THEN 1 ELSE 0 END) * g.size AS BIGINT) AS taken
FROM g LEFT JOIN b ON g.source IS NOT DISTINCT FROM b.source"""

_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_W = "'[^\\x20\\x09-\\x0D]+'"
_OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_W}) AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
f AS (SELECT doc_id, x, CAST(len(regexp_extract_all(x, {_W})) AS BIGINT) AS words, len(regexp_extract_all(x, '[#*$%&|<>»·•]')) AS marks,
  len(list_filter(regexp_split_to_array(x, '[\\s\\x0B]+'), lambda y: y IN ('|', '>', '»', '·', '•'))) AS bars FROM l WHERE regexp_matches(x, {_W})),
j AS (SELECT *, (marks >= 3 AND marks * 4 >= words AND bars >= 3 AND bars * 4 >= words) OR len(regexp_extract_all(x, '[#*$%&|<>]')) * 3 >= words * 2
  OR (words >= 4 AND upper(x) = x AND lower(x) <> x) OR (words <= 25 AND regexp_matches(lower(x), '{quality.BOILERPLATE}'))
  OR (words <= 3 AND NOT regexp_matches(x, '[.!?…:;"''”’»)\\]。！？]\\s*$')) AS bad FROM f),
k AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup, CAST(coalesce(sum(words) FILTER (bad), 0) AS BIGINT) AS lost FROM j GROUP BY 1),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(k.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(k.lost, 0) AS lost_words FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words) AND 100 * lost_words <= {quality.MAX_LOST_PCT} * n_words AS kept FROM a"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // {0}) % 32 + 1, 1)"
_OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
x AS (SELECT page_id, CAST(('0x' || substr(s, 5 * i + 1, 5)) AS BIGINT) AS x, i FROM p, (SELECT unnest(range(8)) AS i)),
b AS (SELECT page_id, string_agg({' || '.join(_DIGIT.format(32**k) for k in (3, 2, 1, 0))}, '' ORDER BY i) AS payload_digest FROM x GROUP BY 1),
m AS (SELECT s, max(page_id) AS best FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN m USING (s) JOIN b USING (page_id)"""
#: The rest needs offsets in code points, tokenizer files, compression or components of a similarity graph.
ORACLES: dict[str, str] = {"op1_chat": _OP1, "op3_mixing": _OP3, "op6_topk": _OP6, "op7_quality": _OP7, "op10_warc": _OP10}
