"""Secret scans through an incremental blob ledger.

Every version of every path is a blob, addressed by the SHA-256 of its text (null: empty). The ledger is a
table of (blob, rule, version, spans): a run scans only blob and rule-version pairs it lacks, appends them,
and joins findings back to all paths. Copies, however many, are scanned once; a hot blob is one row there.
Rows with null paths and repeated rows get their blob's findings like any other. An empty table adds nothing. A text
is scanned whole, one at a time, so the longest bounds memory. Columns besides path and text are ignored.
Pairs that are in the ledger twice, as after two runs at a time, count once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, text_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group (0: all) has `least` characters or more."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False
    #: Lower-case strings of which a text that matches holds one; a cheap test before the pattern.
    hints: tuple[str, ...] = ()

    def scan(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0)).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: Kinds in the order in which spans that start together are listed.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, False, ("akia",)),
    # runs of 24 or more are the runs of [0-9a-f]+ that stay
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
SPANS = "array<struct<start:int,stop:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches):
        for b in batches:
            blobs, lists = b.column("blob"), b.column("rules").to_pylist()
            out: list[tuple] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                low = text.lower()
                for r in rules:
                    if r.name in lists[i]:
                        out.append((blobs[i].as_py(), r.name, r.version, [] if r.hints and not any(h in low for h in r.hints) else [{"start": s, "stop": e} for s, e in r.scan(text)]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), kind), strict=True)], names=["blob", "rule", "version", "spans"])

    return lean(scan)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for versions(path, text).

    One version stands for each blob: the least path that holds it. Only ids and digests are grouped; texts
    move once, to meet that small table, which is the build side of a hash join.
    """
    digests = versions.select("path", blob_of(text_of()).alias("blob"))
    todo = digests.groupBy("blob").agg(F.min("path").alias("path"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is not None:
        current = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        seen = ledger.where(F.array_contains(current, F.struct("rule", "version"))).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    else:
        todo = todo.withColumn("rules", names)
    todo = todo.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), "rules")
    texts = versions.select("path", text_of().alias("text"))
    met = texts.join(todo.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("_path")) & (blob_of(F.col("text")) == F.col("_blob")))
    found = met.select(F.col("_blob").alias("blob"), "rules", "text").mapInArrow(_scanner(rules), LEDGER)
    # a path may hold a blob twice
    return found.groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) for every version; spans: array<struct<start, rank, stop, rule>> by start, then rule as listed."""
    rank = F.coalesce(*[F.when((F.col("rule") == r.name) & (F.col("version") == r.version), F.lit(k)) for k, r in enumerate(rules)])
    hits = ledger.where(F.size("spans") > 0).withColumn("rank", rank).where("rank is not null")
    hits = hits.groupBy("blob", "rule", "rank").agg(F.first("spans").alias("spans"))
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["stop"].alias("stop"), F.col("rule").alias("rule")))
    by_blob = hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(one))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,rule:string>>")
    return versions.select("path", blob_of(text_of()).alias("blob")).join(by_blob, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(spark: SparkSession, versions: DataFrame, path: str | None, rules: tuple[Rule, ...] = RULES) -> str:
    """Scans what the ledger at `path` lacks (a new one in the shared folder if None), appends it, and returns the path."""
    ledger = None
    if path is None:
        path = Scratch(spark, "blob-ledger").path("ledger")
    else:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            ledger = read_ledger(spark, path)
    scan_unseen(versions, ledger, rules).write.mode("append").parquet(path)
    return path


def run_ledger(spark: SparkSession, versions: DataFrame, path: str | None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """update_ledger, and findings for the versions."""
    path = update_ledger(spark, versions, path, rules)
    return findings(versions, read_ledger(spark, path), rules), path


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each span, overlaps merged, replaced by mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["stop"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))
