"""A document's pronunciation plan applied to its blocks in reading order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.verify import NOTATION

RULES = "doc_id long, n int, kind string, key string, spoken string, short_form string"


def usable(rules: DataFrame) -> DataFrame:
    """Rules with a key that running prose can't mean otherwise; of equal keys the first kind, then the first rule.

    Kinds in order: notation, term, dehyphenation, acronym. Single letters and Greek names are left to the
    normaliser, but for dehyphenations.
    """
    vague = ((F.length(F.trim("key")) == 1) & F.col("key").rlike(r"\p{L}")) | F.lower(F.trim("key")).isin(NOTATION)
    rank = F.when(F.col("kind") == "notation", 0).when(F.col("kind") == "term", 1).when(F.col("kind") == "dehyphenation", 2).otherwise(3)
    kept = rules.where((F.trim("key") != "") & (~vague | (F.col("kind") == "dehyphenation")))
    first = F.min_by(F.struct("kind", "spoken", "short_form"), F.struct(rank, "n"))
    return kept.groupBy("doc_id", "key").agg(first.alias("r")).select("doc_id", "key", "r.*")


def _fold(text: str) -> str:
    return " ".join(re.split(r"[\s-]+", text)).strip().lower()


def _speaker(plan: list[dict] | None) -> Callable[[str], str]:
    """What speaks a document's texts in order: an acronym is introduced once, unless its expansion was said before."""
    table = {r["key"]: r for r in plan or ()}
    if not table:
        return lambda text: text
    either = "|".join(re.escape(k) for k in sorted(table, key=len, reverse=True))
    pattern, said, known = re.compile(rf"(?<![A-Za-z0-9])(?:{either})(?![A-Za-z0-9])"), [""], set()
    acronyms = sum(r["kind"] == "acronym" for r in plan)

    def speak(text: str) -> str:
        def one(m: re.Match) -> str:
            rule = table[m[0]]
            if rule["kind"] != "acronym":
                return rule["spoken"]
            if m[0] in known:
                return rule["short_form"]
            known.add(m[0])
            heard = _fold(rule["spoken"]) in " ".join([*said, _fold(text[: m.start()])])
            return rule["short_form"] if heard else f"{rule['spoken']} ({rule['short_form']})"

        text = pattern.sub(one, text)
        if len(known) < acronyms:
            said.append(_fold(text))
        return text

    return speak


def _speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by document, its plan first. A document may go on in the next batch."""
    doc, speak = None, None
    for b in batches:
        docs, pos, texts, plans = (b.column(c).to_pylist() for c in ("doc_id", "pos", "text", "plan"))
        out = []
        for at, (d, k, text) in enumerate(zip(docs, pos, texts, strict=True)):
            if speak is None or d != doc:
                doc, speak = d, _speaker(plans[at])
            if k is not None:
                out.append((d, k, text if text is None else speak(text)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "pos", "_said"])


def apply_plan(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """blocks(doc_id, pos, text) with text spoken by rules(RULES).

    An acronym is introduced where it first comes up, unless its expansion was said before; later it is short.
    Documents go through Python as sorted rows, many a batch: a group a document would take milliseconds each.
    """
    plan = usable(rules).groupBy("doc_id").agg(F.collect_list(F.struct("key", "kind", "spoken", "short_form")).alias("plan"))
    rows = plan.select("doc_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("text"), "plan").unionByName(blocks.select("doc_id", F.col("pos").cast("int").alias("pos"), "text"), allowMissingColumns=True)
    spoken = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("pos").asc_nulls_first()).mapInArrow(_speak, "doc_id long, pos int, _said string")
    return blocks.join(spoken, ["doc_id", "pos"], "left").withColumn("text", F.coalesce("_said", "text")).drop("_said")
