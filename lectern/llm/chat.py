"""Reply trees to conversations: root-to-leaf paths by doubling self-joins, ranked, formatted one per row.

DataFrame functions only. A message is (msg, parent, score, role, text). A parent that is null, absent or the
message itself makes a root. Messages on a parent cycle have no root and appear in no path. Null role and text
are empty. Repeated msg ids are the caller's to make unique (linear_threads does, so repeated rows and equal turns are
messages each). An empty table gives no conversation. Extra columns of the input are ignored.

One conversation is one output row, so a conversation must fit in a row (2 GB); any number of them, of any
skew, is spread by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The template: HEAD role SEP text END. Control strings inside texts become two-character escapes.
HEAD, SEP, END = "### ", ":\n", "</turn>\n"
MAX_ROUNDS = 62  # path doubling: 2^62 messages deep


def escape(text: Column) -> Column:
    r"""Reversible: \ is \b, < is \l, ### is \h, in this order; so no END, HEAD or tag can stand in a text."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("###", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("###", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    r"""As escape, and : is \c, so that SEP first follows the role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def linear_threads(rows: DataFrame, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as reply chains: each row replies to the one before it in its thread.

    Equal turns are ordered by role, then text; repeated rows all stay. A null thread is one thread.
    """
    w = Window.partitionBy(thread).orderBy(F.col(turn), F.col("role"), F.col("text"))
    key = F.coalesce(F.col(thread).cast("string"), F.lit("null"))
    numbered = rows.select(F.col(thread), F.col(turn), "role", "text").withColumn("_pos", F.row_number().over(w))
    return numbered.select(
        thread,
        F.concat_ws(":", key, "_pos").alias("msg"),
        F.when(F.col("_pos") > 1, F.concat_ws(":", key, F.col("_pos") - 1)).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def reply_paths(spark: SparkSession, messages: DataFrame, scratch: Scratch, branches: int | None = None) -> DataFrame:
    """(path, root, path_rank, msg, pos): the messages of each chosen root-to-leaf path, pos from 0 at the root.

    Paths of a root are ranked by mean score, highest first, ties to the smaller leaf; `branches` keeps that
    many of each root, None all. Round k joins the 2^k-step ancestor table with itself, so a tree of depth d
    takes log2(d) self-joins on message ids, which are unique and so spread evenly; the way back down walks the
    same tables for chosen leaves alone. An empty table has no paths.
    """
    own = messages.select("msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    # a root meets itself there, so null parents aren't one hot key
    known = own.select(F.col("msg").alias("_up"))
    parent = F.when(F.col("_up").isNotNull() & (F.col("parent") != F.col("msg")), F.col("parent"))
    first = own.join(known, F.coalesce("parent", "msg") == F.col("_up"), "left").select("msg", parent.alias("anc"), F.col("score").alias("total"))
    # far: the last message met on the way up
    steps = [scratch.save(first.select("msg", "anc", "total", F.lit(1).cast("long").alias("hops"), F.coalesce("anc", "msg").alias("far")), "up0")]
    climbing = steps[0].where("anc is not null").count()
    for k in range(MAX_ROUNDS):
        if not climbing:
            break
        last = steps[-1]
        up = last.select(F.col("msg").alias("anc"), F.col("anc").alias("anc2"), F.col("total").alias("total2"), F.col("hops").alias("hops2"), F.col("far").alias("far2"))
        # messages that have reached their root sit out the join
        higher = last.where("anc is not null").join(up, "anc").select("msg", F.col("anc2").alias("anc"), (F.col("total") + F.col("total2")).alias("total"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("far2").alias("far"))
        steps.append(scratch.save(higher.unionByName(last.where("anc is null")), f"up{k + 1}"))
        left = steps[-1].where("anc is not null").count()
        if left == climbing:  # a tree has messages of all depths up to its own, so none reaching a root means that cycles are left
            break
        climbing = left
    parents = steps[0].where("anc is not null").select(F.col("anc").alias("msg")).distinct()
    leaves = steps[-1].where("anc is null").join(parents, "msg", "left_anti")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("mean"), "path"))
    ranked = leaves.select(F.col("msg").alias("path"), F.col("far").alias("root"), "hops", (F.col("total") / F.col("hops")).alias("mean")).withColumn("path_rank", rank)
    if branches is not None:
        ranked = ranked.where(F.col("path_rank") <= branches)
    members = scratch.save(ranked.select("path", "root", "path_rank", F.col("path").alias("msg"), (F.col("hops") - 1).alias("pos")), "paths")
    for k in range(len(steps) - 2, -1, -1):
        up = steps[k].where("anc is not null").select("msg", "anc")
        # who has the 2^k-th message above
        higher = members.where(F.col("pos") >= 1 << k).join(up, "msg").select("path", "root", "path_rank", F.col("anc").alias("msg"), (F.col("pos") - (1 << k)).alias("pos"))
        members = scratch.save(members.unionByName(higher), f"members{k}")
    last = len(steps) - 2
    scratch.drop(*[f"up{k}" for k in range(len(steps))], *[f"members{k}" for k in range(last, 0, -1)], *(["paths"] if last >= 0 else []))
    return members


def format_paths(paths: DataFrame, messages: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(path, formatted, loss_spans): spans are [start, end) in code points, one for each assistant text as escaped."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(HEAD), escape_role(role), F.lit(SEP)), escape(text)
    turns = paths.select("path", "msg", "pos").join(messages.select("msg", "role", "text"), "msg")
    turns = turns.select("path", "pos", head.alias("head"), body.alias("body"), (role == assistant).alias("loss"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + F.length("head"))
    turn = F.struct("pos", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("loss"), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end"))).alias("span"))
    grouped = turns.groupBy("path").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "path",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, SEP, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(role(p), F.lit(len(HEAD) + 1), F.length(role(p)))).alias("role"),
            unescape(F.substring(p, F.length(role(p)) + F.lit(len(SEP) + 1), F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
