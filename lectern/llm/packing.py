"""Mixture-controlled packing: deficit round-robin over source queues into windows of at most WINDOW ids.

Lanes (about LANE_TOKENS ids each) are packed independently of each other. Every source's documents are dealt
over all lanes by the sum of the source's ids before them, wherever they lie in the input, so that a lane holds
each source in its share, give or take a run (RUN ids or one document). A window
gives every source its share of WINDOW ids as credit; the source with the largest credit sends its next piece
(up to QUANTUM ids or its credit, if that is more), until the window is full; credit over or under is carried
to the next window. Lanes carry it on as well: a lane packs all it holds, so the credit that it leaves behind
is share x its ids less its ids of the source, and what a lane starts with is the sum of that over the lanes
before it, known from counts alone. LANES lanes in a row are packed in turn: what one has beyond full windows goes on
to the next with its credit, and the last ends with windows of powers of two, so nothing is padded. Shares are those of all ids unless given. Given ones hold in all lanes up to the one in which
a favoured source ends; the others share what follows, and sources without a share come last.

Null text is the empty text (the end id alone); null sources are a source; equal ids stay separate documents; an
empty table gives no pieces. A text is encoded whole, so the longest bounds memory with the lane that holds it.
Columns besides doc_id, text and source are ignored. Ids are kept in 16 bits; larger vocabularies are refused.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, sums_before, text_of
from .encoding import Encoder, sliced
from .token_store import with_end

END, WINDOW, QUANTUM, RUN, LANE_TOKENS, LANES = 1, 2048, 512, 2048, 500_000, 4
#: Documents of one source that are dealt together; within: ids of the source before it in its task (part).
RUNS = "part int, source string, within long, n long, doc_ids array<long>, lengths array<int>, ids binary"
_RUNS = pa.schema([("part", pa.int32()), ("source", pa.string()), ("within", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, sent = TaskContext.get().partitionId(), Encoder.of(path), {}
        if encoder.vocabulary > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        for b in sliced(batches, "text", 12_000_000):
            flat, ends = with_end(*encoder.encode(b.column("text")), END)
            coded = b.column("source").dictionary_encode()
            names = [*coded.dictionary.to_pylist(), None]
            codes = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            codes, sizes = codes[order], np.diff(ends, prepend=0)[order]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            place = np.repeat((ends[order] - upto[1:]).astype(np.int32), sizes)
            place += np.arange(upto[-1], dtype=np.int32)
            data = flat.astype("<u2")[place]
            own = np.bincount(codes, sizes, len(names)).astype(np.int64)
            within = upto[:-1] + (np.array([sent.get(s, 0) for s in names]) - (np.cumsum(own) - own))[codes]
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(within // RUN) != 0)) + 1, [len(codes)]])
            for s, n in zip(names, own.tolist(), strict=True):
                sent[s] = sent.get(s, 0) + n
            at, lists, bytes_ = cuts[:-1], pa.array(cuts, pa.int32()), (2 * upto[cuts]).astype(np.int32)
            columns = [pa.array([part] * len(at), pa.int32()), pa.array([names[c] for c in codes[at]], pa.string()), pa.array(within[at], pa.int64()), pa.array(np.diff(upto[cuts]), pa.int64())]
            columns += [pa.ListArray.from_arrays(lists, b.column("doc_id").take(pa.array(order))), pa.ListArray.from_arrays(lists, pa.array(sizes, pa.int32()))]
            columns.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bytes_), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _RUNS.types, strict=True)], schema=_RUNS)

    return lean(encode)


def windows_of(total: int) -> list[int]:
    """Full windows, then powers of two."""
    rest = total % WINDOW
    return [WINDOW] * (total // WINDOW) + [1 << k for k in range(WINDOW.bit_length() - 1, -1, -1) if rest >> k & 1]


def round_robin(lengths: list[int], sources: list, credit: dict, share: dict, windows: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) pieces that fill the windows of one lane."""
    queues: dict = {}
    for i, s in enumerate(sources):
        queues.setdefault(s, deque()).append(i)
    credit = {s: credit.get(s, 0.0) for s in queues}
    at = dict.fromkeys(queues, 0)
    for w, room in enumerate(windows):
        offset = 0
        for s in credit:
            credit[s] += share.get(s, 0.0) * room
        while offset < room:
            s = max(credit, key=credit.get)
            i = queues[s][0]
            n = min(room - offset, lengths[i] - at[s], max(QUANTUM, int(credit[s])))
            yield i, at[s], n, w, offset
            offset += n
            at[s] += n
            credit[s] -= n
            if at[s] == lengths[i]:
                queues[s].popleft()
                at[s] = 0
                if not queues[s]:
                    del credit[s]


@dataclass
class Document:
    """What is left of a document: its ids from start on."""

    doc_id: int | None
    source: str | None
    tokens: int
    start: int
    ids: memoryview


def _documents(runs: list[dict]) -> Iterator[Document]:
    for r in runs:
        data, at = memoryview(np.frombuffer(r["ids"], "<u2").astype("<u4")).cast("B"), 0
        for doc_id, n in zip(r["doc_ids"], r["lengths"], strict=True):
            yield Document(doc_id, r["source"], n, 0, data[4 * at : 4 * (at + n)])
            at += n


def _packed(head: dict, docs: list[Document], carried: int, first: int, last: bool) -> tuple[list[pa.RecordBatch], list[Document], int]:
    """Pieces of a lane with windows from `first` on, what is left for the next lane, and its first window.

    The first `carried` documents come from the lane before.
    """
    lengths = [len(d.ids) // 4 for d in docs]
    share = {p["source"]: p["share"] for p in head["plan"]}
    credit = {p["source"]: p["credit"] for p in head["plan"]}
    late = sum(lengths[:carried])
    for d, n in zip(docs[:carried], lengths, strict=False):
        credit[d.source] = credit.get(d.source, 0.0) + n
    credit = {s: c - share.get(s, 0.0) * late for s, c in credit.items()}
    total = sum(lengths)
    windows = windows_of(total) if last else [WINDOW] * (total // WINDOW)
    pieces = list(round_robin(lengths, [d.source for d in docs], credit, share, windows))
    sent = [0] * len(docs)
    for i, start, n, *_ in pieces:
        sent[i] = start + n
    left = [Document(d.doc_id, d.source, d.tokens, d.start + k, memoryview(bytes(d.ids[4 * k :]))) for d, k, n in zip(docs, sent, lengths, strict=True) if k < n]
    if not pieces:
        return [], left, first
    doc, start, size, window, offset = zip(*pieces, strict=True)
    crc = [zlib.crc32(docs[i].ids[4 * s : 4 * (s + k)]) for i, s, k in zip(doc, start, size, strict=True)]
    columns = [pa.array([docs[i].doc_id for i in doc], pa.int64()), pa.array([docs[i].source for i in doc], pa.string())]
    columns += [pa.array(x, pa.int64()) for x in ([docs[i].start + s for i, s in zip(doc, start, strict=True)], size, crc, [docs[i].tokens for i in doc], np.array(window) + first, offset)]
    return [pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])], left, first + len(windows)


def _pack(batches):
    """Lanes in order: each one's plan, then its runs. A group of lanes lies in one task."""
    head, runs, left, first = None, [], [], 0
    for b in batches:
        for row in b.to_pylist():
            if row["plan"] is None:
                runs.append(row)
                continue
            if head is not None:
                out, left, first = _packed(head, [*left, *_documents(runs)], len(left), first, row["team"] != head["team"])
                yield from out
            if head is None or row["team"] != head["team"]:
                first = row["first"]
            head, runs = row, []
    if head is not None:
        yield from _packed(head, [*left, *_documents(runs)], len(left), first, True)[0]


def _sent_before(totals: DataFrame, shares: dict | None) -> Column:
    """All ids that come before an id, from `at` (ids of its source before it), `all` (of its source) and `total`.

    With shares, source s has sent share x t at time t, until it ends at all / share. Sources without one follow
    in proportion. The ends of the named sources are collected: as many as there are shares.
    """
    if shares is None:
        return F.col("at") * F.col("total") / F.col("all")
    named = [s for s, v in shares.items() if v > 0]
    known = F.lit(False)
    for s in named:
        known = known | F.col("source").eqNullSafe(s)
    sizes = {r["source"]: r["all"] for r in totals.where(known).select("source", "all").collect()}
    given = {s: float(shares[s]) for s in named if s in sizes}
    share = F.coalesce(*[F.when(F.col("source").eqNullSafe(s), F.lit(v)) for s, v in given.items()], F.lit(0.0))
    t = F.col("at") / share
    sent = F.lit(0.0)
    for s, v in given.items():
        sent = sent + F.least(F.lit(float(sizes[s])), t * v)
    first = float(sum(sizes.values()))
    return F.when(share > 0, sent).otherwise(first + F.col("at") * (F.col("total") - first) / F.col("all"))


def pack(spark: SparkSession, docs: DataFrame, scratch: Scratch, path: str, shares: dict | None = None) -> DataFrame:
    """PIECES for documents(doc_id, text, source). Each id lies in one piece; windows are full."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("source").cast("string").alias("source"))
    runs = scratch.save(rows.mapInArrow(_encoder(path), RUNS), "runs")
    held = scratch.save(runs.groupBy("part", "source").agg(F.sum("n").alias("n")), "held")
    total = held.groupBy("source").agg(F.sum("n").alias("all"))
    # where each task's ids of a source begin in all of the source; a row for each task and source, so mostly small enough for Spark to broadcast
    before = lambda key, *by: Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("begin", F.coalesce(F.sum("n").over(before("part", "source")), F.lit(0))).select(F.col("part").alias("_part"), F.col("source").alias("_source"), "begin")
    ends = total.select(F.col("source").alias("_of"), "all", F.sum("all").over(Window.partitionBy()).alias("total"))
    starts = scratch.save(starts.join(ends, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of"), "starts")
    met = runs.join(starts, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))).withColumn("at", F.col("begin") + F.col("within"))
    count = F.greatest(F.lit(1), F.round(F.col("total") / LANE_TOKENS))
    placed = met.withColumn("lane", F.floor(_sent_before(total, shares) * count / F.col("total")).cast("long"))
    own = scratch.save(placed.groupBy("lane", "source").agg(F.sum("n").alias("n")), "lanes")
    if shares is None:
        total = total.withColumn("share", F.col("all") / F.sum("all").over(Window.partitionBy()))
    else:
        sum_ = float(sum(shares.values())) or 1.0
        given = F.coalesce(*[F.when(F.col("source").eqNullSafe(s), F.lit(v / sum_)) for s, v in shares.items()], F.lit(0.0))
        total = total.withColumn("share", given)
    # a lane's ids, and each source's credit before it; a team of lanes knows its windows from its ids
    sizes = scratch.save(own.groupBy("lane").agg(F.sum("n").alias("size")).withColumn("team", F.floor(F.col("lane") / LANES)), "sizes")
    teams = sizes.groupBy("team").agg(F.sum("size").alias("ids"))
    teams = sums_before(teams.withColumn("windows", F.floor(F.col("ids") / WINDOW) + F.bit_count(F.col("ids") % WINDOW)), "team", "windows", "first")
    sizes = sums_before(sizes, "lane", "size", "so_far").join(teams.select("team", "first"), "team")
    own = sums_before(own, "lane", "n", "sent", "source")
    named = total.select(F.col("source").alias("_source"), "share")
    plan = own.join(named, F.col("source").eqNullSafe(F.col("_source"))).join(sizes, "lane")
    entry = F.struct("source", "share", (F.col("share") * F.col("so_far") - F.col("sent")).alias("credit"))
    plan = plan.groupBy("lane").agg(F.collect_list(entry).alias("plan"), F.first("first").alias("first"))
    # a lane's plan comes before its runs; dealt by repartition, as a join's partitions may be cut inside a team
    both = placed.select("lane", "part", "within", "source", "doc_ids", "lengths", "ids").unionByName(plan.withColumn("part", F.lit(-1)), allowMissingColumns=True)
    both = both.withColumn("team", F.floor(F.col("lane") / LANES))
    ids = starts.agg(F.max("total")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, ids // (2 * LANES * LANE_TOKENS))  # about two teams a task, whatever the input's size
    return both.repartition(parts, "team").sortWithinPartitions("lane", "part", "within").mapInArrow(lean(_pack), PIECES)
