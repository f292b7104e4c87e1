"""Token ids in shard files compressed by a Re-Pair grammar.

A shard is a run of documents in ascending id order. Rounds replace frequent adjacent id pairs by nonterminals
(the PAIRS most frequent with MIN_COUNT or more, left to right without overlap, never across a document's
end), until no pair is left that occurs MIN_COUNT times. The file holds the rules, each rule's expansion length, the symbol sequence and each document's place in
it, so one document decodes without the rest. File layout, little-endian:

    magic "RPR1", u32 first id that is a nonterminal, u32 rules, u32 documents, u64 symbols,
    u32 left[rules], u32 right[rules], u32 expansion length[rules],
    u64 first symbol[documents + 1], u16 low half[symbols], u8 high part[symbols]

Files are values of a Parquet table in the shared folder, one row a shard, so any store that Spark writes will do.
Null text is the empty text (the end id alone). Null ids come first; repeated ids stay, in the order of their texts.
An empty table gives no shards. A text is encoded whole and its shard holds it whole, so the longest bounds memory.
Columns besides doc_id and text are ignored. Symbols have 24 bits; a vocabulary and rules beyond that are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, text_of
from .encoding import Encoder, sliced

END = 0
SHARD_TOKENS = 2_000_000
PAIRS, MIN_COUNT, HASH_BITS = 4096, 16, 19
SHARDS = "part int, shard_no int, doc_ids array<long>, lengths array<int>, tokens long, file binary"
_SHARDS = pa.schema([("part", pa.int32()), ("shard_no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.int64()), ("file", pa.binary())])


def compress(ids: np.ndarray, ends: np.ndarray, first_free: int) -> bytes:
    """The file of a shard; ends: where each document's ids end."""
    seq = ids.astype(np.uint32)
    stop = np.zeros(len(seq), dtype=bool)
    stop[ends - 1] = True
    left, right, size = [np.empty(0, np.uint32)] * 3
    recent = 0  # after a round that took all frequent pairs, only pairs with one of its symbols can be frequent
    while len(seq) >= 2:
        a, b = seq[:-1], seq[1:]
        held = ~stop[:-1]
        if recent:
            at = np.flatnonzero(held & ((a >= recent) | (b >= recent)))
            a, b, held = a[at], b[at], slice(None)
        pairs = (a.astype(np.uint64) << np.uint64(32)) | b
        bits = min(HASH_BITS, max(10, len(pairs).bit_length()))
        slot = ((pairs ^ (pairs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)
        counts = np.bincount(slot[held], minlength=1 << bits)
        some = np.flatnonzero(counts >= MIN_COUNT)
        if not len(some):
            break
        cut = len(some) > PAIRS
        if cut:
            some = some[np.argpartition(counts[some], len(some) - PAIRS)[-PAIRS:]]
        number = np.full(1 << bits, -1, dtype=np.int32)
        number[some] = np.arange(len(some), dtype=np.int32)
        inverse = number[slot]
        taken = np.flatnonzero(inverse >= 0 if recent else (inverse >= 0) & held)
        at = at[taken] if recent else taken
        pairs, inverse = pairs[taken], inverse[taken].astype(np.int64)
        # a slot's last pair stands for it, mostly its frequent one; what differs is sorted
        last = np.zeros(len(some), dtype=np.uint64)
        last[inverse] = pairs
        other = np.flatnonzero(last[inverse] != pairs)
        rest, numbers, n = np.unique(pairs[other], return_inverse=True, return_counts=True)
        inverse[other] = len(some) + numbers
        pairs, n = np.concatenate([last, rest]), np.concatenate([np.bincount(inverse, minlength=len(some))[: len(some)], n])
        rule = np.full(len(pairs), -1, dtype=np.int64)
        good = np.flatnonzero(n >= MIN_COUNT)
        if not len(good):
            break
        new = first_free + len(left)
        recent = 0 if cut else new
        rule[good] = new + np.arange(len(good))
        symbol = rule[inverse]
        at, symbol = at[symbol >= 0], symbol[symbol >= 0]
        # of marked neighbours every second one stays, from the left
        fresh = np.diff(at, prepend=-2) != 1
        run = np.cumsum(fresh) - 1
        odd = (at - at[np.flatnonzero(fresh)][run]) & 1
        at, symbol = at[odd == 0], symbol[odd == 0]
        grown = np.concatenate([np.ones(first_free, np.uint32), size]) if len(size) else None
        of = lambda s: np.where(s < first_free, 1, size[np.maximum(s, first_free) - first_free]) if grown is not None else np.ones(len(s), np.uint32)
        l, r = (pairs[good] >> np.uint64(32)).astype(np.uint32), (pairs[good] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        s = (of(l.astype(np.int64)) + of(r.astype(np.int64))).astype(np.uint32)
        left, right, size = np.concatenate([left, l]), np.concatenate([right, r]), np.concatenate([size, s])
        seq[at] = symbol
        stop[at] = stop[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, stop = seq[keep], stop[keep]
    if first_free + len(left) > 1 << 24:
        raise ValueError("symbols need more than 24 bits")
    begins = np.concatenate([[0], np.flatnonzero(stop) + 1]).astype("<u8")
    head = struct.pack("<4sIIIQ", b"RPR1", first_free, len(left), len(ends), len(seq))
    return b"".join([head, left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), size.astype("<u4").tobytes(), begins.tobytes(), (seq & 0xFFFF).astype("<u2").tobytes(), (seq >> 16).astype("u1").tobytes()])


class ShardFile:
    """Reads a shard file; documents by number."""

    def __init__(self, data: bytes):
        magic, self.first, n, docs, symbols = struct.unpack_from("<4sIIIQ", data)
        assert magic == b"RPR1", "not a shard file"
        at = 24
        take = lambda kind, k: np.frombuffer(data, kind, k, at)
        self.left, at = take("<u4", n), at + 4 * n
        self.right, at = take("<u4", n), at + 4 * n
        self.size, at = take("<u4", n), at + 4 * n
        self.begins, at = take("<u8", docs + 1).astype(np.int64), at + 8 * (docs + 1)
        low, at = take("<u2", symbols), at + 2 * symbols
        self.seq = low.astype(np.uint32) | take("u1", symbols).astype(np.uint32) << 16
        # expansions of all symbols; a rule's parts are older than itself
        self.n = np.concatenate([np.ones(self.first, np.int64), self.size])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.full = np.empty(self.at[-1], dtype=np.uint32)
        self.full[: self.first] = np.arange(self.first)
        for k, (x, y) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.first):
            i, m = self.at[k], self.at[k] + self.n[x]
            self.full[i:m] = self.full[self.at[x] : self.at[x + 1]]
            self.full[m : self.at[k + 1]] = self.full[self.at[y] : self.at[y + 1]]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        n = self.n[seq]
        upto = np.cumsum(n)
        return self.full[np.repeat(self.at[seq] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.seq[self.begins[i] : self.begins[i + 1]])

    def lengths(self) -> np.ndarray:
        """Ids of each document, from expansion lengths alone."""
        return np.diff(np.concatenate([[0], np.cumsum(self.n[self.seq])])[self.begins])


def with_end(ids: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with an end id after each."""
    new = ends + np.arange(1, len(ends) + 1)
    out = np.full(len(ids) + len(ends), end, dtype=np.uint32)
    inside = np.ones(len(out), dtype=bool)
    inside[new - 1] = False
    out[inside] = ids
    return out, new


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, encoder = TaskContext.get().partitionId(), 0, Encoder.of(path)
        docs, ids, sizes, held = [], [], [], 0

        def flush():
            flat, ends = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
            row = [part], [shard], [docs], [np.diff(ends, prepend=0).tolist()], [len(flat)], [compress(flat, ends, encoder.vocabulary)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _SHARDS.types, strict=True)], schema=_SHARDS)

        for b in sliced(batches, "text", 12_000_000):
            flat, ends = with_end(*encoder.encode(b.column("text")), END)
            names, lengths, first = b.column("doc_id").to_pylist(), np.diff(ends, prepend=0), 0
            while first < len(names):  # documents until the shard is full
                begin = int(ends[first] - lengths[first])
                stop = min(int(np.searchsorted(ends, begin + SHARD_TOKENS - held)) + 1, len(names))
                docs += names[first:stop]
                ids.append(flat[begin : ends[stop - 1]])
                sizes.append(lengths[first:stop])
                held, first = held + len(ids[-1]), stop
                if held >= SHARD_TOKENS:
                    yield flush()
                    shard, docs, ids, sizes, held = shard + 1, [], [], [], 0
        if docs:
            yield flush()

    return lean(write)


def write_shards(docs: DataFrame, scratch: Scratch, path: str, parts: int) -> DataFrame:
    """Writes documents(doc_id, text) in ascending doc_id order; returns the shard table as read back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return scratch.save(rows.mapInArrow(_writer(path), SHARDS), "shards")


_DIGESTS = "part int, shard_no int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _digests(batches):
    for b in batches:
        for i in range(b.num_rows):
            shard = ShardFile(b.column("file")[i].as_py())
            n = shard.lengths()
            crc = [zlib.crc32(shard.document(k).astype("<u4")) for k in range(len(n))]
            place = [pa.array([b.column(c)[i].as_py()] * len(n), pa.int32()) for c in ("part", "shard_no")]
            values = [b.column("doc_ids")[i].values, pa.array(np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*place, *values], names=["part", "shard_no", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, each decoded by itself from its file.

    Shard starts are sums over a task's shards, and over tasks; files are read in place.
    """
    before = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before("part")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(before("shard_no", "part")), F.lit(0))
    firsts = shards.select("part", "shard_no", inside.alias("inside")).join(parts, "part").select("part", "shard_no", (F.col("base") + F.col("inside")).alias("first"))
    own = shards.select("part", "shard_no", "doc_ids", "file").mapInArrow(lean(_digests), _DIGESTS)
    return own.join(firsts, ["part", "shard_no"]).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
