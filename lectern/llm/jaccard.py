"""Exact Jaccard self-join on word n-grams by a token-group matrix, and its connected components.

A text's set holds the 64-bit hashes of its distinct n-word shingles (the whole word sequence, if shorter).
Texts with equal sets form a class; classes are joined:

1. Tokens are ordered rarest first by a count-min sketch over all documents. Its size is fixed (CELLS), so it
   can be sent to all tasks; its errors change the speed, never the result.
2. Classes are partitioned into groups: equal length band, equal least hash among the more frequent half of
   their tokens, and at most about MEMBERS classes and MEMBER_TOKENS tokens each (larger ones are dealt into blocks).
3. The matrix of groups and the tokens in their members' prefixes gives candidate (query, group) pairs: classes
   of similarity t share at least min(SHARED, ceil(t n)) of the first n - ceil(t n) + SHARED tokens, whichever
   common order is used. A group is one matrix row however many near copies it holds, so pairs of members are
   never made.
4. Texts that a candidate names move once; with a group's members together, its token union is stored, and a
   query's overlap with the union bounds its overlap with any member. Only groups whose bound reaches the
   threshold are opened: exact intersections by the group's inverted index, compared in integers. Queries of a
   group are dealt over cells of at most about VISITORS queries and VISITOR_TOKENS tokens, each with all members
   of the group, so neither a group nor its queries meet in one task when they are many.
5. Links become a union-find forest in each cell (at most one edge a member and visitor), and large-star /
   small-star rounds over the forests' edges give components. Links are counted, not listed.

Null text, empty text and text without words: empty set, no links. Null ids take part through their text, and
never name a component unless it has no other id. Repeated rows and ids are texts like any other, so equal ids
get a row each. An empty table gives an empty result. A text's tokens (8 bytes each) are held in one piece, so the
longest text bounds memory; others go in slices of SLICE bytes. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean
from .encoding import sliced

CELLS, SKETCH_BLOCKS = 1 << 21, 64
SHARED, BAND = 3, 1.1
#: Bounds of a group and of the queries that meet it in one place; one text at least.
MEMBERS, MEMBER_TOKENS, VISITORS, VISITOR_TOKENS = 1024, 1 << 20, 4096, 1 << 22
#: Rows of a batch, and bytes of text that are cut into tokens at once.
ROWS, SLICE = 2000, 2_000_000
#: Rows of 16 bytes that may be broadcast; larger tables are joined by a shuffle.
SENT_ROWS = 500_000
#: Bits of a post's size field.
SIZE_BITS = 24
_A, _B, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def token_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased, words are split at ASCII white space."""
    # filled first: ascii_lower on a slice cast to large_string returns wrong bytes (seen with pyarrow 23.0.1)
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()), r"[\x20\x09-\x0D]+")
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = words[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
    grams = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams = _mix(grams * _A + h[k : k + len(grams)] + _B)
    for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
        if y - x >= n:
            yield np.unique(grams[x : y - n + 1])
        elif y > x:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(x, y):
                one = _mix(one * _A + h[k : k + 1] + _B)
            yield _mix(one + np.uint64(y - x))
        else:
            yield np.empty(0, np.uint64)


def key_of(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def sid_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens * _A >> np.uint64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


#: hash: the text's, which tells rows with equal ids apart.
_CLASSES = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sid", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
CLASSES = "doc_id long, hash long, n long, key binary, sid long, block int, counts binary"
_PER_BLOCK = CELLS // SKETCH_BLOCKS


def _sketch_rows(sketch: np.ndarray) -> pa.RecordBatch:
    rows = []
    for b in range(SKETCH_BLOCKS):
        own = sketch[b * _PER_BLOCK : (b + 1) * _PER_BLOCK]
        some = np.flatnonzero(own)
        if len(some):
            rows.append((b, some.astype("<u2").tobytes() + own[some].astype("<u4").tobytes()))
    n = len(rows)
    empty = [pa.nulls(n, f.type) for f in _CLASSES][:-2]
    return pa.RecordBatch.from_arrays([*empty, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_CLASSES)


def _classify(n: int):
    def run(batches):
        sketch = np.zeros(CELLS, dtype=np.uint32)
        for b in sliced(batches, "text", SLICE):
            sets = list(token_sets(b.column("text"), n))
            cells = _cells(np.concatenate(sets))
            cells.sort()
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            sketch[cells[first]] += np.diff(first, append=len(cells)).astype(np.uint32)
            keys = [key_of(s) if len(s) else None for s in sets]
            ids = pa.array([None if k is None else sid_of(k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), ids, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=_CLASSES)
        yield _sketch_rows(sketch)

    return lean(run)


def _merge_sketch(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
            k = len(counts) // 6
            sums.setdefault(block, np.zeros(_PER_BLOCK, dtype=np.int64))[np.frombuffer(counts, "<u2", k)] += np.frombuffer(counts, "<u4", k, 2 * k)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 2**31 - 1).astype("<i4").tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])


def _merged_sketch(spark: SparkSession, partial: DataFrame) -> np.ndarray:
    """CELLS counts; a fixed 8 MB on the driver."""
    out = np.zeros(CELLS, dtype=np.int32)
    for r in partial.repartition(SKETCH_BLOCKS, "block").mapInArrow(_merge_sketch, "block int, counts binary").collect():
        out[r.block * _PER_BLOCK : (r.block + 1) * _PER_BLOCK] = np.frombuffer(r.counts, "<i4")
    return out


_POSTS = pa.schema([("t", pa.int64()), ("sid", pa.int64()), ("gn", pa.int64())])


def _least(n: int, pct: int) -> int:
    return -(-n * pct // 100)


def _posts(n: int, pct: int, sent):
    """Prefix tokens of each distinct set of a task, with the set's id, its group hash and its size."""

    def run(batches):
        sketch = sent.value
        seen: set[bytes] = set()
        top = (1 << SIZE_BITS) - 1
        for b in sliced(batches, "text", SLICE):
            t, ids, gn, sizes = [], [], [], []
            for s in token_sets(b.column("text"), n):
                if not len(s) or (key := key_of(s)) in seen:
                    continue
                seen.add(key)
                count = sketch[_cells(s)]
                # the least hash among the more frequent half: what one near copy has alone doesn't set it apart
                usual = s[count >= np.partition(count, len(s) // 2)[len(s) // 2]]
                group = int(_mix(usual[:1])[0] >> np.uint64(SIZE_BITS + 1)) << SIZE_BITS
                p = min(len(s), len(s) - _least(len(s), pct) + SHARED)
                # ties by token: s is sorted, and the sort is stable
                t.append(s[np.argsort(count, kind="stable")[:p]])
                ids.append(sid_of(key))
                gn.append(group | min(len(s), top))
                sizes.append(p)
            if t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(np.array(gn, np.int64), sizes))], schema=_POSTS)

    return lean(run)


_VISITS = pa.schema([("cell", pa.int64()), ("role", pa.int32()), ("key", pa.binary()), ("copies", pa.int64()), ("tokens", pa.binary())])
VISITS = "cell long, role int, key binary, copies long, tokens binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _visits(n: int):
    """The token set of each text, once for each cell that it takes part in."""

    def run(batches):
        for b in sliced(batches, "text", SLICE // 2):
            keys, copies, visits = (b.column(c).to_pylist() for c in ("key", "copies", "visits"))
            rows, size = [], 0
            for i, s in enumerate(token_sets(b.column("text"), n)):
                if key_of(s) != keys[i]:
                    raise ValueError("a text's tokens don't match the key it was classified by")
                data = s.tobytes()
                for v in visits[i]:
                    rows.append((v["cell"], v["role"], keys[i], copies[i], data))
                    size += len(data)
                    if size > 8 << 20:
                        yield _batch(rows, _VISITS)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, _VISITS)

    return lean(run)


class Group:
    """Members of a group: their token union, its inverted index, and the forest of links."""

    def __init__(self, pct: int):
        self.pct, self.keys, self.copies, self.sets, self.index = pct, [], [], [], None
        self.visitors: list[tuple[bytes, int, int]] = []

    def add(self, key: bytes, copies: int, tokens: np.ndarray) -> None:
        self.keys.append(key)
        self.copies.append(copies)
        self.sets.append(tokens)

    def close(self) -> None:
        sizes = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        self.sets.clear()
        order = np.argsort(flat, kind="stable")
        self.index = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        flat = flat[order]
        del order
        self.at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.union = flat[self.at]
        self.at = np.append(self.at, len(flat))
        self.sizes, self.weight, self.least = sizes, np.array(self.copies), int(sizes.min())
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.root = list(range(len(sizes)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, members: list[int]) -> None:
        """Members come in key order, so a root has the least key of its tree."""
        roots = [self.find(i) for i in members]
        least = min(roots)
        for r in roots:
            self.root[r] = least

    def edges(self) -> Iterator[tuple[bytes, bytes, int]]:
        """Visitors and members with the root of what they link to; empties the list of visitors."""
        for key, links, member in self.visitors:
            yield key, self.keys[self.find(member)], links
        self.visitors.clear()
        if self.index is not None:
            for i, key in enumerate(self.keys):
                if (r := self.find(i)) != i:
                    yield key, self.keys[r], 0

    def visit(self, key: bytes, q: np.ndarray) -> None:
        """Notes a query's links (copies counted) and a linked member, if there are any."""
        if self.index is None:
            self.close()
        k = np.searchsorted(self.union, q)
        k = k[self.union[np.minimum(k, len(self.union) - 1)] == q]
        own = self.place.get(key)
        if own is not None:
            k = k[self.at[k + 1] - self.at[k] > 1]  # a member's own tokens don't count for others
        # J >= t needs overlap >= t (n + m) / (1 + t), and m is the least size or more
        if len(k) * (100 + self.pct) < self.pct * (len(q) + max(self.least, _least(len(q), self.pct))):
            return
        n = self.at[k + 1] - self.at[k]
        upto = np.cumsum(n)
        members = self.index[np.repeat(self.at[k] - (upto - n), n) + np.arange(upto[-1])]
        both = np.bincount(members, minlength=len(self.sizes))
        linked = 100 * both >= self.pct * (len(q) + self.sizes - both)
        if own is not None:
            linked[own] = False
        found = np.flatnonzero(linked)
        if len(found):
            self.join([*found.tolist(), *([own] if own is not None else [])])
            self.visitors.append((key, int(self.weight[found].sum()), int(found[0])))


LINKS = "a binary, b binary, links long"
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])


def _token_views(column: pa.Array) -> list[np.ndarray]:
    """The values of a binary column as views on its buffer."""
    _, at, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [flat[x:y].view(np.uint64) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _verify(pct: int):
    """Links of each cell. Rows come by cell, members first; equal neighbours are one class that two rows brought."""

    def run(batches):
        group, now, last, rows = None, None, None, []
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("cell", "role", "key", "copies"))
            for cell, role, key, copies, s in zip(*columns, _token_views(b.column("tokens")), strict=True):
                if cell != now:
                    if group is not None:
                        rows += group.edges()
                    group, now, last = Group(pct), cell, None
                if (role, key) == last:
                    continue
                last = role, key
                if role == 0:
                    group.add(key, copies, s.copy())
                elif group.keys:
                    group.visit(key, s)
                    if len(group.visitors) > 50_000:
                        rows += group.edges()
            if len(rows) > 50_000:
                yield _batch(rows, _LINKS)
                rows.clear()
        if group is not None:
            rows += group.edges()
        if rows:
            yield _batch(rows, _LINKS)

    return lean(run)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges(a, b): large-star and small-star rounds until only stars are left."""
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    k = 0
    while True:
        # edges lead down, so a forest of stars has no node with two ways down, or one way down and one up
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 0 and down + up > 1").isEmpty():
            break
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = scratch.save(small, f"edges{k}")
        scratch.drop(f"edges{k - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def sent_if_small(rows: DataFrame) -> DataFrame:
    """A written table with a broadcast hint, if it has SENT_ROWS or fewer."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND))


def jaccard_components(spark: SparkSession, docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, class_size) of documents(doc_id, text); links of `percent` similarity or more."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    made = scratch.save(texts.mapInArrow(_classify(words), CLASSES), "classes", rows=ROWS)
    classes = made.where("block is null").select("doc_id", "hash", "n", "key", "sid")
    sent = spark.sparkContext.broadcast(_merged_sketch(spark, made.where("block is not null").select("block", "counts")))

    # tokens in the prefixes of two classes or more
    posts = texts.where("text is not null").select("text").mapInArrow(_posts(words, percent, sent), "t long, sid long, gn long")
    posts = scratch.save(posts, "posts", rows=ROWS)
    sent.unpersist()
    ends = posts.groupBy("t").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y").select("t")
    posts = posts.join(ends, "t", "left_semi").dropDuplicates(["t", "sid"])

    # groups, cut into blocks of bounded members and tokens
    top = (1 << SIZE_BITS) - 1
    n = F.col("gn").bitwiseAND(F.lit(top))
    grouped = scratch.save(posts.select("t", "sid", n.alias("n"), F.xxhash64(F.shiftright("gn", SIZE_BITS), band(n)).alias("grp")), "grouped0")
    scratch.drop("posts")
    blocks = F.ceil(F.greatest(F.col("k") / MEMBERS, F.col("tokens") / MEMBER_TOKENS))
    sizes = grouped.select("sid", "n", "grp").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens")).select("grp", blocks.alias("blocks")).where("blocks > 1")
    sizes = sent_if_small(scratch.save(sizes, "sizes"))
    dealt = F.xxhash64("grp", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    grouped = scratch.save(grouped.join(sizes, "grp", "left").select("t", "sid", "n", F.when(F.col("blocks").isNotNull(), dealt).otherwise(F.col("grp")).alias("grp")), "grouped")
    scratch.drop("grouped0")

    # the matrix gives queries of groups
    matrix = grouped.groupBy("t", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("k"))
    matrix = matrix.withColumnRenamed("grp", "g")
    fits = (F.col("n") >= top) | (F.col("high") >= top) | ((F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100))
    met = grouped.join(matrix, "t").where(fits & ((F.col("g") != F.col("grp")) | (F.col("k") > 1)))
    enough = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))
    queries = met.groupBy("sid", "n", "g").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= enough)
    queries = scratch.save(queries.select("sid", "n", F.col("g").alias("grp")).distinct(), "queries")

    # and cells of bounded queries, each with all members of the group
    cells = scratch.save(queries.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / VISITORS, F.sum("n") / VISITOR_TOKENS)).alias("cells")), "cells")
    # groups of several cells (or blocks, above) are few, so mostly they can be sent to all tasks, and a large group's rows stay where they are
    crowded = sent_if_small(cells.where("cells > 1"))
    members = grouped.select("sid", "grp").distinct().join(cells, "grp").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    visitors = queries.join(crowded, "grp", "left").withColumn("c", F.pmod(F.xxhash64("sid"), F.coalesce("cells", F.lit(1))))
    place = F.struct(F.xxhash64("grp", "c").alias("cell"), "role")
    visits = visitors.select("sid", "grp", "c", F.lit(1).alias("role")).unionByName(members.select("sid", "grp", "c", F.lit(0).alias("role")))
    visits = visits.groupBy("sid").agg(F.collect_list(place).alias("visits"))

    # one row brings each class's text: the least (id, hash); rows equal in both bring the same
    distinct = classes.where("key is not null").groupBy("key", "sid").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "hash")).alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = scratch.save(distinct, "distinct")
    need = distinct.join(visits, "sid").select("key", "copies", "visits", F.col("rep.doc_id").alias("_id"), F.col("rep.hash").alias("_hash"))
    one = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    brought = texts.where("text is not null").join(need.hint("shuffle_hash"), one).select("text", "key", "copies", "visits")
    placed = brought.mapInArrow(_visits(words), VISITS).repartition("cell").sortWithinPartitions("cell", "role", "key")
    links = scratch.save(placed.mapInArrow(_verify(percent), LINKS), "links", rows=ROWS)
    scratch.drop("grouped", "queries", "cells", "sizes")

    roots = components(spark, links.select("a", "b"), scratch)
    counted = links.where("links > 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "key")
    by_key = distinct.select("key", "least", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").join(counted, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = by_key.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = by_key.join(named, "root").select("key", "copies", "component_id", "links")
    out = classes.join(by_key, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("class_size"),
    )
    out = scratch.save(out, "result")
    scratch.drop("classes", "distinct", "links")
    return out
