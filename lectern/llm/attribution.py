"""Token counts by field and section, from one encoding of the whole document.

A document is rendered as field texts joined by newlines; sections are its lines, and a field is the lines it
spans. Byte-level ids cover the text's bytes exactly, so id lengths give every token's span of characters (all
those it has a byte of) without offset objects; other tokenizers are refused. Tokens and sections, both sorted, are
joined as intervals. The rule for a token over a boundary: it counts for the section that holds most of its
characters, ties to the earlier; a token of line ends only counts for the section before it. Null fields are empty;
a document always has a section. Rows are independent, so repeated rows, equal and null ids stay rows each, and an
empty table gives none. A text is encoded whole, so the longest bounds memory. Columns besides doc_id and the fields
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.decoders import ByteLevel

from .common import lean
from .encoding import Encoder, sliced

RESULT = "doc_id long, n_tokens long, n_sections long, n_crossing long, field_tokens array<long>, section_tokens array<long>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("field_tokens", pa.list_(pa.int64())), ("section_tokens", pa.list_(pa.int64()))])


def id_bytes(encoder: Encoder) -> np.ndarray:
    """Bytes of each id: in a byte-level vocabulary every character stands for one byte."""
    if not hasattr(encoder, "id_bytes"):
        if not isinstance(encoder.tok.decoder, ByteLevel):
            raise ValueError("token spans need a byte-level tokenizer")
        vocab = encoder.tok.get_vocab()
        sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            sizes[i] = len(token)
        encoder.id_bytes = sizes
    return encoder.id_bytes


def attribute(begins: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section and crossing tokens. begins, ends: tokens' characters; stops: ends of sections, without their line ends."""
    if not len(ends):
        return np.zeros(len(stops), dtype=np.int64), 0
    first = np.concatenate([[0], stops[:-1] + 1])  # section starts
    # the section that a token's first character lies in, its line end included
    low = np.searchsorted(first, begins, side="right") - 1
    high = np.searchsorted(first, ends - 1, side="right") - 1
    home, crossing = low.copy(), 0
    for t in np.flatnonzero((ends > stops[low]) & (ends - begins > 1)):  # tokens of a line end and more
        s = np.arange(low[t], high[t] + 1)
        inside = np.minimum(stops[s], ends[t]) - np.maximum(first[s], begins[t])
        home[t] = s[int(np.argmax(inside))] if inside.max() > 0 else low[t]
        crossing += int((inside > 0).sum() > 1 or (inside.max() > 0 and inside.max() < ends[t] - begins[t]))
    return np.bincount(home, minlength=len(stops)), crossing


def _count(path: str, fields: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        sizes = id_bytes(encoder)
        for b in sliced(batches, "rendered"):
            ids, ends = encoder.encode(b.column("rendered"))
            upto = np.concatenate([[0], np.cumsum(sizes[ids])])
            lines = np.stack([b.column(f"_lines{k}").to_numpy(zero_copy_only=False) for k in range(len(fields))], axis=1)
            rows, at = [], 0
            for i, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("rendered").to_pylist(), strict=True)):
                data = np.frombuffer(text.encode(), np.uint8)
                chars = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to a byte
                edges = upto[at : ends[i] + 1] - upto[at]
                stops = np.append(chars[data == 10] - 1, len(text))
                tokens, crossing = attribute(chars[edges[:-1]] - 1, chars[edges[1:] - 1], stops)
                cuts = np.concatenate([[0], np.cumsum(lines[i])])
                by_field = [int(tokens[x:y].sum()) for x, y in zip(cuts, cuts[1:], strict=False)]
                rows.append((doc_id, int(ends[i]) - at, len(stops), crossing, by_field, tokens))
                at = int(ends[i])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT)

    return lean(count)


def token_counts(docs: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """RESULT for docs(doc_id, fields...); field_tokens in the order of fields, section_tokens in that of lines."""
    values = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields}
    lines = [(F.length(v) - F.length(F.replace(v, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(f"_lines{k}") for k, v in enumerate(values.values())]
    rendered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws("\n", *values.values()).alias("rendered"), *lines)
    return rendered.mapInArrow(_count(path, fields), RESULT)
