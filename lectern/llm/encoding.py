"""Whole-text encoding with public tokenizer files, by distinct word.

Both tokenizers split a text at white space before any merge, so a text's ids are its chunks' ids in turn.
A batch's chunks are dictionary-encoded in Arrow, each distinct one is encoded once by the tokenizers
library, and ids are gathered in numpy. Texts in which a cut could fall inside a run of white space (such
runs are one pre-token) go to the library whole, so results equal encode(text) for every text.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Cuts a text can't hold itself; texts that do are encoded whole.
CUT = "\x01"
_WS = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"\x01|{_WS}[ \n]|\n{_WS}"
#: Characters of text encoded at once, and distinct chunks remembered from batch to batch: both bound memory.
PART_CHARS, MEMO = 12_000_000, 500_000
#: Chunks with a space before them that the library gets as one text: the space keeps them apart as in any text.
JOIN = 128


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """encode(texts) -> (ids, ends): all ids, and where each text's ids end."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.vocabulary = max(self.tok.get_vocab().values()) + 1
        # chunk number k has ids[begins[k]:begins[k + 1]]; the first len(memo) are remembered
        self.memo = pa.array([], pa.large_string())
        self.ids, self.begins = array("I"), array("q", [0])

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per Python worker and file, so that tasks share what it remembers."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _chunks(self, chunks: pa.Array) -> np.ndarray:
        """Places of distinct chunks in the store; those that aren't remembered are only there until the next call."""
        known = len(self.memo)
        del self.begins[known + 1 :], self.ids[self.begins[known] :]
        at = pc.fill_null(pc.index_in(chunks, value_set=self.memo), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        added = chunks.take(pa.array(new))
        apart = pc.and_not(pc.starts_with(added, " "), pc.match_substring_regex(added, _WS + "$")).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)])
        added, joined = added.take(pa.array(order)), int(apart.sum())
        at[new[order]] = np.arange(known, known + len(order))

        sizes = pc.utf8_length(added).to_numpy(zero_copy_only=False)
        cuts, spaced = np.append(np.arange(0, joined, JOIN), joined), added.slice(0, joined).cast(pa.string())
        for k in range(0, len(cuts) - 1, 100):
            own = cuts[k : k + 101]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(own, pa.int32()), spaced), "")
            for x, y, enc in zip(own.tolist(), own[1:].tolist(), self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False), strict=False):
                starts = np.fromiter([p for p, _ in enc.offsets], np.int64, len(enc))
                stops = np.searchsorted(starts, np.cumsum(sizes[x:y])) + len(self.ids)
                self.ids.extend(enc.ids)
                self.begins.extend(stops.tolist())
        for k in range(joined, len(added), 20_000):
            for enc in self.tok.encode_batch(added.slice(k, 20_000).to_pylist(), add_special_tokens=False):
                self.ids.extend(enc.ids)
                self.begins.append(len(self.ids))
        if known < MEMO:
            self.memo = pa.concat_arrays([self.memo, added.slice(0, MEMO - known)])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = pc.match_substring_regex(texts, _UNSAFE)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        easy = pc.if_else(whole, "", texts) if len(odd) else texts
        cut = pc.replace_substring(pc.replace_substring(easy, "\n", f"{CUT}\n{CUT}"), " ", f"{CUT} ")
        lists = pc.split_pattern(cut, CUT)
        first = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        which = self._chunks(coded.dictionary)[which]
        begins = np.array(self.begins, dtype=np.int64)
        n = np.diff(begins)[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = upto[first[1:] - first[0]]
        place = np.repeat((begins[which] - upto[:-1]).astype(np.int32), n)
        place += np.arange(upto[-1], dtype=np.int32)
        flat = np.array(self.ids, dtype=np.uint32)[place]
        if not len(odd):
            return flat, ends
        parts, at, sizes = [], 0, np.diff(ends, prepend=0)
        for i in odd.tolist():
            own = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            begins = ends[i] - sizes[i]
            parts += [flat[at:begins], own]
            at = begins
        parts.append(flat[at:])
        for i, own in zip(odd.tolist(), parts[1::2], strict=True):
            sizes[i] = len(own)
        return np.concatenate(parts), np.cumsum(sizes)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, whatever the engine's batch size: one row at least."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield b.slice(x, y - x)
