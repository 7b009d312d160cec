"""Byte-level BPE encoding of a corpus by an index from pairs to their occurrences.

The texts of one task are cut into pre-tokens, distinct pre-tokens not met before are laid out in
one flat array of byte symbols, and every adjacent pair that is a merge goes into an index: merge
rank -> all positions of that pair. Ranks are applied in ascending order, each to all its positions
at once; the merged symbols' neighbours form new pairs, which join the lists of their own ranks.
A pair with the symbol of rank r can only have been learned after r, so a rank once applied never
becomes active again.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the published pre-token pattern of this tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_SHIFT = 20
_BLOCK_CHARS = 4_000_000
_CACHE_WORDS = 300_000


def _printable_bytes() -> dict[str, int]:
    """The tokenizer file writes each byte as one printable character; this maps them back."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexEncoder:
    """Encodes texts with the merges of a byte-level BPE tokenizer file (JSON)."""

    def __init__(self, path: str = TOKENIZER, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for ch, b in _printable_bytes().items():
            self.byte_ids[b] = vocab[ch]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        keys = (left << _SHIFT) | right
        order = np.argsort(keys, kind="stable")
        self._keys = np.append(keys[order], np.int64(2**62))
        self._rank = np.append(order, -1).astype(np.int32)
        self._left = left.astype(np.int32)
        self._right = right.astype(np.int32)
        self._new = np.fromiter((vocab[a + b] for a, b in pairs), np.int32, len(pairs))
        self._split = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self._index: dict[str, int] = {}
        self._ids = np.zeros(0, np.int32)
        self._ends = np.zeros(1, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << _SHIFT) | right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._rank[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return np.zeros(0, np.int32), sizes
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.arange(1, n + 1)
        prv = np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        sized = sizes > 0
        nxt[ends[sized] - 1] = -1
        prv[(ends - sizes)[sized]] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n, -1, np.int32)
        first = np.flatnonzero(nxt >= 0)
        rank_at[first] = self._ranks(sym[first], sym[nxt[first]])

        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(at: np.ndarray) -> None:
            ranks = rank_at[at]
            at = at[ranks >= 0]
            if not len(at):
                return
            ranks = rank_at[at]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for hi in (*cuts.tolist(), len(at)):
                r = int(ranks[lo])
                have = places.get(r)
                if have is None:
                    places[r] = [at[lo:hi]]
                    heapq.heappush(active, r)
                else:
                    have.append(at[lo:hi])
                lo = hi

        enlist(first)
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r)
            at = np.unique(lists[0] if len(lists) == 1 else np.concatenate(lists))
            at = at[rank_at[at] == r]
            if not len(at):
                continue
            if self._left[r] == self._right[r] and len(at) > 1:
                starts = np.append(True, nxt[at[:-1]] != at[1:])
                group = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - group) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self._new[r]
            alive[gone] = False
            rank_at[gone] = -1
            rank_at[at] = -1
            nxt[at] = after
            linked = after >= 0
            prv[after[linked]] = at[linked]
            before = prv[at]
            touched = np.concatenate([at[linked], before[before >= 0]])
            if len(touched):
                rank_at[touched] = self._ranks(sym[touched], sym[nxt[touched]])
                enlist(touched)
        kept = np.append(0, np.cumsum(alive))
        return sym[alive], kept[ends] - kept[ends - sizes]

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        base = len(self._index)
        self._index.update(zip(words, range(base, base + len(words)), strict=True))
        self._ids = np.concatenate([self._ids, ids])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one int32 array, and where each text's ids begin (one entry more)."""
        words = [self._split(t) if t else [] for t in texts]
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        if len(self._index) > _CACHE_WORDS:
            self._clear()
        unseen = list(set(flat) - self._index.keys())
        if unseen:
            self._learn(unseen)
        at = np.fromiter(map(self._index.__getitem__, flat), np.int64, len(flat))
        sizes = self._ends[at + 1] - self._ends[at]
        ends = np.append(0, np.cumsum(sizes))
        ids = self._ids[np.repeat(self._ends[at] - ends[:-1], sizes) + np.arange(ends[-1])] if len(flat) else self._ids[:0]
        return ids, ends[np.append(0, np.cumsum(per_text))]


_ENCODERS: dict[tuple[str, str], PairIndexEncoder] = {}


def _encoder(path: str, pattern: str) -> PairIndexEncoder:
    """One encoder, with what it has learned, per worker process."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PairIndexEncoder(path, pattern)
    return _ENCODERS[key]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """The batch's ids and texts in runs of some million characters; a longer text is a run of its own."""
    texts = batch.column(1).to_pylist()
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _BLOCK_CHARS or i + 1 == len(texts):
            yield batch.column(0).slice(lo, i + 1 - lo), texts[lo : i + 1]
            lo, size = i + 1, 0


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(id, ids)``: the token ids of every text, without special tokens; one output row per input row.

    Null and empty texts give an empty list. The name of a special token inside a text is ordinary
    text. Other columns are ignored; repeated ids give repeated rows. Whole texts are encoded, of any
    length; a task holds one Arrow batch of texts and a word cache of bounded size. No shuffle.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, pattern)
        for batch in batches:
            for keys, texts in _blocks(batch):
                ids, ends = enc.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys, lists], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(id, n_tokens)``: the number of token ids of every text, 0 for null and empty ones."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, pattern)
        for batch in batches:
            for keys, texts in _blocks(batch):
                _, ends = enc.encode(texts)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ends))], names=[id_col, "n_tokens"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)
