"""Token ids as Simple-8b words: a selector of four bits and as many ids as fit into the other sixty."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.tokens import VOCABULARY, encode
from rasterloom.session import ensure_importable

U64 = np.uint64
#: Ids of a block: each block starts at a word of its own, whose index is kept.
BLOCK = 128
#: By selector: ids in a word and bits of each. Selectors 0 and 1 are runs of zeros; 15 is an escape: the next word is one raw id of up to 64 bits.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15


_LIMITS = U64(1) << BITS[1:ESCAPE].astype(U64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=U64), "right").astype(np.uint8)
_SMALL[_SMALL > 0] += 1


def selectors(ids: np.ndarray) -> np.ndarray:
    """For each id the first selector that has room for it, 0 for a zero, ESCAPE beyond 30 bits."""
    out = _SMALL[np.minimum(ids, U64(65535)).astype(np.uint16)]
    big = np.flatnonzero(ids > U64(65535))
    if len(big):
        out[big] = np.searchsorted(_LIMITS, ids[big], "right") + 1
    return out


def _best(need: np.ndarray) -> np.ndarray:
    """The selector of a word that begins at each place of blocks (rows): the one that takes most ids. A row's end counts as zeros, so its last word may be short."""
    n = need.shape[1]
    high = {1: need}

    def ahead(k: int) -> np.ndarray:
        """The highest need of the next k places, from two overlapping halves."""
        if k not in high:
            h = 1 << (k - 1).bit_length() - 1
            x, d = ahead(h), k - h
            y = x.copy()
            if d < n:
                np.maximum(y[:, : n - d], x[:, d:], out=y[:, : n - d])
            high[k] = y
        return high[k]

    out = np.full(need.shape, ESCAPE, np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        out[ahead(int(COUNT[s])) <= (s if s > 1 else 0)] = s
    return out


def pack(ids: np.ndarray, block_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids (uint64), and the number of words of each block; block_of has the bounds of the blocks (a first 0, a last len(ids)).

    All blocks advance together: step by step each one's next word is the selector with most ids that fit; a word may be short only at its block's end.
    """
    ids = ids.astype(U64)
    size = np.diff(block_of)
    blocks, wide = len(size), int(size.max(initial=0))
    if not wide:
        return np.zeros(0, U64), np.zeros(blocks, np.int64)
    inside = np.arange(wide) < size[:, None]
    need = np.zeros((blocks, wide), np.uint8)
    need[inside] = selectors(ids)
    best = _best(need)
    cursor, filled = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    live = np.flatnonzero(size > 0)
    steps = []
    while len(live):
        at = cursor[live]
        sel = best[live, at]
        steps.append((live, at, sel, filled[live]))
        cursor[live] = at + COUNT[sel]
        filled[live] += 1 + (sel == ESCAPE)
        live = live[cursor[live] < size[live]]
    own, at, sel, place = (np.concatenate(c) for c in zip(*steps))
    begin = np.cumsum(filled) - filled
    start = block_of[own] + at
    width = np.minimum(COUNT[sel], size[own] - at)
    words = sel.astype(U64) << U64(60)
    for s in range(2, ESCAPE):
        rows = np.flatnonzero(sel == s)
        for j in range(COUNT[s]):
            rows = rows[width[rows] > j]
            if not len(rows):
                break
            words[rows] |= ids[start[rows] + j] << U64(j * int(BITS[s]))
    out = np.zeros(int(filled.sum()), U64)
    to = begin[own] + place
    out[to] = words
    raw = sel == ESCAPE
    out[to[raw] + 1] = ids[start[raw]]
    return out, filled


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids again. offsets: the first word of every block; words of one selector are decoded together."""
    words = words.astype(U64)
    out = np.zeros(n, U64)
    if not n:
        return out
    end = np.append(offsets[1:], len(words))
    # the raw word after an escape is no word of its own; blocks step together to find it
    cursor, filled = offsets.astype(np.int64).copy(), np.arange(len(offsets), dtype=np.int64) * block
    limit = np.minimum(filled + block, n)
    live = np.arange(len(offsets))
    while len(live):
        w, to = words[cursor[live]], filled[live]
        sel = (w >> U64(60)).astype(np.int64)
        raw = sel == ESCAPE
        width = np.where(raw, 1, np.minimum(COUNT[sel], limit[live] - to))
        out[to[raw]] = words[cursor[live][raw] + 1]
        for s in np.unique(sel[~raw]):
            if s < 2:
                continue
            rows = sel == s
            j = np.arange(COUNT[s])
            v = (w[rows][:, None] >> (U64(BITS[s]) * j.astype(U64))) & U64((1 << int(BITS[s])) - 1)
            keep = j < width[rows][:, None]
            out[(to[rows][:, None] + j)[keep]] = v[keep]
        cursor[live] += 1 + raw
        filled[live] += width
        live = live[cursor[live] < end[live]]
    return out


def _blocks(count: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all blocks of lists of these lengths, and the number of blocks of each list."""
    per = -(-count // block)
    first = np.cumsum(per) - per
    inner = np.arange(int(per.sum())) - np.repeat(first, per)
    base = np.repeat(np.cumsum(count) - count, per)
    return np.append(base + inner * block, int(count.sum())), per


_TYPE = "struct<n_tokens:long,offsets:array<int>,words:binary>"


def _struct(ids: np.ndarray, count: np.ndarray, block: int) -> pa.StructArray:
    bounds, per = _blocks(count, block)
    words, size = pack(ids, bounds)
    owner = np.repeat(np.arange(len(count)), per)
    per_list = np.bincount(owner, weights=size, minlength=len(count)).astype(np.int64)
    word0 = np.cumsum(per_list) - per_list
    offsets = np.cumsum(size) - size - word0[owner]
    at = np.concatenate(([0], np.cumsum(per)))
    ends = np.concatenate(([0], np.cumsum(per_list * 8))).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(count), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(offsets.astype(np.int32))), pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(words.astype("<u8").tobytes())])],
        ["n_tokens", "offsets", "words"],
    )


def _chunks(texts: pa.Array, rows: int = 128):
    for i in range(0, len(texts), rows):
        yield texts.slice(i, rows)


def packed_text(text: Column, block: int = BLOCK, vocabulary: str = VOCABULARY) -> Column:
    """struct<n_tokens, offsets, words> of a text's token ids."""

    @F.arrow_udf(_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for t in _chunks(texts):
            ids = encode(t, vocabulary)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(array("I", row), np.uint32) for row in ids if row)])
            parts.append(_struct(flat, count, block))
        return pa.concat_arrays(parts) if parts else _struct(np.zeros(0, U64), np.zeros(0, np.int64), block)

    return run(text)


def unpacked(code: Column, block: int = BLOCK) -> Column:
    """The ids of a struct that packed_text made, as array<long>; null stays null."""

    @F.arrow_udf("array<long>")
    def run(codes: pa.Array) -> pa.Array:
        out = []
        for c in codes.to_pylist():
            out.append(None if c is None else unpack(np.frombuffer(c["words"], "<u8"), np.array(c["offsets"], np.int64), c["n_tokens"], block).astype(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return run(code)


def token_words(docs: DataFrame, block: int = BLOCK, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_words, offsets, words: the token ids of every row's text as Simple-8b (64-bit little-endian words), without a shuffle.

    A word holds 240 or 120 zeros, or 60 x 1 bit to 2 x 30 bits; an id beyond 30 bits is an escape and a raw word. Blocks of BLOCK ids begin at a word of their own; offsets has its index, so blocks are decoded in parallel.

    Cases: null or empty text: 0 ids, no words. Long texts are coded whole. Rows without doc_id and repeated rows are coded like any other. Empty table: empty result; other columns are ignored.
    """
    ensure_importable(docs.sparkSession)
    return docs.select("doc_id", packed_text(F.col("text"), block, vocabulary).alias("x")).select("doc_id", "x.n_tokens", (F.octet_length("x.words") / 8).cast("long").alias("n_words"), "x.offsets", "x.words")
