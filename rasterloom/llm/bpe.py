"""BPE encoding with reuse of content-defined chunks, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import U64, mix, powers, slices, span_hashes, utf8
from rasterloom.llm.tokens import VOCABULARY, encoding
from rasterloom.session import ensure_importable

#: Bytes under the rolling hash, bits of it that are zero at a boundary (chunks of 2^BITS bytes on average), bytes of chunks that a worker keeps (twice at most).
WINDOW, BITS, KEPT = 24, 9, 24 << 20

#: Places at which the pre-tokenizer splits whatever surrounds them: from a visible character to white space, from a letter to a digit or a sign, from a digit to a letter or a sign, and from an ideograph or kana to a full-width sign. No alternative of its pattern goes on over one, none looks back, and the character before isn't white space, so nothing on the left waits for what follows. The encodings on either side are independent. The classes are spelled out, as libraries differ on rare characters.
_SIGN, _WIDE = r"!-/:-@\[-`{-~", r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_PLACE = rf"(?:(?<=[!-~\u00c0-\u00d6\u00d8-\u00f6{_WIDE}])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9{_SIGN}])|(?<=[0-9])(?=[A-Za-z{_SIGN}])|(?<=[{_WIDE}])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]))"
_FIRST, _LAST = regex.compile(_PLACE), regex.compile("(?r)" + _PLACE)
_STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def boundaries(data: np.ndarray, off: np.ndarray, window: int = WINDOW, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Start of all chunks, and where each text's begin. A chunk begins at the first character after a byte at which the hash of the last `window` bytes of the same text has `bits` zeros."""
    n = len(data)
    p, q = powers(n + 1)
    h = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[:n], out=h[1:])
    hit = np.zeros(n + 1, bool)
    if n >= window:
        r = mix((h[window:] - h[:-window]) * q[: n + 1 - window])
        hit[window:] = r >> U64(64 - bits) == 0
    begin, size = off[:-1], np.diff(off)
    for k in range(window):  # the window lies inside one text
        at = begin + k
        hit[at[at <= n]] = False
    hit[off] = False
    at = np.flatnonzero(hit)
    while len(at):  # on to the start of a character
        inside = ~_STARTS[data[np.minimum(at, max(n - 1, 0))]] & (at < n)
        if not inside.any():
            break
        at = at + inside
    s = np.unique(np.concatenate((at, begin[size > 0])))
    s = s[s < n]
    return s, np.searchsorted(s, off)


class Chunks:
    """Encodes each chunk once as long as it is kept: head and tail are text, what lies between the first and the last agreed place is tokens."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.encode = encoding(path).encode_ordinary
        self.kept, self.size = kept, 0
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def get(self, chunk: bytes) -> tuple[str, np.ndarray | None, str]:
        x = self.new.get(chunk)
        if x is None:
            x = self.old.get(chunk)
            if x is None:
                x = self.make(chunk.decode("utf-8", "surrogatepass"))
            self.new[chunk] = x
            self.size += len(chunk)
            if self.size > self.kept:
                self.old, self.new, self.size = self.new, {}, 0
        return x

    def make(self, text: str) -> tuple[str, np.ndarray | None, str]:
        first = _FIRST.search(text)
        if not first:
            return text, None, ""
        i, j = first.start(), _LAST.search(text).start()
        return text[:i], np.array(self.encode(text[i:j]), np.int32), text[j:]

    def document(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of the whole text. A join is re-encoded from the last agreed place before it to the first one after it, over as many chunks as that takes."""
        out, open_text = [], ""
        for c in chunks:
            head, body, tail = self.get(c)
            open_text += head
            if body is None:
                continue
            if open_text:
                out.append(np.array(self.encode(open_text), np.int32))
            out.append(body)
            open_text = tail
        if open_text:
            out.append(np.array(self.encode(open_text), np.int32))
        return np.concatenate(out) if out else np.zeros(0, np.int32)


_WORKER: dict[tuple, Chunks] = {}


def nearest_chunk(text: Column) -> Column:
    """The least hash of a text's chunks: texts that share most chunks mostly share it too (0 for no text)."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t"):
            data, off = utf8(part.column("t"))
            s, first = boundaries(data, off)
            least = np.zeros(len(off) - 1, np.int64)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                h = span_hashes(data, s, np.append(s[1:], len(data)))
                least[some] = (np.minimum.reduceat(h, first[:-1][some]) >> U64(1)).astype(np.int64)
            out.append(least)
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return run(text)


def _encode(path: str, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _WORKER.get((path, kept)) or _WORKER.setdefault((path, kept), Chunks(path, kept))
        for part in slices(batches, "text"):
            data, off = utf8(part.column("text"))
            s, first = boundaries(data, off)
            raw, cuts = data.tobytes(), [*s.tolist(), len(data)]
            rows = [own.document([raw[cuts[k] : cuts[k + 1]] for k in range(i, j)]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            size = np.array([len(r) for r in rows], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *rows])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat))],
                ["doc_id", "n_tokens", "tokens"],
            )

    return run


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, kept: int = KEPT) -> DataFrame:
    """doc_id, n_tokens, tokens (array<int>): each row's whole text in byte-level BPE, the same as encoding it at once.

    Texts are cut where a rolling hash of their last bytes says so, and a worker encodes equal chunks once. Rows are brought together by their least chunk hash, so texts that share chunks meet in one task; AQE splits a task that becomes too large, which costs reuse but nothing else. A chunk's tokens are taken from its first to its last agreed place; the text of each join between those is encoded again.

    Cases: null or empty text: no tokens. Long texts are encoded whole. Rows without doc_id and repeated rows are encoded like any other. Empty table: empty result; other columns are ignored.
    """
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", nearest_chunk(F.col("text")).alias("near"))
    return rows.hint("rebalance", "near").select("doc_id", "text").mapInArrow(_encode(vocabulary, kept), "doc_id long, n_tokens long, tokens array<int>")


def decoded(tokens: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of token ids; null for null."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        d = encoding(vocabulary)
        return pa.array([None if t is None else d.decode_bytes(t).decode("utf-8", "replace") for t in lists.to_pylist()], pa.string())

    return run(tokens)
