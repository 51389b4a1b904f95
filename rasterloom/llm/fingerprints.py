"""Document fingerprints: context-triggered piecewise hashing, compared by edit distance at compatible block sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.grouping import Groups, gathered, whole_groups
from rasterloom.llm.text import U64, mix, span_hashes, utf8
from rasterloom.session import cut, ensure_importable

#: Window of the rolling hash, smallest block, characters of a signature, common substring that a match needs, least score.
WINDOW, SMALLEST, LENGTH, COMMON, SCORE = 7, 3, 64, 7, 50
#: Bytes from which equal texts match whatever their signature: as many as COMMON of the smallest blocks. Shorter texts are left to the signatures.
COPY = SMALLEST * COMMON
#: Holders of one substring that a task compares with each other; more are compared in a grid of such parts.
PART = 2048
#: Rows of a cell whose pairs are found at once, and pairs that a task holds until it compares them.
STRIP, HELD = 256, 1 << 20
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_LEVELS = 31


def rolling(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The 32-bit rolling hash after every byte; its window is empty at a text's start."""
    size = np.diff(off)
    pad = WINDOW - 1
    shift = np.repeat(np.arange(1, len(size) + 1) * pad, size)
    at = np.arange(len(data)) + shift
    c = np.zeros(len(data) + pad * (len(size) + 1), np.uint32)
    c[at] = data
    n = len(c)
    out, shifts, x = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.empty(n, np.uint32)
    for k in range(WINDOW):
        out[k:] += np.multiply(c[: n - k], np.uint32(1 + WINDOW - k), out=x[k:])
        shifts[k:] ^= np.left_shift(c[: n - k], np.uint32(5 * k), out=x[k:])
    out += shifts
    return out[at]


def signatures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Block size and both signatures (at the block size and at twice of it) of each text.

    A byte ends a chunk if its rolling hash is one below a multiple of the block size, SMALLEST times a power of two: the smallest with which LENGTH chunks would cover the text, halved while fewer than half as many end. A chunk gives one character of its hash; the last character covers all that is left.
    """
    size = np.diff(off)
    docs = len(size)
    m = rolling(data, off) + np.uint32(1)
    pos = np.flatnonzero(m % np.uint32(SMALLEST) == 0)
    q = m[pos] // np.uint32(SMALLEST)
    low = q & (~q + np.uint32(1))
    level = np.where(q == 0, _LEVELS - 1, np.frexp(low.astype(np.float64))[1] - 1)
    doc = np.searchsorted(off, pos, "right") - 1
    table = np.bincount(doc * _LEVELS + level, minlength=docs * _LEVELS).reshape(docs, _LEVELS)
    ends = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
    want = np.maximum(np.ceil(np.log2(np.maximum(size, 1) / (SMALLEST * LENGTH))), 0).astype(np.int64)
    while True:
        few = (want > 0) & (ends[np.arange(docs), want] < LENGTH // 2)
        if not few.any():
            break
        want -= few
    parts = []
    for up, most in ((0, LENGTH), (1, LENGTH // 2)):
        keep = level >= (want + up)[doc]
        p, d = pos[keep], doc[keep]
        first = np.searchsorted(d, np.arange(docs))
        rank = np.arange(len(p)) - first[d]
        keep = rank < most - 1
        p, d, rank = p[keep] + 1, d[keep], rank[keep]
        count = np.bincount(d, minlength=docs)
        begin = np.where(rank == 0, off[d], np.concatenate(([0], p[:-1])) if len(p) else p)
        rest = off[:-1].copy()
        rest[d] = p  # the last one stays
        tail = np.flatnonzero(rest < off[1:])
        s, e, o = np.concatenate((begin, rest[tail])), np.concatenate((p, off[1:][tail])), np.concatenate((d, tail))
        by = np.lexsort((s, o))
        chars = _ALPHABET[(span_hashes(data, s[by], e[by]) >> U64(58)).astype(np.int64)]
        count[tail] += 1
        to = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        parts.append(pa.Array.from_buffers(pa.string(), docs, [None, pa.py_buffer(to), pa.py_buffer(chars.tobytes())]))
    return SMALLEST << want, parts[0], parts[1]


def fingerprint(text: Column, max_bytes: int = 1 << 18) -> Column:
    """struct<block, sig1, sig2> of a text; null for null. About max_bytes at a time, which stay in a core's cache."""

    @F.arrow_udf("struct<block:long,sig1:string,sig2:string>")
    def run(texts: pa.Array) -> pa.Array:
        data, off = utf8(texts)
        parts, row = [], 0
        while row < len(texts):
            to = min(max(row + 1, int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1), len(texts))
            block, s1, s2 = signatures(data[off[row] : off[to]], off[row : to + 1] - off[row])
            parts.append(pa.StructArray.from_arrays([pa.array(block), s1, s2], ["block", "sig1", "sig2"], mask=texts.slice(row, to - row).is_null()))
            row = to
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("block", pa.int64()), ("sig1", pa.string()), ("sig2", pa.string())]))

    return run(text)


def _short_runs(a: np.ndarray) -> np.ndarray:
    """Runs of a character cut to three."""
    if len(a) < 4:
        return a
    return a[np.concatenate((np.ones(3, bool), ~((a[3:] == a[2:-1]) & (a[3:] == a[1:-2]) & (a[3:] == a[:-3]))))]


def _cut_runs(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """_short_runs() of many texts: bytes and offsets."""
    data, off = utf8(column)
    if len(data) > 3:
        run = np.zeros(len(data), bool)
        run[3:] = (data[3:] == data[2:-1]) & (data[3:] == data[1:-2]) & (data[3:] == data[:-3])
        for k in range(3):
            at = off[:-1] + k
            run[at[at < off[1:]]] = False
        off = np.concatenate(([0], np.cumsum(~run)))[off]
        data = data[~run]
    return data, off


def grams_of(block: int, sig1: str, sig2: str) -> np.ndarray:
    """Keys of the COMMON-grams of both signatures with their block sizes."""
    out = []
    for b, s in ((block, sig1), (2 * block, sig2)):
        a = _short_runs(np.frombuffer(s.encode(), np.uint8))
        m = len(a) - COMMON + 1
        if m > 0:
            v = np.zeros(m, U64)
            for j in range(COMMON):
                v = (v << U64(8)) | a[j : j + m]
            out.append(mix(v ^ mix(np.array([b], U64))) >> U64(1))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def substrings(block: np.ndarray, sig1: pa.Array, sig2: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many fingerprints at once, rows sorted and distinct: index of the fingerprint, key as in grams_of(), and the character before the substring (0 at the start)."""
    out = []
    for factor, column in ((1, sig1), (2, sig2)):
        data, off = _cut_runs(column)
        m = max(len(data) - COMMON + 1, 0)
        v = np.zeros(m, U64)
        for j in range(COMMON):
            v = v << U64(8) | data[j : j + m]
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
        before = np.concatenate((np.zeros(1, np.uint8), data))[:m].astype(np.int64)
        before[off[:-1][off[:-1] < m]] = 0
        ok = np.arange(m) + COMMON <= off[1:][doc]
        doc, v, before = doc[ok], v[ok], before[ok]
        out.append((doc, (mix(v ^ mix((factor * block[doc]).astype(U64))) >> U64(1)).astype(np.int64), before))
    doc, key, before = (np.concatenate(x) for x in zip(*out))
    by = np.lexsort((before, key, doc))
    doc, key, before = doc[by], key[by], before[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (before[1:] != before[:-1])
    return doc[new], key[new], before[new]


class Comparer:
    """Scores (0 to 100) of fingerprints with each other, by bit-parallel longest common subsequences over 64-bit words, many pairs at once."""

    def __init__(self, prints: list[tuple[int, str, str]] | pa.Table) -> None:
        """prints: rows of block, sig1 and sig2, or a table with these columns."""
        if not isinstance(prints, pa.Table):
            prints = pa.table({"block": pa.array([p[0] for p in prints], pa.int64())} | {f"sig{k}": pa.array([p[k] for p in prints], pa.string()) for k in (1, 2)})
        n = prints.num_rows
        self.block = prints.column("block").to_numpy()
        self.chars = np.full((n, 2, LENGTH), 64, np.uint8)
        self.size = np.zeros((n, 2), np.int64)
        self._masks: dict[int, np.ndarray] = {}
        code = np.zeros(256, np.uint8)
        code[_ALPHABET] = np.arange(64)
        for k in (0, 1):
            data, off = _cut_runs(prints.column(f"sig{k + 1}"))
            self.size[:, k] = np.diff(off)
            row = np.repeat(np.arange(n), self.size[:, k])
            self.chars[row, k, np.arange(len(data)) - off[row]] = code[data]

    def _places(self, k: int) -> np.ndarray:
        """For signature k of every print and every character the places where it stands, 65 words a print."""
        if k not in self._masks:
            masks, all_rows = np.zeros((len(self.block), 65), U64), np.arange(len(self.block))
            for x in range(LENGTH):
                masks[all_rows, self.chars[:, k, x]] |= U64(1 << x)
            masks[:, 64] = 0
            self._masks[k] = masks.ravel()
        return self._masks[k]

    def _pairs(self, i: np.ndarray, k: int, j: np.ndarray, l: int) -> np.ndarray:  # noqa: E741
        """Scores of signature k of prints i with signature l of prints j."""
        if not len(i):
            return np.zeros(0, np.int64)
        flat, base = self._places(k), i * 65
        m, n = self.size[i, k], self.size[j, l]
        v = np.full(len(i), (1 << 64) - 1, U64)
        theirs = np.ascontiguousarray(self.chars[j, l, : int(n.max())].T)
        at, y, z = np.empty(len(i), np.int64), np.empty(len(i), U64), np.empty(len(i), U64)
        for char in theirs:
            np.add(base, char, out=at)
            np.take(flat, at, out=y, mode="clip")
            y &= v
            np.subtract(v, y, out=z)
            v += y
            v |= z
        full = np.where(m == 64, U64((1 << 64) - 1), (U64(1) << np.minimum(m, 63).astype(U64)) - U64(1))
        common = np.bitwise_count(~v & full).astype(np.int64)
        both = m + n
        score = 100 - 100 * ((both - 2 * common) * LENGTH // np.maximum(both, 1)) // LENGTH
        b = self.block[i] << k
        score = np.where(b < (99 + WINDOW) // WINDOW * SMALLEST, np.minimum(score, b // SMALLEST * np.minimum(m, n)), score)
        return np.where((m > 0) & (n > 0), score, 0)

    def _score(self, i: int, k: int, js: np.ndarray, l: int) -> np.ndarray:  # noqa: E741
        return self._pairs(np.full(len(js), i), k, js, l)

    def hopeful(self, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
        """Whether a pair has signatures of one block size that can score least: signatures of lengths m and n differ by |m - n| edits at least."""
        hope = np.zeros(len(i), bool)
        for k in (0, 1):
            for l in (0, 1):  # noqa: E741
                m, n = self.size[i, k], self.size[j, l]
                hope |= (self.block[j] << l == self.block[i] << k) & (100 - 100 * (np.abs(m - n) * LENGTH // np.maximum(m + n, 1)) // LENGTH >= least)
        return hope

    def of_pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The best score of each pair over the block sizes that both have signatures for."""
        out = np.zeros(len(i), np.int64)
        for k in (0, 1):
            for l in (0, 1):  # noqa: E741
                at = np.flatnonzero(self.block[j] << l == self.block[i] << k)
                out[at] = np.maximum(out[at], self._pairs(i[at], k, j[at], l))
        return out

    def matches(self, i: int, js: np.ndarray, least: int) -> np.ndarray:
        """Whether the scores of i with js are least or more."""
        out = np.zeros(len(js), bool)
        at = np.flatnonzero(self.hopeful(np.full(len(js), i), js, least))
        out[at] = self.scores(i, js[at]) >= least
        return out

    def scores(self, i: int, js: np.ndarray) -> np.ndarray:
        return self.of_pairs(np.full(len(js), i), js)


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, key, before = substrings(b.column("block").to_numpy(), b.column("sig1"), b.column("sig2"))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(before.astype(np.int8)), b.column("id").take(pa.array(doc))], ["gram", "before", "id"])


_LINKED = "u long, v long, cu long, cv long, score double"


def _compare(least: int):
    """Of beside()'s rows the pairs that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, parts, of in gathered(batches):
            score = Comparer(pa.concat_tables([heads, parts])).of_pairs(of, heads.num_rows + np.arange(len(of)))
            keep = score >= least
            if keep.any():
                found = parts.select(["u", "v", "cu", "cv"]).append_column("score", pa.array(score.astype(float)))
                yield from found.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _grid(least: int, chunk: int = 1 << 14):
    """Of the holders of each substring (rows sorted by cell) all pairs in different groups that match. A pair counts only where its common substring begins: where the characters before differ or one is at its start. In a cell of two parts only pairs across them count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            cell, ids, comp, before, part = (t.column(c).to_numpy() for c in ("cell", "id", "comp", "before", "part"))
            edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            own, place, number = np.unique(ids, return_index=True, return_inverse=True)
            prints = Comparer(t.take(pa.array(place)))
            left, right, have = [], [], 0

            def linked() -> Iterator[pa.RecordBatch]:
                i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
                # one print stands in many cells: compare distinct pairs
                pair = np.unique(number[i] * len(own) + number[j])
                i, j = pair // len(own), pair % len(own)
                hope = prints.hopeful(i, j, least)
                i, j = i[hope], j[hope]
                for k in range(0, len(i), chunk):
                    a, b = i[k : k + chunk], j[k : k + chunk]
                    score = prints.of_pairs(a, b)
                    ok = score >= least
                    if ok.any():
                        a, b = a[ok], b[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[a], own[b], comp[place[a]], comp[place[b]], score[ok].astype(float))], ["u", "v", "cu", "cv", "score"])

            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                c, p, s, d = comp[lo:hi], before[lo:hi], part[lo:hi], ids[lo:hi]
                if (c == c[0]).all():
                    continue
                across = bool((s != s[0]).any())
                for at in range(0, hi - lo, STRIP):
                    x = slice(at, at + STRIP)
                    meet = (c[x, None] != c) & ((p[x, None] != p) | (p[x, None] == 0)) & (d[x, None] > d)
                    if across:
                        meet &= s[x, None] != s
                    i, j = np.nonzero(meet)
                    left.append(i + lo + at)
                    right.append(j + lo)
                    have += len(i)
                    if have >= HELD:
                        yield from linked()
                        left, right, have = [], [], 0
            yield from linked()

    return run


def _rest(shared: DataFrame, groups: Groups, least: int) -> DataFrame:
    """(u, v, cu, cv, score): all pairs that share a substring, match, and are still in different groups."""
    rows = shared.join(groups.state.select("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = rows.groupBy("gram").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).filter("a < b").select("gram", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = rows.join(mixed, "gram").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = rows.select("*", other).withColumn("cell", F.xxhash64("gram", F.least("part", "other"), F.greatest("part", "other"))).join(groups.items, "id")
    return cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_grid(least), _LINKED)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, block, sig1, sig2 for each row of docs."""
    ensure_importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("x")).select("doc_id", "x.*")


def matched_fingerprints(docs: DataFrame, least: int = SCORE, copy: int = COPY) -> DataFrame:
    """fingerprints() with, for documents that match others: group_id (the smallest doc_id of all that hang together by matches), partner (a doc_id of the group with another fingerprint that matches this one, the best of those compared with it; null where all partners have the same fingerprint) and score (with the partner, 100 where it is null). Documents without a match have nulls.

    Two fingerprints match if signatures of one block size share COMMON characters in a row and the best edit-distance score over their compatible block sizes is least or more: 100 - 100 * edits / both lengths, edits being insertions and deletions; small blocks cap it by what so short signatures can tell, and equal fingerprints score 100. Every fingerprint is a query; all common substrings are candidates, without a cap; equal fingerprints are compared once, and matches inside a known group aren't repeated.

    Equal texts (of one fingerprint, length and 64-bit hash) of `copy` bytes or more match with score 100 though their signature, with runs cut to three, be shorter than COMMON: a text that repeats one line has such a one.

    Cases: null text: null signatures, no match. Empty text: empty signatures, no match; nor have signatures shorter than COMMON, even if equal, but those of equal texts from `copy` bytes on. Long texts are hashed whole. Repeated rows have the same fingerprint: they match each other if their doc_ids differ. Null doc_id: fingerprint, no match. Empty table: empty result; other columns are ignored.
    """
    ensure_importable(docs.sparkSession)
    # documents of one fingerprint match each other if it is long enough to match at all, others if their texts are equal
    long_enough = F.length(F.regexp_replace("sig1", r"(.)\1{3,}", r"$1$1$1")) >= COMMON
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("x"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash")).select("doc_id", "x.*", "bytes", "hash")
    whole = whole.withColumn("print_id", F.when(F.length("sig1") > 0, F.xxhash64("block", "sig1", "sig2")))
    prints = cut(whole.withColumn("text_id", F.when(~long_enough & (F.col("bytes") >= copy), F.xxhash64("print_id", "bytes", "hash"))).drop("bytes", "hash"), "prints")
    one = cut(prints.filter("print_id is not null and doc_id is not null").groupBy(F.col("print_id").alias("id")).agg(F.first("block").alias("block"), F.first("sig1").alias("sig1"), F.first("sig2").alias("sig2")), "one")
    grams = one.mapInArrow(_substrings, "gram long, before byte, id long").repartition("gram")
    hubs = grams.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    shared = cut(grams.join(hubs.hint("shuffle_hash"), "gram"), "shared")
    groups = Groups(one, lambda rows: rows.mapInArrow(_compare(least), _LINKED))
    # first each substring's holders with its first and its last one, then all that are still apart
    ends = F.array(F.struct(F.lit(1).alias("level"), F.col("a").alias("v")), F.struct(F.lit(0).alias("level"), F.col("b").alias("v")))
    met = shared.select(F.col("id").alias("u"), F.explode(ends).alias("w")).filter("u != w.v")
    groups.descend(met.groupBy("u", F.col("w.v").alias("v")).agg(F.max("w.level").alias("level")))
    groups.merge(_rest(shared, groups, least), 0)
    reps = prints.filter("doc_id is not null").groupBy("print_id").agg(F.min("doc_id").alias("doc"))
    both = groups.links.union(groups.links.select("v", "u", "score")).join(reps.withColumnRenamed("print_id", "v"), "v")
    best = both.groupBy("u").agg(F.min_by(F.struct(F.col("doc").alias("partner"), "score"), F.struct(-F.col("score"), "doc")).alias("x"))
    links = groups.state.join(best.withColumnRenamed("u", "id"), "id").select(F.col("id").alias("print_id"), F.col("comp").alias("group_print"), "x.*")
    rows = prints.join(links, "print_id", "left").withColumn("g", F.when(F.col("doc_id").isNotNull(), F.coalesce("group_print", F.when(long_enough, F.col("print_id")), "text_id")))
    of = rows.filter("g is not null").groupBy("g").agg(F.min("doc_id").alias("group_id"), F.max("doc_id").alias("last")).filter("last > group_id").drop("last")
    return rows.join(of, "g", "left").select("doc_id", "block", "sig1", "sig2", "group_id", F.when(F.col("group_id").isNotNull(), F.col("partner")).alias("partner"), F.when(F.col("group_id").isNotNull(), F.coalesce("score", F.lit(100)).cast("int")).alias("score"))
