"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import U64, mix, slices, utf8
from rasterloom.session import ensure_importable

#: Character n-grams, buckets, rows a language gives to training (about; drawn by hash of doc_id), additive smoothing.
NS, BUCKETS, PER_LANGUAGE, ALPHA = (2, 3, 4), 1 << 16, 2000, 0.1
#: By how many nats a gram (plus NOISE / sqrt(grams)) a text may be rarer than its language's usual text: SLACK, or what calibrated() finds on HELD tenths of the training rows, if these hold CALIBRATE texts of LONG grams. It refuses CLEAN of them at most.
SLACK, NOISE, HELD, CALIBRATE, LONG, CLEAN = 3.5, 6.0, 2, 50, 64, 0.001
#: Bytes of the model up to which it is broadcast: 512 languages of BUCKETS.
MOST = BUCKETS * 512 * 4
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point below 65,536 whether it belongs to a word: letters and marks."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(1 << 16)])


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts that lie end to end, and where each text's begin."""
    lead = (data & 0xC0) != 0x80
    s = np.flatnonzero(lead)
    x = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    a, b, c, d = (x[s + k] & (0x3F if k else 0xFF) for k in range(4))
    code = np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
    return code, np.concatenate(([0], np.cumsum(lead)))[off]


def words_only(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of other characters than letters made one space."""
    letter = _letters()[np.minimum(code, 0xFFFF)]
    high = np.flatnonzero(code > 0xFFFF)
    if len(high):
        kinds, which = np.unique(code[high], return_inverse=True)
        letter[high] = np.array([unicodedata.category(chr(min(int(c), 0x10FFFF)))[0] in "LM" for c in kinds])[which]
    code = np.where(letter, code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1]
    keep[off[:-1][off[:-1] < len(code)]] = True
    return code[keep], np.concatenate(([0], np.cumsum(keep)))[off]


@dataclass
class Model:
    """languages, their prior and typical mean score, the log-probability matrix (a row a bucket), and the slack of accepted texts."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray
    usual: np.ndarray
    slack: float = SLACK


def features(arr: pa.Array, buckets: int = BUCKETS, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the column: first row, end row, buckets of all grams, and where each text's begin."""
    row = 0
    for part in slices(iter([pa.RecordBatch.from_arrays([arr], ["t"])]), "t", max_bytes):
        to = row + part.num_rows
        yield row, to, *gram_buckets(*words_only(*characters(*utf8(part.column("t"), lower=True))), buckets)
        row = to


def gram_buckets(code: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every text (those of one text together, by n and place), and where each text's begin. buckets: a power of two."""
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)
    counts = [np.maximum(size - n + 1, 0) for n in NS]
    start = np.concatenate(([0], np.cumsum(np.sum(counts, axis=0))))
    out, base = np.empty(start[-1], np.int64), start[:-1].copy()
    v = np.zeros(len(code), U64)
    for j in range(max(NS)):  # v: hash of the next j + 1 characters
        v = v[: len(code) - j] * U64(0x9FB21C651E98DF25) + code[j:].astype(U64) + U64(1) if len(code) > j else v[:0]
        if j + 1 in NS:
            inside = np.arange(len(v)) + j < off[1:][doc[: len(v)]]
            h = (mix(v[inside] + U64(j + 1)) >> U64(65 - buckets.bit_length())).astype(np.int64)
            c = counts[NS.index(j + 1)]
            out[np.arange(len(h)) + np.repeat(base - (np.cumsum(c) - c), c)] = h
            base += c
    return out, start


def scores(model: Model, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of every text in every language, and its number of grams."""
    n, k = len(arr), len(model.languages)
    out, grams = np.zeros((n, k)), np.zeros(n, np.int64)
    for lo, hi, h, start in features(arr, len(model.matrix)):
        c = np.diff(start)
        grams[lo:hi] = c
        some = np.flatnonzero(c)
        if len(some):
            out[lo + some] = np.add.reduceat(model.matrix[h], start[:-1][some], axis=0, dtype=np.float64)
    return out, grams


def decide(model: Model, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language (-1: undetermined), its mean lead over the second a gram, grams, and whether it is accepted."""
    n = len(arr)
    if not model.languages:
        return np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
    s, grams = scores(model, arr)
    with_prior = s + model.prior
    best = with_prior.argmax(axis=1)
    g = np.maximum(grams, 1)
    order = np.sort(with_prior, axis=1)
    lead = (order[:, -1] - order[:, -2]) / g if s.shape[1] > 1 else np.zeros(n)
    ok = (grams > 0) & (rarity(model, s, best, g) <= model.slack)
    return np.where(ok, best, -1), np.where(grams > 0, lead, 0.0), grams, ok


def rarity(model: Model, s: np.ndarray, best: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """By how many nats a gram texts are rarer than the usual text of their best language, less what chance does to short ones."""
    return model.usual[best] - s[np.arange(len(s)), best] / grams - NOISE / np.sqrt(grams)


def junk_of(texts: pa.Array) -> pa.Array:
    """The texts with the letters of each in random order (the same for the same text), spaces where they were: no language, though its letters are as frequent."""
    out = []
    for t in texts.to_pylist():
        code, _ = words_only(*characters(*utf8(pa.array([t], pa.string()), lower=True)))
        at = np.flatnonzero(code != 32)
        code[at] = code[np.random.default_rng(len(code)).permutation(at)]
        out.append("".join(map(chr, code.tolist())))
    return pa.array(out, pa.string())


def slack_between(clean: np.ndarray, junk: np.ndarray) -> float:
    """The slack that lets all but CLEAN of the clean rarities pass, or half way from there to the rarity that all but CLEAN of the junk exceed, if that is higher."""
    most = float(np.quantile(clean, 1 - CLEAN))
    return max(most, (most + float(np.quantile(junk, CLEAN))) / 2)


def _model(languages: list[str], counts: np.ndarray, alpha: float, prior: np.ndarray, slack: float = SLACK) -> Model:
    total = counts.sum(axis=1, keepdims=True)
    logp = np.log((counts + alpha) / (total + alpha * counts.shape[1]))
    return Model(languages, np.ascontiguousarray(logp.T).astype(np.float32), prior, (counts * logp).sum(axis=1) / np.maximum(total[:, 0], 1), slack)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, alpha: float = ALPHA) -> Model:
    """A model of about per_language labelled rows of each language (text and lang not null), drawn by hash of doc_id. Counting is distributed and sparse; what reaches the driver is a table of languages x buckets at most, and two figures for each held-out text.

    HELD tenths of the sample are held out to calibrate the slack on: under a model of the others, the rarity of these texts against that of junk made of them. The final model counts all of the sample. ValueError if the model were larger than MOST bytes (too many labels for languages).
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    labelled = docs.filter("lang is not null and text is not null").select("lang", "text", "doc_id")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    have = {r["lang"]: r["n"] for r in sizes.limit(MOST // (4 * buckets) + 1).collect()}
    languages = sorted(have)
    if len(languages) * buckets * 4 > MOST:
        raise ValueError(f"more than {MOST // (4 * buckets)} languages")
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), np.zeros(0))
    index = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, per_language / have[name]) * 1_000_000))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")]).select(index[F.col("lang")].alias("k"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) < HELD).cast("int").alias("held"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = (b.column("held").to_numpy() * len(languages) + b.column("k").to_numpy()).astype(np.int64)
            for lo, hi, h, start in features(b.column("text"), buckets):
                cell, n = np.unique(np.repeat(k[lo:hi], np.diff(start)) * buckets + h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    table = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * len(languages) * buckets)
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    seen, held = counts.reshape(2, len(languages), buckets)
    prior = np.log(np.array([have[x] for x in languages]) / sum(have.values()))
    shared = spark.sparkContext.broadcast(_model(languages, seen, alpha, prior))

    def rarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            columns = []
            for texts in (b.column("text"), junk_of(b.column("text"))):
                s, grams = scores(m, texts)
                columns.append(rarity(m, s, (s + m.prior).argmax(axis=1), np.maximum(grams, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["clean", "junk"]).filter(pa.array(grams >= LONG))

    tried = sample.filter("held = 1").select("text").mapInArrow(rarities, "clean double, junk double").toArrow()
    enough = tried.num_rows >= CALIBRATE and (seen.sum(axis=1) > 0).all()
    return _model(languages, seen + held, alpha, prior, slack_between(tried.column("clean").to_numpy(), tried.column("junk").to_numpy()) if enough else SLACK)


def language(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column struct<lang, lead, n_grams, accepted> of docs's text; the model is broadcast (train() bounds its size)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,lead:double,n_grams:long,accepted:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        best, lead, grams, ok = decide(m, texts)
        names = pa.array([*m.languages, UNDETERMINED]).take(pa.array(np.where(best < 0, len(m.languages), best)))
        return pa.StructArray.from_arrays([names, pa.array(np.round(lead, 6)), pa.array(grams), pa.array(ok)], ["lang", "lead", "n_grams", "accepted"])

    return run(docs[text])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang (predicted), lead (nats a gram over the second language), n_grams, accepted, one row for each row of docs.

    Multinomial naive Bayes over the hashed 2- to 4-grams of characters of the lower-case text, where each run of all but letters (and marks) is one space. A text is accepted if its grams aren't rarer than those of its language's usual text by more than the model's slack; otherwise, and without grams, lang is "und".

    Cases: null or empty text, or none but spaces: no grams or a few, "und", not accepted. Long texts are scored whole. Repeated rows and rows without doc_id are scored like any other. Ties go to the language first by name. Without labelled rows there is no language and every row is "und". Empty table: empty result; other columns are ignored.
    """
    model = model or train(docs)
    return docs.select("doc_id", language(docs, model).alias("x")).select("doc_id", "x.*")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs whose language is accepted, with their columns; cases as in identify()."""
    model = model or train(docs)
    return docs.filter(language(docs, model)["accepted"])
