"""Secret scans: sliding-window Shannon entropy of candidate strings, by character class."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import runs, slices, utf8
from rasterloom.session import ensure_importable, unused

#: Characters of a candidate, least length, window, and for each class the bits from which a window is a finding.
LEAST, WINDOW = 20, 20
LIMITS = {"hex": 2.75, "alnum": 3.7, "base64": 3.9}
#: Whole candidates that match are no secrets: one letter case without digits (words), digits only, one repeated character, paths.
ALLOW = (r"[a-z]+", r"[A-Z]+", r"[A-Z]?[a-z]+", r"[0-9]+", r"(.)\1*", r"[-_=+/]+", r"[A-Za-z]+(?:[-_/][A-Za-z]+)+")
#: Signs of the poorest random keys of each class (base32 among alnum), and the share of such that TAIL's limits may lose.
SIGNS, TAIL = {"hex": 16, "alnum": 32, "base64": 64}, 0.001
#: Parts of a candidate that are no secrets either: words in any case, also joined (someName, HTTP), with up to four digits behind, and numbers.
PROSE = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,4}|[A-Z]+|[0-9]+)"
MASK = "<SECRET>"

_CAND = np.zeros(256, bool)
_CAND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"]] = True
_PROSE = re.compile(rf"{PROSE}?(?:[-_/+=]{PROSE}?)*")
_PIECES = (("hex", re.compile(r"[0-9a-f]+")), ("hex", re.compile(r"[0-9A-F]+")), ("alnum", re.compile(r"[0-9A-Za-z]+")), ("base64", re.compile(r"[0-9A-Za-z+/]+")))
_DASHED = re.compile(r"(?<![^=_-])(?:[0-9a-f]+(?:[=_-]+[0-9a-f]+)+|[0-9A-F]+(?:[=_-]+[0-9A-F]+)+)(?![^=_-])")
_CLASSES = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+")), ("alnum", re.compile(r"[0-9A-Za-z]+")), ("base64", re.compile(r"[0-9A-Za-z+/=_-]+")))


@lru_cache(8)
def _terms(window: int) -> list[float]:
    """c * log2(c): the entropy of a window of w characters is log2(w) - sum(c log2 c) / w."""
    return [0.0] + [float(c * np.log2(c)) for c in range(1, window + 2)]


def window_entropy(s: str, window: int = WINDOW) -> tuple[float, int]:
    """The highest entropy (bits a character) of a window and the first start with it. Counts are kept incrementally: each step takes one character out and one in. A shorter string is one window."""
    w = min(window, len(s))
    if not w:
        return 0.0, 0
    t = _terms(w)
    counts: dict[str, int] = {}
    total = 0.0
    best, at = -1.0, 0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += t[n + 1] - t[n]
        counts[c] = n + 1
        if i >= w:
            out = s[i - w]
            n = counts[out]
            total += t[n - 1] - t[n]
            counts[out] = n - 1
        if i >= w - 1:
            e = np.log2(w) - total / w
            if e > best + 1e-9:
                best, at = e, i - w + 1
    return round(float(best), 6) + 0.0, at


def class_of(s: str) -> str:
    return next(name for name, p in _CLASSES if p.fullmatch(s))


def pieces(s: str) -> Iterator[tuple[str, str]]:
    """(class, string) of the parts of a run that are judged besides the whole: its maximal hex (one case), alnum and base64 sub-runs, none of which crosses = - _, and neighbouring hex parts between these without them (a UUID)."""
    for kind, p in _PIECES:
        for m in p.finditer(s):
            yield kind, m[0]
    for m in _DASHED.finditer(s):
        yield "hex", re.sub("[=_-]", "", m[0])


@lru_cache(64)
def tail(kind: str, window: int) -> float:
    """The entropy that all but TAIL of random strings of a class reach, one window long, rounded down to 0.05."""
    x = np.sort(np.random.default_rng(1).integers(0, SIGNS[kind], (50_000, window)), axis=1)
    edge = np.concatenate((np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]), axis=1)
    run = np.diff(np.append(np.flatnonzero(edge), x.size))
    total = np.bincount(np.nonzero(edge)[0], run * np.log2(run), len(x))
    return float(np.floor(np.quantile(np.log2(window) - total / window, TAIL) * 20) / 20)


def judged(text: str, window: int, limits: dict[str, float], skip: re.Pattern | None) -> tuple[str, float] | None:
    """Class and entropy if the run is a finding: its own where it passes as a whole, else those of the first part that passes its class's limit."""
    kind = class_of(text)
    bits, _ = window_entropy(text, window)
    if bits >= limits[kind]:
        return kind, bits
    low = {k: min(v, tail(k, window)) for k, v in LIMITS.items()} if limits is LIMITS else limits
    for part_kind, part in pieces(text):
        if len(part) > 1 and np.log2(min(len(part), window)) >= low[part_kind] and not _PROSE.fullmatch(part) and not (skip and skip.fullmatch(part)):
            part_bits, _ = window_entropy(part, window)
            if part_bits >= low[part_kind]:
                return part_kind, part_bits
    return (kind, bits) if bits >= low[kind] and not _PROSE.fullmatch(text) else None


def find(data: np.ndarray, off: np.ndarray, least: int = LEAST, window: int = WINDOW, limits: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW) -> list[tuple[int, int, int, str, str, float]]:
    """(document, first byte, end byte, class, string, entropy) of all findings."""
    limits = limits or LIMITS
    skip = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None
    flags = _CAND[data]
    # a text's end ends its candidates: cut runs at the offsets
    s, e = runs(flags)
    inner = off[1:-1]
    if len(inner) and len(s):
        k = np.searchsorted(s, inner, "right") - 1
        hit = np.unique(inner[(k >= 0) & (inner > s[k]) & (inner < e[k])])
        s, e = np.sort(np.concatenate((s, hit))), np.sort(np.concatenate((e, hit)))
    long = e - s >= least
    s, e = s[long], e[long]
    doc = np.searchsorted(off, s, "right") - 1
    raw, out = data.tobytes(), []
    for d, i, j in zip(doc.tolist(), s.tolist(), e.tolist()):
        text = raw[i:j].decode("ascii")
        if skip and re.fullmatch(skip, text):
            continue
        found = judged(text, window, limits, skip)
        if found:
            out.append((d, i - int(off[d]), j - int(off[d]), found[0], text, found[1]))
    return out


_SCHEMA = "doc_id long, start long, end long, class string, value string, entropy double"


def scan(docs: DataFrame, **parameters) -> DataFrame:
    """One row for each secret: doc_id, start and end (bytes of the UTF-8 text, end exclusive), class, value, entropy.

    A candidate is a maximal run of at least LEAST characters of A-Z a-z 0-9 + / = _ -. Its class is the narrowest of hex (one case), alnum and base64. Its figure is the highest Shannon entropy of any window of WINDOW characters (the run itself if shorter); from the class's limit it is a finding, unless the whole run matches the allow list.

    A run that isn't one as a whole is judged by its parts, each at the limit of its own class: maximal hex, alnum and base64 sub-runs, cut at = - _ (key=<hex>, sk-<hex>), and neighbouring hex parts together (a UUID). Parts that match the allow list or are words or numbers (PROSE) don't count. Without limits given, a run that isn't prose as a whole and its parts are findings from the low tail of random strings on, too (tail()), since short keys often miss LIMITS; prose is held to LIMITS. The row then has the part's class and entropy; start, end and value stay those of the run, all of which is masked.

    Cases: null or empty text: no rows. Long texts and runs are scanned whole. Repeated rows give their findings each time; a null doc_id stays null. Equal windows: the first counts. Empty table: empty result; other columns are ignored.
    """
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = find(*utf8(part.column("text")), **parameters)
            if rows:
                d, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), *map(pa.array, rest)], ["doc_id", "start", "end", "class", "value", "entropy"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _mask(texts: pa.Array, mask: str, parameters: dict) -> pa.Array:
    hits: dict[int, list[tuple[int, int]]] = {}
    data, off = utf8(texts)
    for d, i, j, *_ in find(data, off, **parameters):
        hits.setdefault(d, []).append((i, j))
    if not hits:
        return texts
    out = texts.to_pylist()
    for d, spans in hits.items():
        s, at, parts = data[off[d] : off[d + 1]].tobytes(), 0, []
        for i, j in spans:
            parts += [s[at:i], mask.encode()]
            at = j
        out[d] = b"".join([*parts, s[at:]]).decode()
    return pa.array(out, texts.type)


def masked(text: Column, mask: str = MASK, **parameters) -> Column:
    """The text with every secret replaced by the mask; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts = [_mask(p.column("t"), mask, parameters) for p in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t")]
        return pa.concat_arrays(parts) if parts else texts

    return run(text)


def redact(docs: DataFrame, **parameters) -> DataFrame:
    """docs with the secrets in text masked and n_chars, where there is such a column, counted again for texts that changed; all rows and columns stay, whatever the columns' names. Cases as in scan()."""
    ensure_importable(docs.sparkSession)
    old = unused(docs, "old")
    clean = docs.withColumn(old, F.length("text")).withColumn("text", masked(F.col("text"), **parameters))
    if "n_chars" in docs.columns:
        changed = F.length("text") != F.col(old)  # null for a null text
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*[f"`{c}`" for c in docs.columns])


def oracle(least: int = LEAST, window: int = WINDOW, table: str = "documents") -> str:
    """The judgement of whole runs as DuckDB SQL: scan() where no run is a finding by its parts alone."""
    allow = "|".join(a for a in ALLOW if "\\1" not in a)
    cls = "[A-Za-z0-9+/=_-]"
    return f"""
WITH pieces AS (
  SELECT doc_id, text, unnest(regexp_extract_all(text, '{cls}{{{least},}}')) AS value,
         generate_subscripts(regexp_extract_all(text, '{cls}{{{least},}}'), 1) AS k
  FROM {table}),
gaps AS (
  SELECT doc_id, text, unnest(regexp_split_to_array(text, '{cls}{{{least},}}')) AS gap,
         generate_subscripts(regexp_split_to_array(text, '{cls}{{{least},}}'), 1) AS k
  FROM {table}),
placed AS (
  SELECT p.doc_id, p.value, sum(strlen(g.gap)) OVER w + coalesce(sum(strlen(p.value)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM pieces p JOIN gaps g ON p.doc_id = g.doc_id AND p.k = g.k
  WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.k)),
kinds AS (
  SELECT doc_id, value, start,
         CASE WHEN regexp_full_match(value, '[0-9a-f]+|[0-9A-F]+') THEN 'hex'
              WHEN regexp_full_match(value, '[0-9A-Za-z]+') THEN 'alnum' ELSE 'base64' END AS class
  FROM placed
  WHERE NOT regexp_full_match(value, '{allow}') AND length(replace(value, left(value, 1), '')) > 0),
scored AS (
  SELECT doc_id, start, value, class,
         round(list_max(list_transform(range(1, length(value) - {window} + 2),
               lambda i: list_aggregate(string_split(substr(value, i, {window}), ''), 'entropy'))), 6) AS entropy
  FROM kinds)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(value) AS BIGINT) AS "end", class, value, entropy
FROM scored
WHERE entropy >= CASE class {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items())} END"""
