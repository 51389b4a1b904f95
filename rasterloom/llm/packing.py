"""Packing: length buckets that minimise padding over the whole corpus, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm.tokens import VOCABULARY, lengths
from rasterloom.session import cut, ensure_importable

#: Buckets, padded tokens of a batch, lanes over which the numbering of a bucket is spread.
BUCKETS, BUDGET, LANES = 16, 65_536, 1024


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets that minimise the padding sum(count * (bound - length)); exact dynamic programming over the sorted distinct lengths. Of equal costs the one with the lower bounds wins.

    cost(i, j) of one bucket for lengths i < k <= j is L[j] * (N[j] - N[i]) - (S[j] - S[i]); it satisfies the quadrangle inequality, so the best split moves right with j and a layer is found by divide and conquer, level by level and vectorised.
    """
    m = len(length)
    if m == 0:
        return []
    whole = int(max(length)) * int(sum(count.tolist()))
    kind = np.int64 if whole < 1 << 61 else object  # Python's integers for what 64 bits don't hold: no cost is rounded
    L, count = np.concatenate(([0], length)).astype(kind), np.asarray(count).astype(kind)
    N = np.concatenate(([0], np.cumsum(count))).astype(kind)
    S = np.concatenate(([0], np.cumsum(L[1:] * count))).astype(kind)
    best = L * N - S
    best[0] = 0
    splits = []
    for _ in range(1, min(buckets, m)):
        new, arg = np.full(m + 1, 2 * whole + 1).astype(kind), np.zeros(m + 1, np.int64)
        new[0] = 0
        lo, hi, a, b = (np.array([v]) for v in (1, m, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(b, j - 1) - a + 1
            first = np.cumsum(size) - size
            i = np.arange(int(size.sum())) + np.repeat(a - first, size)
            to = np.repeat(j, size)
            c = best[i] + L[to] * (N[to] - N[i]) - (S[to] - S[i])
            new[j] = np.minimum.reduceat(c, first)
            equal = np.flatnonzero(c == new[to])
            k = arg[j] = i[equal[np.searchsorted(equal, first)]]
            left, right = lo < j, j < hi
            lo, hi, a, b = (np.concatenate((x[left], y[right])) for x, y in ((lo, j + 1), (j - 1, hi), (a, k), (k, b)))
        splits.append(arg)
        best = new
    out, j = [], m
    for arg in reversed(splits):
        out.append(int(length[j - 1]))
        j = int(arg[j])
        if j == 0:
            break
    if j:
        out.append(int(length[j - 1]))
    return sorted(out)


def token_length(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for null."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(lengths(texts, vocabulary))

    return run(text)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, lanes: int = LANES, vocabulary: str = VOCABULARY, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot, padding: every row of docs in a batch.

    The bucket bounds are optimal for the histogram of all lengths as they are. A bucket's rows are ordered by (doc_id modulo lanes, doc_id) and cut into batches of as many as fit into the budget at the bucket's length, one at least. batch counts from 0 inside a bucket, slot inside a batch; padding is bucket_len - n_tokens.

    The lengths are computed once and written. The histogram goes to the driver: t tokens have less than sqrt(2 t) distinct lengths above 0, whatever the corpus holds; numbering is spread over lanes, whose totals alone are summed in order.

    Cases: null or empty text: length 0. A text longer than the budget is a batch of its own, whole. Null doc_id: in lane 0, first. Repeated rows are packed each; ties are told apart by length. Empty table: empty result; other columns are ignored.
    """
    ensure_importable(docs.sparkSession)
    size = length if length is not None else token_length(F.col("text"), vocabulary)
    lens = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("n_tokens")), "lengths")
    histogram = lens.groupBy(F.col("n_tokens").alias("len")).agg(F.count("*").alias("n")).orderBy("len").toArrow()
    bounds = boundaries(histogram.column("len").to_numpy(), histogram.column("n").to_numpy(), buckets)
    case = F.lit(None).cast("int")
    upto = F.lit(None).cast("long")
    for i in range(len(bounds) - 1, -1, -1):
        case = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(case)
        upto = F.when(F.col("n_tokens") <= bounds[i], bounds[i]).otherwise(upto)
    rows = lens.withColumns({"bucket": case, "bucket_len": upto, "lane": F.coalesce(F.pmod("doc_id", F.lit(lanes)), F.lit(0)).cast("int")})
    totals = rows.groupBy("bucket", "lane").agg(F.count("*").alias("n"))
    before = totals.select("bucket", "lane", (F.sum("n").over(W.partitionBy("bucket").orderBy("lane")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("bucket", "lane").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens")) - 1
    cap = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    placed = rows.withColumn("rank", rank).join(before, ["bucket", "lane"]).withColumn("at", F.col("rank") + F.col("before"))
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("at") / cap).alias("batch"), F.pmod("at", cap).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
