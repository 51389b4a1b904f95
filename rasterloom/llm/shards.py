"""Sharding: contiguous shards of whole groups whose largest is as small as can be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.session import cut, ensure_importable

SHARDS = 64


def cuts_at(ends: np.ndarray, total: int, capacity: int, most: int) -> list[int] | None:
    """The positions (sums of sizes) at which greedy filling ends its shards, or None if it takes more than `most`. ends: sorted sums up to and including each group."""
    out, at = [], 0
    while at < total:
        if len(out) == most:
            return None
        i = int(np.searchsorted(ends, at + capacity, "right")) - 1
        if i < 0 or ends[i] <= at:
            return None
        at = int(ends[i])
        out.append(at)
    return out


def smallest(ends: np.ndarray, total: int, shards: int, low: int, high: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity in [low, high], by binary search, and its cuts."""
    while low < high:
        mid = (low + high) // 2
        if cuts_at(ends, total, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, cuts_at(ends, total, low, shards) or []


def minimax_shards(docs: DataFrame, size: Column, group: list[str], shards: int = SHARDS) -> DataFrame:
    """group columns, n_rows, size, end (sum of sizes up to it), shard (from 0), capacity: one row for each group, in the order of the group columns.

    Rows that agree in the group columns form an atomic group. Shards are runs of groups; the capacity is the smallest for which greedy filling needs no more than `shards`, and the greedy cuts at that capacity are the result.

    At scale: the groups are sorted by range over all executors and summed in two steps (inside parts, then over the parts' totals). The j-th cut for any capacity between the bounds total/shards and total/shards + largest lies between j * (low - largest) and j * high, so only the sums in those windows go to the task that searches; it keeps eight bytes for each.

    Cases: null sizes count 0; nulls in the group columns are a value of their own and come first. A group of size 0 stays with its predecessor. Equal sizes and repeated rows need no care. A group larger than total/shards raises the capacity to its size. Fewer groups than shards: the last shards stay empty. Empty table: empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    parts = docs.groupBy(*group).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(size.cast("long"), F.lit(0))).alias("size"))
    parts = cut(parts.repartitionByRange(*[F.col(f"`{g}`").asc_nulls_first() for g in group]).withColumn("part", F.spark_partition_id()), "parts")
    totals = parts.groupBy("part").agg(F.sum("size").alias("of_part"), F.max("size").alias("largest"))
    before = totals.select("part", (F.sum("of_part").over(W.orderBy("part")) - F.col("of_part")).alias("before"))
    inside = F.sum("size").over(W.partitionBy("part").orderBy(*[F.col(f"`{g}`").asc_nulls_first() for g in group]))
    ends = cut(parts.join(before, "part").withColumn("end", inside + F.col("before")).drop("part", "before"), "ends")
    total, largest = totals.agg(F.sum("of_part"), F.max("largest")).first()
    if not total:
        return ends.withColumn("shard", F.lit(0)).withColumn("capacity", F.lit(0).cast("long"))
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    least = max(low - largest, 0)
    near = ends.select("end").filter(F.ceil(F.col("end") / high) <= F.floor(F.col("end") / least)) if least else ends.select("end")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unique(np.concatenate([np.array([total]), *(b.column("end").to_numpy() for b in batches)]))
        capacity, at = smallest(kept, total, shards, low, high)
        yield pa.RecordBatch.from_arrays([pa.array([capacity]), pa.array([at], pa.list_(pa.int64()))], ["capacity", "cuts"])

    found = near.distinct().repartition(1).mapInArrow(search, "capacity long, cuts array<long>").first()
    places = F.array(*[F.lit(c).cast("long") for c in found["cuts"]])
    return ends.withColumn("shard", F.size(F.filter(places, lambda c: c < F.col("end")))).withColumn("capacity", F.lit(found["capacity"]).cast("long"))


def oracle(shards: int = SHARDS) -> str:
    """minimax_shards over documents by (source, doc_id), sized by the bytes of text, as DuckDB SQL."""
    base = 10**13
    fold = f"list_reduce(list_prepend(CAST(0 AS HUGEINT), sizes), lambda acc, x: CASE WHEN acc % {base} + x <= mid THEN acc + x ELSE (acc // {base} + 1) * {base} + x END)"
    return f"""
WITH RECURSIVE g AS (
  SELECT source, doc_id, count(*) AS n_rows, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS size
  FROM documents GROUP BY source, doc_id),
o AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS BIGINT) AS "end",
         row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS k FROM g),
a AS (SELECT list(CAST(size AS HUGEINT) ORDER BY k) AS sizes, CAST(max(size) AS BIGINT) AS big, CAST(sum(size) AS BIGINT) AS total FROM o),
s AS (
  SELECT greatest(big, CAST(ceil(total / {shards}) AS BIGINT)) AS lo, CAST(ceil(total / {shards}) AS BIGINT) + big AS hi FROM a
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT lo, hi, mid, {fold} // {base} + 1 <= {shards} AS ok FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM s WHERE lo < hi), a)),
c AS (SELECT min(hi) AS capacity FROM s),
w AS (
  SELECT k, size AS fill, 0 AS shard FROM o WHERE k = 1
  UNION ALL
  SELECT o.k, CASE WHEN w.fill + o.size <= capacity THEN w.fill + o.size ELSE o.size END, CASE WHEN w.fill + o.size <= capacity THEN w.shard ELSE w.shard + 1 END
  FROM w JOIN o ON o.k = w.k + 1, c)
SELECT o.source, o.doc_id, o.n_rows, o.size, o."end", w.shard, CAST(c.capacity AS BIGINT) AS capacity FROM o JOIN w USING (k), c"""
