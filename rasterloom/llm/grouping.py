"""Groups by verified pairs: rounds of candidate pairs, each compared on its own, merge what they link."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.components import connected_components
from rasterloom.session import cut

#: Pairs that one block compares with the same item, and pairs (40 bytes each) up to which a round's pairs are broadcast to the items; more are joined by shuffle.
BLOCK, BROADCAST = 512, 1 << 18


def beside(pairs: DataFrame, items: DataFrame, n_pairs: int, block: int = BLOCK) -> DataFrame:
    """The items of pairs (u, v, cu, cv) in blocks (v, salt), in order: v's item in a row whose u is null, then those of about `block` of its us. items: id and what is compared. An item with many pairs is in as many blocks as they fill, so no task's work grows with a group."""
    few = F.broadcast if n_pairs <= BROADCAST else lambda d: d
    degree = pairs.groupBy("v").agg(F.count("*").alias("n"))
    salted = pairs.join(few(degree), "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / block)).cast("int")).drop("n")
    ends = items.join(few(salted), items["id"] == salted["u"]).drop("id")
    hubs = salted.select("v", "salt").distinct()
    none = F.lit(None).cast("long")
    heads = items.join(few(hubs), items["id"] == hubs["v"]).drop("id").withColumns({"u": none, "cu": none, "cv": none})
    return heads.unionByName(ends).repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """From beside()'s batches: a row with v's item, and rows with items to compare with it (a block may come in several parts)."""
    head = None
    for b in batches:
        if not b.num_rows:
            continue
        start = np.flatnonzero(b.column("u").is_null().to_numpy(zero_copy_only=False))
        first = int(start[0]) if len(start) else b.num_rows
        if first and head is not None:
            yield head, b.slice(0, first)
        for i, j in zip(start.tolist(), [*start[1:].tolist(), b.num_rows]):
            head = b.slice(i, 1)
            if j > i + 1:
                yield head, b.slice(i + 1, j - i - 1)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """blocks() put together, about `rows` rows of parts at a time: heads, parts, and the index of its head for each row of parts. Most blocks are a few rows, which don't pay for a comparison of their own."""
    heads: list[pa.RecordBatch] = []
    parts: list[pa.RecordBatch] = []
    have = 0

    def all_held() -> tuple[pa.Table, pa.Table, np.ndarray]:
        return pa.Table.from_batches(heads), pa.Table.from_batches(parts), np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])

    for head, part in blocks(batches):
        heads.append(head)
        parts.append(part)
        have += part.num_rows
        if have >= rows:
            yield all_held()
            heads, parts, have = [], [], 0
    if parts:
        yield all_held()


class Groups:
    """Groups that grow by rounds of candidate pairs.

    state has (id, comp, stop) of every id that is linked so far: its group's name (an id of it) and the level at which its own search ends (null: it goes on to the last). links has (u, v, score) of all verified pairs.
    """

    def __init__(self, items: DataFrame, compare: Callable[[DataFrame], DataFrame], ends: Callable[[int], Column] | None = None) -> None:
        """compare: from beside()'s rows to (u, v, cu, cv, score) of the pairs that are linked. ends: for the level reached, an aggregate over a group's links that gives the level at which its ids' search ends if no more are found."""
        spark = items.sparkSession
        self.items, self.compare, self.ends = items, compare, ends
        self.state = spark.createDataFrame([], "id long, comp long, stop int")
        self.links = spark.createDataFrame([], "u long, v long, score double")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """pairs (u, v, level) whose ends are in different groups and of which one at least still searches at the level, with these groups as cu and cv."""
        a, b = (self.state.select(F.col("id").alias(x), F.col("comp").alias("c" + x), F.col("stop").alias("s" + x)) for x in "uv")
        joined = pairs.join(a, "u", "left").join(b, "v", "left").withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")})
        return joined.filter("cu != cv and least(coalesce(su, 0), coalesce(sv, 0)) <= level").select("u", "v", "level", "cu", "cv")

    def descend(self, pairs: DataFrame) -> None:
        """Compare pairs (u, v, level) level by level from the deepest on and merge the groups that are linked; what an earlier level has brought together isn't compared."""
        while True:
            now = cut(self.apart(pairs), "pairs")
            sizes = sorted(((r["level"], r["count"]) for r in now.groupBy("level").count().collect()), reverse=True)
            for level, n in sizes:
                if self.step(now.filter(F.col("level") == level), n, level):
                    break
            if not sizes or level == sizes[-1][0]:
                return
            pairs = now.filter(F.col("level") < level).select("u", "v", "level")

    def step(self, pairs: DataFrame, n: int, level: int) -> bool:
        """Compare n pairs (u, v, cu, cv) and merge the groups that are linked. Whether any are."""
        return n > 0 and self.merge(self.compare(beside(pairs.select("u", "v", "cu", "cv"), self.items, n)), level)

    def merge(self, found: DataFrame, level: int) -> bool:
        """Merge the groups of found (u, v, cu, cv, score), pairs that are linked and their groups so far. Whether there are any."""
        found = cut(found, "links")
        if found.isEmpty():
            return False
        merged = connected_components(found.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        self.links = self.links.union(found.select("u", "v", "score").dropDuplicates(["u", "v"]))
        ids = self.state.union(found.select("u", "cu", F.lit(None).cast("int"))).union(found.select("v", "cv", F.lit(None).cast("int")))
        ids = ids.groupBy("id").agg(F.max("comp").alias("comp"), F.max("stop").alias("stop"))
        moved = ids.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp"), "stop")
        if self.ends is not None:
            of = self.links.join(moved.select(F.col("id").alias("u"), "comp"), "u").groupBy("comp").agg(self.ends(level).alias("end"))
            # what has ended stays so; what would end at a later level is judged anew
            moved = moved.join(of, "comp", "left").select("id", "comp", F.when(F.col("stop") > level, F.col("stop")).otherwise(F.col("end")).alias("stop"))
        self.state = cut(moved, "state")
        return True


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups (one or many a table) from batches sorted by key: a table never ends inside a group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if not len(change):
            held.append(b)
            continue
        held.append(b.slice(0, int(change[-1])))
        yield pa.Table.from_batches(held)
        held = [b.slice(int(change[-1]))]
    if held:
        yield pa.Table.from_batches(held)
