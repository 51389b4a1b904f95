"""Chat formatting: a prefix tree of conversations, laid out depth first with position ids and ancestor attention intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm.text import U64, mix
from rasterloom.llm.tokens import VOCABULARY, encode
from rasterloom.session import cut, ensure_importable

#: How a turn is written.
TEMPLATE = "<|{role}|>\n{text}\n"


def turn_tokens(role: Column, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Token ids of a formatted turn; nulls count as empty."""

    @F.arrow_udf("array<int>")
    def run(roles: pa.Array, texts: pa.Array) -> pa.Array:
        turns = pa.array([TEMPLATE.format(role=r or "", text=t or "") for r, t in zip(roles.to_pylist(), texts.to_pylist())], pa.string())
        return pa.array(encode(turns, vocabulary), pa.list_(pa.int32()))

    return run(role, text)


_PLACE = "struct<start:long,position:long,attention:array<struct<from:long,to:long>>>"


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and where the flattened one of each begins (one more entry at the end)."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, np.concatenate(([0], np.cumsum(size)))


def _path(turns: pa.Array) -> pa.Array:
    """For each list of turn hashes (two of each turn) the ids of its tree nodes: a node's id is 128 bits of hash of all turns up to it, with which no two prefixes of a corpus are taken for one."""
    size, start = _parts(turns)
    flat = turns.flatten()
    lanes = [flat.field(f).to_numpy(zero_copy_only=False).view(U64) for f in ("h", "g")]
    ids = np.empty((len(flat), 2), U64)
    state = np.zeros((len(size), 2), U64)
    for depth in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > depth)
        at = start[on] + depth
        for k, x in enumerate(lanes):
            state[on, k] = mix(state[on, k] * U64(0x9FB21C651E98DF25) + x[at] + U64(0x9E3779B97F4A7C15))
        ids[at] = state[on]
    flat_ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(ids.tobytes())]).cast(pa.binary())
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), flat_ids)


def _place(steps: pa.Array) -> pa.Array:
    """From a node's ancestors and itself (offset in the parent's range, tokens), root first: its start, its first position id and the ancestors' intervals, those that touch made one and empty ones left out."""
    size, start = _parts(steps)
    flat = steps.flatten()
    offset, tokens = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("offset", "size"))
    row = np.repeat(np.arange(len(size)), size)
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (offset, tokens)]
    begin = sums[0][1:] - sums[0][start[row]]  # of every ancestor, in the tree's sequence
    last = start[1:] - 1
    position = sums[1][last] - sums[1][start[:-1]]
    above = np.ones(len(flat), bool)
    above[last] = False
    keep = np.flatnonzero(above & (tokens > 0))
    i, j, of = begin[keep], begin[keep] + tokens[keep], row[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (of[1:] != of[:-1]) | (i[1:] != j[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(keep)) - 1 if len(keep) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(i[new]), pa.array(j[ends])], ["from", "to"])
    bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(size))))), pa.int32())
    return pa.StructArray.from_arrays([pa.array(begin[last]), pa.array(position), pa.ListArray.from_arrays(bounds, spans)], ["start", "position", "attention"])


def _before(children: DataFrame) -> DataFrame:
    """children (node, parent, conv_id, subtree, ...) with `earlier`, the subtrees of the siblings with smaller conv_ids. They are sorted by range over all executors and summed in two steps, so a parent with very many children is shared out."""
    parts = cut(children.repartitionByRange("parent", "conv_id").withColumn("part", F.spark_partition_id()), "siblings")
    totals = parts.groupBy("parent", "part").agg(F.sum("subtree").alias("of_part"))
    before = totals.select("parent", "part", (F.sum("of_part").over(W.partitionBy("parent").orderBy("part")) - F.col("of_part")).alias("before"))
    inside = F.sum("subtree").over(W.partitionBy("parent", "part").orderBy("conv_id")) - F.col("subtree")
    return parts.withColumn("inside", inside).join(before, ["parent", "part"]).withColumn("earlier", F.col("inside") + F.col("before")).drop("inside", "before", "part")


def prefix_tree(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each distinct prefix of conversations (conv_id, turn, role, text): tree (smallest conv_id of those with this first turn), depth (from 0), start (of the node's tokens in the tree's depth-first sequence), tokens, position_ids (one a token; a conversation's own positions run from 0 whatever other branches lie between), attention (the intervals of that sequence that hold its ancestors' tokens; within the node attention is causal), n_convs (that pass through), conv_ids (that end here, sorted).

    Conversations whose first turns (role and text) are equal share nodes up to the first difference; shared tokens are emitted once. Siblings come in the order of the smallest conv_id that passes through them. A conversation reads back as the ancestors' intervals followed by the node's own tokens.

    At scale: nodes are made by grouping on 128-bit hashes of whole prefixes, subtree sizes and starts by joining each node with its ancestors (nodes times depth rows); siblings are ordered by range, so a first turn that all share is no bottleneck.

    Cases: null conv_id: the row is left out. Null turn comes first; equal turns are ordered by role and text, so repeated rows are turns of their own. Null role or text counts as empty. Long texts stay whole. Empty table: empty result; other columns are ignored.
    """
    ensure_importable(conversations.sparkSession)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("depth", F.row_number().over(order) - 1).withColumn("tokens", turn_tokens(F.col("role"), F.col("text"), vocabulary))
    turns = cut(turns.select("conv_id", "depth", F.xxhash64("role", "text").alias("h"), F.xxhash64("text", F.lit(1), "role").alias("g"), "tokens"), "turns")
    paths = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "h", "g"))).alias("t")).select("conv_id", F.arrow_udf(_path, "array<binary>")("t").alias("path"))
    paths = cut(paths, "paths")
    at = paths.select("conv_id", F.posexplode("path").alias("depth", "node"), "path")
    nodes = at.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.array_sort(F.collect_list(F.when(F.col("depth") == F.size("path") - 1, F.col("conv_id")))).alias("conv_ids"))
    first = nodes.join(turns.drop("h", "g"), ["conv_id", "depth"])
    nodes = cut(first.join(paths, "conv_id").withColumn("path", F.slice("path", F.lit(1), F.col("depth") + 1)).withColumn("size", F.size("tokens").cast("long")), "nodes")
    subtree = nodes.select(F.explode("path").alias("node"), "size").groupBy("node").agg(F.sum("size").alias("subtree"))
    light = nodes.select("node", "conv_id", "depth", "size", F.when(F.col("depth") > 0, F.element_at("path", -2)).alias("parent"))
    parents = light.select(F.col("node").alias("parent"), F.col("size").alias("of_parent"))
    child = light.filter("parent is not null").join(subtree, "node").join(parents, "parent")
    offsets = _before(child).select("node", "size", (F.col("of_parent") + F.col("earlier")).alias("offset")).union(light.filter("parent is null").select("node", "size", F.lit(0).cast("long").alias("offset")))
    offsets = cut(offsets, "offsets")
    steps = nodes.select(F.col("node").alias("at"), F.posexplode("path").alias("k", "node")).join(offsets, "node").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("k", "offset", "size"))).alias("steps"))
    placed = cut(steps.select(F.col("at").alias("node"), F.arrow_udf(_place, _PLACE)(F.col("steps")).alias("p")), "placed")
    roots = light.filter("parent is null").select(F.col("node").alias("root"), F.col("conv_id").alias("tree"))
    out = nodes.withColumn("root", F.element_at("path", 1)).join(roots, "root").join(placed, "node")
    ids = F.when(F.col("size") > 0, F.sequence(F.col("p.position"), F.col("p.position") + F.col("size") - 1)).otherwise(F.array().cast("array<long>"))
    return out.select("tree", F.col("depth").cast("int").alias("depth"), F.col("p.start").alias("start"), "tokens", ids.alias("position_ids"), F.col("p.attention").alias("attention"), "n_convs", "conv_ids")
