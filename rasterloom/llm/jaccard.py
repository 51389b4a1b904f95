"""N-gram Jaccard join of a whole table with itself: a MinHash LSH forest finds candidates, exact set arithmetic decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm.grouping import Groups, blocks, whole_groups
from rasterloom.llm.text import U64, mix, shingles, slices, utf8
from rasterloom.session import cut, ensure_importable, unused

#: Words of a gram, least Jaccard similarity, trees, hashes down each tree, recall wanted at the threshold.
GRAM, THRESHOLD, TREES, DEPTH, RECALL = 2, 0.6, 40, 8, 0.95
#: Grams in a part of a group, grams that a set counts as besides its own, sets that share a gram up to which their pairs are counted one by one.
CELL, SET_COSTS, FEW = 1 << 20, 1 << 10, 8


def recall_at(depth: int, threshold: float, trees: int) -> float:
    """The chance that a pair at the threshold shares a prefix of that depth in one tree at least."""
    return 1 - (1 - threshold**depth) ** trees


def shortened(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The shortest prefix that any query needs: that at which one without a known partner finds a pair at the threshold with the recall (or one hash)."""
    depth = deepest
    while depth > 1 and recall_at(depth, threshold, trees) < recall:
        depth -= 1
    return depth


def hash_family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(seed, seed + 2 * n, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (x[:n] | U64(1)).astype(np.uint32), x[n:].astype(np.uint32)


def signatures(grams: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash signatures, one row for each non-empty set."""
    x = (mix(grams) >> U64(32)).astype(np.uint32)
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), len(a)), np.uint32)
    for j in range(len(a)):
        out[:, j] = np.minimum.reduceat(x * a[j] + b[j], at)
    return out


def set_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 63-bit id for each set; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(grams + U64(1)))))
    size = np.diff(bounds)
    ids = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(U64)) >> U64(1)
    return np.where(size > 0, np.maximum(ids, U64(1)), U64(0)).astype(np.int64)


def _sketch(gram: int, stop: int, depth: int, trees: int):
    """nodes: for each tree the id of the path of the first `stop` hashes. deep: the hashes below, bits_of() bits each, the next one highest."""
    bits = bits_of(stop, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family(depth * trees)
        for part in slices(batches, "text"):
            data, off = utf8(part.column("text"), lower=True)
            g, bounds = shingles(data, off, gram)
            size = np.diff(bounds)
            keep = np.flatnonzero(size > 0)
            if not len(keep):
                continue
            sig = signatures(g, bounds, a, b).reshape(len(keep), trees, depth)
            key = np.zeros((len(keep), trees), U64)
            for j in range(stop):
                key = mix(key * U64(0x9FB21C651E98DF25) + sig[:, :, j].astype(U64) + np.arange(trees, dtype=U64))
            deep = np.zeros((len(keep), trees), U64)
            for j in range(stop, depth):
                deep = deep << U64(bits) | sig[:, :, j].astype(U64) >> U64(32 - bits)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, trees), pa.int32()), pa.array(x.view(np.int64).ravel())) for x in (key, deep)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(keep)), pa.array(set_ids(g, bounds)[keep]), pa.array(size[keep].astype(np.int32)), *lists],
                ["doc_id", "set_id", "n_grams", "nodes", "deep"],
            )

    return run


def bits_of(stop: int, depth: int) -> int:
    return min(32, 63 // max(1, depth - stop))


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            g, bounds = shingles(*utf8(part.column("text"), lower=True), gram)
            ids = set_ids(g, bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(g.view(np.int64)))
            own = pa.array(ids == part.column("set_id").to_numpy())  # an id may have other texts, too
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["id", "grams"]).filter(own)

    return run


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, part in blocks(batches):
            one, many = head.column("grams").flatten().to_numpy(), part.column("grams")
            size = many.value_lengths().to_numpy()
            flat = many.flatten().to_numpy()
            at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
            shared = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(size) - size)
            union = len(one) + size - shared
            ok = shared >= threshold * union
            if ok.any():
                keep = pa.array(ok)
                columns = [part.column(c).filter(keep) for c in ("u", "v", "cu", "cv")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((shared / union)[ok])], ["u", "v", "cu", "cv", "score"])

    return run


def _prefix(level: Column | int, stop: int, depth: int) -> Column:
    """What a trie row's `deep` says of its path down to a level."""
    if isinstance(level, int):
        return F.shiftright("deep", bits_of(stop, depth) * (depth - level)) if level > stop else F.lit(0).cast("long")
    return F.coalesce(*[F.when(level == k, _prefix(k, stop, depth)) for k in range(stop, depth + 1)])


def tries(sketch: DataFrame, stop: int, depth: int) -> DataFrame:
    """(set_id, n_grams, node, deep, match): for every set and tree the longest prefix of its path that another set has, in hashes, where that is `stop` or longer.

    Each tree's paths are sorted; the longest match of a path is that with one of its two neighbours in that order. Sets that several documents have stand in the trees once.
    """
    one = sketch.groupBy("set_id").agg(F.min_by(F.struct("n_grams", "nodes", "deep"), "doc_id").alias("x"))
    paths = one.select("set_id", "x.n_grams", F.explode(F.arrays_zip("x.nodes", "x.deep")).alias("p")).select("set_id", "n_grams", F.col("p.nodes").alias("node"), F.col("p.deep").alias("deep"))
    order = W.partitionBy("node").orderBy("deep", "set_id")
    bits = bits_of(stop, depth)

    def shared(other: str) -> Column:
        longer = sum((F.expr(f"int(shiftright(deep, {bits * (depth - k)}) = shiftright({other}, {bits * (depth - k)}))") for k in range(stop + 1, depth + 1)), F.lit(0))
        return F.when(F.col(other).isNull(), 0).otherwise(stop + longer)

    beside = paths.withColumns({"before": F.lag("deep").over(order), "after": F.lead("deep").over(order)})
    return beside.select("set_id", "n_grams", "node", "deep", F.greatest(shared("before"), shared("after")).alias("match")).filter("match > 0")


def stars(trie: DataFrame, threshold: float, stop: int, depth: int) -> DataFrame:
    """(u, v, level): at every level each set of a trie node with the node's hub, a set that another order of ids at each level puts first; level is the deepest at which the pair meets. Pairs whose sizes alone rule the threshold out are left out."""
    hubs, ways = {}, []
    for k in range(stop, depth + 1):
        node = W.partitionBy("node", *([_prefix(k, stop, depth)] if k > stop else []))
        hubs[f"hub{k}"] = F.min(F.struct(F.xxhash64("set_id", F.lit(k)), "set_id", "n_grams")).over(node)
        ways.append(F.when(F.col("match") >= k, F.struct(F.lit(k).alias("level"), F.col(f"hub{k}.set_id").alias("hub"), F.col(f"hub{k}.n_grams").alias("n"))))
    met = trie.withColumns(hubs).select("set_id", "n_grams", F.explode(F.array(*ways)).alias("w")).filter("w is not null and w.hub != set_id")
    return met.filter(_near(F.col("n_grams"), F.col("w.n"), threshold)).groupBy(F.col("set_id").alias("u"), F.col("w.hub").alias("v")).agg(F.max("w.level").alias("level"))


def _near(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b)


def rest(trie: DataFrame, groups: Groups, threshold: float) -> DataFrame:
    """(u, v, cu, cv): all pairs of sets that share a node, whatever the levels at which their searches ended, and are still in different groups. Pairs whose sizes alone rule the threshold out are left out."""
    state = groups.state.select(F.col("id").alias("set_id"), "comp")
    rows = trie.join(state, "set_id", "left").select("node", "set_id", "n_grams", F.coalesce("comp", "set_id").alias("comp"))
    mixed = rows.groupBy("node").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("node")
    nodes = cut(rows.join(mixed, "node", "left_semi"), "mixed")
    one = nodes.select("node", F.col("set_id").alias("u"), F.col("n_grams").alias("n"), F.col("comp").alias("cu"))
    other = nodes.select("node", F.col("set_id").alias("v"), F.col("n_grams").alias("m"), F.col("comp").alias("cv"))
    pairs = one.join(other, "node").filter("u > v and cu != cv").filter(_near(F.col("n"), F.col("m"), threshold))
    return pairs.select("u", "v", "cu", "cv").distinct()


def search(docs: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> tuple[DataFrame, Groups]:
    """The sketch (doc_id, set_id, n_grams, ...) of docs (doc_id long, text) and the groups of set_ids, by an LSH forest.

    Every set asks each of its trees for the sets that share its path down to a level, from the full depth on. What is found is compared exactly. A query's search by hubs ends at the level at which its recall is reached, estimated from what its group's k verified links would miss there: a pair of similarity s is found at level d with the chance r = 1 - (1 - s^d)^trees, so k links stand for sum(1 / r) pairs; with one more, unseen, at the threshold, the recall is (k + 1) / (sum(1 / r) + 1 / r(threshold)). Without links that asks for the length shortened() gives; many close links end a search deeper, where nodes hold fewer strangers.

    First each node's sets are compared with one hub, those of the deepest level before all others; then all pairs that share a node at any level, ended or not, and are still in different groups. So a group of copies costs about its size, while every candidate pair is compared or known to be in one group; links() compares the latter.
    """
    stop = shortened(threshold, trees, depth, recall)
    sketch = cut(docs.mapInArrow(_sketch(gram, stop, depth, trees), "doc_id long, set_id long, n_grams int, nodes array<long>, deep array<long>"), "sketch")
    trie = cut(tries(sketch, stop, depth), "trie")
    hubs = cut(stars(trie, threshold, stop, depth), "stars")
    reps = sketch.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).join(trie.select("set_id").distinct(), "set_id", "left_semi")
    texts = docs.join(reps.hint("shuffle_hash"), "doc_id").select("set_id", "text")
    sets = cut(texts.mapInArrow(_sets(gram), "id long, grams array<long>"), "sets")

    def ends(level: int) -> Column:
        reached = []
        for k in range(level, stop, -1):
            chance = lambda s: 1 - F.pow(1 - F.pow(s, F.lit(k)), F.lit(trees))  # noqa: B023, E731
            estimate = (F.count("*") + 1) / (F.sum(1 / chance(F.col("score"))) + 1 / chance(F.lit(threshold)))
            reached.append(F.when(estimate >= recall, k))
        return F.coalesce(*reached, F.lit(stop))

    groups = Groups(sets, lambda rows: rows.mapInArrow(_compare(threshold), "u long, v long, cu long, cv long, score double"), ends)
    for high, low in ((depth, depth), (depth - 1, stop)):  # two rounds: each leaves plans and classes in the driver
        if low <= high:
            now = cut(groups.apart(hubs.filter(F.col("level").between(low, high))), "pairs")
            groups.step(now, now.count(), high)
    left = cut(rest(trie, groups, threshold), "rest")
    groups.step(left, left.count(), stop)
    return sketch, groups


def common(values: np.ndarray, size: np.ndarray, split: int) -> np.ndarray:
    """How many values sets have in common: those before `split` (rows) with those from there on (columns), or all with all if split is 0 (the diagonal has no meaning). The sets lie end to end in values, each without repeats."""
    m = len(size)
    order = np.argsort(values, kind="stable")
    v, owner = values[order], np.repeat(np.arange(m), size)[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), v[1:] != v[:-1])))
    count = np.diff(np.append(start, len(v)))
    out = np.zeros((m, m), np.int64)
    for c in range(2, FEW + 1):  # what few sets have: pair by pair
        at = start[count == c]
        if len(at):
            i, j = np.triu_indices(c, 1)
            x = owner[at[:, None] + np.arange(c)]
            out += np.bincount((x[:, i] * m + x[:, j]).ravel(), minlength=m * m).reshape(m, m)
    out = out[:split, split:] if split else out + out.T
    many, step = np.flatnonzero(count > FEW), max(64, (1 << 21) // max(1, m))
    for k in range(0, len(many), step):  # what many have: by products of matrices
        n = count[many[k : k + step]]
        at = np.repeat(start[many[k : k + step]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        has = np.zeros((m, len(n)), np.float32)
        has[owner[at], np.repeat(np.arange(len(n)), n)] = 1
        out += (has[:split] @ has[split:].T if split else has @ has.T).astype(np.int64)
    return out


def _degrees(threshold: float):
    """From the rows of cells: for every set of a cell its links there and the most similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            comp, i, j, part, ids, doc, copies = (t.column(c).to_numpy() for c in ("comp", "i", "j", "part", "id", "doc", "copies"))
            lists = t.column("grams").combine_chunks()
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            start = np.flatnonzero(np.concatenate((np.ones(1, bool), (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))  # a hash may have two cells
            out = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(ids)]):
                split = int(np.searchsorted(part[a:b], j[a])) if i[a] < j[a] else 0
                if b - a < 2 or i[a] < j[a] and split in (0, b - a):
                    continue
                size = np.diff(off[a : b + 1])
                shared = common(flat[off[a] : off[b]], size, split)
                one, other = (slice(a, a + split), slice(a + split, b)) if split else (slice(a, b), slice(a, b))
                rows, columns = (size[:split], size[split:]) if split else (size, size)
                union = rows[:, None] + columns - shared
                ok = shared >= threshold * union
                if not split:
                    np.fill_diagonal(ok, False)
                score = np.where(ok, shared / union, 0.0)
                for x, y, o, s in ((one, other, ok, score), (other, one, ok.T, score.T))[: 2 if split else 1]:
                    best = s.argmax(1)  # the first, as rows are sorted by doc
                    some = o.any(1)
                    out.append((ids[x][some], (o @ copies[y])[some], doc[y][best][some], s[np.arange(len(best)), best][some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["id", "n", "partner", "jaccard"])

    return run


def links(groups: Groups, copies: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """(id, n, partner, jaccard) for every id of groups: the documents whose sets are linked to it and the most similar of these sets' documents. copies: (id, doc, copies), a set's smallest doc_id and number of documents.

    Within a group all pairs of sets are compared, whether the forest had them as candidates or not. A group's sets are dealt to parts of about `cell` grams, and any two parts meet in one task; a group of few sets is one part. Only counts leave a task, so the output grows with the sets, not with their pairs.
    """
    of = groups.state.select("id", "comp").join(copies, "id")
    sets = groups.items.join(of, "id")
    parts = groups.items.select("id", (F.size("grams") + SET_COSTS).alias("cost")).join(groups.state.select("id", "comp"), "id").groupBy("comp").agg(F.ceil(F.sum("cost") / cell).cast("int").alias("parts"))
    dealt = sets.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("comp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "doc", F.col("copies"), "grams")
    cells = cells.withColumn("cell", F.xxhash64("comp", "i", "j")).repartition("cell").sortWithinPartitions("cell", "comp", "i", "j", "part", "doc")
    found = cells.mapInArrow(_degrees(threshold), "id long, n long, partner long, jaccard double")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.min_by(F.struct("partner", "jaccard"), F.struct(-F.col("jaccard"), "partner")).alias("x")).select("id", "n", "x.*")


def near_links(docs: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """The similarity join of docs (doc_id, text, ...) with itself, one row a document: doc_id, class_id (the smallest doc_id of the documents that links join to it, taken transitively; its own without links), n_links (the other documents whose exact Jaccard similarity to it reaches the threshold), partner (the most similar document with other grams; null without), jaccard (to the partner).

    The sets are those of near_duplicates. Documents with the very same grams are linked (similarity 1) and counted, but their sets are compared once. Candidates that bring classes together come from the LSH forest of search(); inside a class every pair of sets is compared (links()), so a link is missed only where the forest leaves its ends in different classes.

    Cases: null doc_id: not in the result. Null or empty text, or one without words: a class of its own, no links. Long texts count whole. Repeated rows (an id twice) count as one document if their texts have equal grams; with other texts each is a document and has a row. Equal similarities: the partner with the smaller id. Other columns are ignored. Empty table: empty result.
    """
    ensure_importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sketch, groups = search(docs, threshold=threshold, **parameters)
    ids = sketch.select("doc_id", F.col("set_id").alias("id")).distinct()
    copies = cut(ids.groupBy("id").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "copies")
    state = groups.state.select("id", "comp").join(copies.select("id", "doc"), "id")
    named = state.join(state.groupBy("comp").agg(F.min("doc").alias("first")), "comp").select("id", "first")
    sets = copies.join(named.join(links(groups, copies, threshold), "id"), "id", "left")
    sets = sets.select("id", F.coalesce("first", "doc").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "partner", "jaccard")
    none = docs.select("doc_id").distinct().join(ids.select("doc_id"), "doc_id", "left_anti")
    return ids.join(sets, "id").drop("id").unionByName(none.withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")}), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """Each document of docs (doc_id, text, ...) that has a near duplicate: doc_id, group_id (the group's smallest doc_id), partner (a doc_id of the group whose set was compared with this document's, the most similar such; null for documents whose only partners have the very same grams), jaccard (to the partner; 1.0 where it is null).

    The sets are the distinct word n-grams (lower case, words of letters, digits and non-ASCII characters, 50-bit hashes). Documents are grouped by the pairs whose exact Jaccard similarity reaches the threshold, taken transitively; pairs inside a group that is known already aren't compared, so the result is linear in the documents though the pairs are not. Candidates come from the LSH forest of search(); every document is a query, and no partner or candidate is left out. parameters: those of search().

    Cases: null doc_id: not in the result. Null or empty text, or one without words: no grams, no partner. Long texts count whole. Repeated rows (an id twice) count as one document if their texts have equal grams; with other texts each is compared, and an id has one row, in the smallest group. Equal similarities: the partner with the smaller id. Other columns are ignored. Empty table: empty result.
    """
    ensure_importable(docs.sparkSession)
    sketch, groups = search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null"), **parameters)
    ids = sketch.select("doc_id", "set_id").distinct()
    reps = ids.groupBy("set_id").agg(F.min("doc_id").alias("doc"))
    both = groups.links.union(groups.links.select("v", "u", "score")).join(reps.withColumnRenamed("set_id", "v"), "v")
    best = both.groupBy("u").agg(F.min_by(F.struct(F.col("doc").alias("partner"), F.col("score").alias("jaccard")), F.struct(-F.col("score"), "doc")).alias("x"))
    found = groups.state.join(best.withColumnRenamed("u", "id"), "id").select(F.col("id").alias("set_id"), "comp", "x.*")
    rows = ids.join(found, "set_id", "left").withColumn("g", F.coalesce("comp", "set_id"))
    of = rows.groupBy("g").agg(F.min("doc_id").alias("group_id"), F.max("doc_id").alias("last")).filter("last > group_id")
    return (
        rows.join(of, "g")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("group_id", "partner", F.coalesce("jaccard", F.lit(1.0)).alias("jaccard")), F.struct("group_id", "set_id")).alias("x"))
        .select("doc_id", "x.*")
    )


def near_groups(docs: DataFrame, **parameters) -> DataFrame:
    """near_duplicates as one row a group: group_id, doc_ids (all members, sorted), n_docs, pairs (each member's verified pair with its partner), least_jaccard (of those, 1.0 if all sets are equal). Cases as there."""
    return (
        near_duplicates(docs, **parameters)
        .groupBy("group_id")
        .agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.count("*").alias("n_docs"), F.array_sort(F.collect_set(F.when(F.col("partner").isNotNull(), F.struct(F.col("doc_id").alias("a"), F.col("partner").alias("b"), "jaccard")))).alias("pairs"), F.min("jaccard").alias("least_jaccard"))
    )


def first_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs without all but the first (smallest doc_id) document of each near-duplicate group; the columns stay, whatever their names. Rows without doc_id, text or words stay. A doc_id that repeats keeps one row if its group keeps that id and it has a group; of rows equal in doc_id and text one stays."""
    near = near_duplicates(docs, **parameters)
    gone_id, why = unused(docs, "gone_id"), unused(docs, "why")
    gone = near.filter("doc_id != group_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(gone_id), F.lit(0).alias(why))
    names = [f"`{c}`" for c in docs.columns]
    twice = docs.groupBy("doc_id").agg(F.count("*").alias(why)).filter(F.col(why) > 1).select(F.col("doc_id").alias(gone_id), F.lit(1).alias(why)).dropna()
    mark = gone.union(twice).groupBy(gone_id).agg(F.min(why).alias(why))
    kept = docs.join(mark.hint("shuffle_hash"), docs["doc_id"] == mark[gone_id], "left").filter(F.coalesce(why, F.lit(1)) == 1)
    once = kept.filter(F.col(why).isNull()).select(*names)
    more = kept.filter(F.col(why) == 1).dropDuplicates(["doc_id", "text"]).select(*names)
    return once.union(more)
