"""Connected components, region graphs and segmentation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.colour import half_up, with_oklab
from rasterloom.operators.images import Planes, grid, per_image
from rasterloom.operators.stencil import column, row, at


class Forest:
    """Union by the smaller root, with path halving."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> int:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return min(a, b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is joined to by edges (a, b): in every round the larger root of each edge hangs on the smaller one, and all paths are cut short."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def label(classes: np.ndarray, void: int = -1) -> np.ndarray:
    """Labels of the 4-connected components of equal class, dense and in raster order; -1 for void. Works on runs: each row's are found at once, and runs that touch in neighbouring rows are joined."""
    h, w = classes.shape
    start = np.ones((h, w), bool)
    start[:, 1:] = classes[:, 1:] != classes[:, :-1]
    run = np.cumsum(start.ravel()).reshape(h, w) - 1
    same = classes[1:] == classes[:-1]
    up, down = run[:-1][same], run[1:][same]
    new = np.ones(len(up), bool)
    new[1:] = (up[1:] != up[:-1]) | (down[1:] != down[:-1])
    root = roots(int(run.max()) + 1, up[new], down[new])[run] if run.size else run
    ok = classes != void
    out = np.full((h, w), -1, np.int64)
    if ok.any():
        values, first = np.unique(root[ok], return_index=True)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(first)] = np.arange(len(values))
        out[ok] = rank[np.searchsorted(values, root[ok])]
    return out


def label_components(px: DataFrame, void: int = -1) -> DataFrame:
    """img_id, x, y, class, comp for every pixel (missing ones are void; comp is -1 there): components numbered from 0 by their first pixel."""

    def run(w: int, h: int, p: Planes) -> dict:
        x, y = grid(w, h)
        return {"x": x, "y": y, "class": p["class"].ravel(), "comp": label(p["class"], void).ravel()}

    return per_image(px, run, "x int, y int, class int, comp int", {"class": void})


def components(labels: DataFrame) -> DataFrame:
    """img_id, comp, class, area and bounds of labelled components."""
    return labels.filter("comp >= 0").groupBy("img_id", "comp").agg(F.min("class").alias("class"), F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def label_by_propagation(px: DataFrame, void: int = -1, rounds: int | None = None) -> DataFrame:
    """The same labels by a DataFrame fixpoint, for images too large for one task: the smallest pixel index spreads along row and column runs of one class until nothing changes. Each round is written to the shared folder."""
    from rasterloom.session import cut

    p = px.filter(F.col("class") != void).withColumn("root", (F.col("y") * F.col("width") + F.col("x")).cast("long"))
    p = cut(p.select("img_id", "width", "height", "x", "y", "class", "root"), "label")
    k = 0
    while rounds is None or k < rounds:
        k += 1

        def spread(d: DataFrame, order: W, by: str, along: str) -> DataFrame:
            gap = F.when((F.lag("class").over(order) == F.col("class")) & (F.lag(along).over(order) == F.col(along) - 1), 0).otherwise(1)
            d = d.withColumn("__g", gap).withColumn("__run", F.sum("__g").over(order.rowsBetween(W.unboundedPreceding, 0)))
            return d.withColumn("root", F.min("root").over(W.partitionBy("img_id", by, "__run"))).drop("__g", "__run")

        new = cut(spread(spread(p, row(), "y", "x"), column(), "x", "y"), "label")
        changed = new.agg(F.sum("root")).first() != p.agg(F.sum("root")).first()
        p = new
        if not changed:
            break
    dense = F.dense_rank().over(W.partitionBy("img_id").orderBy("root")) - 1
    return p.withColumn("comp", dense).select("img_id", "x", "y", "class", "comp")


def adaptive_min_area(comps: DataFrame, pixels: DataFrame, budget: float = 0.015) -> DataFrame:
    """img_id, min_area: one more than the largest component that fits, smallest first, into 1.5 % of the pixels; at most 0.4 % of them (4 at least). pixels: img_id, pixels."""
    upto = W.partitionBy("img_id").orderBy("area").rowsBetween(W.unboundedPreceding, 0)
    c = comps.join(pixels, "img_id").withColumn("cum", F.sum("area").over(upto))
    t = c.groupBy("img_id").agg(F.coalesce(F.max(F.when(F.col("cum") <= F.col("pixels") * budget, F.col("area") + 1)), F.lit(0)).alias("t"), F.max("pixels").alias("pixels"))
    return t.select("img_id", F.least("t", F.greatest(F.lit(4), half_up(F.col("pixels") * 0.004))).cast("long").alias("min_area"))


def class_adjacency(px: DataFrame) -> DataFrame:
    """img_id, lo, hi, border: length of the boundary that two classes share (both not negative)."""
    c = F.col("class")
    two = px.select("img_id", "class", at("class", 1, row()).alias("e"), at("class", 1, column()).alias("s"))
    both = two.select("img_id", "class", F.explode(F.array("e", "s")).alias("other")).filter((c >= 0) & (F.col("other") >= 0) & (c != F.col("other")))
    return both.groupBy("img_id", F.least("class", "other").alias("lo"), F.greatest("class", "other").alias("hi")).agg(F.count("*").alias("border"))


def region_graph(labels: DataFrame, px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (img_id, comp, area, okL, okA, okB: mean Oklab) and edges (img_id, u, v, distance) of touching components."""
    p = with_oklab(labels.filter("comp >= 0").join(px.select("img_id", "x", "y", "r", "g", "b"), ["img_id", "x", "y"]), ("okL", "okA", "okB"))
    v = p.groupBy("img_id", "comp").agg(F.count("*").alias("area"), *[F.avg(f"ok{c}").alias(f"ok{c}") for c in "LAB"])
    two = labels.select("img_id", "comp", at("comp", 1, row()).alias("e"), at("comp", 1, column()).alias("s"))
    e = two.select("img_id", "comp", F.explode(F.array("e", "s")).alias("other")).filter("comp >= 0 and other >= 0 and comp != other").select("img_id", F.least("comp", "other").alias("u"), F.greatest("comp", "other").alias("v")).distinct()
    side = lambda n: v.select("img_id", F.col("comp").alias(n), *[F.col(f"ok{c}").alias(f"{n}_{c}") for c in "LAB"])
    d = F.sqrt(sum(((F.col(f"u_{c}") - F.col(f"v_{c}")) * (F.col(f"u_{c}") - F.col(f"v_{c}")) for c in "LAB"), F.lit(0.0)))
    return v, e.join(side("u"), ["img_id", "u"]).join(side("v"), ["img_id", "v"]).select("img_id", "u", "v", d.alias("distance"))


def despeckled(classes: np.ndarray, min_area: int, void: int = -1, isolated: bool = False) -> tuple[np.ndarray, int]:
    """Components below min_area take, smallest first, the class with which they share the longest border; not yet absorbed small neighbours don't count. isolated: only those whose neighbours are all of one class."""
    out = classes.copy()
    h, w = classes.shape
    labels = label(classes, void)
    n = int(labels.max()) + 1
    if min_area <= 1 or n <= 0:
        return out, 0
    flat = labels.ravel()
    areas = np.bincount(flat[flat >= 0], minlength=n)
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(n + 1))
    small = [c for c in np.argsort(areas, kind="stable").tolist() if areas[c] < min_area]
    waiting = np.zeros(n, bool)
    cls = out.ravel()

    def around(c: int) -> tuple[np.ndarray, np.ndarray]:
        at_ = order[bounds[c] : bounds[c + 1]]
        y, x = at_ // w, at_ % w
        # the four neighbours of a pixel follow each other, pixel by pixel: the first class met wins ties
        near = np.stack([np.where(x > 0, at_ - 1, -1), np.where(x < w - 1, at_ + 1, -1), np.where(y > 0, at_ - w, -1), np.where(y < h - 1, at_ + w, -1)], 1).ravel()
        near = near[near >= 0]
        return at_, near[flat[near] != c]

    if isolated:
        small = [c for c in small if len(set(classes.ravel()[around(c)[1]].tolist())) <= 1]
    waiting[small] = True
    merged = 0
    for c in small:
        at_, near = around(c)
        lab = flat[near]
        near = near[(lab < 0) | ~waiting[np.maximum(lab, 0)]]
        if not len(near):
            continue
        votes: dict[int, int] = {}
        for v in np.where(flat[near] < 0, void, cls[near]).tolist():
            votes[v] = votes.get(v, 0) + 1
        cls[at_] = max(votes, key=votes.__getitem__)
        waiting[c] = False
        merged += 1
    return out, merged


def despeckle(px: DataFrame, min_area: int, void: int = -1, isolated: bool = False) -> DataFrame:
    """img_id, x, y, class after despeckled(), for every pixel."""

    def run(w: int, h: int, p: Planes) -> dict:
        x, y = grid(w, h)
        return {"x": x, "y": y, "class": despeckled(p["class"], min_area, void, isolated)[0].ravel()}

    return per_image(px, run, "x int, y int, class int", {"class": void})


def flooded(passable: np.ndarray) -> np.ndarray:
    """The passable pixels that are 4-connected to a passable pixel on the border."""
    lab = label(np.where(passable, 1, -1))
    edge = np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
    return np.isin(lab, edge[edge >= 0])


def flood_from_border(px: DataFrame, passable: str) -> DataFrame:
    """img_id, x, y, reached (0 or 1) for every pixel; passable: a column that is 1 where the flood may go."""

    def run(w: int, h: int, p: Planes) -> dict:
        x, y = grid(w, h)
        return {"x": x, "y": y, "reached": flooded(p[passable] == 1).astype(np.int32).ravel()}

    return per_image(px, run, "x int, y int, reached int", {passable: 0})


def kruskal(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray, area: np.ndarray, k: float, target: int = 1) -> np.ndarray:
    """Regions of a graph by Felzenszwalb and Huttenlocher (2004): edges in order of weight join two regions if neither's internal difference plus k over its area is smaller. Stops at `target` regions. Roots by node."""
    f = Forest(n)
    size, inner = area.astype(float).tolist(), [0.0] * n
    left = n
    for i in np.argsort(weight, kind="stable").tolist():
        if left <= target:
            break
        a, b = f.find(int(u[i])), f.find(int(v[i]))
        if a == b:
            continue
        if weight[i] <= min(inner[a] + k / size[a], inner[b] + k / size[b]):
            s = size[a] + size[b]
            r = f.join(a, b)
            size[r], inner[r] = s, float(weight[i])
            left -= 1
    return np.array([f.find(i) for i in range(n)])


def _oklab(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.stack([r, g, b], -1) / 255.0
    lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    lms = np.cbrt(lin @ np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]).T)
    return lms @ np.array([[0.2104542553, 0.793617785, -0.0040720468], [1.9779984951, -2.428592205, 0.4505937099], [0.0259040371, 0.7827717662, -0.808675766]]).T


def without_runts(roots: np.ndarray, u: np.ndarray, v: np.ndarray, least: int, share: float = 0.67) -> np.ndarray:
    """Regions smaller than `least` joined to the neighbour that has `share` or more of their border (counted in graph edges; of equal ones the first met), in the order in which the edges (u, v) meet them. One between two regions stays: it tells where their edge runs."""
    a, b = roots[u], roots[v]
    size = np.bincount(roots, minlength=len(roots))
    apart = np.flatnonzero(a != b)
    pairs = np.stack([np.stack([a[apart], b[apart]], 1), np.stack([b[apart], a[apart]], 1)], 1).reshape(-1, 2)
    pairs = pairs[size[pairs[:, 0]] < least]
    borders: dict[int, dict[int, int]] = {}
    for runt, other in pairs.tolist():
        own = borders.setdefault(runt, {})
        own[other] = own.get(other, 0) + 1
    up, size = {}, size.tolist()

    def find(i: int) -> int:
        while i in up:
            i = up[i]
        return i

    for runt, near in borders.items():
        if runt in up or size[runt] >= least:
            continue
        best = max(near, key=near.__getitem__)
        if near[best] < share * sum(near.values()):
            continue
        to = find(best)
        if to != runt:
            up[runt] = to
            size[to] += size[runt]
    moved = np.arange(len(roots))
    for i in up:
        moved[i] = find(i)
    return moved[roots]


def segmented(rgba: tuple[np.ndarray, ...], k: float = 300.0, min_region: int = 0) -> np.ndarray:
    """Segments of an image on its 8-connected pixel graph, weighted by distance in Oklab and alpha (times 255), dense in raster order; of the regions below min_region those inside one other region join it (without_runts)."""
    r, g, b, a = rgba
    h, w = r.shape
    f = np.concatenate([_oklab(r, g, b), a[..., None] / 255.0], -1) * 255.0
    idx = np.arange(h * w).reshape(h, w)
    us, vs, ws = [], [], []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        p = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        q = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        us.append(idx[p].ravel())
        vs.append(idx[q].ravel())
        ws.append(np.sqrt(((f[p] - f[q]) ** 2).sum(-1)).ravel())
    u, v, wt = map(np.concatenate, (us, vs, ws))
    roots = kruskal(h * w, u, v, wt, np.ones(h * w), k)
    if min_region > 0:
        roots = without_runts(roots, u, v, min_region)
    values, first, inverse = np.unique(roots, return_index=True, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(first)] = np.arange(len(values))
    return rank[inverse].reshape(h, w)


def segment(px: DataFrame, k: float = 300.0, min_region: int = 0) -> DataFrame:
    """img_id, x, y, comp: segmented() on every image."""

    def run(w: int, h: int, p: Planes) -> dict:
        x, y = grid(w, h)
        return {"x": x, "y": y, "comp": segmented(tuple(p[c].astype(float) for c in "rgba"), k, min_region).ravel()}

    return per_image(px, run, "x int, y int, comp int", dict.fromkeys("rgba", 0))


def merge_regions(labels: DataFrame, px: DataFrame, k: float = 0.05, target: int = 1) -> DataFrame:
    """img_id, comp, region: touching components merged by kruskal() on mean Oklab distance."""
    v, e = region_graph(labels, px)
    pairs = e.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("distance", "u", "v"))).alias("edges"))
    nodes = v.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("comp", "area"))).alias("nodes"))
    both = nodes.join(pairs, "img_id", "left")


    @F.arrow_udf("array<struct<comp:int,region:int>>")
    def run(nodes_: pa.Array, edges_: pa.Array) -> pa.Array:
        out = []
        for ns, es in zip(nodes_.to_pylist(), edges_.to_pylist()):
            es = es or []
            at_ = {n["comp"]: i for i, n in enumerate(ns)}
            roots = kruskal(len(ns), np.array([at_[x["u"]] for x in es], int), np.array([at_[x["v"]] for x in es], int), np.array([x["distance"] for x in es], float), np.array([n["area"] for n in ns]), k, target)
            out.append([{"comp": n["comp"], "region": ns[r]["comp"]} for n, r in zip(ns, roots)])
        return pa.array(out, pa.list_(pa.struct([("comp", pa.int32()), ("region", pa.int32())])))

    return both.select("img_id", F.explode(run("nodes", "edges")).alias("m")).select("img_id", "m.comp", "m.region")


def flatten_segments(px: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pixel takes its segment's mean Oklab colour and mean alpha; columns okL, okA, okB, a."""
    p = with_oklab(px.join(labels.select("img_id", "x", "y", "comp"), ["img_id", "x", "y"]), ("okL", "okA", "okB"))
    seg = W.partitionBy("img_id", "comp")
    return p.select("img_id", "x", "y", "comp", *[F.avg(f"ok{c}").over(seg).alias(f"ok{c}") for c in "LAB"], half_up(F.avg("a").over(seg)).cast("int").alias("a"))
