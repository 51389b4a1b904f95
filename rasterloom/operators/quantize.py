"""Palettes: colour bins, Wu's splits, Lloyd steps in Oklab, nearest entries, alpha levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.colour import half_up, short_hex, with_oklab
from rasterloom.operators.regions import _oklab
from rasterloom.operators.stencil import column, row, at
from rasterloom.session import ensure_importable

SIDE = 32


def bins(px: DataFrame, alpha_floor: int = 1) -> DataFrame:
    """img_id, rb, gb, bb, n, sr, sg, sb, s2: moments of the 32^3 colour bins of pixels with alpha from the floor on."""
    c = [F.col(x).cast("long") for x in "rgb"]
    b = [F.shiftright(F.col(x), 3).alias(f"{x}b") for x in "rgb"]
    return px.filter(F.col("a") >= alpha_floor).groupBy("img_id", *b).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{x}") for v, x in zip(c, "rgb")], F.sum(sum((v * v for v in c), F.lit(0))).alias("s2"))


def wu_boxes(rb: np.ndarray, n: np.ndarray, sums: np.ndarray, s2: np.ndarray, most: int) -> np.ndarray:
    """The box of each bin after Wu's splits (1991): the box with the largest squared error is cut where the sum of squared means grows most, r before g before b on ties, until there are `most` boxes or none can be cut. rb: bins as rows (r, g, b)."""
    box = np.zeros(len(rb), np.int64)

    def error(sel: np.ndarray) -> float:
        w = n[sel].sum()
        return float(s2[sel].sum() - (sums[sel].sum(0) ** 2).sum() / w) if w else 0.0

    spread = {0: error(box == 0)}
    dead: set[int] = set()
    while len(spread) < most:
        live = [b for b in spread if b not in dead and spread[b] > 0]
        if not live:
            break
        b = max(live, key=lambda i: (spread[i], -i))
        sel = np.flatnonzero(box == b)
        w, s = n[sel].sum(), sums[sel].sum(0)
        best = (0.0, -1, -1)
        for axis in range(3):
            v = rb[sel, axis]
            size = np.bincount(v, n[sel], SIDE)
            part = np.stack([np.bincount(v, sums[sel, c], SIDE) for c in range(3)], 1)
            lo_w, lo_s = np.cumsum(size)[:-1], np.cumsum(part, 0)[:-1]
            ok = (lo_w > 0) & (lo_w < w)
            gain = np.full(SIDE - 1, -np.inf)
            gain[ok] = (lo_s[ok] ** 2).sum(1) / lo_w[ok] + ((s - lo_s[ok]) ** 2).sum(1) / (w - lo_w[ok])
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), axis, i)
        if best[1] < 0:
            dead.add(b)
            continue
        new = len(spread)
        box[sel[rb[sel, best[1]] > best[2]]] = new
        spread[b], spread[new] = error(box == b), error(box == new)
    return box


def lloyd(lab: np.ndarray, weight: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """k-means of weighted points from given centres; empty clusters keep theirs, the lowest index wins ties."""
    for _ in range(rounds):
        near = ((lab[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        w = np.bincount(near, weight, len(centres))
        moved = np.stack([np.bincount(near, weight * lab[:, c], len(centres)) for c in range(3)], 1)
        some = w > 0
        centres = centres.copy()
        centres[some] = moved[some] / w[some, None]
    return centres


def _to_srgb(lab: np.ndarray) -> np.ndarray:
    l, m, s = ((lab @ np.array(k)) ** 3 for k in ([1, 0.3963377774, 0.2158037573], [1, -0.1055613458, -0.0638541728], [1, -0.0894841775, -1.291485548]))  # noqa: E741
    lin = np.stack([4.0767416621 * l - 3.3077115913 * m + 0.2309699292 * s, -1.2684380046 * l + 2.6097574011 * m - 0.3413193965 * s, -0.0041960863 * l - 0.7034186147 * m + 1.707614701 * s], 1)
    c = np.where(lin <= 0.0031308, lin * 12.92, 1.055 * np.maximum(lin, 0) ** (1 / 2.4) - 0.055)
    return np.clip(np.floor(c * 255 + 0.5), 0, 255).astype(np.int64)


def palette_of(rb: np.ndarray, n: np.ndarray, sums: np.ndarray, s2: np.ndarray, colours: int, rounds: int = 4) -> np.ndarray:
    """RGB palette of an image's bins: Wu's boxes, then Lloyd rounds in Oklab over the occupied bins."""
    box = wu_boxes(rb, n, sums, s2, min(max(colours, 1), 256))
    k = int(box.max()) + 1
    w = np.bincount(box, n, k)
    mean = np.stack([np.bincount(box, sums[:, c], k) for c in range(3)], 1) / w[:, None]
    at_ = sums / n[:, None]
    lab = lloyd(_oklab(at_[:, 0], at_[:, 1], at_[:, 2]), n, _oklab(mean[:, 0], mean[:, 1], mean[:, 2]), rounds)
    return _to_srgb(lab) if rounds else np.floor(mean + 0.5).astype(np.int64)


def quantize(px: DataFrame, colours: int, rounds: int = 4) -> DataFrame:
    """img_id, idx, r, g, b: a palette for each image. The histogram is a distributed aggregate; only an image's bins (32,768 at most) meet in Python."""
    ensure_importable(px.sparkSession)
    h = bins(px).groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("rb", "gb", "bb", "n", "sr", "sg", "sb", "s2"))).alias("h"))

    @F.arrow_udf("array<struct<idx:int,r:int,g:int,b:int>>")
    def run(hs: pa.Array) -> pa.Array:
        out = []
        for h_ in hs.to_pylist():
            m = np.array([list(b.values()) for b in h_], np.float64)
            p = palette_of(m[:, :3].astype(np.int64), m[:, 3], m[:, 4:7], m[:, 7], colours, rounds)
            out.append([{"idx": i, "r": int(c[0]), "g": int(c[1]), "b": int(c[2])} for i, c in enumerate(p)])
        return pa.array(out, pa.list_(pa.struct([(k, pa.int32()) for k in ("idx", "r", "g", "b")])))

    return h.select("img_id", F.explode(run("h")).alias("p")).select("img_id", "p.*")


def _distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    return sum(((i - j) * (i - j) for i, j in zip(p, q)), F.lit(0.0))


def nearest(px: DataFrame, palette: DataFrame, tie: str = "idx") -> DataFrame:
    """px with idx, the nearest palette entry in Oklab (lowest index on ties). Distances are computed once for each distinct colour of an image; a palette without img_id serves all images."""
    own = "img_id" in palette.columns
    entries = palette.select(*(["img_id"] if own else []), F.col(tie).alias("idx"), "r", "g", "b")
    entries = with_oklab(entries, ("pL", "pA", "pB")).drop("r", "g", "b")
    d = px.select(*(["img_id"] if own else []), "r", "g", "b").distinct()
    d = with_oklab(d, ("cL", "cA", "cB"))
    both = d.join(entries, "img_id") if own else d.crossJoin(entries)
    keys = (["img_id"] if own else []) + ["r", "g", "b"]
    dist = _distance(tuple(F.col(f"c{c}") for c in "LAB"), tuple(F.col(f"p{c}") for c in "LAB"))
    best = both.groupBy(*keys).agg(F.min_by("idx", F.struct(F.round(dist, 12).alias("d"), "idx")).alias("idx"))
    return px.join(best, keys)


def palette_weights(px: DataFrame, palette: DataFrame) -> DataFrame:
    """img_id, idx, r, g, b, weight, hex of the palette entries that pixels (alpha of 8 or more) fall to, as shares."""
    n = nearest(px.filter("a >= 8"), palette).groupBy("img_id", "idx").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy("img_id"))
    on = ["img_id", "idx"] if "img_id" in palette.columns else ["idx"]
    return n.withColumn("weight", F.col("n") / whole).join(palette, on).select("img_id", "idx", "r", "g", "b", "weight", short_hex(*[F.col(c) for c in "rgb"]).alias("hex"))


def css_variables(weights: DataFrame, prefix: str = "--color") -> DataFrame:
    """img_id, css: the palette as custom properties, heaviest first."""
    rank = F.row_number().over(W.partitionBy("img_id").orderBy(F.desc("weight"), "idx"))
    line = F.format_string(f"{prefix}-%d: %s;", F.col("k"), F.col("hex"))
    return weights.withColumn("k", rank).groupBy("img_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda s: s["t"]), "\n").alias("css"))


def lloyd_step(h: DataFrame, centres: DataFrame) -> DataFrame:
    """One k-means step as joins: img_id, idx, L, A, B, weight: the weighted mean of the bins (bins()) nearest to each centre (idx, L, A, B)."""
    p = with_oklab(h.select("img_id", "n", "rb", "gb", "bb", *[(F.col(f"s{c}") / F.col("n")).alias(c) for c in "rgb"]), ("bL", "bA", "bB"))
    both = p.crossJoin(centres.select("idx", *[F.col(c).alias(f"k{c}") for c in "LAB"]))
    dist = F.round(_distance(tuple(F.col(f"b{c}") for c in "LAB"), tuple(F.col(f"k{c}") for c in "LAB")), 12)
    near = both.groupBy("img_id", "rb", "gb", "bb").agg(F.min_by("idx", F.struct(dist.alias("d"), "idx")).alias("idx"), F.first("n").alias("n"), *[F.first(f"b{c}").alias(c) for c in "LAB"])
    return near.groupBy("img_id", "idx").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "LAB"], F.sum("n").alias("weight"))


def levels_of(hist: np.ndarray, most: int, rounds: int = 24) -> list[int]:
    """At most `most` alpha levels of a 256-bin histogram by Lloyd's algorithm from evenly spaced starts; 0 and 255 are added if they occur, so there may be more."""
    used = np.flatnonzero(hist)
    if not len(used):
        return []
    if len(used) <= most:
        return used.tolist()
    c = used[np.floor(np.arange(most) * (len(used) - 1) / max(most - 1, 1) + 0.5).astype(int)].astype(float)
    for _ in range(rounds):
        near = np.abs(used[:, None] - c[None]).argmin(1)
        w = np.bincount(near, hist[used], len(c))
        s = np.bincount(near, hist[used] * used, len(c))
        new = np.where(w > 0, np.floor(s / np.maximum(w, 1) + 0.5), c)
        if (new == c).all():
            break
        c = new
    out = {int(v) for v in c}
    return sorted(out | {v for v in (0, 255) if hist[v]})


def alpha_levels(px: DataFrame, most: int = 8) -> DataFrame:
    """img_id, levels: the alpha levels of each image, from a 256-row histogram."""
    ensure_importable(px.sparkSession)
    h = px.groupBy("img_id", "a").agg(F.count("*").alias("n")).groupBy("img_id").agg(F.collect_list(F.struct("a", "n")).alias("h"))

    @F.arrow_udf("array<int>")
    def run(hs: pa.Array) -> pa.Array:
        out = []
        for h_ in hs.to_pylist():
            hist = np.zeros(256)
            for e in h_:
                hist[e["a"]] = e["n"]
            out.append(levels_of(hist, most))
        return pa.array(out, pa.list_(pa.int32()))

    return h.select("img_id", run("h").alias("levels"))


def nearest_level(levels: Column, value: Column) -> Column:
    """The closest of sorted levels, the lower one on ties."""
    return F.array_min(F.transform(levels, lambda l: F.struct(F.abs(l - value).alias("d"), l.alias("l"))))["l"]


def banded(px: DataFrame, most: int = 8) -> DataFrame:
    """px with levels (the image's alpha_levels) and band, the level nearest to each pixel's alpha."""
    return px.join(alpha_levels(px, most), "img_id").withColumn("band", nearest_level(F.col("levels"), F.col("a")))


def fringe_levels(px: DataFrame, threshold: float = 0.2, level: str = "band") -> DataFrame:
    """img_id, level, n, inside, kept: for every alpha level its pixels and those whose four neighbours (as far as they exist) have the same level; levels but 0 and 255 need an inside share of the threshold."""
    v = F.col(level)
    same = [F.coalesce(at(level, d, o) == v, F.lit(True)) for o in (row(), column()) for d in (-1, 1)]
    inner = F.when(same[0] & same[1] & same[2] & same[3], 1).otherwise(0)
    g = px.select("img_id", v.alias("level"), inner.alias("i")).groupBy("img_id", "level").agg(F.count("*").alias("n"), F.sum("i").alias("inside"))
    return g.withColumn("kept", F.col("level").isin(0, 255) | (F.col("inside") / F.col("n") >= threshold))


def collapse_fringe(px: DataFrame, most: int = 8, threshold: float = 0.2) -> DataFrame:
    """Alpha of levels that fringe_levels() drops moves to the nearest kept level (the lower on ties), that of the others to their level; images that lose no level, or all, stay as they are."""
    p = banded(px, most)
    f = fringe_levels(p, threshold)
    g = f.groupBy("img_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("level")))).alias("keep"), F.bool_and("kept").alias("whole"))
    p = p.join(g, "img_id")
    moved = F.when(F.array_contains("keep", F.col("band")), F.col("band")).otherwise(nearest_level(F.col("keep"), F.col("band")))
    as_is = F.col("whole") | (F.size("keep") == 0) | (F.size("levels") <= 2)
    return p.withColumn("a", F.when(as_is, F.col("a")).otherwise(moved)).drop("levels", "band", "keep", "whole")


def dominant_of_box(h: DataFrame) -> DataFrame:
    """img_id, box, r, g, b: the mean of each box's most populated bin; h: bins() with a column box."""
    m = F.max_by(F.struct(*[half_up(F.col(f"s{c}") / F.col("n")).cast("int").alias(c) for c in "rgb"]), F.struct("n", -F.col("rb"), -F.col("gb"), -F.col("bb")))
    return h.groupBy("img_id", "box").agg(m.alias("m")).select("img_id", "box", "m.*")


def median_of_box(h: DataFrame) -> DataFrame:
    """img_id, box, r, g, b: for each channel the weighted median of the means of the box's bins: the first at which half of the pixels are reached."""
    mean = {c: F.col(f"s{c}") / F.col("n") for c in "rgb"}
    box = W.partitionBy("img_id", "box")
    reached = {f"u{c}": F.sum("n").over(box.orderBy(f"m{c}")) for c in "rgb"}
    p = h.withColumns({f"m{c}": v for c, v in mean.items()}).withColumns(reached | {"half": F.sum("n").over(box) / 2})
    return p.groupBy("img_id", "box").agg(*[half_up(F.min(F.when(F.col(f"u{c}") >= F.col("half"), F.col(f"m{c}")))).cast("int").alias(c) for c in "rgb"])


__all__ = ["alpha_levels", "bins", "collapse_fringe", "css_variables", "dominant_of_box", "fringe_levels", "levels_of", "lloyd", "lloyd_step", "median_of_box", "nearest", "nearest_level", "palette_of", "palette_weights", "quantize", "wu_boxes"]
