"""Histograms, modes, flatness, thresholds and background votes: grouping and windows, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.colour import half_up, key_of, luma709, pack_rgba, unpack_rgba, with_oklab
from rasterloom.operators.stencil import row, box_sum, interior_noise

RGBA = ("r", "g", "b", "a")


def _c() -> list[Column]:
    return [F.col(c) for c in RGBA]


def colour_histogram(px: DataFrame) -> DataFrame:
    """img_id, key, n: pixels of each RGBA key; all transparent ones are key 0."""
    return px.groupBy("img_id", key_of(*_c()).alias("key")).agg(F.count("*").alias("n"))


def distinct_colours(px: DataFrame, cap: int | None = None) -> DataFrame:
    """img_id, colours, capped: distinct keys; beyond the cap the count is cap + 1."""
    d = px.groupBy("img_id").agg(F.countDistinct(key_of(*_c())).alias("colours"))
    if cap is None:
        return d.withColumn("capped", F.lit(False))
    return d.select("img_id", F.least("colours", F.lit(cap + 1)).alias("colours"), (F.col("colours") > cap).alias("capped"))


def dominant_colour(px: DataFrame) -> DataFrame:
    """The most frequent RGBA value of each image; of equal counts the one seen first in raster order."""
    k = px.groupBy("img_id", pack_rgba(*_c()).alias("key")).agg(F.count("*").alias("n"), F.min(F.col("y") * F.col("width") + F.col("x")).alias("first"))
    best = k.groupBy("img_id").agg(F.max_by("key", F.struct("n", -F.col("first"))).alias("key"), F.max("n").alias("n"))
    return best.select("img_id", "n", *[u.alias(c) for c, u in zip(RGBA, unpack_rgba(F.col("key")))])


def is_opaque(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg(F.bool_and(F.col("a") == 255).alias("opaque"))


def flatness(px: DataFrame, key: Column | None = None, cap: int = 4096, luma: Column | None = None) -> DataFrame:
    """img_id, colours, capped, run_ratio (horizontal runs over pixels), noise: what the choice of a mode rests on."""
    k = px.withColumn("key", key if key is not None else key_of(*_c()))
    starts = F.when(F.lag("key").over(row()).eqNullSafe(F.col("key")), 0).otherwise(1)
    agg = k.withColumn("run", starts).groupBy("img_id").agg(F.countDistinct("key").alias("n"), (F.sum("run") / F.count("*")).alias("run_ratio"), F.count("*").alias("pixels"))
    out = agg.select("img_id", F.least("n", F.lit(cap + 1)).alias("colours"), (F.col("n") > cap).alias("capped"), "run_ratio", "pixels")
    return out.join(interior_noise(px, luma), "img_id")


def otsu(px: DataFrame, luma: Column | None = None, alpha: Column | None = None) -> DataFrame:
    """img_id, threshold: Otsu's (1979) on the 256 rounded luminances of pixels with alpha of 128 or more; the lowest of equal thresholds, 128 without a split."""
    l = luma if luma is not None else luma709(*_c()[:3])  # noqa: E741
    opaque = (alpha if alpha is not None else F.col("a")) >= 128
    h = px.filter(opaque).groupBy("img_id", half_up(l).cast("int").alias("t")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("img_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("img_id")
    h = h.withColumns({"wb": F.sum("n").over(upto), "sb": F.sum(F.col("n") * F.col("t")).over(upto), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("t")).over(whole)})
    wf = F.col("w") - F.col("wb")
    diff = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    between = F.when(wf > 0, F.col("wb").cast("double") * wf * diff * diff)
    best = h.withColumn("v", between).filter("v is not null").groupBy("img_id").agg(F.max_by("t", F.struct("v", -F.col("t"))).alias("threshold"))
    return px.select("img_id").distinct().join(best, "img_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(128)))


def bradley(px: DataFrame, luma: Column | None = None, alpha: Column | None = None, window: int = 0, percent: float = 15) -> DataFrame:
    """ink = 1 where the luminance is at most (100 - percent)% of the mean around it (Bradley and Roth, 2007); the means are two running window sums. Without a window its side is an eighth of the smaller dimension, which must then be one for all images."""
    l = luma if luma is not None else luma709(*_c()[:3])  # noqa: E741
    opaque = (alpha if alpha is not None else F.col("a")) >= 128
    if not window:
        first = px.select("width", "height").first()
        window = max(3, int(min(first) / 8 + 0.5)) if first else 3
    half = max(1, window >> 1)
    p = px.withColumns({"lum": l.cast("double"), "ok": opaque})
    p = box_sum(p.withColumns({"s": F.when(F.col("ok"), F.col("lum")).otherwise(0.0), "k": F.when(F.col("ok"), 1).otherwise(0)}), ["s", "k"], half)
    dark = F.col("ok") & (F.col("k") > 0) & (F.col("lum") <= F.col("s") / F.col("k") * ((100 - percent) / 100))
    return p.withColumn("ink", F.when(dark, 1).otherwise(0)).drop("lum", "ok", "s", "k")


def apply_threshold(px: DataFrame, cutoff: DataFrame | None = None, luma: Column | None = None, foreground: tuple[int, int, int] = (0, 0, 0), background: tuple[int, int, int] = (255, 255, 255), black_on_white: bool = True) -> DataFrame:
    """Every pixel in one of two colours; alpha below 128 becomes void. cutoff: img_id, threshold (Otsu's if missing)."""
    l = luma if luma is not None else luma709(*_c()[:3])  # noqa: E741
    t = cutoff if cutoff is not None else otsu(px, luma)
    dark = half_up(l) <= F.col("threshold")
    fg = dark if black_on_white else ~dark
    void = F.col("a") < 128
    out = {c: F.when(void, 0).when(fg, f).otherwise(b) for c, f, b in zip("rgb", foreground, background)}
    return px.join(t, "img_id").withColumns(out | {"a": F.when(void, 0).otherwise(255)})


def background_colour(px: DataFrame) -> DataFrame:
    """The most frequent border colour; of equal counts the one first met (top and bottom pixel of each column, then both ends of each inner row)."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    order = F.when(y == 0, 2 * x).when(y == h - 1, 2 * x + 1).when(x == 0, 2 * w + 2 * (y - 1)).otherwise(2 * w + 2 * (y - 1) + 1)
    edge = px.filter((x == 0) | (y == 0) | (x == w - 1) | (y == h - 1))
    votes = edge.groupBy("img_id", key_of(*_c()).alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = votes.groupBy("img_id").agg(F.max_by("key", F.struct("n", -F.col("first"))).alias("key"))
    return best.select("img_id", *[u.alias(c) for c, u in zip(RGBA, unpack_rgba(F.col("key")))])


def background_distance(px: DataFrame, colour: DataFrame) -> DataFrame:
    """Oklab distance of each pixel to its image's background colour; 0 where it is transparent."""
    bg = colour.select("img_id", *[F.col(c).alias(f"bg_{c}") for c in "rgb"])
    p = px.join(bg, "img_id")
    p = with_oklab(with_oklab(p, ("__okL", "__okA", "__okB")), ("__u", "__v", "__w"), ("bg_r", "bg_g", "bg_b"))
    d = F.sqrt(sum(((F.col(i) - F.col(j)) * (F.col(i) - F.col(j)) for i, j in zip(("__okL", "__okA", "__okB"), ("__u", "__v", "__w"))), F.lit(0.0)))
    return p.withColumn("distance", F.when(F.col("a") == 0, F.lit(0.0)).otherwise(d)).drop("bg_r", "bg_g", "bg_b", "__okL", "__okA", "__okB", "__u", "__v", "__w")


def remove_background_everywhere(px: DataFrame, colour: DataFrame | None = None, tolerance: float = 0.02, feather: bool = False) -> DataFrame:
    """Alpha 0 where the distance is within the tolerance; with feather a ramp up to twice of it. Pixels are only ever made more transparent."""
    p = background_distance(px, colour if colour is not None else background_colour(px))
    d = F.col("distance")
    alpha = F.when(d <= tolerance, 0)
    if feather:
        alpha = alpha.when(d < 2 * tolerance, half_up(255 * ((d - tolerance) / tolerance)).cast("int"))
    return p.withColumn("a", F.when(alpha.isNotNull() & (alpha < F.col("a")), alpha).otherwise(F.col("a"))).drop("distance")


def runs_horizontal(px: DataFrame, value: str = "class") -> DataFrame:
    """Maximal runs of equal value in each row: img_id, y, x0, len, value (gaps and islands)."""
    starts = F.when(F.lag(value).over(row()).eqNullSafe(F.col(value)), 0).otherwise(1)
    p = px.withColumn("__s", starts).withColumn("__run", F.sum("__s").over(row().rowsBetween(W.unboundedPreceding, 0)))
    return p.groupBy("img_id", "y", "__run").agg(F.min("x").alias("x0"), F.count("*").alias("len"), F.first(value).alias(value)).drop("__run")
