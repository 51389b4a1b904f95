"""The editing chain: DataFrame to DataFrame functions of dense rasters, used with df.transform, and a runner that keeps the fixed order."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.colour import clamp, gaussian, half_up, luma709, over, stored
from rasterloom.operators.stencil import at, clamped, column, extreme, prefix_sums, row, separable, sobel

RGB, RGBA = ("r", "g", "b"), ("r", "g", "b", "a")


def W_() -> Column:  # noqa: N802
    return F.col("width")


def H_() -> Column:  # noqa: N802
    return F.col("height")


def X() -> Column:  # noqa: N802
    return F.col("x")


def Y() -> Column:  # noqa: N802
    return F.col("y")


def _i(c: Column) -> Column:
    return c.cast("int")


def _each(px: DataFrame, f: Callable[[Column], Column], channels: tuple[str, ...] = RGB) -> DataFrame:
    return px.withColumns({c: f(F.col(c)) for c in channels if c in px.columns})


def crop(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A sub-rectangle, clamped to the image."""
    x0, y0 = F.least(F.lit(x), W_() - 1), F.least(F.lit(y), H_() - 1)
    w, h = F.greatest(F.lit(1), F.least(F.lit(width), W_() - x0)), F.greatest(F.lit(1), F.least(F.lit(height), H_() - y0))
    p = px.withColumns({"__x": x0, "__y": y0, "__w": w, "__h": h}).filter((X() >= F.col("__x")) & (X() < F.col("__x") + F.col("__w")) & (Y() >= F.col("__y")) & (Y() < F.col("__y") + F.col("__h")))
    return p.withColumns({"x": _i(X() - F.col("__x")), "y": _i(Y() - F.col("__y")), "width": _i(F.col("__w")), "height": _i(F.col("__h"))}).drop("__x", "__y", "__w", "__h")


def trim(px: DataFrame, threshold: int = 10) -> DataFrame:
    """Without the borders that differ from the top left pixel by the threshold at most."""
    first = W.partitionBy("img_id")
    own = [c for c in RGBA if c in px.columns]
    p = px.withColumns({f"__{c}": F.min_by(c, F.struct("y", "x")).over(first) for c in own})
    far = F.greatest(F.lit(0), *[F.abs(F.col(c) - F.col(f"__{c}")) for c in own]) > threshold
    box = {"__x0": F.min(F.when(far, X())), "__x1": F.max(F.when(far, X())), "__y0": F.min(F.when(far, Y())), "__y1": F.max(F.when(far, Y()))}
    p = p.withColumns({k: v.over(first) for k, v in box.items()})
    whole = F.col("__x0").isNull()
    p = p.filter(whole | (X().between(F.col("__x0"), F.col("__x1")) & Y().between(F.col("__y0"), F.col("__y1"))))
    out = {"x": F.when(whole, X()).otherwise(X() - F.col("__x0")), "y": F.when(whole, Y()).otherwise(Y() - F.col("__y0")), "width": F.when(whole, W_()).otherwise(F.col("__x1") - F.col("__x0") + 1), "height": F.when(whole, H_()).otherwise(F.col("__y1") - F.col("__y0") + 1)}
    return p.withColumns({k: _i(v) for k, v in out.items()}).drop(*[f"__{c}" for c in own], *box)


def resample(px: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Nearest-neighbour resize: each target pixel takes the source pixel under its centre (an equi-join on computed places)."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    dims = px.groupBy("img_id").agg(F.max("width").alias("sw"), F.max("height").alias("sh"))
    dims = dims.select("img_id", "sw", "sh", _i(_sub(w)).alias("width"), _i(_sub(h)).alias("height"))
    t = dims.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("tx"))
    t = t.withColumns({"x": _i(F.least(F.col("sw") - 1, F.floor((F.col("tx") + 0.5) * F.col("sw") / W_()))), "y": _i(F.least(F.col("sh") - 1, F.floor((F.col("ty") + 0.5) * F.col("sh") / H_())))})
    src = px.drop("width", "height")
    return t.join(src, ["img_id", "x", "y"]).drop("x", "y", "sw", "sh").withColumnsRenamed({"tx": "x", "ty": "y"})


def _sub(c: Column) -> Column:
    return c


def subsample(px: DataFrame, max_pixels: int) -> DataFrame:
    """Nearest-neighbour reduction to max_pixels at most; smaller images stay."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(max_pixels)) / (F.col("sw") * F.col("sh"))))
    return resample(px, F.greatest(F.lit(1), F.floor(F.col("sw") * scale)), F.greatest(F.lit(1), F.floor(F.col("sh") * scale)))


def resize(px: DataFrame, width: int, height: int, kernel: str = "nearest") -> DataFrame:
    """To one size: 'nearest', or 'linear', 'cubic', 'lanczos3' as a separable join of target pixels with weighted taps (wider when shrinking)."""
    if kernel == "nearest":
        return resample(px, width, height)
    support = {"linear": 1.0, "cubic": 2.0, "lanczos3": 3.0}[kernel]
    channels = [c for c in RGBA if c in px.columns]

    def weight(t: Column) -> Column:
        u = F.abs(t)
        if kernel == "linear":
            return F.greatest(F.lit(0.0), 1 - u)
        if kernel == "cubic":
            return F.when(u < 1, 1.5 * u * u * u - 2.5 * u * u + 1).when(u < 2, -0.5 * u * u * u + 2.5 * u * u - 4 * u + 2).otherwise(0.0)
        pi = F.pi()
        return F.when(u < 1e-9, 1.0).when(u < 3, 3 * F.sin(pi * u) * F.sin(pi * u / 3) / (pi * pi * u * u)).otherwise(0.0)

    def axis(d: DataFrame, pos: str, size: str, target: int) -> DataFrame:
        n = F.col(size)
        ratio = n / F.lit(float(target))
        scale = F.greatest(F.lit(1.0), ratio)
        # every source pixel goes to the target pixels that it weighs on; beyond the border the edge pixel stands in
        t0 = F.greatest(F.lit(0), _i(F.ceil((F.col(pos) + 0.5 - support * scale) / ratio - 0.5)))
        t1 = F.least(F.lit(target - 1), _i(F.floor((F.col(pos) + 0.5 + support * scale) / ratio - 0.5)))
        e = d.filter(t0 <= t1).withColumn("__t", F.explode(F.sequence(t0, t1)))
        w = weight(((F.col("__t") + 0.5) * ratio - (F.col(pos) + 0.5)) / scale)
        other = [c for c in ("x", "y") if c != pos]
        keep = [c for c in ("width", "height") if c != size]
        g = e.withColumn("__w", w).groupBy("img_id", *other, *keep, "__t").agg(*[(F.sum(F.col(c) * F.col("__w")) / F.sum("__w")).alias(c) for c in channels])
        return g.withColumnRenamed("__t", pos).withColumn(size, F.lit(target))

    out = axis(axis(px.select("img_id", "width", "height", "x", "y", *channels), "x", "width", width), "y", "height", height)
    return _each(out, stored, tuple(channels)).select("img_id", "width", "height", "x", "y", *channels)


def rotate(px: DataFrame, quarter_turns: int) -> DataFrame:
    """Clockwise by quarter turns, without loss."""
    for _ in range(quarter_turns % 4):
        px = px.withColumns({"x": _i(H_() - 1 - Y()), "y": X(), "width": H_(), "height": W_()})
    return px


def turned(px: DataFrame, degrees: float, background: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Clockwise by any angle, bilinear, on a canvas that holds the whole image; quarter turns are exact. Colours are weighted by alpha; beyond the border there is background."""
    if degrees % 90 == 0:
        return rotate(px, int(degrees // 90))
    t = math.radians(degrees)
    c, s = math.cos(t), math.sin(t)
    return transformed(px, (c, -s, s, c), background)


def transformed(px: DataFrame, m: tuple[float, float, float, float], background: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """An image under a 2x2 matrix, bilinear, on the smallest canvas that holds it. Every target pixel takes the four source pixels around where it comes from: a join, with the work of four rows a pixel."""
    a, b, c, d = m
    det = a * d - b * c
    size = px.groupBy("img_id").agg(F.max("width").alias("sw"), F.max("height").alias("sh"))
    n = [_i(F.greatest(F.lit(1), F.ceil(F.round(abs(p) * F.col("sw") + abs(q) * F.col("sh"), 9)))) for p, q in ((a, b), (c, d))]
    size = size.withColumns({"width": n[0], "height": n[1]})
    grid = size.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    u, v = X() - (W_() - 1) / 2.0, Y() - (H_() - 1) / 2.0
    sx = F.round((d * u - b * v) / det + (F.col("sw") - 1) / 2.0, 9)
    sy = F.round((-c * u + a * v) / det + (F.col("sh") - 1) / 2.0, 9)
    at = grid.withColumns({"fx": sx, "fy": sy}).withColumns({"x0": _i(F.floor("fx")), "y0": _i(F.floor("fy"))})
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)])
    w = lambda f, k, i: F.when(i == 0, 1 - (F.col(f) - F.col(k))).otherwise(F.col(f) - F.col(k))
    e = at.select("*", F.explode(taps).alias("t")).withColumns({"w": w("fx", "x0", F.col("t.i")) * w("fy", "y0", F.col("t.j")), "qx": F.col("x0") + F.col("t.i"), "qy": F.col("y0") + F.col("t.j")})
    src = px.select("img_id", F.col("x").alias("qx"), F.col("y").alias("qy"), *[F.col(k).alias(f"s_{k}") for k in RGBA])
    full = {k: F.coalesce(f"s_{k}", F.lit(g)) for k, g in zip(RGBA, background)}
    g = e.join(src, ["img_id", "qx", "qy"], "left").withColumns({f"s_{k}": v for k, v in full.items()})
    sums = [F.sum(F.col("w") * F.col(f"s_{k}") * F.col("s_a")).alias(f"m_{k}") for k in RGB] + [F.sum(F.col("w") * F.col("s_a")).alias("m_a")]
    out = g.groupBy("img_id", "width", "height", "x", "y").agg(*sums)
    new = {k: F.when(F.col("m_a") > 0, _i(clamp(half_up(F.round(F.col(f"m_{k}") / F.col("m_a"), 6)), 0, 255))).otherwise(0) for k in RGB} | {"a": _i(clamp(half_up(F.round("m_a", 6)), 0, 255))}
    return out.select("img_id", "width", "height", "x", "y", *[v.alias(k) for k, v in new.items()])


def flip(px: DataFrame) -> DataFrame:
    """Top to bottom."""
    return px.withColumn("y", _i(H_() - 1 - Y()))


def flop(px: DataFrame) -> DataFrame:
    """Left to right."""
    return px.withColumn("x", _i(W_() - 1 - X()))


def affine(px: DataFrame, m: tuple[float, float, float, float]) -> DataFrame:
    """Nearest-neighbour 2x2 transform about the centre, in an image of the same size; what comes from outside is void."""
    a, b, c, d = m
    det = a * d - b * c
    cx, cy = (W_() - 1) / 2.0, (H_() - 1) / 2.0
    u, v = X() - cx, Y() - cy
    t = px.select("img_id", "width", "height", "x", "y", _i(half_up((d * u - b * v) / det + cx)).alias("sx"), _i(half_up((-c * u + a * v) / det + cy)).alias("sy"))
    own = [k for k in RGBA if k in px.columns]
    src = px.select("img_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *own)
    return t.join(src, ["img_id", "sx", "sy"], "left").fillna(0, own).drop("sx", "sy")


def extend(px: DataFrame, top: int = 0, right: int = 0, bottom: int = 0, left: int = 0, how: str = "background", background: tuple[int, ...] = (0, 0, 0, 0)) -> DataFrame:
    """Padding: background, copy (the border pixel), repeat or mirror."""
    own = [c for c in RGBA if c in px.columns] or [c for c in px.columns if c not in ("img_id", "width", "height", "x", "y")]
    dims = px.select("img_id", F.col("width").alias("sw"), F.col("height").alias("sh")).distinct()
    t = dims.select("*", F.explode(F.sequence(F.lit(0), F.col("sh") + top + bottom - 1)).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.col("sw") + left + right - 1)).alias("tx"))

    def source(i: Column, n: Column) -> Column:
        if how == "copy":
            return F.least(n - 1, F.greatest(F.lit(0), i))
        if how == "repeat":
            return F.pmod(i, n)
        if how == "mirror":
            m = F.pmod(i, 2 * n)
            return F.when(m < n, m).otherwise(2 * n - 1 - m)
        return i

    t = t.withColumns({"x": _i(source(F.col("tx") - left, F.col("sw"))), "y": _i(source(F.col("ty") - top, F.col("sh")))})
    out = t.join(px.select("img_id", "x", "y", *own), ["img_id", "x", "y"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(own, background)})
    return out.select("img_id", _i(F.col("sw") + left + right).alias("width"), _i(F.col("sh") + top + bottom).alias("height"), F.col("tx").alias("x"), F.col("ty").alias("y"), *own)


def median(px: DataFrame, size: int = 3, channels: tuple[str, ...] = RGB) -> DataFrame:
    """The k x k median (lower middle of the taps inside the image); alpha stays. A row's taps are gathered along x, then whole gathered rows along y: two sorts."""
    own, r = [c for c in channels if c in px.columns], size // 2
    rows = px.withColumns({f"__m_{c}": F.array(*[at(c, d, row()) for d in range(-r, r + 1)]) for c in own})
    taken = rows.withColumns({f"__m_{c}": F.array(*[at(f"__m_{c}", d, column()) for d in range(-r, r + 1)]) for c in own})
    taps = taken.withColumns({f"__m_{c}": F.array_sort(F.array_compact(F.flatten(F.array_compact(f"__m_{c}")))) for c in own})
    mid = lambda c: F.get(f"__m_{c}", _i(F.floor((F.size(f"__m_{c}") - 1) / 2)))
    return taps.withColumns({c: mid(c) for c in own}).drop(*[f"__m_{c}" for c in own])


def convolve(px: DataFrame, kernel: list[list[float]], scale: float | None = None, offset: float = 0.0, channels: tuple[str, ...] = RGB) -> DataFrame:
    """Any odd kernel; taps outside the image take the nearest border pixel. Each row of the kernel is applied along x, then their results are added along y: two sorts."""
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2
    own = [c for c in channels if c in px.columns]
    div = scale if scale is not None else (sum(map(sum, kernel)) or 1.0)
    lines = {k: [(d - rx, float(v)) for d, v in enumerate(line) if v] for k, line in enumerate(kernel) if any(line)}
    total = lambda terms: reduce(lambda u, v: u + v, terms, F.lit(0.0))
    rows = px.withColumns({f"__k{k}_{c}": total([clamped(c, d, row()) * v for d, v in line]) for c in own for k, line in lines.items()})
    sums = rows.withColumns({f"__s_{c}": total([clamped(f"__k{k}_{c}", k - ry, column()) for k in lines]) for c in own})
    return sums.withColumns({c: stored(F.col(f"__s_{c}") / div + offset) for c in own}).drop(*[f"__s_{c}" for c in own], *[f"__k{k}_{c}" for c in own for k in lines])


def blur(px: DataFrame, sigma: float, channels: tuple[str, ...] = RGBA) -> DataFrame:
    own = [c for c in channels if c in px.columns]
    soft = separable(_each(px, lambda c: c.cast("double"), tuple(own)), own, gaussian(max(1, int(3 * sigma + 0.5)), sigma), "clamp")
    return _each(soft, stored, tuple(own))


def sharpen(px: DataFrame, sigma: float = 1.0, amount: float = 1.0) -> DataFrame:
    """Unsharp mask."""
    own = [c for c in RGB if c in px.columns]
    d = px.withColumns({f"__{c}": F.col(c).cast("double") for c in own})
    d = separable(d, [f"__{c}" for c in own], gaussian(max(1, int(3 * sigma + 0.5)), sigma), "clamp")
    return d.withColumns({c: stored(F.col(c) + amount * (F.col(c) - F.col(f"__{c}"))) for c in own}).drop(*[f"__{c}" for c in own])


def clahe(px: DataFrame, tile: int = 8, limit: float = 3.0) -> DataFrame:
    """Contrast-limited equalisation: each tile's histogram of luma is cut at limit times its mean, the rest spread evenly; a pixel's channels move by its tile's curve."""
    p = px.withColumns({"tx": _i(F.floor(X() / tile)), "ty": _i(F.floor(Y() / tile)), "l": _i(half_up(luma709(*[F.col(c) for c in RGB])))})
    h = p.groupBy("img_id", "tx", "ty", "l").agg(F.count("*").alias("n"))
    t = W.partitionBy("img_id", "tx", "ty")
    h = h.withColumn("all", F.sum("n").over(t)).withColumn("cap", limit * F.col("all") / 256.0).withColumn("cut", F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), F.col("cap"))))
    spare = (F.col("all") - F.sum("cut").over(t)) / 256.0
    h = h.withColumn("spare", spare).withColumn("cdf", F.sum("cut").over(t.orderBy("l")) + F.col("spare") * (F.col("l") + 1))
    curve = h.select("img_id", "tx", "ty", "l", (F.col("cdf") / F.col("all") * 255).alias("to"))
    gain = F.col("to") / F.greatest(F.col("l"), F.lit(1))
    return p.join(curve, ["img_id", "tx", "ty", "l"]).withColumns({c: stored(F.col(c) * gain) for c in RGB}).drop("tx", "ty", "l", "to")


def gamma(px: DataFrame, g: float = 2.2) -> DataFrame:
    return _each(px, lambda c: stored(F.pow(c / 255.0, F.lit(1 / g)) * 255))


def linear(px: DataFrame, a: float, b: float) -> DataFrame:
    return _each(px, lambda c: stored(c * a + b))


def normalize(px: DataFrame) -> DataFrame:
    """The darkest luma becomes 0 and the lightest 255."""
    whole = W.partitionBy("img_id")
    l = luma709(*[F.col(c) for c in RGB])  # noqa: E741
    p = px.withColumns({"__lo": F.min(l).over(whole), "__hi": F.max(l).over(whole)})
    span = F.col("__hi") - F.col("__lo")
    return _each(p, lambda c: F.when(span > 0, stored((c - F.col("__lo")) * 255 / span)).otherwise(c)).drop("__lo", "__hi")


def grayscale(px: DataFrame) -> DataFrame:
    return modulate(px, saturation=0.0)


def negate(px: DataFrame) -> DataFrame:
    return _each(px, lambda c: 255 - c)


def tint(px: DataFrame, r: int, g: int, b: int) -> DataFrame:
    l = luma709(*[F.col(c) for c in RGB]) / 255.0  # noqa: E741
    return px.withColumn("__l", l).withColumns({c: stored(F.col("__l") * v) for c, v in zip(RGB, (r, g, b))}).drop("__l")


def modulate(px: DataFrame, brightness: float = 1.0, saturation: float = 1.0, hue: float = 0.0, lightness: float = 0.0) -> DataFrame:
    """Brightness, saturation and hue about the luma axis, then an addition of lightness (percent)."""
    import math

    l = luma709(*[F.col(c) for c in RGB])  # noqa: E741
    p = px.withColumns({"__l": l, **{f"__{c}": (F.col(c) - l) * saturation for c in RGB}})
    cs, sn = math.cos(math.radians(hue)), math.sin(math.radians(hue))
    k, q = (1 - cs) / 3, sn / math.sqrt(3)
    d = [F.col(f"__{c}") for c in RGB]
    turned = [d[0] * (cs + k) + d[1] * (k - q) + d[2] * (k + q), d[0] * (k + q) + d[1] * (cs + k) + d[2] * (k - q), d[0] * (k - q) + d[1] * (k + q) + d[2] * (cs + k)] if hue else d
    return p.withColumns({c: stored((F.col("__l") + t) * brightness + lightness * 2.55) for c, t in zip(RGB, turned)}).drop("__l", *[f"__{c}" for c in RGB])


SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))


def recomb(px: DataFrame, m: tuple[tuple[float, ...], ...] = SEPIA) -> DataFrame:
    s = px.withColumns({f"__{c}": F.col(c) for c in RGB})
    return s.withColumns({c: stored(row[0] * F.col("__r") + row[1] * F.col("__g") + row[2] * F.col("__b")) for c, row in zip(RGB, m)}).drop("__r", "__g", "__b")


def threshold(px: DataFrame, at: int = 128) -> DataFrame:
    return _each(px, lambda c: F.when(c >= at, 255).otherwise(0))


def dilate(px: DataFrame, radius: int = 1, channels: tuple[str, ...] = RGB) -> DataFrame:
    for c in channels:
        px = extreme(px, c, radius, True)
    return px


def erode(px: DataFrame, radius: int = 1, channels: tuple[str, ...] = RGB) -> DataFrame:
    for c in channels:
        px = extreme(px, c, radius, False)
    return px


BLENDS: dict[str, Callable[[Column, Column], Column]] = {
    "over": lambda b, s: s,
    "multiply": lambda b, s: b * s,
    "screen": lambda b, s: b + s - b * s,
    "overlay": lambda b, s: F.when(b <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s)),
    "darken": F.least,
    "lighten": F.greatest,
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
    "add": lambda b, s: F.least(F.lit(1.0), b + s),
    "hard-light": lambda b, s: F.when(s <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s)),
    "soft-light": lambda b, s: F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b)) - b)),
    "colour-dodge": lambda b, s: F.when(b == 0, F.lit(0.0)).when(s >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / (1 - s))),
    "colour-burn": lambda b, s: F.when(b >= 1, F.lit(1.0)).when(s <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), (1 - b) / s)),
}


#: Where an overlay is anchored: shares of the free width and height.
GRAVITY = {"north": (0.5, 0), "northeast": (1, 0), "east": (1, 0.5), "southeast": (1, 1), "south": (0.5, 1), "southwest": (0, 1), "west": (0, 0.5), "northwest": (0, 0), "centre": (0.5, 0.5), "center": (0.5, 0.5)}


def placed(px: DataFrame, overlay: DataFrame, left: int | None, top: int | None, gravity: str, tile: bool) -> DataFrame:
    """The overlay's pixels (width and height are its own) at their place on each image of px: at left and top, else by gravity; tiled, it repeats from there in all directions until the image is full."""
    own = ["img_id"] if "img_id" in overlay.columns else []
    size = px.groupBy("img_id").agg(F.max("width").alias("bw"), F.max("height").alias("bh"))
    o = overlay.select(*own, F.col("width").alias("ow"), F.col("height").alias("oh"), "x", "y", *[F.col(c).alias(f"o_{c}") for c in RGBA])
    o = o.join(size, own) if own else o.crossJoin(size)  # without img_id the one overlay goes to every image, which is what composite() gives back
    sx, sy = GRAVITY[gravity]
    dx = F.lit(left) if left is not None else _i(F.floor((F.col("bw") - F.col("ow")) * sx))
    dy = F.lit(top) if top is not None else _i(F.floor((F.col("bh") - F.col("oh")) * sy))
    at = o.withColumns({"x": X() + dx, "y": Y() + dy})
    if tile:
        for pos, step, most in (("x", "ow", "bw"), ("y", "oh", "bh")):
            first = F.pmod(F.col(pos), F.col(step))
            at = at.filter(first < F.col(most)).withColumn(pos, F.explode(F.sequence(first, F.col(most) - 1, F.col(step))))
    return at.select("img_id", _i(X()).alias("x"), _i(Y()).alias("y"), *[f"o_{c}" for c in RGBA])


def composite(px: DataFrame, overlay: DataFrame, blend: str = "over", left: int | None = None, top: int | None = None, gravity: str | None = None, tile: bool = False) -> DataFrame:
    """The overlay's pixels (of the same img_id, or of all images if it has none) blended over px, by the compositing rules for straight alpha: a mode of BLENDS, or dest-over (below what is there) or xor (where only one is). Anchored at left and top (the origin without gravity), else by GRAVITY; a tiled overlay repeats over the whole image."""
    keys = (["img_id"] if "img_id" in overlay.columns else []) + ["x", "y"]
    if gravity or tile:
        keys = ["img_id", "x", "y"]
        o = placed(px, overlay, left, top, gravity or "northwest", tile)
    else:
        o = overlay.withColumns({"x": X() + (left or 0), "y": Y() + (top or 0)}).select(*keys, *[F.col(c).alias(f"o_{c}") for c in RGBA])
    if blend in ("dest-over", "xor"):
        return _porter_duff(px.join(o, keys, "left"), blend)
    p = px.join(o, keys, "left")
    sa, ba = F.coalesce(F.col("o_a"), F.lit(0)) / 255.0, F.col("a") / 255.0
    ra = sa + ba * (1 - sa)
    f = BLENDS[blend]

    def channel(c: str) -> Column:
        b, s = F.col(c) / 255.0, F.col(f"o_{c}") / 255.0
        mixed = (1 - sa) * ba * b + (1 - ba) * sa * s + sa * ba * f(b, s)
        return F.when(F.col("o_a").isNull() | (F.col("o_a") == 0), F.col(c)).otherwise(_i(clamp(half_up(F.round(mixed / ra * 255, 9)), 0, 255)))

    new = {c: channel(c) for c in RGB} | {"a": F.when(F.col("o_a").isNull(), F.col("a")).otherwise(_i(half_up(F.round(ra * 255, 9))))}
    return p.withColumns(new).drop(*[f"o_{c}" for c in RGBA])


def _porter_duff(p: DataFrame, blend: str) -> DataFrame:
    """The two modes that take the sides by coverage alone (Porter and Duff, 1984)."""
    sa, ba = F.coalesce(F.col("o_a"), F.lit(0)) / 255.0, F.col("a") / 255.0
    ws, wb = (sa * (1 - ba), ba) if blend == "dest-over" else (sa * (1 - ba), ba * (1 - sa))
    p = p.withColumns({"__ws": ws, "__wb": wb})
    total = F.col("__ws") + F.col("__wb")
    mixed = lambda c: F.when(total > 0, _i(clamp(half_up(F.round((F.coalesce(F.col(f"o_{c}"), F.lit(0)) * F.col("__ws") + F.col(c) * F.col("__wb")) / total, 9)), 0, 255))).otherwise(0)
    new = {c: F.when(F.col("o_a").isNull(), F.col(c)).otherwise(mixed(c)) for c in RGB} | {"a": F.when(F.col("o_a").isNull(), F.col("a")).otherwise(_i(half_up(F.round(total * 255, 9))))}
    return p.withColumns(new).drop(*[f"o_{c}" for c in RGBA], "__ws", "__wb")


def unflatten(px: DataFrame) -> DataFrame:
    """Pure white becomes transparent."""
    white = (F.col("r") == 255) & (F.col("g") == 255) & (F.col("b") == 255)
    return px.withColumn("a", F.when(white, 0).otherwise(F.col("a")))


def flatten(px: DataFrame, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    a = F.col("a")
    return px.withColumns({f"__{c}": over(F.col(c), a, v) for c, v in zip(RGB, background)}).withColumns({c: F.col(f"__{c}") for c in RGB}).withColumn("a", F.lit(255)).drop(*[f"__{c}" for c in RGB])


#: The order in which edit() applies whatever is asked for.
ORDER = ("crop", "trim", "resize", "rotate", "flip", "flop", "affine", "extend", "median", "blur", "sharpen", "clahe", "gamma", "linear", "convolve", "normalize", "grayscale", "negate", "tint", "modulate", "recomb", "threshold", "dilate", "erode", "composite", "unflatten", "flatten")


def has_ops(ops: dict) -> bool:
    return any(k in ORDER and v not in (None, False) for k, v in ops.items())


def edit(px: DataFrame, ops: dict[str, dict | bool]) -> DataFrame:
    """The operations named by ops (their keyword arguments, or True), in ORDER whatever order they were given in."""
    unknown = set(ops) - set(ORDER)
    if unknown:
        raise ValueError(f"no such operation: {', '.join(sorted(unknown))}")
    for name in ORDER:
        args = ops.get(name)
        if args not in (None, False):
            px = px.transform(partial(globals()[name], **({} if args is True else args)))
    return px


def smart_crop(px: DataFrame, width: int, height: int, aspect: float = 1.0, least_scale: float = 0.6, size_weight: float = 0.12, centre_weight: float = 0.25, saturation_weight: float = 0.3) -> DataFrame:
    """img_id, x, y, width, height, score: the window of an aspect that captures most importance (Sobel edges and saturation) for its area and distance from the centre. Candidates are a small grid computed here; their sums are joins with four corners of a summed-area table. Of equal scores the first candidate by size, y and x wins; scores are compared to nine digits. All images have the size given."""
    import math

    half = lambda v: math.floor(v + 0.5)
    mw, mh = width, half(width / aspect)
    if mh > height:
        mh, mw = height, half(height * aspect)
    mw, mh = min(mw, width), min(mh, height)
    cand, k = [], 0
    far = math.hypot(width / 2, height / 2) or 1
    for s in range(6):
        scale = 1 - (1 - least_scale) * s / 5
        w, h = max(1, half(mw * scale)), max(1, half(mh * scale))
        for y in range(0, height - h + 1, max(1, half(h / 16))):
            for x in range(0, width - w + 1, max(1, half(w / 16))):
                cost = size_weight * (w * h) / (width * height) + centre_weight * (math.hypot(x + w / 2 - width / 2, y + h / 2 - height / 2) / far) * 0.1
                cand.append((k, x, y, w, h, cost))
                k += 1
    c = px.sparkSession.createDataFrame(cand, "k int, cx int, cy int, cw int, ch int, cost double")
    r, g, b, a = (F.col(v) for v in RGBA)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    sat = F.when(top > 0, (top - low) / top * (a / 255.0)).otherwise(0.0)
    imp = sobel(px, (0.299 * r + 0.587 * g + 0.114 * b) * (a / 255.0), saturation_weight * sat * 255)
    sums = prefix_sums(imp.select("img_id", "x", "y", F.col("importance").alias("s")), ["s"])
    corners = c.select("k", F.explode(F.array(*[F.struct((F.col("cx") + dx * F.col("cw") - 1).alias("x"), (F.col("cy") + dy * F.col("ch") - 1).alias("y"), F.lit(sign).alias("sign")) for dx, dy, sign in ((1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1))])).alias("p")).select("k", "p.*").filter("x >= 0 and y >= 0")
    inside = sums.join(corners, ["x", "y"]).groupBy("img_id", "k").agg(F.sum(F.col("s") * F.col("sign")).alias("inside"))
    total = sums.filter((X() == width - 1) & (Y() == height - 1)).select("img_id", F.col("s").alias("total"))
    scored = inside.join(total, "img_id").join(c, "k").withColumn("score", F.round(F.col("inside") / F.col("total") - F.col("cost"), 9))
    best = scored.filter("total > 1e-6").groupBy("img_id").agg(F.max_by(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cw").alias("width"), F.col("ch").alias("height"), "score"), F.struct("score", -F.col("k"))).alias("m"))
    flat = total.filter("total <= 1e-6").select("img_id", F.lit((width - mw) // 2).alias("x"), F.lit((height - mh) // 2).alias("y"), F.lit(mw).alias("width"), F.lit(mh).alias("height"), F.lit(0.0).alias("score"))
    return best.select("img_id", "m.*").union(flat)


__all__ = [*ORDER, "BLENDS", "ORDER", "SEPIA", "edit", "has_ops", "smart_crop", "subsample"]
