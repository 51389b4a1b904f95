"""Plan shapes for neighbourhoods of dense images: each axis is one sort by (img_id, line), however many taps it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from rasterloom.functions.colour import gaussian, half_up, mean_luma



def row() -> WindowSpec:
    return W.partitionBy("img_id", "y").orderBy("x")


def column() -> WindowSpec:
    return W.partitionBy("img_id", "x").orderBy("y")


def at(c: Column | str, d: int, over: WindowSpec) -> Column:
    """The value d steps on; null beyond the border."""
    return F.lead(c, d).over(over) if d > 0 else F.lag(c, -d).over(over) if d < 0 else (F.col(c) if isinstance(c, str) else c)


def clamped(c: str, d: int, over: WindowSpec) -> Column:
    """The value d steps on; the border's own beyond it (for steps up to the border's distance the nearest existing one)."""
    x = at(c, d, over)
    step = 1 if d > 0 else -1
    for k in range(abs(d) - 1, -1, -1):
        x = F.coalesce(x, at(c, k * step, over))
    return x


def weighted(c: str, kernel: list[float], over: WindowSpec, border: str = "null") -> Column:
    """A 1-D convolution; border 'null' (null where a tap is missing) or 'clamp'."""
    r = len(kernel) // 2
    tap = clamped if border == "clamp" else at
    return sum((tap(c, i - r, over) * w for i, w in enumerate(kernel) if i != 0), tap(c, -r, over) * kernel[0])


def separable(px: DataFrame, columns: list[str], kernel: list[float], border: str = "null") -> DataFrame:
    """Blur columns along x, then along y: two sorts for all of them together."""
    rows = px.withColumns({c: weighted(c, kernel, row(), border) for c in columns})
    return rows.withColumns({c: weighted(c, kernel, column(), border) for c in columns})


def prefix_sums(px: DataFrame, columns: list[str]) -> DataFrame:
    """Summed-area tables: column c becomes the sum over all pixels up and left of it, itself included."""
    rows = px.withColumns({c: F.sum(c).over(row().rowsBetween(W.unboundedPreceding, 0)) for c in columns})
    return rows.withColumns({c: F.sum(c).over(column().rowsBetween(W.unboundedPreceding, 0)) for c in columns})


def box_sum(px: DataFrame, columns: list[str], half: int) -> DataFrame:
    """Sums over the (2 half + 1) square around each pixel, cut at the border."""
    rows = px.withColumns({c: F.sum(c).over(row().rowsBetween(-half, half)) for c in columns})
    return rows.withColumns({c: F.sum(c).over(column().rowsBetween(-half, half)) for c in columns})


def extreme(px: DataFrame, name: str, radius: int, grow: bool = True) -> DataFrame:
    """Dilation (grow) or erosion by a square of side 2 radius + 1: running maxima or minima per axis."""
    f = F.max if grow else F.min
    rows = px.withColumn(name, f(name).over(row().rowsBetween(-radius, radius)))
    return rows.withColumn(name, f(name).over(column().rowsBetween(-radius, radius)))


def neighbours8(c: str, px: DataFrame, prefix: str = "n") -> DataFrame:
    """Eight columns n_<dx>_<dy> (m for minus) with the neighbours' values; null beyond the border."""

    def name(dx: int, dy: int) -> str:
        return f"{prefix}_{'m' if dx < 0 else ''}{abs(dx)}_{'m' if dy < 0 else ''}{abs(dy)}"

    rows = px.withColumns({f"__l": at(c, -1, row()), f"__r": at(c, 1, row())})
    out = {}
    for dy in (-1, 0, 1):
        for dx, src in ((-1, "__l"), (0, c), (1, "__r")):
            if dx or dy:
                out[name(dx, dy)] = at(src, dy, column())
    return rows.withColumns(out).drop("__l", "__r")


N8 = ["n_m1_m1", "n_0_m1", "n_1_m1", "n_m1_0", "n_1_0", "n_m1_1", "n_0_1", "n_1_1"]


def selective_blur(px: DataFrame, radius: int, delta: int = 20, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """A clamped Gaussian blur of sigma radius/3 that keeps a pixel if any channel would move by more than delta."""
    k = gaussian(radius, radius / 3 if radius else 1.0)
    soft = separable(px.withColumns({f"s_{c}": F.col(c).cast("double") for c in channels}), [f"s_{c}" for c in channels], k, "clamp")
    moved = [F.abs(F.col(f"s_{c}") - F.col(c)) for c in channels]
    far = (F.greatest(*moved) if len(moved) > 1 else moved[0]) > delta
    return soft.withColumns({c: F.when(far, F.col(c)).otherwise(half_up(F.round(f"s_{c}", 9)).cast("int")) for c in channels}).drop(*[f"s_{c}" for c in channels])


def diffusion_step(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), kappa: float = 20.0, rate: float = 0.2) -> DataFrame:
    """One Perona-Malik step (1990) on double channels; border pixels stay."""

    def flux(d: Column) -> Column:
        return F.exp(-(d / kappa) * (d / kappa)) * d

    out = {}
    for c in channels:
        p = F.col(c)
        n, s, e, w = at(c, -1, column()), at(c, 1, column()), at(c, 1, row()), at(c, -1, row())
        out[c] = F.when(n.isNotNull() & s.isNotNull() & e.isNotNull() & w.isNotNull(), p + rate * (flux(n - p) + flux(s - p) + flux(e - p) + flux(w - p))).otherwise(p)
    return px.withColumns(out)


def iterations_for(noise: Column, strength: float) -> Column:
    return half_up(24 * strength * (1 - F.exp(-F.greatest(noise - 0.3, F.lit(0.0)) / 0.5))).cast("int")


def interior_noise(px: DataFrame, luma: Column | None = None) -> DataFrame:
    """img_id, noise: mean distance of a pixel's luminance from its 3x3 mean, over pixels on no edge (central gradient up to 24); 0 without such pixels."""
    l = luma if luma is not None else mean_luma(*[F.col(c) for c in "rgba"])  # noqa: E741
    p = neighbours8("lum", px.withColumn("lum", l.cast("double")))
    inner = p.filter((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("width") - 1) & (F.col("y") < F.col("height") - 1))
    flat = F.hypot(F.col("n_1_0") - F.col("n_m1_0"), F.col("n_0_1") - F.col("n_0_m1")) <= 24
    mean = (sum((F.col(c) for c in N8), F.col("lum"))) / 9
    noise = inner.groupBy("img_id").agg(F.coalesce(F.avg(F.when(flat, F.abs(F.col("lum") - mean))), F.lit(0.0)).alias("noise"))
    return px.select("img_id").distinct().join(noise, "img_id", "left").withColumn("noise", F.coalesce("noise", F.lit(0.0)))


def boundary_band(px: DataFrame, radius: int = 12, label: str = "class") -> DataFrame:
    """band = 1 within radius (a box) of a change of label between 4-neighbours."""
    v = F.col(label)
    near = [at(label, d, o) for o in (row(), column()) for d in (-1, 1)]
    change = F.greatest(*[F.when(n.isNotNull() & (n != v), 1).otherwise(0) for n in near])
    seed = px.withColumn("band", change)
    return extreme(seed, "band", radius) if radius > 0 else seed


def bilateral(px: DataFrame, radius: int = 4, sigma_space: float = 1.8, sigma_range: float = 60.0) -> DataFrame:
    """A bilateral filter of RGBA where band = 1 (Tomasi and Manduchi, 1998); the taps are a join of the band's pixels with their neighbours, so the work follows the band and not the image. Results are stored as 8-bit channels."""
    ch = ("r", "g", "b", "a")
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    centre = px.filter("band = 1").select("img_id", "x", "y", *[F.col(c).alias(f"c_{c}") for c in ch])
    taps = centre.select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy")).withColumns({"tx": F.col("x") + F.col("dx"), "ty": F.col("y") + F.col("dy")})
    src = px.select("img_id", F.col("x").alias("tx"), F.col("y").alias("ty"), *ch)
    dist = sum(((F.col(c) - F.col(f"c_{c}")) * (F.col(c) - F.col(f"c_{c}")) for c in ch), F.lit(0))
    w = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.lit(2 * sigma_space**2)) * F.exp(-dist / F.lit(2 * sigma_range**2))
    means = taps.join(src, ["img_id", "tx", "ty"]).withColumn("w", w).groupBy("img_id", "x", "y").agg(*[F.bround(F.sum(F.col("w") * F.col(c)) / F.sum("w")).cast("int").alias(f"m_{c}") for c in ch])
    out = px.join(means, ["img_id", "x", "y"], "left")
    return out.withColumns({c: F.coalesce(f"m_{c}", c) for c in ch}).drop(*[f"m_{c}" for c in ch])


def refine_source(px: DataFrame, radius: int = 12, label: str = "class", **smoothing: float) -> DataFrame:
    """The image that sub-pixel measuring reads: bilateral() within boundary_band() of the labels, untouched elsewhere."""
    return bilateral(boundary_band(px, radius, label), **smoothing)


def sobel(px: DataFrame, luma: Column, extra: Column | None = None) -> DataFrame:
    """importance: the Sobel gradient of luma over 4 (borders clamped), plus extra."""
    p = px.withColumn("lum", luma.cast("double"))
    rows = p.withColumns({"__l": clamped("lum", -1, row()), "__r": clamped("lum", 1, row())})
    rows = rows.withColumns({"__d": F.col("__r") - F.col("__l"), "__s": F.col("__l") + 2 * F.col("lum") + F.col("__r")})
    gx = clamped("__d", -1, column()) + 2 * F.col("__d") + clamped("__d", 1, column())
    gy = clamped("__s", 1, column()) - clamped("__s", -1, column())
    out = F.hypot(gx, gy) / 4
    return rows.withColumn("importance", out if extra is None else out + extra).drop("__l", "__r", "__d", "__s")
