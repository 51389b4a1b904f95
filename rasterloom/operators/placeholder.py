"""Cosine moments and BlurHash, gradients by least squares."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.colour import clamp, linear_to_srgb, srgb_to_linear
from rasterloom.functions.scalar import encode83


def cosine_moments(px: DataFrame, cx: int = 4, cy: int = 3) -> DataFrame:
    """img_id, i, j, lr, lg, lb: the 2-D cosine moments of linear RGB. Cosines depend on (component, place) only; the sums are one aggregate with a column for each moment, so pixels aren't multiplied."""
    lin = {f"l{c}": srgb_to_linear(F.col(c)) for c in "rgb"}
    p = px.select("img_id", "width", "height", "x", "y", *[v.alias(k) for k, v in lin.items()])
    aggs, names = [], []
    for j in range(cy):
        for i in range(cx):
            basis = F.cos(math.pi * i * F.col("x") / F.col("width")) * F.cos(math.pi * j * F.col("y") / F.col("height")) * (1.0 if i == j == 0 else 2.0)
            for c in lin:
                names.append(f"m_{i}_{j}_{c}")
                aggs.append((F.sum(basis * F.col(c)) / F.max(F.col("width") * F.col("height"))).alias(names[-1]))
    g = p.groupBy("img_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.col(f"m_{i}_{j}_{c}").alias(c) for c in lin]) for j in range(cy) for i in range(cx)])
    return g.select("img_id", F.explode(rows).alias("m")).select("img_id", "m.*")


def blurhash(px: DataFrame, cx: int = 4, cy: int = 3) -> DataFrame:
    """img_id, hash: the BlurHash text of each image (alpha is ignored)."""
    m = cosine_moments(px, cx, cy)
    g = m.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("j", "i", "lr", "lg", "lb"))).alias("m"))
    rest = F.slice("m", F.lit(2), F.lit(cx * cy - 1))
    top = F.array_max(F.transform(rest, lambda s: F.greatest(F.abs(s["lr"]), F.abs(s["lg"]), F.abs(s["lb"])))) if cx * cy > 1 else F.lit(0.0)
    quant = clamp(F.floor(top * 166 - 0.5), 0, 82)
    g = g.withColumn("q", quant)
    scale = (F.col("q") + 1) / 166.0
    step = lambda v: clamp(F.floor(F.signum(v) * F.sqrt(F.abs(v / scale)) * 9 + 9.5), 0, 18)
    ac = F.array_join(F.transform(rest, lambda s: encode83(step(s["lr"]) * 361 + step(s["lg"]) * 19 + step(s["lb"]), 2)), "")
    dc = F.get("m", F.lit(0))
    first = linear_to_srgb(dc["lr"]) * 65536 + linear_to_srgb(dc["lg"]) * 256 + linear_to_srgb(dc["lb"])
    size = encode83(F.lit((cx - 1) + (cy - 1) * 9), 1)
    return g.select("img_id", F.concat(size, encode83(F.col("q") if cx * cy > 1 else F.lit(0), 1), encode83(first, 4), ac).alias("hash"))


def linear_ramps(px: DataFrame, value: str = "v", by: tuple[str, ...] = ("img_id",)) -> DataFrame:
    """by, n, c0, cx, cy, rms: the plane c0 + cx*x + cy*y that fits a channel best, by one aggregate of moments and Cramer's rule; null where the pixels lie on a line."""
    x, y, v = (F.col(c).cast("double") for c in ("x", "y", value))
    m = px.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in {"sx": x, "sy": y, "sv": v, "sxx": x * x, "syy": y * y, "sxy": x * y, "sxv": x * v, "syv": y * v, "svv": v * v}.items()])
    n = F.col("n")
    c = {k: F.col(f"s{k}") - F.col(f"s{k[0]}") * F.col(f"s{k[1]}") / n for k in ("xx", "yy", "xy", "xv", "yv", "vv")}
    det = c["xx"] * c["yy"] - c["xy"] * c["xy"]
    a = F.when(F.abs(det) > 1e-9, (c["xv"] * c["yy"] - c["yv"] * c["xy"]) / det)
    b = F.when(F.abs(det) > 1e-9, (c["xx"] * c["yv"] - c["xy"] * c["xv"]) / det)
    base = F.col("sv") / n - a * F.col("sx") / n - b * F.col("sy") / n
    rms = F.sqrt(F.greatest((c["vv"] - a * c["xv"] - b * c["yv"]) / n, F.lit(0.0)))
    return m.select(*by, "n", base.alias("c0"), a.alias("cx"), b.alias("cy"), rms.alias("rms"))
