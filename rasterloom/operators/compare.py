"""Full-reference comparison of two rasters: pixel equi-joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.colour import gaussian, half_up, luma709, over, premultiplied, with_delta_e2000, with_lab
from rasterloom.operators.stencil import column, row, at, weighted

C1, C2 = 6.5025, 58.5225
WHITE = (255, 255, 255)


def pairs(reference: DataFrame, candidate: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """Pixels side by side: channels p_* of the reference and q_* of the candidate, joined on (img_id, x, y). Both sides are hashed on img_id and place once; images of other size leave pixels unmatched, which paired() callers may check with same_size()."""
    p = reference.select("img_id", "width", "height", "x", "y", *[F.col(c).alias(f"p_{c}") for c in channels])
    q = candidate.select("img_id", "x", "y", *[F.col(c).alias(f"q_{c}") for c in channels])
    return p.join(q, ["img_id", "x", "y"])


def same_size(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """img_id, same: whether both rasters of that id have one size."""
    a = reference.groupBy("img_id").agg(F.max("width").alias("w1"), F.max("height").alias("h1"))
    b = candidate.groupBy("img_id").agg(F.max("width").alias("w2"), F.max("height").alias("h2"))
    return a.join(b, "img_id").select("img_id", ((F.col("w1") == F.col("w2")) & (F.col("h1") == F.col("h2"))).alias("same"))


def _pre(side: str) -> dict[str, Column]:
    a = F.col(f"{side}_a")
    return {f"{side}_{c}": premultiplied(F.col(f"{side}_{c}"), a) for c in "rgb"}


def premultiply_pairs(both: DataFrame) -> DataFrame:
    return both.withColumns(_pre("p") | _pre("q"))


def errors(both: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a"), divisor: int | None = None) -> DataFrame:
    """img_id, n, exact, exact_ratio, max_diff, mse, rmse, psnr (null if equal), lossless; of channels as they are (premultiply_pairs() first for alpha)."""
    d = [F.col(f"p_{c}") - F.col(f"q_{c}") for c in channels]
    worst = F.greatest(*[F.abs(x) for x in d]) if len(d) > 1 else F.abs(d[0])
    e = both.select("img_id", worst.alias("m"), sum((x * x for x in d), F.lit(0)).cast("long").alias("sq"))
    g = e.groupBy("img_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("m") == 0, 1)).alias("exact"), F.max("m").alias("max_diff"), (F.sum("sq") / (F.count("*") * (divisor or len(channels)))).alias("mse"))
    psnr = F.when(F.col("mse") > 0, 10 * F.log10(F.lit(65025.0) / F.col("mse")))
    return g.select("img_id", "n", "exact", (F.col("exact") / F.col("n")).alias("exact_ratio"), "max_diff", "mse", F.sqrt("mse").alias("rmse"), psnr.alias("psnr"), (F.col("exact") == F.col("n")).alias("lossless"))


def window_for(width: int, height: int) -> int:
    """Side of the SSIM window: 11, or the largest odd one that fits."""
    m = min(width, height)
    return 11 if m >= 11 else m - 1 + m % 2


def ssim_planes(both: DataFrame, width: int, height: int, planes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """img_id and a column for each of planes (name: its values on both sides): mean structural similarity (Wang et al., 2004) of images of one size, Gaussian window of sigma 1.5, interior pixels only. The five moments of all planes are blurred together: one sort an axis, whatever the planes. Images thinner than 3 score 1 where equal, else 0."""
    base = both.select("img_id", "x", "y", *[v.cast("double").alias(f"{n}_{k}") for n, pq in planes.items() for k, v in zip(("mx", "my"), pq)])
    if min(width, height) < 3:
        return base.groupBy("img_id").agg(*[F.when(F.bool_and(F.col(f"{n}_mx") == F.col(f"{n}_my")), 1.0).otherwise(0.0).alias(n) for n in planes])
    base = base.withColumns({f"{n}_{i}{j}": F.col(f"{n}_m{i}") * F.col(f"{n}_m{j}") for n in planes for i, j in ("xx", "yy", "xy")})
    m = [f"{n}_{k}" for n in planes for k in ("mx", "my", "xx", "yy", "xy")]
    k = gaussian(window_for(width, height) // 2, 1.5)
    rows = base.withColumns({c: weighted(c, k, row()) for c in m}).filter(F.col(m[0]).isNotNull())
    full = rows.withColumns({c: weighted(c, k, column()) for c in m}).filter(F.col(m[0]).isNotNull())

    def score(n: str) -> Column:
        mx, my, xx, yy, xy = (F.col(f"{n}_{c}") for c in ("mx", "my", "xx", "yy", "xy"))
        return F.avg((2 * mx * my + C1) * (2 * (xy - mx * my) + C2) / ((mx * mx + my * my + C1) * ((xx - mx * mx) + (yy - my * my) + C2))).alias(n)

    return full.groupBy("img_id").agg(*[score(n) for n in planes])


def ssim(both: DataFrame, width: int, height: int, p: Column | str = "p", q: Column | str = "q") -> DataFrame:
    """img_id, ssim: ssim_planes() of two columns."""
    return ssim_planes(both, width, height, {"ssim": tuple(F.col(c) if isinstance(c, str) else c for c in (p, q))})


def ssim_rgba(both: DataFrame, width: int, height: int) -> DataFrame:
    """img_id, ssim, ssim_luma of premultiplied pairs: the mean over r, g, b, and alpha where the reference's varies or both are constant and differ."""
    planes = {f"s_{c}": (F.col(f"p_{c}"), F.col(f"q_{c}")) for c in "rgba"} | {"ssim_luma": tuple(luma709(*[F.col(f"{s}_{c}") for c in "rgb"]) for s in "pq")}
    out = ssim_planes(both, width, height, planes)
    alpha = both.groupBy("img_id").agg(*[f(f"{s}_a").alias(f"{s}_{n}") for s in "pq" for n, f in (("lo", F.min), ("hi", F.max))])
    varies = F.col("p_lo") != F.col("p_hi")
    counts = varies | ((F.col("q_lo") == F.col("q_hi")) & (F.col("p_lo") != F.col("q_lo")))
    rgb = F.col("s_r") + F.col("s_g") + F.col("s_b")
    return out.join(alpha, "img_id").select("img_id", F.when(counts, (rgb + F.col("s_a")) / 4).otherwise(rgb / 3).alias("ssim"), "ssim_luma")


def delta_e_field(both: DataFrame, background: tuple[int, int, int] = WHITE) -> DataFrame:
    """Every pixel's CIEDE2000 between the two sides flattened over a background: column de."""
    flat = [tuple(over(F.col(f"{s}_{c}"), F.col(f"{s}_a"), b) for c, b in zip("rgb", background)) for s in "pq"]
    named = both.withColumns({f"f{s}_{c}": x for s, side in zip("pq", flat) for c, x in zip("rgb", side)})
    p, q = (tuple(f"__{s}_{c}" for c in "LAB") for s in "pq")
    d = with_lab(with_lab(named, p, ("fp_r", "fp_g", "fp_b")), q, ("fq_r", "fq_g", "fq_b"))
    d = with_delta_e2000(d, "de", p, q).drop(*p, *q)
    same = (F.col("fp_r") == F.col("fq_r")) & (F.col("fp_g") == F.col("fq_g")) & (F.col("fp_b") == F.col("fq_b"))
    return d.withColumn("de", F.when(same, F.lit(0.0)).otherwise(F.col("de")))


def delta_e_stats(field: DataFrame) -> DataFrame:
    """img_id, de_mean, de_p95, de_max; the quantile comes from bins of 0.01, capped at 100."""
    h = field.groupBy("img_id", F.least(F.lit(10000), half_up(F.col("de") * 100)).cast("int").alias("bin")).agg(F.count("*").alias("k"), F.sum("de").alias("s"), F.max("de").alias("m"))
    whole = W.partitionBy("img_id")
    h = h.withColumns({"cum": F.sum("k").over(whole.orderBy("bin")), "n": F.sum("k").over(whole)})
    p95 = F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * 0.95), F.col("bin"))) / 100
    return h.groupBy("img_id").agg((F.sum("s") / F.sum("k")).alias("de_mean"), p95.alias("de_p95"), F.max("m").alias("de_max"))


def coherent(field: DataFrame, threshold: float = 2.0, neighbours: int = 4) -> DataFrame:
    """bad: de above the threshold; kept: bad with at least so many bad ones of its eight neighbours."""
    p = field.withColumn("bad", F.when(F.col("de") > threshold, 1).otherwise(0))
    p = p.withColumn("row3", F.coalesce(at("bad", -1, row()), F.lit(0)) + F.col("bad") + F.coalesce(at("bad", 1, row()), F.lit(0)))
    around = F.coalesce(at("row3", -1, column()), F.lit(0)) + F.col("row3") + F.coalesce(at("row3", 1, column()), F.lit(0)) - F.col("bad")
    return p.withColumn("kept", F.when((F.col("bad") == 1) & (around >= neighbours), 1).otherwise(0)).drop("row3")


def severity(field: DataFrame, threshold: float = 2.0, neighbours: int = 4) -> DataFrame:
    """img_id, differing, coherent, clusters, largest, mass, score: how much of the error hangs together, by 4-connected clusters of coherent pixels."""
    from rasterloom.operators.regions import label_components

    marked = coherent(field, threshold, neighbours)
    per = marked.groupBy("img_id").agg(F.sum("bad").alias("differing"), F.sum("kept").alias("coherent"), F.count("*").alias("n"))
    labels = label_components(marked.select("img_id", "width", "height", "x", "y", F.when(F.col("kept") == 1, 1).otherwise(-1).alias("class")))
    areas = labels.filter("comp >= 0").groupBy("img_id", "comp").agg(F.count("*").alias("area"))
    agg = areas.groupBy("img_id").agg(F.count("*").alias("clusters"), F.max("area").alias("largest"), F.sum(F.col("area") * F.col("area")).alias("sq"))
    out = per.join(agg, "img_id", "left")
    mass = F.least(F.lit(1.0), F.sqrt(F.coalesce("sq", F.lit(0)).cast("double")) / F.col("n"))
    return out.select("img_id", "differing", "coherent", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("largest", F.lit(0)).alias("largest"), mass.alias("mass"), (1 - mass).alias("score"))


def composite(psnr: Column, ssim_: Column, score: Column) -> Column:
    """(clamp(psnr/40) * ssim^2 * severity)^(1/4); a null psnr is a lossless one."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    p = F.when(psnr.isNull(), F.lit(1.0)).otherwise(unit(psnr / 40))
    return F.pow(p * unit(ssim_) * unit(ssim_) * unit(score), F.lit(0.25))


def report(reference: DataFrame, candidate: DataFrame, width: int, height: int) -> DataFrame:
    """The whole comparison, one row an image: errors, SSIM, delta E, severity and composite of images of one size."""
    both = pairs(reference, candidate)
    field = delta_e_field(both)
    pre = premultiply_pairs(both)
    e = errors(pre)
    out = e.join(ssim_rgba(pre, width, height), "img_id").join(delta_e_stats(field), "img_id").join(severity(field), "img_id")
    one = F.col("lossless")
    return out.withColumns({"ssim": F.when(one, 1.0).otherwise(F.col("ssim")), "ssim_luma": F.when(one, 1.0).otherwise(F.col("ssim_luma"))}).withColumn("composite", F.when(one, 1.0).otherwise(composite(F.col("psnr"), F.col("ssim"), F.col("score"))))


def heat_map(both: DataFrame, threshold: float = 2.0, keep: float = 0.1, colour: tuple[int, int, int] = (255, 40, 40), alpha: bool = True) -> DataFrame:
    """The difference image: changed pixels in one colour, the others faded gray; columns changed, de, r, g, b."""
    f = delta_e_field(both)
    delta = F.abs(F.col("p_a") - F.col("q_a")) / 255.0 * 100 if alpha else F.lit(0.0)
    changed = F.greatest(F.col("de"), delta) > threshold
    gray = half_up(255 * (1 - keep) + luma709(*[F.col(f"fp_{c}") for c in "rgb"]) * keep).cast("int")
    return f.select("img_id", "x", "y", "de", F.when(changed, 1).otherwise(0).alias("changed"), *[F.when(changed, v).otherwise(gray).alias(c) for c, v in zip("rgb", colour)])


def heat_summary(heat: DataFrame) -> DataFrame:
    return heat.groupBy("img_id").agg(F.sum("changed").alias("changed"), F.count("*").alias("n"), (F.sum("changed") / F.count("*")).alias("fraction"), F.max("de").alias("de_max"), F.avg("de").alias("de_mean"))
