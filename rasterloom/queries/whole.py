"""Queries: whole images in binary columns, held to the same SQL as the pixel relation's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import bindings as B
from rasterloom.operators import whole as I
from rasterloom.queries import edits, metrics, regions
from rasterloom.queries.sql import GRAY
from rasterloom.sources.rasters import from_pixels, to_pixels

R6 = lambda c: F.round(c, 6).alias(c)


def _gray(s: SparkSession, d: str) -> DataFrame:
    return from_pixels(B.gray_rgba(B.gray8(s, d)))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    r = from_pixels(B.rgba4(s, d, True))
    return I.pairs(r, r.withColumn("img_id", F.col("img_id") - 1))


def whole_histogram(s: SparkSession, d: str) -> DataFrame:
    return I.colour_histogram(_gray(s, d))


def whole_otsu(s: SparkSession, d: str) -> DataFrame:
    return I.otsu(_gray(s, d))


def whole_flatness(s: SparkSession, d: str) -> DataFrame:
    return I.flatness(_gray(s, d)).select("img_id", "colours", R6("run_ratio"), R6("noise"))


def whole_blur(s: SparkSession, d: str) -> DataFrame:
    return to_pixels(I.selective_blur(_gray(s, d), 2), "img_id").select("img_id", "x", "y", F.col("r").alias("v"))


def whole_components(s: SparkSession, d: str) -> DataFrame:
    c = F.col("class")
    px = B.heat(s, d).select("img_id", "width", "height", "x", "y", c.alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    return I.components(from_pixels(px), _red)


def _red(p):
    return p[..., 0]


def whole_report(s: SparkSession, d: str) -> DataFrame:
    return I.report(_pairs(s, d)).select("img_id", "n", "exact", "max_diff", R6("mse"), R6("psnr"), R6("ssim"), R6("ssim_luma"), R6("de_mean"), R6("de_p95"), R6("de_max"))


def whole_diff(s: SparkSession, d: str) -> DataFrame:
    return I.heat_map(_pairs(s, d)).select("img_id", "changed", "n", R6("fraction"), R6("de_max"), R6("de_mean"))


def whole_despike(s: SparkSession, d: str) -> DataFrame:
    """Ringing clipped in the sheets of lineitem (voids and all)."""
    return to_pixels(I.despike(from_pixels(B.sheet(s, d))).drop("touched"), "img_id")


QUERIES = {f.__name__: f for f in (whole_histogram, whole_otsu, whole_flatness, whole_blur, whole_components, whole_report, whole_diff, whole_despike)}
ORACLE = {
    "whole_histogram": f"WITH {GRAY} SELECT img_id, (CAST(v AS BIGINT) << 24) + (v << 16) + (v << 8) + 255 AS key, count(*) AS n FROM gray GROUP BY 1, 2",
    "whole_otsu": metrics.ORACLE["otsu"],
    "whole_flatness": f"SELECT m.img_id, m.colours, m.run_ratio, n.noise FROM ({metrics.ORACLE['mode_select']}) m JOIN ({metrics.ORACLE['interior_noise']}) n USING (img_id)",
    "whole_blur": edits.ORACLE["blur_selective"],
    "whole_components": regions.ORACLE["component_bounds"],
    "whole_report": metrics.ORACLE["compare_report_by_image"],
    "whole_diff": metrics.ORACLE["diff_summary"],
}
