"""Geometry as DXF, EPS, PDF and SVG text, one document an image, by ordered string aggregates over shapes.

Shapes (img_id, ord, width, height, r, g, b, a) are closed polygons (points: array of struct<x, y>) or, where they have a column radius that isn't null, circles (cx, cy, radius), which stay circles: CIRCLE in DXF, arc in EPS, four cubics in PDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.colour import hex_of
from rasterloom.functions.markup import rounded, rounded3
from rasterloom.functions.scalar import acad_colour


def _documents(shapes: DataFrame, text, head, tail) -> DataFrame:
    """img_id, text of shapes (img_id, ord, width, height, ...)."""
    g = shapes.withColumn("__t", text).groupBy("img_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("ord", F.col("__t").alias("t")))).alias("s"))
    return g.select("img_id", F.concat(head, F.array_join(F.transform("s", lambda x: x["t"]), ""), tail).alias("text"))


#: Handle length of a quarter circle's cubic.
KAPPA = 0.5522847498


def _or_circle(shapes: DataFrame, polygon: Column, circle: Column | None) -> Column:
    return F.when(F.col("radius").isNotNull(), circle).otherwise(polygon) if circle is not None and "radius" in shapes.columns else polygon


def _numbers(*values: Column) -> Column:
    return F.concat_ws(" ", *[rounded3(v.cast("double")) for v in values])


def _round_path() -> Column:
    """A circle as PDF operators: from the right, counterclockwise, y upwards."""
    x, y, r = F.col("cx"), F.col("height") - F.col("cy"), F.col("radius")
    quarters = (((1, KAPPA), (KAPPA, 1), (0, 1)), ((-KAPPA, 1), (-1, KAPPA), (-1, 0)), ((-1, -KAPPA), (-KAPPA, -1), (0, -1)), ((KAPPA, -1), (1, -KAPPA), (1, 0)))
    curves = [x_ for q in quarters for x_ in (F.lit("\n"), _numbers(*[v for i, j in q for v in (x + r * i, y + r * j)]), F.lit(" c"))]
    return F.concat(_numbers(x + r, y), F.lit(" m"), *curves)


def svg(shapes: DataFrame, precision: int = 2) -> DataFrame:
    """Closed polygons (points: array of struct<x, y>; r, g, b, a) as paths."""
    xy = lambda p: F.concat(rounded(p["x"].cast("double"), precision), F.lit(" "), rounded(p["y"].cast("double"), precision))
    d = F.concat(F.lit("M"), F.array_join(F.transform("points", xy), "L"), F.lit("Z"))
    alpha = F.when(F.col("a") < 255, F.concat(F.lit('" fill-opacity="'), rounded3(F.col("a") / 255.0))).otherwise("")
    fill = F.concat(F.lit('" fill="'), hex_of(F.col("r"), F.col("g"), F.col("b")), alpha, F.lit('"/>'))
    t = F.concat(F.lit('<path fill-rule="evenodd" d="'), d, fill)
    if "radius" in shapes.columns:
        place = [v for k, c in (("cx", "cx"), ("cy", "cy"), ("r", "radius")) for v in (F.lit(f'" {k}="'), rounded(F.col(c).cast("double"), precision))]
        t = _or_circle(shapes, t, F.concat(F.lit("<circle "), F.substring(F.concat(*place), 3, 10_000), fill))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit('">'))
    return _documents(shapes, t, head, F.lit("</svg>"))


def dxf(shapes: DataFrame, units: int = 4) -> DataFrame:
    """ASCII DXF of closed polygons: a layer a colour, true colour, y upwards."""
    layer = F.concat(F.lit("C"), F.upper(F.substring(hex_of(F.col("r"), F.col("g"), F.col("b")), 2, 6)))
    true = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("string")
    vertex = lambda p: F.concat(F.lit("\n10\n"), rounded3(p["x"]), F.lit("\n20\n"), rounded3(F.col("height") - p["y"]))
    t = F.concat(F.lit("0\nLWPOLYLINE\n8\n"), layer, F.lit("\n62\n"), acad_colour(F.col("r"), F.col("g"), F.col("b")).cast("string"), F.lit("\n420\n"), true, F.lit("\n90\n"), F.size("points").cast("string"), F.lit("\n70\n1"), F.array_join(F.transform("points", vertex), ""), F.lit("\n"))
    if "radius" in shapes.columns:
        place = [v for k, c in (("10", F.col("cx")), ("20", F.col("height") - F.col("cy")), ("40", F.col("radius"))) for v in (F.lit(f"\n{k}\n"), rounded3(c.cast("double")))]
        t = _or_circle(shapes, t, F.concat(F.lit("0\nCIRCLE\n8\n"), layer, F.lit("\n62\n"), acad_colour(F.col("r"), F.col("g"), F.col("b")).cast("string"), F.lit("\n420\n"), true, *place, F.lit("\n")))
    return _documents(shapes, t, F.lit(f"0\nSECTION\n2\nHEADER\n9\n$INSUNITS\n70\n{units}\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"), F.lit("0\nENDSEC\n0\nEOF\n"))


def _painted():
    y = lambda p: F.concat(rounded3(p["x"]), F.lit(" "), rounded3(F.col("height") - p["y"]))
    first = F.concat(y(F.get("points", F.lit(0))), F.lit(" m"))
    rest = F.transform(F.slice("points", F.lit(2), F.greatest(F.size("points") - 1, F.lit(0))), lambda p: F.concat(F.lit("\n"), y(p), F.lit(" l")))
    return F.concat(first, F.array_join(rest, ""))


def _rgb(op: str):
    return F.concat(*[x for c in "rgb" for x in (rounded3(F.col(c) / 255.0), F.lit(" "))], F.lit(op))


def eps(shapes: DataFrame) -> DataFrame:
    arc = F.concat(_rgb("setrgbcolor\n"), F.lit("newpath\n"), _numbers(F.col("cx"), F.col("height") - F.col("cy"), F.col("radius")), F.lit(" 0 360 arc\nclosepath eofill\n")) if "radius" in shapes.columns else None
    t = F.concat(_rgb("setrgbcolor\n"), F.lit("newpath\n"), F.regexp_replace(F.regexp_replace(_painted(), " m(?=\n|$)", " moveto"), " l(?=\n|$)", " lineto"), F.lit("\nclosepath eofill\n"))
    head = F.concat(F.lit("%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 "), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n%%EndComments\n"))
    return _documents(shapes, _or_circle(shapes, t, arc), head, F.lit("%%EOF\n"))


def pdf(shapes: DataFrame) -> DataFrame:
    """A single-page document; the cross-reference offsets are lengths summed as they grow."""
    way = _or_circle(shapes, _painted(), _round_path() if "radius" in shapes.columns else None)
    t = F.concat(_rgb("rg\n"), way, F.lit("\nh f*\n"))
    body = _documents(shapes, t, F.lit(""), F.lit("")).join(shapes.groupBy("img_id").agg(F.max("width").alias("width"), F.max("height").alias("height")), "img_id")
    o1 = "1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n"
    o2 = "2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n"
    o3 = F.concat(F.lit("3 0 obj\n<</Type/Page/Parent 2 0 R/MediaBox[0 0 "), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("]/Contents 4 0 R/Resources<<>>>>\nendobj\n"))
    o4 = F.concat(F.lit("4 0 obj\n<</Length "), F.length("text").cast("string"), F.lit(">>\nstream\n"), F.col("text"), F.lit("endstream\nendobj\n"))
    head = "%PDF-1.4\n"
    a1, a2 = len(head), len(head) + len(o1)
    a3 = a2 + len(o2)
    b = body.withColumns({"o3": o3, "o4": o4})
    a4 = F.lit(a3) + F.length("o3")
    at = lambda v: F.concat(F.lpad(v.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    xref = F.concat(F.lit("xref\n0 5\n0000000000 65535 f \n"), *[at(v if not isinstance(v, int) else F.lit(v)) for v in (a1, a2, a3, a4)], F.lit("trailer\n<</Size 5/Root 1 0 R>>\nstartxref\n"), (a4 + F.length("o4")).cast("string"), F.lit("\n%%EOF\n"))
    return b.select("img_id", F.concat(F.lit(head + o1 + o2), "o3", "o4", xref).alias("text"))
