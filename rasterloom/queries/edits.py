"""Queries: the editing chain, stencils, crops."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import bindings as B
from rasterloom.functions.colour import gaussian
from rasterloom.operators import edit as E
from rasterloom.operators import histogram as H
from rasterloom.operators import stencil as S
from rasterloom.queries.sql import GRAY, HEAT, MIXED4, PAIRS4, blur_cte, oklab_cte

KEEP = ("img_id", "width", "height", "x", "y", "r", "g", "b", "a")
R6 = lambda c: F.round(c, 6).alias(c)


def _rgba(s: SparkSession, d: str) -> DataFrame:
    return B.rgba4(s, d, True)


def _edit(**ops):
    def run(s: SparkSession, d: str) -> DataFrame:
        return E.edit(_rgba(s, d), ops).select(*KEEP)

    return run


def _gray(s: SparkSession, d: str) -> DataFrame:
    return B.gray8(s, d).withColumnRenamed("v", "r")


def edit_dilate(s: SparkSession, d: str) -> DataFrame:
    return E.dilate(_gray(s, d), 1, ("r",)).select("img_id", "x", "y", "r")


def edit_erode(s: SparkSession, d: str) -> DataFrame:
    return E.erode(_gray(s, d), 1, ("r",)).select("img_id", "x", "y", "r")


def edit_median(s: SparkSession, d: str) -> DataFrame:
    return E.median(_gray(s, d), 3, ("r",)).select("img_id", "x", "y", "r")


def edit_convolve(s: SparkSession, d: str) -> DataFrame:
    return E.convolve(_gray(s, d), [[0, -1, 0], [-1, 5, -1], [0, -1, 0]], channels=("r",)).select("img_id", "x", "y", "r")


def edit_blur(s: SparkSession, d: str) -> DataFrame:
    return E.blur(_gray(s, d), 0.7, ("r",)).select("img_id", "x", "y", "r")


def edit_composite_multiply(s: SparkSession, d: str) -> DataFrame:
    p = _rgba(s, d)
    over = p.withColumn("img_id", F.col("img_id") - 1)
    return E.composite(p, over, "multiply").select("img_id", "x", "y", "r", "g", "b", "a")


def edit_chain(s: SparkSession, d: str) -> DataFrame:
    """Several operations, given in another order than the one they are done in."""
    return E.edit(_rgba(s, d), {"negate": True, "flip": True, "crop": {"x": 1, "y": 0, "width": 3, "height": 3}, "rotate": {"quarter_turns": 1}}).select(*KEEP)


def edit_resize_lanczos(s: SparkSession, d: str) -> DataFrame:
    return E.resize(B.gray_rgba(B.gray8(s, d)), 5, 5, "lanczos3")


def edit_modulate(s: SparkSession, d: str) -> DataFrame:
    return E.modulate(_rgba(s, d), brightness=1.1, saturation=0.5, hue=40).select(*KEEP)


def edit_clahe(s: SparkSession, d: str) -> DataFrame:
    return E.clahe(B.gray_rgba(B.gray8(s, d)), 4).select(*KEEP)


def subsample(s: SparkSession, d: str) -> DataFrame:
    return E.subsample(B.heat(s, d).select("img_id", "width", "height", "x", "y", "class"), 200).select("img_id", "width", "height", "x", "y", "class")


def blur_selective(s: SparkSession, d: str) -> DataFrame:
    return S.selective_blur(B.gray8(s, d), 2, 20, ("v",)).select("img_id", "x", "y", "v")


def diffuse_step(s: SparkSession, d: str) -> DataFrame:
    p = B.gray8(s, d).withColumn("v", F.col("v").cast("double"))
    return S.diffusion_step(p, ("v",)).select("img_id", "x", "y", R6("v"))


def boundary_band(s: SparkSession, d: str) -> DataFrame:
    return S.boundary_band(B.heat(s, d), 2).select("img_id", "x", "y", "band")


def bilateral_band(s: SparkSession, d: str) -> DataFrame:
    p = B.heat(s, d).filter("x < 12 and y < 12").withColumns({"width": F.lit(12), "height": F.lit(12), "r": F.least(F.col("n") * 37, F.lit(255)).cast("int"), "g": (F.col("class") * 100).cast("int"), "b": F.lit(7), "a": F.lit(255)})
    return S.bilateral(S.boundary_band(p, 1), 2).select("img_id", "x", "y", "r", "g", "b", "a")


def sobel_importance(s: SparkSession, d: str) -> DataFrame:
    return S.sobel(B.gray8(s, d), F.col("v")).select("img_id", "x", "y", R6("importance"))


def integral_image(s: SparkSession, d: str) -> DataFrame:
    return S.prefix_sums(B.gray8(s, d).withColumn("v", F.col("v").cast("long")), ["v"]).select("img_id", "x", "y", "v")


def smart_crop(s: SparkSession, d: str) -> DataFrame:
    return E.smart_crop(B.gray_rgba(B.gray8(s, d)), 8, 8).select("img_id", "x", "y", "width", "height", F.round("score", 6).alias("score"))


def bg_remove_everywhere(s: SparkSession, d: str) -> DataFrame:
    return H.remove_background_everywhere(_rgba(s, d), tolerance=0.08, feather=True).select("img_id", "x", "y", "a")


_W = f"WITH {MIXED4}"
_ID = "4 AS width, 4 AS height"
_STORE = lambda e: f"CAST(round_even(least(255.0, greatest(0.0, {e})), 0) AS INTEGER)"
_L = "0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b"
_S3 = [(0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131)]
_BOX = "FROM gray a JOIN gray b ON b.img_id = a.img_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY a.img_id, a.x, a.y"
_SORT = "SELECT img_id, x, y, lum, lag(lum) OVER r AS w0, lead(lum) OVER r AS e0 FROM (SELECT img_id, x, y, v::DOUBLE AS lum FROM gray) WINDOW r AS (PARTITION BY img_id, y ORDER BY x)"
_SOBEL = f"""sb0 AS ({_SORT}), sb1 AS (SELECT img_id, x, y, coalesce(e0, lum) - coalesce(w0, lum) AS d, coalesce(w0, lum) + 2 * lum + coalesce(e0, lum) AS t FROM sb0),
sb2 AS (SELECT img_id, x, y, d, coalesce(lag(d) OVER k, d) AS dn, coalesce(lead(d) OVER k, d) AS ds, coalesce(lag(t) OVER k, t) AS tn, coalesce(lead(t) OVER k, t) AS ts FROM sb1 WINDOW k AS (PARTITION BY img_id, x ORDER BY y)),
imp AS MATERIALIZED (SELECT img_id, x, y, sqrt(power(dn + 2*d + ds, 2) + power(ts - tn, 2)) / 4 AS importance FROM sb2)"""
_CAND = """cand AS (SELECT row_number() OVER (ORDER BY s, y, x) AS k, x, y, w FROM (SELECT s, w, unnest(range(0, 8 - w + 1)) AS x FROM (SELECT s, greatest(1, CAST(floor(8 * (1 - 0.4 * s / 5.0) + 0.5) AS INTEGER)) AS w FROM range(0, 6) t(s))) a JOIN (SELECT unnest(range(0, 8)) AS y) b ON b.y + w <= 8)"""

QUERIES = {
    "edit_crop": _edit(crop={"x": 1, "y": 1, "width": 2, "height": 9}), "edit_flip": _edit(flip=True), "edit_flop": _edit(flop=True), "edit_rotate90": _edit(rotate={"quarter_turns": 1}), "edit_negate": _edit(negate=True),
    "edit_linear": _edit(linear={"a": 1.2, "b": -10.0}), "edit_recomb": _edit(recomb=True), "edit_threshold": _edit(threshold={"at": 128}), "edit_unflatten": _edit(threshold={"at": 128}, unflatten=True), "edit_flatten": _edit(flatten={"background": (10, 20, 30)}),
    "edit_gamma": _edit(gamma={"g": 2.2}), "edit_normalize": _edit(normalize=True), "edit_grayscale": _edit(grayscale=True), "edit_tint": _edit(tint={"r": 255, "g": 128, "b": 0}), "edit_affine": _edit(affine={"m": (0, -1, 1, 0)}),
    "edit_extend": _edit(extend={"top": 1, "left": 2, "right": 1, "bottom": 0, "how": "mirror"}), "edit_trim": _edit(trim={"threshold": 40}), "edit_resize_nearest": _edit(resize={"width": 6, "height": 3}), "edit_sharpen": _edit(sharpen={"sigma": 0.7}),
} | {f.__name__: f for f in (edit_dilate, edit_erode, edit_median, edit_convolve, edit_blur, edit_composite_multiply, edit_chain, edit_resize_lanczos, edit_modulate, edit_clahe, subsample, blur_selective, diffuse_step, boundary_band, bilateral_band, sobel_importance, integral_image, smart_crop, bg_remove_everywhere)}
_MIR = lambda i, n: f"(CASE WHEN (({i}) % {2 * n} + {2 * n}) % {2 * n} < {n} THEN (({i}) % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - (({i}) % {2 * n} + {2 * n}) % {2 * n} END)"
def _modulated() -> str:
    """brightness 1.1, saturation 0.5, hue 40, with the rotation's weights as numbers."""
    cs, sn = math.cos(math.radians(40)), math.sin(math.radians(40))
    k, q = (1 - cs) / 3, sn / math.sqrt(3)
    turn = ((cs + k, k - q, k + q), (k + q, cs + k, k - q), (k - q, k + q, cs + k))
    new = ", ".join(f"{_STORE('(l + (' + ' + '.join(f'd{i} * {v!r}::DOUBLE' for i, v in zip('rgb', row)) + ')) * 1.1::DOUBLE')} AS {c}" for c, row in zip("rgb", turn))
    return f"{_W}, m AS (SELECT *, {_L} AS l, " + ", ".join(f"({c} - ({_L})) * 0.5::DOUBLE AS d{c}" for c in "rgb") + f" FROM rgba) SELECT img_id, {_ID}, x, y, {new}, a FROM m"


_CLAHE = f"""WITH {GRAY}, h AS (SELECT img_id, x // 4 AS tx, y // 4 AS ty, v AS l, count(*) AS n FROM gray GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY img_id, tx, ty) AS total FROM h), c AS (SELECT *, least(n::DOUBLE, greatest(1.0::DOUBLE, 3.0::DOUBLE * total / 256.0::DOUBLE)) AS cut FROM k),
e AS (SELECT *, (total - sum(cut) OVER (PARTITION BY img_id, tx, ty)) / 256.0::DOUBLE AS spare, sum(cut) OVER (PARTITION BY img_id, tx, ty ORDER BY l) AS upto FROM c),
g AS (SELECT img_id, tx, ty, l, (upto + spare * (l + 1)) / total * 255 / greatest(l, 1) AS gain FROM e)
SELECT p.img_id, 8 AS width, 8 AS height, p.x, p.y, {", ".join(f"{_STORE('v * gain')} AS {c}" for c in "rgb")}, 255 AS a FROM gray p JOIN g ON g.img_id = p.img_id AND g.tx = p.x // 4 AND g.ty = p.y // 4 AND g.l = p.v"""

_SHARP = f"{_W}, s AS (SELECT img_id, x, y, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM rgba), {blur_cte('s', 'soft', ['r', 'g', 'b'], gaussian(2, 0.7), clamp=True, w=4, h=4)} SELECT p.img_id, {_ID}, p.x, p.y, " + ", ".join(f"{_STORE(f'p.{c} + 1.0::DOUBLE * (p.{c} - s.{c})')} AS {c}" for c in "rgb") + ", p.a FROM rgba p JOIN soft s USING (img_id, x, y)"
ORACLE = {
    "edit_sharpen": _SHARP,
    "edit_modulate": _modulated(),
    "edit_clahe": _CLAHE,
    "edit_crop": f"{_W} SELECT img_id, 2 AS width, 3 AS height, x - 1 AS x, y - 1 AS y, r, g, b, a FROM rgba WHERE x BETWEEN 1 AND 2 AND y >= 1",
    "edit_flip": f"{_W} SELECT img_id, {_ID}, x, 3 - y AS y, r, g, b, a FROM rgba",
    "edit_flop": f"{_W} SELECT img_id, {_ID}, 3 - x AS x, y, r, g, b, a FROM rgba",
    "edit_rotate90": f"{_W} SELECT img_id, {_ID}, 3 - y AS x, x AS y, r, g, b, a FROM rgba",
    "edit_negate": f"{_W} SELECT img_id, {_ID}, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM rgba",
    "edit_linear": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"{_STORE(f'{c} * 1.2::DOUBLE - 10')} AS {c}" for c in "rgb") + ", a FROM rgba",
    "edit_recomb": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"{_STORE(f'{m[0]}::DOUBLE*r + {m[1]}::DOUBLE*g + {m[2]}::DOUBLE*b')} AS {c}" for c, m in zip("rgb", _S3)) + ", a FROM rgba",
    "edit_threshold": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"CASE WHEN {c} >= 128 THEN 255 ELSE 0 END AS {c}" for c in "rgb") + ", a FROM rgba",
    "edit_unflatten": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"CASE WHEN {c} >= 128 THEN 255 ELSE 0 END AS {c}" for c in "rgb") + ", CASE WHEN r >= 128 AND g >= 128 AND b >= 128 THEN 0 ELSE a END AS a FROM rgba",
    "edit_flatten": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"CASE WHEN a = 255 THEN {c} WHEN a = 0 THEN {v} ELSE CAST(floor({c} * (a / 255.0::DOUBLE) + {v} * (1 - a / 255.0::DOUBLE) + 0.5) AS INTEGER) END AS {c}" for c, v in zip("rgb", (10, 20, 30))) + ", 255 AS a FROM rgba",
    "edit_gamma": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"{_STORE(f'power({c} / 255.0::DOUBLE, 1/2.2::DOUBLE) * 255')} AS {c}" for c in "rgb") + ", a FROM rgba",
    "edit_normalize": f"{_W}, e AS (SELECT img_id, min({_L}) AS lo, max({_L}) AS hi FROM rgba GROUP BY 1) SELECT img_id, {_ID}, x, y, " + ", ".join(f"CASE WHEN hi > lo THEN {_STORE(f'({c} - lo) * 255 / (hi - lo)')} ELSE {c} END AS {c}" for c in "rgb") + ", a FROM rgba JOIN e USING (img_id)",
    "edit_grayscale": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"{_STORE(_L)} AS {c}" for c in "rgb") + ", a FROM rgba",
    "edit_tint": f"{_W} SELECT img_id, {_ID}, x, y, " + ", ".join(f"{_STORE(f'(({_L}) / 255.0::DOUBLE) * {v}')} AS {c}" for c, v in zip("rgb", (255, 128, 0))) + ", a FROM rgba",
    "edit_affine": f"{_W} SELECT img_id, {_ID}, 3 - y AS x, x AS y, r, g, b, a FROM rgba",
    "edit_extend": f"{_W}, t AS (SELECT img_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, {_MIR('tx - 2', 4)} AS x, {_MIR('ty - 1', 4)} AS y FROM (SELECT DISTINCT img_id FROM rgba) CROSS JOIN range(0, 7) i(tx) CROSS JOIN range(0, 5) j(ty)) SELECT img_id, 7 AS width, 5 AS height, tx AS x, ty AS y, r, g, b, a FROM t JOIN rgba USING (img_id, x, y)",
    "edit_trim": f"""{_W}, f AS (SELECT img_id, r AS r0, g AS g0, b AS b0, a AS a0 FROM rgba WHERE x = 0 AND y = 0), d AS (SELECT rgba.*, greatest(abs(r - r0), abs(g - g0), abs(b - b0), abs(a - a0)) > 40 AS far FROM rgba JOIN f USING (img_id)),
b AS (SELECT img_id, min(x) FILTER (far) AS x0, max(x) FILTER (far) AS x1, min(y) FILTER (far) AS y0, max(y) FILTER (far) AS y1 FROM d GROUP BY 1)
SELECT img_id, coalesce(x1 - x0 + 1, 4) AS width, coalesce(y1 - y0 + 1, 4) AS height, x - coalesce(x0, 0) AS x, y - coalesce(y0, 0) AS y, r, g, d.b AS b, a FROM d JOIN b USING (img_id) WHERE x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)""",
    "edit_resize_nearest": f"{_W}, t AS (SELECT img_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CAST(least(3, floor((tx + 0.5) * 4 / 6)) AS INTEGER) AS x, CAST(least(3, floor((ty + 0.5) * 4 / 3)) AS INTEGER) AS y FROM (SELECT DISTINCT img_id FROM rgba) CROSS JOIN range(0, 6) i(tx) CROSS JOIN range(0, 3) j(ty)) SELECT img_id, 6 AS width, 3 AS height, tx AS x, ty AS y, r, g, b, a FROM t JOIN rgba USING (img_id, x, y)",
    "edit_dilate": f"WITH {GRAY} SELECT a.img_id, a.x, a.y, max(b.v) AS r {_BOX}",
    "edit_erode": f"WITH {GRAY} SELECT a.img_id, a.x, a.y, min(b.v) AS r {_BOX}",
    "edit_median": f"WITH {GRAY} SELECT a.img_id, a.x, a.y, list_sort(list(b.v))[(count(*) - 1) // 2 + 1] AS r {_BOX}",
    "edit_convolve": f"WITH {GRAY} SELECT c.img_id, c.x, c.y, CAST(least(255, greatest(0, 5 * c.v - sum(t.v))) AS INTEGER) AS r FROM gray c CROSS JOIN (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) k(dx, dy) JOIN gray t ON t.img_id = c.img_id AND t.x = least(7, greatest(0, c.x + dx)) AND t.y = least(7, greatest(0, c.y + dy)) GROUP BY c.img_id, c.x, c.y, c.v",
    "edit_blur": f"WITH {GRAY}, g AS (SELECT img_id, x, y, v::DOUBLE AS v FROM gray), {blur_cte('g', 'bl', ['v'], gaussian(2, 0.7), clamp=True)} SELECT img_id, x, y, {_STORE('v')} AS r FROM bl",
    "edit_composite_multiply": f"""{_W}, {PAIRS4}, m AS (SELECT img_id, x, y, p_r, p_g, p_b, p_a, q_a / 255.0::DOUBLE AS sa, p_a / 255.0::DOUBLE AS ba, q_r, q_g, q_b, q_a FROM pairs), l AS (SELECT * FROM rgba WHERE img_id = (SELECT max(img_id) FROM rgba))
SELECT img_id, x, y, """ + ", ".join(f"CASE WHEN q_a = 0 THEN p_{c} ELSE CAST(least(255, greatest(0, floor(round(((1 - sa) * ba * (p_{c} / 255.0::DOUBLE) + (1 - ba) * sa * (q_{c} / 255.0::DOUBLE) + sa * ba * ((p_{c} / 255.0::DOUBLE) * (q_{c} / 255.0::DOUBLE))) / (sa + ba * (1 - sa)) * 255, 9) + 0.5))) AS INTEGER) END AS {c}" for c in "rgb") + ", CAST(floor(round((sa + ba * (1 - sa)) * 255, 9) + 0.5) AS INTEGER) AS a FROM m UNION ALL SELECT img_id, x, y, r, g, b, a FROM l",
    "edit_chain": f"{_W} SELECT img_id, 3 AS width, 3 AS height, 2 - y AS x, 2 - (3 - 1 - (x - 1)) AS y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM rgba WHERE x >= 1 AND y <= 2".replace("2 - y AS x, 2 - (3 - 1 - (x - 1)) AS y", "2 - y AS x, 2 - (x - 1) AS y"),
    "subsample": f"WITH {HEAT}, t AS (SELECT img_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CAST(least(23, floor((tx + 0.5) * 24 / 12)) AS INTEGER) AS x, CAST(least(30, floor((ty + 0.5) * 31 / 16)) AS INTEGER) AS y FROM (SELECT DISTINCT img_id FROM heat) CROSS JOIN range(0, 12) i(tx) CROSS JOIN range(0, 16) j(ty)) SELECT img_id, 12 AS width, 16 AS height, tx AS x, ty AS y, class FROM t JOIN heat USING (img_id, x, y)",
    "blur_selective": f"WITH {GRAY}, g AS (SELECT img_id, x, y, v::DOUBLE AS s FROM gray), {blur_cte('g', 'bl', ['s'], gaussian(2, 2 / 3), clamp=True)} SELECT img_id, x, y, CASE WHEN abs(s - v) > 20 THEN v ELSE CAST(floor(round(s, 9) + 0.5) AS INTEGER) END AS v FROM bl JOIN gray USING (img_id, x, y)",
    "diffuse_step": f"WITH {GRAY} SELECT c.img_id, c.x, c.y, round(CASE WHEN count(t.v) = 4 THEN c.v + 0.2::DOUBLE * sum(exp(-power((t.v - c.v) / 20.0::DOUBLE, 2)) * (t.v - c.v)) ELSE c.v END, 6) AS v FROM gray c LEFT JOIN gray t ON t.img_id = c.img_id AND abs(t.x - c.x) + abs(t.y - c.y) = 1 GROUP BY c.img_id, c.x, c.y, c.v",
    "boundary_band": f"WITH {HEAT}, s AS MATERIALIZED (SELECT DISTINCT a.img_id, a.x, a.y FROM heat a JOIN heat b ON b.img_id = a.img_id AND abs(b.x - a.x) + abs(b.y - a.y) = 1 AND b.class <> a.class), n AS (SELECT DISTINCT h.img_id, h.x, h.y FROM heat h JOIN s ON s.img_id = h.img_id AND abs(s.x - h.x) <= 2 AND abs(s.y - h.y) <= 2) SELECT h.img_id, h.x, h.y, CASE WHEN n.x IS NULL THEN 0 ELSE 1 END AS band FROM heat h LEFT JOIN n ON n.img_id = h.img_id AND n.x = h.x AND n.y = h.y",
    "bilateral_band": f"""WITH {HEAT}, p AS MATERIALIZED (SELECT img_id, x, y, class, CAST(least(n * 37, 255) AS INTEGER) AS r, class * 100 AS g, 7 AS b, 255 AS a FROM heat WHERE x < 12 AND y < 12),
s AS MATERIALIZED (SELECT DISTINCT a.img_id, a.x, a.y FROM p a JOIN p b ON b.img_id = a.img_id AND abs(b.x - a.x) + abs(b.y - a.y) = 1 AND b.class <> a.class),
band AS MATERIALIZED (SELECT DISTINCT h.* FROM p h JOIN s ON s.img_id = h.img_id AND abs(s.x - h.x) <= 1 AND abs(s.y - h.y) <= 1),
m AS (SELECT c.img_id, c.x, c.y, t.r, t.g, t.b, t.a, exp(-(power(t.x - c.x, 2) + power(t.y - c.y, 2)) / (2 * 1.8 * 1.8)::DOUBLE) * exp(-(power(t.r - c.r, 2) + power(t.g - c.g, 2)) / 7200.0::DOUBLE) AS w FROM band c JOIN p t ON t.img_id = c.img_id AND abs(t.x - c.x) <= 2 AND abs(t.y - c.y) <= 2),
v AS (SELECT img_id, x, y, """ + ", ".join(f"CAST(round_even(sum(w * {c}) / sum(w), 0) AS INTEGER) AS {c}" for c in "rgba") + " FROM m GROUP BY 1, 2, 3) SELECT p.img_id, p.x, p.y, " + ", ".join(f"coalesce(v.{c}, p.{c}) AS {c}" for c in "rgba") + " FROM p LEFT JOIN v ON v.img_id = p.img_id AND v.x = p.x AND v.y = p.y",
    "sobel_importance": f"WITH {GRAY}, {_SOBEL} SELECT img_id, x, y, round(importance, 6) AS importance FROM imp",
    "integral_image": f"WITH {GRAY} SELECT a.img_id, a.x, a.y, CAST(sum(b.v) AS BIGINT) AS v FROM gray a JOIN gray b ON b.img_id = a.img_id AND b.x <= a.x AND b.y <= a.y GROUP BY 1, 2, 3",
    "smart_crop": f"""WITH {GRAY}, {_SOBEL}, {_CAND}, tot AS (SELECT img_id, sum(importance) AS t FROM imp GROUP BY 1),
sc AS (SELECT i.img_id, c.k, c.x, c.y, c.w, round(sum(i.importance) / max(t) - 0.12::DOUBLE * (w * w / 64.0::DOUBLE) - 0.25::DOUBLE * (sqrt(power(c.x + w / 2.0::DOUBLE - 4, 2) + power(c.y + w / 2.0::DOUBLE - 4, 2)) / sqrt(32.0::DOUBLE)) * 0.1::DOUBLE, 9) AS score FROM cand c JOIN imp i ON i.x BETWEEN c.x AND c.x + w - 1 AND i.y BETWEEN c.y AND c.y + w - 1 JOIN tot USING (img_id) GROUP BY i.img_id, c.k, c.x, c.y, c.w)
SELECT img_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, w AS width, w AS height, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, k) AS rn FROM sc) WHERE rn = 1""",
    "bg_remove_everywhere": f"""{_W}, e AS (SELECT img_id, r, g, b, a, CASE WHEN y = 0 THEN 2 * x WHEN y = 3 THEN 2 * x + 1 WHEN x = 0 THEN 8 + 2 * (y - 1) ELSE 9 + 2 * (y - 1) END AS o FROM rgba WHERE x IN (0, 3) OR y IN (0, 3)),
k AS (SELECT img_id, CASE WHEN a = 0 THEN 0 ELSE r END AS b_r, CASE WHEN a = 0 THEN 0 ELSE g END AS b_g, CASE WHEN a = 0 THEN 0 ELSE b END AS b_b, a AS b_a, count(*) AS n, min(o) AS f FROM e GROUP BY 1, 2, 3, 4, 5),
bg AS MATERIALIZED (SELECT img_id, b_r, b_g, b_b FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, f) AS rn FROM k) WHERE rn = 1),
both_ AS MATERIALIZED (SELECT rgba.*, b_r, b_g, b_b FROM rgba JOIN bg USING (img_id)), {oklab_cte('both_', 'o1', prefix='p_')}, {oklab_cte('o1', 'o2', prefix='q_', cols=('b_r', 'b_g', 'b_b'))},
d AS (SELECT img_id, x, y, a, CASE WHEN a = 0 THEN 0 ELSE sqrt(power(p_L - q_L, 2) + power(p_A - q_A, 2) + power(p_B - q_B, 2)) END AS d FROM o2),
n AS (SELECT *, CASE WHEN d <= 0.08 THEN 0 WHEN d < 0.16 THEN CAST(floor(255 * ((d - 0.08::DOUBLE) / 0.08::DOUBLE) + 0.5) AS INTEGER) END AS na FROM d)
SELECT img_id, x, y, CASE WHEN na IS NOT NULL AND na < a THEN na ELSE a END AS a FROM n""",
}
