"""Queries: palettes, components, graphs, meshes, contours, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import bindings as B
from rasterloom.functions.scalar import DIGITS83
from rasterloom.operators import geometry as G
from rasterloom.operators import histogram as H
from rasterloom.operators import placeholder as P
from rasterloom.operators import quantize as Q
from rasterloom.operators import regions as R
from rasterloom.plans import vectorize as V
from rasterloom.queries.sql import GRAY, HEAT, MIXED4, RGBA4, SHEET, linear, oklab_cte

R6 = lambda c: F.round(c, 6).alias(c)
PALETTE = [(0, 40, 20, 30), (1, 40, 200, 60), (2, 80, 120, 150), (3, 200, 60, 220), (4, 240, 240, 240)]


def _palette(s: SparkSession) -> DataFrame:
    return s.createDataFrame(PALETTE, "idx int, r int, g int, b int")


def _heat(s: SparkSession, d: str) -> DataFrame:
    return B.heat(s, d).select("img_id", "width", "height", "x", "y", "class")


def _labels(s: SparkSession, d: str) -> DataFrame:
    size = (F.lit(24).alias("width"), F.lit(31).alias("height"))
    return R.label_components(_heat(s, d)).select("img_id", *size, "x", "y", "class", "comp")


def _heat_rgb(s: SparkSession, d: str) -> DataFrame:
    return B.heat(s, d).select("img_id", "width", "height", "x", "y", (F.col("class") * 100).alias("r"), (F.col("x") * 10).cast("int").alias("g"), (F.col("y") * 8).cast("int").alias("b"), F.lit(255).alias("a"))


def wu_bins(s: SparkSession, d: str) -> DataFrame:
    return Q.bins(B.sheet(s, d))


def palette_nearest(s: SparkSession, d: str) -> DataFrame:
    return Q.nearest(B.sheet(s, d), _palette(s)).select("img_id", "x", "y", "idx")


def palette_weights(s: SparkSession, d: str) -> DataFrame:
    return Q.palette_weights(B.sheet(s, d), _palette(s)).select("img_id", "idx", R6("weight"), "hex")


def lloyd_step(s: SparkSession, d: str) -> DataFrame:
    from rasterloom.functions.colour import with_oklab

    c = with_oklab(_palette(s).select("idx", F.col("r").alias("r0"), F.col("g").alias("g0"), F.col("b").alias("b0")), ("L", "A", "B"), ("r0", "g0", "b0"))
    return Q.lloyd_step(Q.bins(B.sheet(s, d)), c).select("img_id", "idx", R6("L"), F.round("A", 6).alias("ca"), F.round("B", 6).alias("cb"), "weight")


def alpha_levels(s: SparkSession, d: str) -> DataFrame:
    """Few enough levels to keep them all, by the same route as many."""
    return Q.alpha_levels(B.rgba4(s, d), 16)


def alpha_levels_lloyd(s: SparkSession, d: str) -> DataFrame:
    return Q.alpha_levels(B.rgba4(s, d, True), 4)


def alpha_fringe(s: SparkSession, d: str) -> DataFrame:
    p = B.rgba4(s, d, True).withColumn("level", (F.floor(F.col("a") / 64) * 64).cast("int"))
    return Q.fringe_levels(p, 0.2, "level")


def alpha_collapse(s: SparkSession, d: str) -> DataFrame:
    return Q.collapse_fringe(B.rgba4(s, d, True), 4).select("img_id", "x", "y", "a")


def quantize_palette(s: SparkSession, d: str) -> DataFrame:
    return Q.quantize(B.sheet(s, d), 8)


def components(s: SparkSession, d: str) -> DataFrame:
    return R.label_components(_heat(s, d))


def components_fixpoint(s: SparkSession, d: str) -> DataFrame:
    """The same labels by a DataFrame fixpoint."""
    return R.label_by_propagation(_heat(s, d))


def component_bounds(s: SparkSession, d: str) -> DataFrame:
    return R.components(_labels(s, d))


def adaptive_min_area(s: SparkSession, d: str) -> DataFrame:
    lab = _labels(s, d)
    return R.adaptive_min_area(R.components(lab), lab.groupBy("img_id").agg(F.count("*").alias("pixels")))


def class_adjacency(s: SparkSession, d: str) -> DataFrame:
    return R.class_adjacency(_heat(s, d))


def region_graph(s: SparkSession, d: str) -> DataFrame:
    _, e = R.region_graph(_labels(s, d), _heat_rgb(s, d))
    return e.select("img_id", "u", "v", R6("distance"))


def despeckle(s: SparkSession, d: str) -> DataFrame:
    return R.despeckle(_heat(s, d), 3)


def merge_regions(s: SparkSession, d: str) -> DataFrame:
    return R.merge_regions(_labels(s, d), _heat_rgb(s, d), 0.5)


def segment_pixels(s: SparkSession, d: str) -> DataFrame:
    return R.segment(_heat_rgb(s, d), 300, 4)


def flatten_segments(s: SparkSession, d: str) -> DataFrame:
    f = R.flatten_segments(_heat_rgb(s, d), _labels(s, d))
    return f.select("img_id", "x", "y", "comp", F.round("okL", 6).alias("L"), F.round("okA", 6).alias("ca"), F.round("okB", 6).alias("cb"), "a")


def bg_flood(s: SparkSession, d: str) -> DataFrame:
    p = _heat(s, d).withColumn("free", F.when(F.col("class") == 0, 1).otherwise(0))
    return R.flood_from_border(p, "free")


def runs_horizontal(s: SparkSession, d: str) -> DataFrame:
    return H.runs_horizontal(_heat(s, d))


def mesh_rectangles(s: SparkSession, d: str) -> DataFrame:
    """The pixels that the rectangles rebuild; the oracle is the image itself."""
    return V.rebuilt(V.mesh_rectangles(_heat(s, d)))


def mesh_rectangle_list(s: SparkSession, d: str) -> DataFrame:
    return V.mesh_rectangles(_heat(s, d))


def boundary_edges(s: SparkSession, d: str) -> DataFrame:
    return G.boundary_edges(_labels(s, d))


def crack_degree(s: SparkSession, d: str) -> DataFrame:
    return G.crack_degree(_labels(s, d))


def loop_area(s: SparkSession, d: str) -> DataFrame:
    return G.loop_areas(G.boundary_edges(_labels(s, d))).select("img_id", "comp", F.col("area").cast("double").alias("area"))


def contour_areas(s: SparkSession, d: str) -> DataFrame:
    """Signed areas of a component's loops add up to its pixels."""
    c = G.trace_contours(_labels(s, d))
    return c.groupBy("img_id", "comp").agg(F.sum("signed_area").alias("area"))


def contours(s: SparkSession, d: str) -> DataFrame:
    return G.trace_contours(_labels(s, d))


def arc_twins(s: SparkSession, d: str) -> DataFrame:
    return G.verify_twins(G.decompose_to_arcs(_labels(s, d)))


def _ink(s: SparkSession, d: str) -> DataFrame:
    return _heat(s, d).withColumn("ink", F.when(F.col("class") > 0, 1).otherwise(0))


def thinning(s: SparkSession, d: str) -> DataFrame:
    return G.thinned(_ink(s, d), "ink")


def centreline_length(s: SparkSession, d: str) -> DataFrame:
    c = G.centrelines(_ink(s, d), "ink")
    return c.groupBy("img_id").agg(F.count("*").alias("lines"), R6_sum("length"))


def R6_sum(c: str):  # noqa: N802
    return F.round(F.sum(c), 6).alias(c)


def polyline_simplify(s: SparkSession, d: str) -> DataFrame:
    return G.centrelines(_ink(s, d), "ink", 1.5)


def _points(s: SparkSession, d: str) -> DataFrame:
    """A closed polygon of eight points from each embedding's first sixteen numbers."""
    e = B.table(s, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"), "embedding")
    return e.select("vec_id", "seq", F.get("embedding", F.col("seq") * 2).cast("double").alias("px"), F.get("embedding", F.col("seq") * 2 + 1).cast("double").alias("py"))


def fit_circle(s: SparkSession, d: str) -> DataFrame:
    return G.fit_circle(_points(s, d), ["vec_id"]).select("vec_id", "n", R6("cx"), R6("cy"), R6("radius"), R6("err"))


def fit_rect(s: SparkSession, d: str) -> DataFrame:
    return G.fit_rect(_points(s, d), ["vec_id"]).select("vec_id", *[R6(c) for c in ("x0", "y0", "x1", "y1", "err")])


def shoelace(s: SparkSession, d: str) -> DataFrame:
    return G.shoelace(_points(s, d), ["vec_id"]).select("vec_id", R6("area"))


def polyline_length(s: SparkSession, d: str) -> DataFrame:
    return G.polyline_length(_points(s, d), ["vec_id"]).select("vec_id", R6("length"))


def gradient_moments(s: SparkSession, d: str) -> DataFrame:
    return P.linear_ramps(B.gray8(s, d)).select("img_id", "n", *[R6(c) for c in ("c0", "cx", "cy", "rms")])


def blurhash_factors(s: SparkSession, d: str) -> DataFrame:
    return P.cosine_moments(B.rgba4(s, d), 3, 2).select("img_id", "i", "j", *[R6(c) for c in ("lr", "lg", "lb")])


def blurhash_text(s: SparkSession, d: str) -> DataFrame:
    return P.blurhash(B.rgba4(s, d))


def vectorize_auto(s: SparkSession, d: str) -> DataFrame:
    return V.vectorize(_heat_rgb(s, d))


def vectorize_exact(s: SparkSession, d: str) -> DataFrame:
    return V.vectorize(_heat_rgb(s, d), "exact")


def vectorize_trace(s: SparkSession, d: str) -> DataFrame:
    return V.vectorize(_heat_rgb(s, d), preset="logo")


def vectorize_budget(s: SparkSession, d: str) -> DataFrame:
    return V.within_budget(_heat_rgb(s, d), 6000).select("img_id", "strength", "bytes", "met")


def lossless_choice(s: SparkSession, d: str) -> DataFrame:
    return V.choose_lossless(V.lossless_candidates(_heat_rgb(s, d)))


def colour_separations(s: SparkSession, d: str) -> DataFrame:
    return V.separations(_heat_rgb(s, d), V.PRESETS["lineart"])


_LAB = f"""{HEAT}, cell AS MATERIALIZED (SELECT img_id, x, y, class, y * 24 + x AS i FROM heat),
edge AS MATERIALIZED (SELECT a.img_id, a.i AS i, b.i AS j FROM cell a JOIN cell b ON b.img_id = a.img_id AND b.class = a.class AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x - 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1) OR (b.x = a.x AND b.y = a.y - 1))),
reach AS (SELECT img_id, i AS root, i FROM cell UNION SELECT r.img_id, r.root, e.j FROM reach r JOIN edge e ON e.img_id = r.img_id AND e.i = r.i WHERE e.j > r.root),
root AS MATERIALIZED (SELECT img_id, i, min(root) AS root FROM reach GROUP BY 1, 2),
lab AS MATERIALIZED (SELECT c.img_id, c.x, c.y, c.class, CAST(dense_rank() OVER (PARTITION BY c.img_id ORDER BY root) - 1 AS INTEGER) AS comp FROM cell c JOIN root USING (img_id, i))"""
_L = f"WITH RECURSIVE {_LAB}"
_HRGB = "hrgb AS (SELECT img_id, x, y, class * 100 AS r, x * 10 AS g, y * 8 AS b, 255 AS a FROM heat)"
_PAL = "pal AS (SELECT * FROM (VALUES " + ", ".join(map(str, PALETTE)) + ") v(idx, pr, pg, pb))"
_DIST = "round(power(c_L - p_L, 2) + power(c_A - p_A, 2) + power(c_B - p_B, 2), 12)"
_NEAR = f"""{SHEET}, {_PAL}, {oklab_cte('pal', 'pok', prefix='p_', cols=('pr', 'pg', 'pb'))}, dc AS (SELECT DISTINCT img_id, r, g, b FROM sheet), {oklab_cte('dc', 'cok', prefix='c_')},
near AS MATERIALIZED (SELECT img_id, r, g, b, idx FROM (SELECT img_id, r, g, b, idx, row_number() OVER (PARTITION BY img_id, r, g, b ORDER BY {_DIST}, idx) AS rn FROM cok, pok) WHERE rn = 1)"""
_BINS = "bins AS MATERIALIZED (SELECT img_id, r >> 3 AS rb, g >> 3 AS gb, b >> 3 AS bb, count(*) AS n, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb, CAST(sum(r*r + g*g + b*b) AS BIGINT) AS s2 FROM sheet GROUP BY 1, 2, 3, 4)"
_POLY = "poly AS MATERIALIZED (SELECT vec_id, CAST(k AS INTEGER) AS seq, embedding[2*k+1]::DOUBLE AS px, embedding[2*k+2]::DOUBLE AS py FROM embeddings, range(0, 8) t(k))"
_SIDES = " UNION ALL ".join(f"SELECT c.img_id, c.comp, c.x, c.y, '{s}' AS side, coalesce(o.comp, -2) AS other FROM lab c LEFT JOIN lab o ON o.img_id = c.img_id AND o.x = c.x + ({dx}) AND o.y = c.y + ({dy}) WHERE coalesce(o.comp, -2) <> c.comp" for s, dx, dy in (("n", 0, -1), ("e", 1, 0), ("s", 0, 1), ("w", -1, 0)))

NAMES = (wu_bins, palette_nearest, palette_weights, lloyd_step, alpha_levels, alpha_levels_lloyd, alpha_fringe, alpha_collapse, quantize_palette, components, components_fixpoint, component_bounds, adaptive_min_area, class_adjacency, region_graph, despeckle, merge_regions, segment_pixels, flatten_segments, bg_flood, runs_horizontal, mesh_rectangles, mesh_rectangle_list, boundary_edges, crack_degree, loop_area, contour_areas, contours, arc_twins, thinning, centreline_length, polyline_simplify, fit_circle, fit_rect, shoelace, polyline_length, gradient_moments, blurhash_factors, blurhash_text, vectorize_auto, vectorize_exact, vectorize_trace, vectorize_budget, lossless_choice, colour_separations)
QUERIES = {f.__name__: f for f in NAMES}
def _blurhash(cx: int = 4, cy: int = 3) -> str:
    """The whole text in SQL: cosine moments of linear colours, quantised, in base 83."""
    digits = "(SELECT '" + DIGITS83.replace("'", "''") + "')"
    base83 = lambda e, n: " || ".join(f"substr({digits}, CAST({e} AS BIGINT) // {83 ** (n - k)} % 83 + 1, 1)" for k in range(1, n + 1))
    step = lambda c: f"least(18, greatest(0, floor(sign({c}) * sqrt(abs({c} / ((q + 1) / 166.0::DOUBLE))) * 9 + 9.5)))"
    byte = lambda c: f"least(255, greatest(0, floor((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * power({c}, 1 / 2.4::DOUBLE) - 0.055 END) * 255 + 0.5)))"
    return f"""WITH {RGBA4}, lin AS (SELECT img_id, x, y, {", ".join(f"{linear(f'CAST({c} AS DOUBLE)')} AS l{c}" for c in "rgb")} FROM rgba),
m AS (SELECT img_id, i, j, {", ".join(f"sum(cos(pi() * i * x / 4) * cos(pi() * j * y / 4) * (CASE WHEN i + j = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) * l{c}) / 16 AS m{c}" for c in "rgb")} FROM lin, range(0, {cx}) a(i), range(0, {cy}) b(j) GROUP BY ALL),
t AS (SELECT *, max(CASE WHEN i + j > 0 THEN greatest(abs(mr), abs(mg), abs(mb)) END) OVER (PARTITION BY img_id) AS top FROM m),
u AS (SELECT *, least(82, greatest(0, floor(top * 166 - 0.5))) AS q FROM t),
w AS (SELECT img_id, i, j, q, {step("mr")} * 361 + {step("mg")} * 19 + {step("mb")} AS v, {byte("mr")} * 65536 + {byte("mg")} * 256 + {byte("mb")} AS first FROM u)
SELECT img_id, {base83(str((cx - 1) + (cy - 1) * 9), 1)} || {base83("max(q)", 1)} || {base83("max(CASE WHEN i + j = 0 THEN first END)", 4)} || string_agg({base83("v", 2)}, '' ORDER BY j, i) FILTER (i + j > 0) AS hash FROM w GROUP BY img_id"""


ORACLE = {
    "blurhash_text": _blurhash(),
    "wu_bins": f"WITH {SHEET}, {_BINS} SELECT * FROM bins",
    "palette_nearest": f"WITH {_NEAR} SELECT img_id, x, y, idx FROM sheet JOIN near USING (img_id, r, g, b)",
    "palette_weights": f"WITH {_NEAR}, n AS (SELECT img_id, idx, count(*) AS n FROM sheet JOIN near USING (img_id, r, g, b) GROUP BY 1, 2) SELECT img_id, idx, round(n / CAST(sum(n) OVER (PARTITION BY img_id) AS DOUBLE), 6) AS weight, CASE WHEN pr % 17 = 0 AND pg % 17 = 0 AND pb % 17 = 0 THEN printf('#%x%x%x', pr // 17, pg // 17, pb // 17) ELSE printf('#%02x%02x%02x', pr, pg, pb) END AS hex FROM n JOIN pal USING (idx)",
    "lloyd_step": f"""WITH {SHEET}, {_BINS}, bm AS (SELECT *, sr / n::DOUBLE AS mr, sg / n::DOUBLE AS mg, sb / n::DOUBLE AS mb FROM bins), {oklab_cte('bm', 'bok', prefix='c_', cols=('mr', 'mg', 'mb'))}, {_PAL}, {oklab_cte('pal', 'pok', prefix='p_', cols=('pr', 'pg', 'pb'))},
near AS (SELECT *, row_number() OVER (PARTITION BY img_id, rb, gb, bb ORDER BY {_DIST}, idx) AS rn FROM bok, pok)
SELECT img_id, idx, round(sum(c_L * n) / sum(n), 6) AS L, round(sum(c_A * n) / sum(n), 6) AS ca, round(sum(c_B * n) / sum(n), 6) AS cb, CAST(sum(n) AS BIGINT) AS weight FROM near WHERE rn = 1 GROUP BY 1, 2""",
    "alpha_levels": f"WITH {RGBA4} SELECT img_id, list_sort(list(DISTINCT a)) AS levels FROM rgba GROUP BY 1",
    "alpha_fringe": f"""WITH {MIXED4}, l AS MATERIALIZED (SELECT img_id, x, y, a // 64 * 64 AS level FROM rgba), k AS (SELECT c.img_id, c.x, c.y, c.level, count(t.level) FILTER (t.level <> c.level) AS other FROM l c JOIN l t ON t.img_id = c.img_id AND abs(t.x - c.x) + abs(t.y - c.y) = 1 GROUP BY 1, 2, 3, 4)
SELECT img_id, level, count(*) AS n, count(*) FILTER (other = 0) AS inside, level IN (0, 255) OR count(*) FILTER (other = 0) / CAST(count(*) AS DOUBLE) >= 0.2 AS kept FROM k GROUP BY 1, 2""",
    "components": f"{_L} SELECT * FROM lab",
    "components_fixpoint": f"{_L} SELECT * FROM lab",
    "component_bounds": f"{_L} SELECT img_id, comp, min(class) AS class, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lab GROUP BY 1, 2",
    "adaptive_min_area": f"{_L}, ar AS (SELECT img_id, comp, count(*) AS area FROM lab GROUP BY 1, 2), cu AS (SELECT img_id, area, sum(area) OVER (PARTITION BY img_id ORDER BY area, comp) AS cum FROM ar) SELECT img_id, CAST(least(coalesce(max(area + 1) FILTER (cum <= 744 * 0.015), 0), greatest(4, floor(744 * 0.004 + 0.5))) AS BIGINT) AS min_area FROM cu GROUP BY 1",
    "class_adjacency": f"WITH {HEAT} SELECT a.img_id, least(a.class, b.class) AS lo, greatest(a.class, b.class) AS hi, count(*) AS border FROM heat a JOIN heat b ON b.img_id = a.img_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE a.class <> b.class GROUP BY 1, 2, 3",
    "region_graph": f"""{_L}, {_HRGB}, {oklab_cte('hrgb', 'ho', prefix='c_')}, v AS MATERIALIZED (SELECT img_id, comp, avg(c_L) AS L, avg(c_A) AS ca, avg(c_B) AS cb FROM lab JOIN ho USING (img_id, x, y) GROUP BY 1, 2),
e AS (SELECT DISTINCT a.img_id, least(a.comp, b.comp) AS u, greatest(a.comp, b.comp) AS v FROM lab a JOIN lab b ON b.img_id = a.img_id AND abs(b.x - a.x) + abs(b.y - a.y) = 1 WHERE a.comp <> b.comp)
SELECT e.img_id, e.u, e.v, round(sqrt(power(p.L - q.L, 2) + power(p.ca - q.ca, 2) + power(p.cb - q.cb, 2)), 6) AS distance FROM e JOIN v p ON p.img_id = e.img_id AND p.comp = e.u JOIN v q ON q.img_id = e.img_id AND q.comp = e.v""",
    "flatten_segments": f"{_L}, {_HRGB}, {oklab_cte('hrgb', 'ho', prefix='c_')} SELECT img_id, x, y, comp, round(avg(c_L) OVER w, 6) AS L, round(avg(c_A) OVER w, 6) AS ca, round(avg(c_B) OVER w, 6) AS cb, 255 AS a FROM lab JOIN ho USING (img_id, x, y) WINDOW w AS (PARTITION BY img_id, comp)",
    "bg_flood": f"{_L}, t AS (SELECT DISTINCT img_id, comp FROM lab WHERE class = 0 AND (x IN (0, 23) OR y IN (0, 30))) SELECT l.img_id, l.x, l.y, CASE WHEN t.comp IS NULL THEN 0 ELSE 1 END AS reached FROM lab l LEFT JOIN t ON t.img_id = l.img_id AND t.comp = l.comp",
    "runs_horizontal": f"WITH {HEAT}, s AS (SELECT *, x - row_number() OVER (PARTITION BY img_id, y, class ORDER BY x) AS g FROM heat) SELECT img_id, y, min(x) AS x0, count(*) AS len, class FROM s GROUP BY img_id, y, class, g",
    "mesh_rectangles": f"WITH {HEAT} SELECT img_id, x, y, class FROM heat",
    "boundary_edges": f"{_L} {_SIDES}",
    "crack_degree": f"""{_L}, q AS (SELECT a.img_id, a.x + 1 AS x, a.y + 1 AS y, a.comp AS a, b.comp AS b, c.comp AS c, d.comp AS d FROM lab a JOIN lab b ON b.img_id = a.img_id AND b.x = a.x + 1 AND b.y = a.y JOIN lab c ON c.img_id = a.img_id AND c.x = a.x + 1 AND c.y = a.y + 1 JOIN lab d ON d.img_id = a.img_id AND d.x = a.x AND d.y = a.y + 1)
SELECT img_id, x, y, (a <> b)::INT + (b <> c)::INT + (c <> d)::INT + (d <> a)::INT AS degree FROM q""",
    "loop_area": f"{_L} SELECT img_id, comp, CAST(count(*) AS DOUBLE) AS area FROM lab GROUP BY 1, 2",
    "contour_areas": f"{_L} SELECT img_id, comp, CAST(count(*) AS DOUBLE) AS area FROM lab GROUP BY 1, 2",
    "fit_circle": f"""WITH {_POLY}, m AS MATERIALIZED (SELECT vec_id, count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(px*px + py*py) AS mz, covar_pop(px, px) AS a, covar_pop(px, py) AS b, covar_pop(py, py) AS c, covar_pop(px, px*px + py*py) / 2 AS d, covar_pop(py, px*px + py*py) / 2 AS e FROM poly GROUP BY 1),
k AS MATERIALIZED (SELECT *, (d*c - e*b) / (a*c - b*b) AS cx, (a*e - b*d) / (a*c - b*b) AS cy FROM m), r AS MATERIALIZED (SELECT *, sqrt(mz - 2*(cx*mx + cy*my) + cx*cx + cy*cy) AS radius FROM k)
SELECT vec_id, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(radius, 6) AS radius, round(max(abs(sqrt(power(px - cx, 2) + power(py - cy, 2)) - radius)), 6) AS err FROM r JOIN poly USING (vec_id) GROUP BY vec_id, n, cx, cy, radius""",
    "fit_rect": f"WITH {_POLY}, b AS MATERIALIZED (SELECT vec_id, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM poly GROUP BY 1) SELECT vec_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(max(least(px - x0, x1 - px, py - y0, y1 - py)), 6) AS err FROM b JOIN poly USING (vec_id) GROUP BY vec_id, b.x0, b.y0, b.x1, b.y1",
    "shoelace": f"WITH {_POLY} SELECT a.vec_id, round(sum(a.px * b.py - b.px * a.py) / 2, 6) AS area FROM poly a JOIN poly b ON b.vec_id = a.vec_id AND b.seq = (a.seq + 1) % 8 GROUP BY 1",
    "polyline_length": f"WITH {_POLY} SELECT a.vec_id, round(sum(sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2))), 6) AS length FROM poly a JOIN poly b ON b.vec_id = a.vec_id AND b.seq = a.seq + 1 GROUP BY 1",
    "gradient_moments": f"""WITH {GRAY}, m AS (SELECT img_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, covar_pop(v, v) AS vv FROM gray GROUP BY 1),
k AS MATERIALIZED (SELECT *, (xv*yy - yv*xy) / (xx*yy - xy*xy) AS cx, (xx*yv - xv*xy) / (xx*yy - xy*xy) AS cy FROM m) SELECT img_id, n, round(mv - cx*mx - cy*my, 6) AS c0, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(greatest(0, vv - cx*xv - cy*yv)), 6) AS rms FROM k""",
    "blurhash_factors": f"""WITH {RGBA4}, l AS (SELECT img_id, x, y, {linear('r::DOUBLE')} AS lr, {linear('g::DOUBLE')} AS lg, {linear('b::DOUBLE')} AS lb FROM rgba), p AS (SELECT *, cos(pi() * i * x / 4) * cos(pi() * j * y / 4) * CASE WHEN i = 0 AND j = 0 THEN 1 ELSE 2 END AS f FROM l CROSS JOIN range(0, 3) a(i) CROSS JOIN range(0, 2) b(j))
SELECT img_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(f * lr) / 16, 6) AS lr, round(sum(f * lg) / 16, 6) AS lg, round(sum(f * lb) / 16, 6) AS lb FROM p GROUP BY 1, 2, 3""",
}
