"""Queries: outlines that agree, curves on shared arcs, box colours, layers between colours, icon sets, traced animations, page documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom import bindings as B
from rasterloom.functions import scalar as N
from rasterloom.operators import edit as E
from rasterloom.operators import histogram as H
from rasterloom.operators import outline as O
from rasterloom.operators import paint as P
from rasterloom.operators import quantize as Q
from rasterloom.operators import regions as R
from rasterloom.plans import assets as A
from rasterloom.plans import vectorize as V
from rasterloom.queries import metrics
from rasterloom.queries.regions import _BINS, _L, _heat, _heat_rgb, _labels
from rasterloom.queries.sql import GRAY, HEAT, MIXED4, RGBA4, SHEET
from rasterloom.sources import codecs, rasters
from rasterloom.sources.rasters import from_pixels

R6 = lambda c: F.round(c, 6).alias(c)
_ORIGINS = ("https://a.example", "http://localhost:5173")


def outline_pins(s: SparkSession, d: str) -> DataFrame:
    """The lattice vertices on outlines, and whether smoothing must leave them."""
    return O.agreeing_outlines(_labels(s, d)).select("img_id", "lx", "ly", "pinned").distinct()


def outline_smooth(s: SparkSession, d: str) -> DataFrame:
    return O.agreeing_outlines(_labels(s, d)).select("img_id", "comp", "loop", "seq", "lx", "ly", R6("x"), R6("y"))


def outline_agreement(s: SparkSession, d: str) -> DataFrame:
    """Each lattice vertex once an image: components that share it moved it to one place."""
    v = O.agreeing_outlines(_labels(s, d), passes=3)
    return v.groupBy("img_id", "lx", "ly").agg(F.countDistinct(F.round("x", 9), F.round("y", 9)).alias("places"))


def arc_faces(s: SparkSession, d: str) -> DataFrame:
    return O.fitted_faces(_labels(s, d))


def outline_refined(s: SparkSession, d: str) -> DataFrame:
    px = _heat_rgb(s, d).select("img_id", "x", "y", "r", "g", "b", "a")
    return O.refined_outlines(_labels(s, d).join(px, ["img_id", "x", "y"])).select("img_id", "comp", "loop", "seq", "lx", "ly", R6("x"), R6("y"))


def vectorize_mosaic(s: SparkSession, d: str) -> DataFrame:
    return V.vectorize(_heat_rgb(s, d), "mosaic", options=V.Options(colours=6))


def vectorize_gradients(s: SparkSession, d: str) -> DataFrame:
    return V.vectorize(_heat_rgb(s, d), "trace", options=V.Options(colours=4, gradients=True))


def vectorize_refined(s: SparkSession, d: str) -> DataFrame:
    return V.vectorize(_heat_rgb(s, d), "trace", options=V.Options(colours=6, subpixel=True))


def gradient_paints(s: SparkSession, d: str) -> DataFrame:
    return P.gradients(_labels(s, d).join(_heat_rgb(s, d).select("img_id", "x", "y", "r", "g", "b"), ["img_id", "x", "y"])).select("img_id", "comp", "kind", "stops", R6("error"), R6("flat_error"), "svg")


def _boxes(s: SparkSession, d: str) -> DataFrame:
    half = lambda c: F.shiftright(c, 4)
    return Q.bins(B.sheet(s, d)).withColumn("box", half("rb") * 4 + half("gb") * 2 + half("bb"))


def box_dominant(s: SparkSession, d: str) -> DataFrame:
    return Q.dominant_of_box(_boxes(s, d))


def box_median(s: SparkSession, d: str) -> DataFrame:
    return Q.median_of_box(_boxes(s, d))


def _classes(s: SparkSession, d: str) -> DataFrame:
    c = F.col("class")
    k = _heat(s, d).select("img_id", "class").distinct()
    return k.select("img_id", "class", F.concat(F.lit("p"), c.cast("string")).alias("path_id"), (c * 51).alias("r"), (c * 17).alias("g"), (200 - c * 30).alias("b"), (255 - c * 40).alias("a"))


def blend_layer(s: SparkSession, d: str) -> DataFrame:
    ground = _heat(s, d).groupBy("img_id").agg(F.max("class").alias("class"))
    return A.blend_layer(R.class_adjacency(_heat(s, d)), _classes(s, d), ground, 1.5).select("img_id", "text", F.array_join("clips", ",").alias("clips"))


def stroke_attributes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = A.stroke_attributes((k % 256).cast("int"), (k * 7 % 256).cast("int"), ((k % 3) * 17).cast("int"), (255 - (k % 5) * 51).cast("int"), (k % 4) / 2)
    return B.table(s, d, "part").select("p_partkey", t.alias("attributes"), A.clip_path(k.cast("string")).alias("clip"))


def origins_allowed(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    origin = F.get(F.array(*[F.lit(x) for x in (None, "", *_ORIGINS, "http://localhost:3000", "null")]), (k % 6).cast("int"))
    return B.table(s, d, "part").select("p_partkey", N.is_allowed_origin(origin, _ORIGINS).alias("allowed"))


def memory_refusals(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    limit = F.when(k % 7 == 0, F.lit(0)).otherwise(F.lit(4_000_000_000))
    return B.table(s, d, "part").select("p_partkey", N.memory_refusal(N.outline_bytes(k * 100_000), limit, F.lit(1_000_000_000)).alias("why"))


def office_command(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return B.table(s, d, "part").select("p_partkey", F.array_join(N.office_arguments(F.concat(F.lit("in/"), k, F.lit(".docx")), F.lit("pdf"), F.concat(F.lit("/out/"), k)), "|").alias("arguments"))


def favicon_files(s: SparkSession, d: str) -> DataFrame:
    return A.favicon_set(from_pixels(_heat_rgb(s, d))).select("img_id", "file", "width", F.length("bytes").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


def _heat_frames(s: SparkSession, d: str) -> DataFrame:
    """The five heat images as frames of one animation."""
    r = from_pixels(_heat_rgb(s, d))
    return r.select(F.lit(1).alias("img_id"), (F.row_number().over(W.orderBy("img_id")) - 1).alias("frame"), F.lit(120).alias("delay_ms"), "width", "height", "data")


def animation_traced(s: SparkSession, d: str) -> DataFrame:
    return A.traced_animation(_heat_frames(s, d))


def placeholder_documents(s: SparkSession, d: str) -> DataFrame:
    return A.placeholder_svg(from_pixels(_heat_rgb(s, d)))


def page_documents(s: SparkSession, d: str) -> DataFrame:
    """Pages of bytes that stand for JPEGs, bound into seven documents."""
    k = F.col("page_id")
    return A.page_documents(B.markup(s, d).select((k % 7).alias("doc"), k.alias("page"), (k % 90 + 10).cast("int").alias("width"), F.lit(64).alias("height"), F.encode(F.substring("html", 1, 500), "utf-8").alias("jpeg")))


def codec_kinds(s: SparkSession, d: str) -> DataFrame:
    """Images encoded as BMP, icon, portable map and TGA, and decoded again by what their bytes say they are."""
    files = rasters.to_files(B.gray_rgba(B.gray8(s, d)), ["bmp", "ico", "pnm", "tga"])
    return rasters.decoded_pixels(files, ["kind", "img_id"]).select("kind", "format", "img_id", "x", "y", "r", "g", "b", "a")


def _animation(frames: pa.Array) -> pa.Array:
    out = []
    for own in frames.to_pylist():
        px = [(np.frombuffer(f["data"], np.uint8).reshape(f["height"], f["width"], 4), 40 * k) for k, f in enumerate(own)]
        out.append(codecs.encode_apng(px))
    return pa.array(out, pa.binary())


def apng_composed(s: SparkSession, d: str) -> DataFrame:
    """The five heat images as frames of an animated PNG, read back and composed."""
    frames = from_pixels(_heat_rgb(s, d)).groupBy(F.lit("a").alias("path")).agg(F.sort_array(F.collect_list(F.struct("img_id", "width", "height", "data"))).alias("f"))
    files = frames.select("path", F.arrow_udf(_animation, "binary")("f").alias("content"))
    return rasters.to_pixels(rasters.apng_frames(files).withColumn("frame", F.col("frame").cast("int")), "frame").select(F.col("img_id").alias("frame"), "x", "y", "r", "g", "b", "a")


def _mark(s: SparkSession) -> DataFrame:
    """A 3 x 2 overlay."""
    rows = [(3, 2, x, y, 90 * x, 200 - 60 * y, 10 + 40 * x * y, 255 - 70 * x) for x in range(3) for y in range(2)]
    return s.createDataFrame(rows, "width int, height int, x int, y int, r int, g int, b int, a int")


def composite_tiled(s: SparkSession, d: str) -> DataFrame:
    px = B.gray_rgba(B.gray8(s, d))
    return E.composite(px, _mark(s), "screen", gravity="southeast", tile=True).select("img_id", "x", "y", "r", "g", "b", "a")


def composite_gravity(s: SparkSession, d: str) -> DataFrame:
    return E.composite(B.rgba4(s, d, True), _mark(s), "dest-over", gravity="east").select("img_id", "x", "y", "r", "g", "b", "a")


def composite_xor(s: SparkSession, d: str) -> DataFrame:
    return E.composite(B.rgba4(s, d, True), _mark(s), "xor", 1, 1).select("img_id", "x", "y", "r", "g", "b", "a")


def rotate_any(s: SparkSession, d: str) -> DataFrame:
    return E.turned(B.rgba4(s, d), 30.0)


def auto_options(s: SparkSession, d: str) -> DataFrame:
    f = H.flatness(B.gray8(s, d), key=F.col("v"), cap=62, luma=F.col("v"))
    return V.auto_options(f, 9.0)


def dominated_traces(s: SparkSession, d: str) -> DataFrame:
    """The heat images' exact meshes as traces, against sources of 100 bytes."""
    px = _heat_rgb(s, d)
    traces = V.vectorize(px, "pixel").select("img_id", "svg")
    return V.dominated(traces, V.lossless_candidates(px), traces.select("img_id", F.lit(100).alias("bytes")), 1.0)


QUERIES = {f.__name__: f for f in (outline_pins, outline_smooth, outline_agreement, outline_refined, gradient_paints, arc_faces, vectorize_mosaic, vectorize_gradients, vectorize_refined, box_dominant, box_median, blend_layer, stroke_attributes, origins_allowed, memory_refusals, office_command, favicon_files, animation_traced, placeholder_documents, page_documents, codec_kinds, apng_composed, composite_tiled, composite_gravity, composite_xor, rotate_any, auto_options, dominated_traces)}

_VERTICES = f"""{_L}, v AS (SELECT i.img_id, CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y FROM (SELECT DISTINCT img_id FROM lab) i, range(0, 25) a(x), range(0, 32) b(y)),
q AS (SELECT v.img_id, v.x, v.y, coalesce(a.comp, -2) AS a, coalesce(b.comp, -2) AS b, coalesce(c.comp, -2) AS c, coalesce(d.comp, -2) AS d FROM v
  LEFT JOIN lab a ON a.img_id = v.img_id AND a.x = v.x - 1 AND a.y = v.y - 1 LEFT JOIN lab b ON b.img_id = v.img_id AND b.x = v.x AND b.y = v.y - 1
  LEFT JOIN lab c ON c.img_id = v.img_id AND c.x = v.x AND c.y = v.y LEFT JOIN lab d ON d.img_id = v.img_id AND d.x = v.x - 1 AND d.y = v.y),
deg AS (SELECT img_id, x AS lx, y AS ly, (a <> b)::INT + (b <> c)::INT + (c <> d)::INT + (d <> a)::INT AS n FROM q)"""
_BOXES = f"WITH {SHEET}, {_BINS}, boxed AS (SELECT *, (rb >> 4) * 4 + (gb >> 4) * 2 + (bb >> 4) AS box FROM bins)"
_MEDIAN = ", ".join(f"(SELECT CAST(floor(min(m) + 0.5) AS INTEGER) FROM (SELECT s{c} / n AS m, sum(n) OVER (ORDER BY s{c} / n) AS u, sum(n) OVER () AS t FROM boxed x WHERE x.img_id = k.img_id AND x.box = k.box) WHERE u >= t / 2) AS {c}" for c in "rgb")
_HEX = lambda r, g, b: f"CASE WHEN {r} % 17 = 0 AND {g} % 17 = 0 AND {b} % 17 = 0 THEN '#' || lower(to_hex({r} // 17)) || lower(to_hex({g} // 17)) || lower(to_hex({b} // 17)) ELSE '#' || " + " || ".join(f"lpad(lower(to_hex({c})), 2, '0')" for c in (r, g, b)) + " END"
_SHORT = lambda v: f"regexp_replace(regexp_replace(printf('%.3f', {v}), '0+$', ''), '\\.$', '')"

_MARK = "mark AS (SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CAST(90 * u AS INTEGER) AS sr, CAST(200 - 60 * v AS INTEGER) AS sg, CAST(10 + 40 * u * v AS INTEGER) AS sb, CAST(255 - 70 * u AS INTEGER) AS s_a FROM range(0, 3) a(u), range(0, 2) b(v))"
_BYTE = lambda e: f"CAST(least(255, greatest(0, floor(round({e}, 9) + 0.5))) AS INTEGER)"


def _duff(ws: str, wb: str, dx: int, dy: int) -> str:
    new = ", ".join(f"CASE WHEN s_a IS NULL THEN {c} WHEN ws + wb > 0 THEN {_BYTE(f'(coalesce(s{c}, 0) * ws + {c} * wb) / (ws + wb)')} ELSE 0 END AS {c}" for c in "rgb")
    return f"WITH {MIXED4}, {_MARK}, p AS (SELECT r.*, m.* EXCLUDE (u, v), coalesce(s_a, 0) / 255.0::DOUBLE AS sa, a / 255.0::DOUBLE AS ba FROM rgba r LEFT JOIN mark m ON r.x = m.u + {dx} AND r.y = m.v + {dy}), w AS (SELECT *, {ws} AS ws, {wb} AS wb FROM p) SELECT img_id, x, y, {new}, CASE WHEN s_a IS NULL THEN a ELSE {_BYTE('(ws + wb) * 255')} END AS a FROM w"


_SCREEN = ", ".join(f"{_BYTE(f'((1 - sa) * v / 255.0::DOUBLE + sa * (v / 255.0::DOUBLE + s{c} / 255.0::DOUBLE - v * s{c} / 65025.0::DOUBLE)) * 255')} AS {c}" for c in "rgb")
_TURN = """sz AS (SELECT ceil(round(4 * cos(radians(30)) + 4 * sin(radians(30)), 9)) AS n), t AS (SELECT i.img_id, CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y, CAST(n AS INTEGER) AS n,
  round(cos(radians(30)) * (a.x - (n - 1) / 2.0) + sin(radians(30)) * (b.y - (n - 1) / 2.0) + 1.5, 9) AS fx, round(-sin(radians(30)) * (a.x - (n - 1) / 2.0) + cos(radians(30)) * (b.y - (n - 1) / 2.0) + 1.5, 9) AS fy FROM (SELECT DISTINCT img_id FROM rgba) i, sz, range(0, 6) a(x), range(0, 6) b(y)),
e AS (SELECT t.*, coalesce(s.r, 0) AS sr, coalesce(s.g, 0) AS sg, coalesce(s.b, 0) AS sb, coalesce(s.a, 0) AS s_a, (CASE WHEN i = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE WHEN j = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) AS w
  FROM t CROSS JOIN range(0, 2) k(i) CROSS JOIN range(0, 2) l(j) LEFT JOIN rgba s ON s.img_id = t.img_id AND s.x = floor(fx) + i AND s.y = floor(fy) + j)"""

ORACLE = {
    "codec_kinds": f"WITH {GRAY} SELECT kind, kind AS format, img_id, x, y, v AS r, v AS g, v AS b, 255 AS a FROM gray CROSS JOIN (VALUES ('bmp'), ('ico'), ('pnm'), ('tga')) k(kind)",
    "apng_composed": f"WITH {HEAT}, f AS (SELECT img_id, row_number() OVER (ORDER BY img_id) - 1 AS frame FROM (SELECT DISTINCT img_id FROM heat)) SELECT CAST(frame AS INTEGER) AS frame, x, y, class * 100 AS r, x * 10 AS g, y * 8 AS b, 255 AS a FROM heat JOIN f USING (img_id)",
    "composite_tiled": f"WITH {GRAY}, {_MARK}, p AS (SELECT g.*, m.*, s_a / 255.0::DOUBLE AS sa FROM gray g JOIN mark m ON (g.x - 5 + 300) % 3 = m.u AND (g.y - 6 + 200) % 2 = m.v) SELECT img_id, x, y, {_SCREEN}, 255 AS a FROM p",
    "composite_gravity": _duff("sa * (1 - ba)", "ba", 1, 1),
    "composite_xor": _duff("sa * (1 - ba)", "ba * (1 - sa)", 1, 1),
    "rotate_any": f"WITH {RGBA4}, {_TURN}, m AS (SELECT img_id, n, x, y, " + ", ".join(f"sum(w * s{c} * s_a) AS m{c}" for c in "rgb") + ", sum(w * s_a) AS ma FROM e GROUP BY ALL) SELECT img_id, n AS width, n AS height, x, y, " + ", ".join(f"CASE WHEN ma > 0 THEN CAST(least(255, greatest(0, floor(round(m{c} / ma, 6) + 0.5))) AS INTEGER) ELSE 0 END AS {c}" for c in "rgb") + ", CAST(least(255, greatest(0, floor(round(ma, 6) + 0.5))) AS INTEGER) AS a FROM m",
    "auto_options": f"SELECT m.img_id, CASE WHEN m.n > 62 THEN 48 ELSE 16 END AS colours, m.n > 62 AS gradients, z.noise <= 9 AS subpixel, z.noise <= 9 AS lattice FROM (WITH {GRAY} SELECT img_id, count(DISTINCT v) AS n FROM gray GROUP BY 1) m JOIN ({metrics.ORACLE['interior_noise']}) z USING (img_id)",
    "outline_pins": f"{_VERTICES} SELECT img_id, lx, ly, lx <= 0 OR ly <= 0 OR lx >= 24 OR ly >= 31 OR n <> 2 AS pinned FROM deg WHERE n > 0",
    "outline_agreement": f"{_VERTICES} SELECT img_id, lx, ly, CAST(1 AS BIGINT) AS places FROM deg WHERE n > 0",
    "box_dominant": f"""{_BOXES} SELECT img_id, box, {", ".join(f"CAST(floor(s{c} / n + 0.5) AS INTEGER) AS {c}" for c in "rgb")} FROM boxed QUALIFY row_number() OVER (PARTITION BY img_id, box ORDER BY n DESC, rb, gb, bb) = 1""",
    "box_median": f"{_BOXES}, k AS (SELECT DISTINCT img_id, box FROM boxed) SELECT img_id, box, {_MEDIAN} FROM k",
    "blend_layer": f"""WITH {HEAT}, adj AS (SELECT a.img_id, least(a.class, b.class) AS lo, greatest(a.class, b.class) AS hi, count(*) AS border FROM heat a JOIN heat b ON b.img_id = a.img_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE a.class <> b.class GROUP BY 1, 2, 3),
g AS (SELECT img_id, max(class) AS ground FROM heat GROUP BY 1), e AS (SELECT adj.*, ground, 255 - lo * 40 AS la, 255 - hi * 40 AS ha FROM adj JOIN g USING (img_id) WHERE border >= 8),
m AS (SELECT *, {", ".join(f"CAST(floor({lo} * (la / (la + ha)) + {hi} * (ha / (la + ha)) + 0.5) AS INTEGER) AS {c}" for c, lo, hi in (("r", "lo * 51", "hi * 51"), ("g", "lo * 17", "hi * 17"), ("b", "(200 - lo * 30)", "(200 - hi * 30)")))}, CAST(floor((la + ha) / 2 + 0.5) AS INTEGER) AS a FROM e),
t AS (SELECT *, '" stroke="' || {_HEX("r", "g", "b")} || '"' || CASE WHEN a < 255 THEN ' stroke-opacity="' || {_SHORT("a / 255.0")} || '"' ELSE '' END || '/>' AS paint FROM m),
p AS (SELECT img_id, lo, hi, 0 AS k, -1 AS clip, '<use href="#p' || CASE WHEN ground = lo THEN hi ELSE lo END || paint AS text FROM t WHERE ground IN (lo, hi)
  UNION ALL SELECT img_id, lo, hi, 0, hi, '<use href="#p' || lo || paint FROM t WHERE ground NOT IN (lo, hi) UNION ALL SELECT img_id, lo, hi, 1, lo, '<use href="#p' || hi || paint FROM t WHERE ground NOT IN (lo, hi)),
s AS (SELECT img_id, clip, string_agg(text, '' ORDER BY lo, hi, k) AS body FROM p GROUP BY 1, 2)
SELECT img_id, '<g fill="none" stroke-width="1.5" stroke-linejoin="round">' || string_agg(CASE WHEN clip = -1 THEN body ELSE '<g clip-path="url(#cp' || clip || ')">' || body || '</g>' END, '' ORDER BY clip) || '</g>' AS text, coalesce(string_agg(clip, ',' ORDER BY clip) FILTER (clip >= 0), '') AS clips FROM s GROUP BY 1""",
    "stroke_attributes": f"""WITH k AS (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey % 3 * 17 AS b, 255 - p_partkey % 5 * 51 AS a, p_partkey % 4 / 2 AS w FROM part)
SELECT p_partkey, CASE WHEN w > 0 THEN ' stroke="' || {_HEX("r", "g", "b")} || '" stroke-width="' || {_SHORT("w")} || '"' || CASE WHEN a < 255 THEN ' stroke-opacity="' || {_SHORT("a / 255.0")} || '"' ELSE '' END ELSE '' END AS attributes,
'<clipPath id="c' || p_partkey || '"><use href="#' || p_partkey || '"/></clipPath>' AS clip FROM k""",
    "origins_allowed": "SELECT p_partkey, p_partkey % 6 < 4 AS allowed FROM part",
    "memory_refusals": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey * 7200000 > 3000000000 THEN 'outlines need about ' || format('{:,}', CAST(floor(p_partkey * 7200000 / 1048576 + 0.5) AS BIGINT)) || ' MB, but only 2,861 MB of 3,815 MB are free' END AS why FROM part",
    "office_command": "SELECT p_partkey, '--headless|--norestore|--convert-to|pdf|--outdir|/out/' || p_partkey || '|in/' || p_partkey || '.docx' AS arguments FROM part",
}
