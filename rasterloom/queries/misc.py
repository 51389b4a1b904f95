"""Queries: markup, animation, batches, codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import bindings as B
from rasterloom.functions import markup as M
from rasterloom.functions import scalar as N
from rasterloom.queries.sql import GRAY
from rasterloom.sources import export, rasters


def _svg(s: SparkSession, d: str) -> DataFrame:
    """Small documents from parts: path data, shapes and prologs that vary with the key."""
    k = F.col("p_partkey")
    body = F.concat(F.lit('<path fill-opacity="1" d="M'), (k % 100).cast("string"), F.lit(".123456 5 L10-"), (k % 7).cast("string"), F.lit('.5 20 h5v.75z"/>  <circle cx="50.5000" cy="'), (k % 50).cast("string"), F.lit('.25" r="10.333333"/>\n<line x1="0"/>'))
    head = F.when(k % 3 == 0, '<?xml version="1.0"?>\n<!-- made -->\n<svg width="10" height="20">').when(k % 3 == 1, '<svg viewBox="0 0 9 9">').otherwise("<html><svg>")
    return B.table(s, d, "part").select("p_partkey", F.concat(head, body, F.lit("\n</svg>")).alias("svg"))


def sniff_svg(s: SparkSession, d: str) -> DataFrame:
    a = _svg(s, d).select(F.col("p_partkey").alias("id"), M.looks_like_svg(F.col("svg")).alias("is_svg"))
    return a.union(B.markup(s, d).select((F.col("page_id") + 10_000_000).alias("id"), M.looks_like_svg(F.col("html"))))


def svg_nodes(s: SparkSession, d: str) -> DataFrame:
    return _svg(s, d).select("p_partkey", M.complexity(F.col("svg")).alias("c")).select("p_partkey", "c.*")


def svg_minify(s: SparkSession, d: str) -> DataFrame:
    return B.markup(s, d).select("page_id", M.minified(F.col("html")).alias("text"))


def svg_optimize(s: SparkSession, d: str) -> DataFrame:
    return _svg(s, d).select("p_partkey", M.optimize(F.col("svg")).alias("text"))


def payload_roundtrip(s: SparkSession, d: str) -> DataFrame:
    p = B.markup(s, d).withColumn("doc", M.embedded(F.encode("html", "utf-8"))).select("page_id", "html", M.payload(F.col("doc")).alias("p"))
    return p.select("page_id", "p.sha256", "p.verified", (F.decode("p.content", "utf-8") == F.col("html")).alias("same"), F.octet_length("p.content").cast("long").alias("n_bytes"))


def safe_extension(s: SparkSession, d: str) -> DataFrame:
    p = B.table(s, d, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("../dir.v2/file "), k.cast("string"), F.when(k % 4 == 0, ".XLSX").when(k % 4 == 1, ".exe").when(k % 4 == 2, ".tar.pdf").otherwise(" "))
    return p.select("p_partkey", name.alias("name")).select("p_partkey", N.safe_extension(F.col("name"), "docx").alias("ext"))


def _names(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".svg", ".PDF", ".png", ".jpeg", ".dxf", ".xyz", ".TGA", ".ico")]), (k % 8 + 1).cast("int"))
    return B.table(s, d, "part").select("p_partkey", ext.alias("ext"))


def convert_route(s: SparkSession, d: str) -> DataFrame:
    return _names(s, d).select("p_partkey", "ext", N.convert_route(F.col("ext"), F.col("p_partkey") % 2 == 0).alias("route"), N.format_of(F.col("ext")).alias("format"))


def byte_sizes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.concat(k.cast("string"), F.when(k % 4 == 0, "KB").when(k % 4 == 1, ".5 mb").when(k % 4 == 2, "").otherwise(" stone"))
    return B.table(s, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", N.byte_size(F.col("t")).cast("long").alias("n_bytes"))


def page_specs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.concat((k % 9).cast("string"), F.lit(","), (k % 5 + 3).cast("string"), F.lit("-"), (k % 5).cast("string"), F.lit(", x, 2"))
    return B.table(s, d, "part").select("p_partkey", N.page_indices(t).alias("pages")).select("p_partkey", F.array_join("pages", ",").alias("pages"))


def anim_delays(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    f = B.frames(s, d)
    first = F.first("delay_ms").over(W.partitionBy("anim_id").orderBy("frame"))
    given = F.when(F.col("frame") % 3 == 1, None).otherwise(F.col("delay_ms"))
    return f.withColumn("first", first).select("anim_id", "frame", N.normal_delay(given, F.col("first")).alias("delay_ms"))


def anim_sample(s: SparkSession, d: str) -> DataFrame:
    n = B.frames(s, d).groupBy("anim_id").agg(F.count("*").alias("n"))
    return n.select("anim_id", F.explode(N.sample_frames(F.col("n"), 4)).alias("frame"))


def anim_timing(s: SparkSession, d: str) -> DataFrame:
    return M.frame_timing(B.frames(s, d), "anim_id", "frame")


def anim_document(s: SparkSession, d: str) -> DataFrame:
    f = B.frames(s, d).withColumn("svg", F.concat(F.lit('<svg viewBox="0 0 9 9"><path d="M0 0h'), F.col("delay_ms").cast("string"), F.lit('"/></svg>')))
    return M.animated(f, "anim_id", "frame", "svg")


def sprite_sheet(s: SparkSession, d: str) -> DataFrame:
    p = _svg(s, d).withColumn("grp", F.col("p_partkey") % 10)
    return M.sprite_sheet(p, ["grp"], "p_partkey", F.concat(F.lit("i<"), F.col("p_partkey").cast("string")), F.col("svg"))


def _round2(v: Column) -> Column:
    """v to two places with its sign, also that of a zero, which F.round loses."""
    return F.when(v.cast("string").startswith("-"), -F.round(-v, 2)).otherwise(F.round(v, 2))


def gcode_lines(s: SparkSession, d: str) -> DataFrame:
    e = B.table(s, d, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("line"), "embedding")
    pts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(_round2(F.get("embedding", F.col("line") * 8 + i * 2).cast("double") * 100).alias("x"), _round2(F.get("embedding", F.col("line") * 8 + i * 2 + 1).cast("double") * 100).alias("y")))
    return M.gcode(e.select("vec_id", "line", pts.alias("points")), "vec_id", 64, signed_zero=True)


def batch_summary(s: SparkSession, d: str) -> DataFrame:
    doc = B.table(s, d, "documents")
    rows = doc.select("source", F.octet_length("text").cast("long").alias("in_bytes"), F.col("n_chars").alias("out_bytes"), F.when(F.col("doc_id") % 17 == 0, "cut short").alias("error"))
    return M.batch_summary(rows, ["source"])


def responsive_matrix(s: SparkSession, d: str) -> DataFrame:
    p = B.table(s, d, "part").select(F.col("p_partkey").alias("img_id"), (F.col("p_size") * 40).alias("width"))
    return M.responsive_matrix(p, [320, 640, 960, 1280], ["avif", "webp", "jpeg"])


def codec_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Images encoded as PNG and decoded again: the pixels of the binding."""
    files = rasters.to_files(B.gray_rgba(B.gray8(s, d)), ["png"])
    return rasters.decoded_pixels(files, ["img_id"]).select("img_id", "x", "y", "r", "g", "b", "a")


def _shapes(s: SparkSession, d: str) -> DataFrame:
    e = B.table(s, d, "embeddings").filter("vec_id < 20")
    pts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.round(F.get("embedding", i * 2).cast("double") * 50 + 50, 2).alias("x"), F.round(F.get("embedding", i * 2 + 1).cast("double") * 50 + 50, 2).alias("y")))
    return e.select((F.col("vec_id") % 4).alias("img_id"), F.col("vec_id").alias("ord"), F.lit(100).alias("width"), F.lit(100).alias("height"), pts.alias("points"), (F.col("label") * 25).alias("r"), F.lit(34).alias("g"), F.lit(51).alias("b"), F.lit(255).alias("a"))


def export_documents(s: SparkSession, d: str) -> DataFrame:
    """The same polygons as DXF, EPS, PDF and SVG."""
    out = None
    for name in ("dxf", "eps", "pdf", "svg"):
        one = getattr(export, name)(_shapes(s, d)).withColumn("format", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_SVG = """svgs AS MATERIALIZED (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '<?xml version="1.0"?>' || chr(10) || '<!-- made -->' || chr(10) || '<svg width="10" height="20">' WHEN 1 THEN '<svg viewBox="0 0 9 9">' ELSE '<html><svg>' END
  || '<path fill-opacity="1" d="M' || p_partkey % 100 || '.123456 5 L10-' || p_partkey % 7 || '.5 20 h5v.75z"/>  <circle cx="50.5000" cy="' || p_partkey % 50 || '.25" r="10.333333"/>' || chr(10) || '<line x1="0"/>' || chr(10) || '</svg>' AS svg FROM part)"""
_SNIFF = r"(?is)^\s*(?:<\?xml[^>]*\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<svg[\s>]"
_FR = "fr AS MATERIALIZED (SELECT conv_id AS anim_id, turn AS frame, CAST(length(text) % 200 AS INTEGER) AS delay_ms FROM conversations)"
_NUM = lambda e: f"regexp_replace(regexp_replace(printf('%.3f', {e}), '0+$', ''), '\\.$', '')"
_XY = lambda l, i: f"'X' || {_NUM(f'round(embedding[{l * 8 + i * 2 + 1}]::DOUBLE * 100, 2)')} || ' Y' || {_NUM(f'64 - round(embedding[{l * 8 + i * 2 + 2}]::DOUBLE * 100, 2)')}"
_CUT = lambda l: f"'G0 ' || {_XY(l, 0)} || chr(10) || 'M3 S1000' || chr(10) || 'G1 ' || {_XY(l, 1)} || ' F1000' || chr(10) || 'G1 ' || {_XY(l, 2)} || chr(10) || 'M5' || chr(10)"

NAMES = (sniff_svg, svg_nodes, svg_minify, svg_optimize, payload_roundtrip, safe_extension, convert_route, byte_sizes, page_specs, anim_delays, anim_sample, anim_timing, anim_document, sprite_sheet, gcode_lines, batch_summary, responsive_matrix, codec_round_trip, export_documents)
QUERIES = {f.__name__: f for f in NAMES}
ORACLE = {
    "sniff_svg": f"WITH {_SVG} SELECT p_partkey AS id, p_partkey % 3 <> 2 AS is_svg FROM svgs UNION ALL SELECT page_id + 10000000, regexp_matches(left(html, 2048), '{_SNIFF}') FROM pages",
    "svg_nodes": f"WITH {_SVG} SELECT p_partkey, CAST(strlen(svg) AS INTEGER) AS bytes, 4 + 4 + 2 AS nodes, 3 AS shapes FROM svgs",
    "svg_minify": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<\?xml.*?\?>', '', 'g'), '(?is)<!doctype[^>]*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\s(?:fill-opacity="1"|stroke-opacity="1"|opacity="1"|fill-rule="nonzero"|stroke="none"|stroke-linecap="butt"|stroke-linejoin="miter")', '', 'g'), '>\s+<', '><', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
    "svg_optimize": f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '<svg width="10" height="20">' WHEN 1 THEN '<svg viewBox="0 0 9 9">' ELSE '<html><svg>' END || '<path d="M' || CASE WHEN p_partkey % 100 = 0 THEN '' ELSE (p_partkey % 100)::VARCHAR END || '.12 5 L10-' || p_partkey % 7 || '.5 20 h5v.75z"/><circle cx="50.5" cy="' || p_partkey % 50 || '.25" r="10.33"/><line x1="0"/></svg>' AS text FROM part""",
    "payload_roundtrip": "SELECT page_id, sha256(html) AS sha256, true AS verified, true AS same, strlen(html) AS n_bytes FROM pages",
    "safe_extension": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'xlsx' WHEN 2 THEN 'pdf' ELSE 'docx' END AS ext FROM part",
    "convert_route": "WITH n AS (SELECT p_partkey, ['.svg', '.PDF', '.png', '.jpeg', '.dxf', '.xyz', '.TGA', '.ico'][p_partkey % 8 + 1] AS ext FROM part) SELECT p_partkey, ext, CASE WHEN ext = '.svg' THEN 'vectorize' WHEN lower(ext) IN ('.dxf', '.eps', '.pdf') THEN 'vector-export' WHEN p_partkey % 2 = 0 THEN 'rasterize' ELSE 'raster-convert' END AS route, CASE WHEN lower(ext) IN ('.png', '.jpeg', '.tga', '.ico') THEN lower(ext[2:]) END AS format FROM n",
    "byte_sizes": "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN nullif(p_partkey, 0) * 1000 WHEN 1 THEN (p_partkey + 0.5) * 1000000 WHEN 2 THEN p_partkey END AS BIGINT) AS n_bytes FROM part",
    "page_specs": "SELECT p_partkey, array_to_string(list_concat(list_concat(CASE WHEN p_partkey % 9 > 0 THEN [p_partkey % 9 - 1] ELSE [] END, range(greatest(1, p_partkey % 5) - 1, p_partkey % 5 + 3)), [1]), ',') AS pages FROM part",
    "anim_delays": f"WITH {_FR}, g AS (SELECT *, first_value(delay_ms) OVER (PARTITION BY anim_id ORDER BY frame) AS f FROM fr) SELECT anim_id, frame, CASE WHEN coalesce(CASE WHEN frame % 3 = 1 THEN NULL ELSE delay_ms END, f) > 0 THEN coalesce(CASE WHEN frame % 3 = 1 THEN NULL ELSE delay_ms END, f) ELSE 100 END AS delay_ms FROM g",
    "anim_sample": f"WITH {_FR}, n AS (SELECT anim_id, count(*) AS n FROM fr GROUP BY 1) SELECT DISTINCT anim_id, CAST(CASE WHEN n <= 4 THEN i ELSE floor(i * (n - 1) / 3.0::DOUBLE + 0.5) END AS INTEGER) AS frame FROM n CROSS JOIN range(0, 4) t(i) WHERE n > 4 OR i < n",
    "anim_timing": f"WITH {_FR}, k AS (SELECT anim_id, frame, count(*) OVER (PARTITION BY anim_id) AS n, row_number() OVER (PARTITION BY anim_id ORDER BY frame) - 1 AS k FROM fr) SELECT anim_id, frame, n, round(-((n - k) % n) / 10.0::DOUBLE, 6) + 0 AS delay_s FROM k",
    "gcode_lines": f"SELECT vec_id, 'G21' || chr(10) || 'G90' || chr(10) || 'G0 F3000' || chr(10) || 'M5' || chr(10) || {_CUT(0)} || {_CUT(1)} || 'G0 X0 Y0' || chr(10) || 'M5' || chr(10) || 'M2' || chr(10) AS text FROM embeddings",
    "sprite_sheet": f"""WITH {_SVG} SELECT p_partkey % 10 AS grp, '<svg xmlns="http://www.w3.org/2000/svg" aria-hidden="true">' || string_agg('<symbol id="i&lt;' || p_partkey || '" viewBox="' || CASE p_partkey % 3 WHEN 0 THEN '0 0 10 20' WHEN 1 THEN '0 0 9 9' ELSE '0 0 24 24' END || '">' || trim(regexp_replace(regexp_replace(svg, '(?s)^.*?<svg\\b[^>]*>', ''), '\\s*</svg>$', ''), chr(10) || ' ') || '</symbol>', '' ORDER BY p_partkey) || '</svg>' AS text FROM svgs GROUP BY 1""",
    "batch_summary": "WITH r AS (SELECT source, strlen(text) AS i, n_chars AS o, doc_id % 17 = 0 AS bad FROM documents), g AS (SELECT source, count(*) AS files, count(*) FILTER (bad) AS failed, CAST(coalesce(sum(i) FILTER (NOT bad), 0) AS BIGINT) AS in_bytes, CAST(coalesce(sum(o) FILTER (NOT bad), 0) AS BIGINT) AS out_bytes FROM r GROUP BY 1) SELECT *, CASE WHEN in_bytes = 0 THEN '-' ELSE CASE WHEN in_bytes >= out_bytes THEN '-' ELSE '+' END || printf('%.1f', abs((in_bytes - out_bytes) / in_bytes::DOUBLE * 100)) || '%' END AS change FROM g",
    "responsive_matrix": "WITH w AS (SELECT p_partkey AS img_id, p_size * 40 AS own, unnest(CASE WHEN p_size * 40 >= 320 THEN list_filter([320, 640, 960, 1280], lambda v: v <= p_size * 40) ELSE [p_size * 40] END) AS width FROM part), f AS (SELECT img_id, CAST(width AS INTEGER) AS width, unnest(['avif', 'webp', 'jpeg']) AS format FROM w) SELECT *, img_id || '-' || width || '.' || CASE format WHEN 'jpeg' THEN 'jpg' ELSE format END AS name FROM f",
    "codec_round_trip": f"WITH {GRAY} SELECT img_id, x, y, v AS r, v AS g, v AS b, 255 AS a FROM gray",
}
