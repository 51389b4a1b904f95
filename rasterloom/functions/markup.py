"""Vector markup as text: sniffing, counting, minifying, payloads, sheets and animations, by regular expressions that the JVM runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUMBER = r"-?\.?\d[\d.eE+-]*"
_SNIFF = r"(?is)^\s*(?:<\?xml[^>]*\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<svg[\s>]"


def looks_like_svg(content: Column) -> Column:
    """Whether the first 2048 characters open an SVG document (after prolog, comments and doctype)."""
    return F.substring(content, 1, 2048).rlike(_SNIFF)


def is_pdf(content: Column) -> Column:
    """%PDF- within the first kilobyte of a binary."""
    return F.locate("%PDF-", F.decode(F.substring(content, 1, 1028), "ISO-8859-1")) > 0


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def path_nodes(d: Column) -> Column:
    """Anchor points of path data: by command, the numbers that follow over its arity, one at least; closing adds none."""
    runs = F.regexp_extract_all(d, F.lit("([MmLlHhVvCcSsQqTtAa][^MmLlHhVvCcSsQqTtAaZz]*)"), F.lit(1))
    arity = F.create_map(*[F.lit(x) for k, v in {"m": 2, "l": 2, "t": 2, "h": 1, "v": 1, "c": 6, "s": 4, "q": 4, "a": 7}.items() for x in (k, v)])
    one = lambda s: F.greatest(F.lit(1), F.floor(F.regexp_count(s, F.lit(NUMBER)) / F.element_at(arity, F.lower(F.substring(s, 1, 1))))).cast("int")
    return F.coalesce(F.aggregate(F.transform(runs, one), F.lit(0), lambda a, x: a + x), F.lit(0))


def complexity(text: Column) -> Column:
    """struct<bytes, nodes, shapes> of a document; circles, ellipses and rectangles count four nodes, lines two."""
    paths = F.regexp_extract_all(text, F.lit(r'\sd="([^"]*)"'), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(r'<(?:polygon|polyline)\b[^>]*\spoints="([^"]*)"'), F.lit(1))
    total = lambda a: F.coalesce(F.aggregate(a, F.lit(0), lambda x, y: x + y), F.lit(0))
    nodes = total(F.transform(paths, path_nodes)) + total(F.transform(lists, lambda s: F.floor(F.regexp_count(s, F.lit(NUMBER)) / 2).cast("int")))
    nodes = nodes + 4 * count_of(text, r"<(?:circle|ellipse|rect)\b") + 2 * count_of(text, r"<line\b")
    return F.struct(F.octet_length(text).alias("bytes"), nodes.alias("nodes"), count_of(text, r"<(?:path|circle|ellipse|rect|line|polygon|polyline|image)\b").alias("shapes"))


#: Attributes at their initial value.
DEFAULTS = (r'fill-opacity="1"', r'stroke-opacity="1"', r'opacity="1"', r'fill-rule="nonzero"', r'stroke="none"', r'stroke-linecap="butt"', r'stroke-linejoin="miter"')


def minified(text: Column, drop_defaults: bool = True) -> Column:
    """Without prolog, doctype, comments, white space between tags and (if asked) attributes at their defaults; every pass is linear in the text."""
    s = F.regexp_replace(text, r"(?s)<\?xml.*?\?>", "")
    s = F.regexp_replace(s, r"(?is)<!doctype[^>]*>", "")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    if drop_defaults:
        s = F.regexp_replace(s, r"\s(?:" + "|".join(DEFAULTS) + ")", "")
    s = F.regexp_replace(s, r">\s+<", "><")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def optimize(text: Column, precision: int = 2) -> Column:
    """minified(), and numbers of coordinate attributes rounded; transforms and widths stay."""
    attr = r'(\s(?:d|points|cx|cy|r|rx|ry|x|y|x1|y1|x2|y2)=")([^"]*)(")'
    s = minified(text)
    pieces = F.regexp_extract_all(F.concat(s, F.lit("\0")), F.lit(r"(?s)(.*?(?:\s(?:d|points|cx|cy|r|rx|ry|x|y|x1|y1|x2|y2)=\"[^\"]*\"|\x00))"), F.lit(1))

    def piece(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?s)^(.*?)" + attr + "$", 1)
        name, body = F.regexp_extract(p, r"(?s)^(.*?)" + attr + "$", 2), F.regexp_extract(p, r"(?s)^(.*?)" + attr + "$", 3)
        tokens = F.regexp_extract_all(body, F.lit(r"(-?\d*\.?\d+(?:[eE][-+]?\d+)?|[^-.\d]+|.)"), F.lit(1))
        short = lambda t: F.when(t.rlike(r"^-?\d*\.\d{%d,}$" % (precision + 1)), rounded(t.cast("double"), precision)).otherwise(t)
        return F.when(p.rlike(attr + "$"), F.concat(head, name, F.array_join(F.transform(tokens, short), ""), F.lit('"'))).otherwise(p)

    return F.replace(F.array_join(F.transform(pieces, piece), ""), F.lit("\0"), F.lit(""))


def rounded(v: Column, precision: int) -> Column:
    """A number's shortest text at that precision: no exponent, trailing zeros, zero before the point, or negative zero."""
    s = F.format_string(f"%.{precision}f", F.floor(v * 10**precision + 0.5) / F.lit(float(10**precision)))
    if precision:
        s = F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
    return F.regexp_replace(F.regexp_replace(s, r"^(-?)0\.", "$1."), r"^-0?$", "0")


def escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def embedded(content: Column, mime: str = "application/octet-stream") -> Column:
    """A document that carries bytes as base64, with their SHA-256 as provenance."""
    return F.concat(F.lit('<svg data-sha256="'), F.sha2(content, 256), F.lit(f'"><image href="data:{mime};base64,'), F.regexp_replace(F.base64(content), r"\s", ""), F.lit('"/></svg>'))


def payload(document: Column) -> Column:
    """struct<content, sha256, verified>: the bytes that embedded() put in, and whether they are still the same."""
    body = F.unbase64(F.regexp_extract(document, r'base64,([^"]*)"', 1))
    said = F.regexp_extract(document, r'data-sha256="([0-9a-f]*)"', 1)
    return F.struct(body.alias("content"), said.alias("sha256"), (F.sha2(body, 256) == said).alias("verified"))


def inner(svg: Column) -> Column:
    """What stands between the outer tags."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(svg, r"(?s)^.*?<svg\b[^>]*>", ""), r"</svg>\s*$", ""), r"(?s)<\?xml.*?\?>", "")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def view_box(svg: Column, default: str) -> Column:
    tag = F.regexp_extract(svg, r"(?i)<svg\b[^>]*>", 0)
    vb = F.regexp_extract(tag, 'viewBox="([^"]*)"', 1)
    w, h = (F.regexp_extract(tag, r"(?i)\s" + k + r"""\s*=\s*["']([\d.]+)(?:px)?["']""", 1) for k in ("width", "height"))
    return F.when(vb != "", vb).when((w != "") & (h != ""), F.concat(F.lit("0 0 "), w, F.lit(" "), h)).otherwise(F.lit(default))


def _joined(df: DataFrame, by: list[str], order: list[str], text: Column, sep: str = "") -> DataFrame:
    """by, text: the texts of each group in order, joined."""
    s = F.array_sort(F.collect_list(F.struct(*order, text.alias("__t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(s, lambda x: x["__t"]), sep).alias("text"))


def sprite_sheet(items: DataFrame, by: list[str], order: str, ident: Column, svg: Column) -> DataFrame:
    """by, text: one sheet of symbols for each group."""
    sym = F.concat(F.lit('<symbol id="'), escaped(ident), F.lit('" viewBox="'), view_box(svg, "0 0 24 24"), F.lit('">'), inner(svg), F.lit("</symbol>"))
    out = _joined(items.withColumn("__sym", sym), by, [order], F.col("__sym"))
    return out.withColumn("text", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" aria-hidden="true">'), "text", F.lit("</svg>")))


def frame_timing(frames: DataFrame, by: str, frame: str, fps: float = 10.0) -> DataFrame:
    """by, frame, n, delay_s: the negative start of each frame of a looped animation that shows one of n frames at a time."""
    n = F.count("*").over(W.partitionBy(by))
    k = F.row_number().over(W.partitionBy(by).orderBy(frame)) - 1
    return frames.withColumns({"n": n, "__k": k}).select(by, frame, "n", F.round(-((F.col("n") - F.col("__k")) % F.col("n")) / F.lit(fps), 6).alias("delay_s"))


def animated(frames: DataFrame, by: str, frame: str, svg: str, fps: float = 10.0) -> DataFrame:
    """by, text: frames as groups of one animated document; the first one also shows without animation."""
    t = frames.join(frame_timing(frames, by, frame, fps), [by, frame])
    k = F.row_number().over(W.partitionBy(by).orderBy(frame)) - 1
    t = t.withColumn("__k", k).withColumn("__g", F.format_string('<g class="fr" style="animation-delay:%ss">%s</g>', F.col("delay_s").cast("string"), inner(F.col(svg))))
    body = _joined(t, [by], ["__k"], F.col("__g"))
    n = t.groupBy(by).agg(F.max("n").alias("n"), F.min_by(F.col(svg), "__k").alias("first"))
    css = F.format_string("<style>.fr{opacity:0;animation:show %ss steps(1,end) infinite}.fr:first-of-type{opacity:1}@keyframes show{0%%{opacity:1}%s%%{opacity:0}}@media(prefers-reduced-motion:reduce){.fr{animation:none}}</style>", (F.col("n") / fps).cast("string"), F.round(100 / F.col("n"), 4).cast("string"))
    doc = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), view_box(F.col("first"), "0 0 100 100"), F.lit('">'), css, "text", F.lit("</svg>"))
    return body.join(n, by).select(by, F.when(F.col("n") == 1, F.col("first")).otherwise(doc).alias("text"))


def component(svg: Column, name: str, framework: str = "react") -> Column:
    """Source of a UI component around the markup; for React attributes are camel-cased and classes renamed."""
    s = F.trim(minified(svg, drop_defaults=False))
    if framework in ("react", "solid"):
        for attr in ("stroke-width", "stroke-linejoin", "stroke-linecap", "fill-rule", "clip-path", "stop-color", "fill-opacity", "stroke-opacity"):
            head, tail = attr.split("-", 1)
            s = F.replace(s, F.lit(f" {attr}="), F.lit(f" {head}{tail.title().replace('-', '')}="))
        if framework == "react":
            s = F.replace(s, F.lit(" class="), F.lit(" className="))
        return F.concat(F.lit(f"export function {name}(props) {{ return "), with_props(s, "{...props}"), F.lit("; }"))
    if framework == "vue":
        return F.concat(F.lit("<template>"), with_props(s, 'v-bind="$attrs"'), F.lit("</template>"))
    return F.concat(F.lit("<script>let rest = $props();</script>"), with_props(s, "{...rest}"))


def with_props(svg: Column, expr: str) -> Column:
    """An expression in the root tag."""
    return F.regexp_replace(svg, r"^(\s*<svg\b[^>]*?)(/?>)", F.lit("$1 " + expr.replace("$", r"\$") + "$2"))


def change(out: Column, into: Column) -> Column:
    """A change of size as text, with a minus for smaller."""
    pct = (into - out) / into * 100
    return F.when(into == 0, "-").otherwise(F.format_string("%s%.1f%%", F.when(pct >= 0, "-").otherwise("+"), F.abs(pct)))


def batch_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, files, failed, in_bytes, out_bytes, change of rows (file, in_bytes, out_bytes, error)."""
    g = rows.groupBy(*by) if by else rows.groupBy()
    ok = F.col("error").isNull()
    a = g.agg(F.count("*").alias("files"), F.count("error").alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("in_bytes"))), F.lit(0)).alias("in_bytes"), F.coalesce(F.sum(F.when(ok, F.col("out_bytes"))), F.lit(0)).alias("out_bytes"))
    return a.withColumn("change", change(F.col("out_bytes"), F.col("in_bytes")))


def responsive_matrix(images: DataFrame, widths: list[int], formats: list[str]) -> DataFrame:
    """img_id, width, format, name: what to render for images (img_id, width): the widths that don't enlarge, or the image's own."""
    w = F.filter(F.array_sort(F.array(*[F.lit(x) for x in widths])), lambda v: v <= F.col("width"))
    w = F.when(F.size(w) == 0, F.array(F.col("width").cast("int"))).otherwise(w)
    e = images.select("img_id", F.explode(w).alias("w")).select("img_id", "w", F.explode(F.array(*[F.lit(f) for f in formats])).alias("format"))
    ext = F.when(F.col("format") == "jpeg", "jpg").otherwise(F.col("format"))
    return e.select("img_id", F.col("w").alias("width"), "format", F.concat_ws("", F.col("img_id").cast("string"), F.lit("-"), F.col("w").cast("string"), F.lit("."), ext).alias("name"))


def gcode(lines: DataFrame, by: str, height: int, feed: int = 1000, power: int = 1000, travel: int = 3000, signed_zero: bool = False) -> DataFrame:
    """by, text: a laser program of polylines (by, line, points: array of struct<x, y>) of two points or more; y is flipped by the height. signed_zero: what is rounded to zero from below is written -0, as printf does, not 0."""
    xy = lambda p: F.concat(F.lit("X"), rounded3(p["x"], signed_zero), F.lit(" Y"), rounded3(F.lit(float(height)) - p["y"], signed_zero))
    pts = F.col("points")
    first = F.concat(F.lit("G0 "), xy(F.get(pts, F.lit(0))), F.lit(f"\nM3 S{power}\nG1 "), xy(F.get(pts, F.lit(1))), F.lit(f" F{feed}"))
    rest = F.transform(F.slice(pts, F.lit(3), F.greatest(F.size(pts) - 2, F.lit(0))), lambda p: F.concat(F.lit("\nG1 "), xy(p)))
    cut = lines.filter(F.size("points") >= 2).withColumn("__c", F.concat(first, F.array_join(rest, ""), F.lit("\nM5\n")))
    return _joined(cut, [by], ["line"], F.col("__c")).withColumn("text", F.concat(F.lit(f"G21\nG90\nG0 F{travel}\nM5\n"), "text", F.lit("G0 X0 Y0\nM5\nM2\n")))


def rounded3(v: Column, signed_zero: bool = False) -> Column:
    s = F.format_string("%.3f", v.cast("double"))
    s = F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
    return s if signed_zero else F.regexp_replace(s, "^-0$", "0")


#: Media types of images that a document may take in, by extension.
IMAGE_TYPES = {"gif": "image/gif", "svg": "image/svg+xml"} | dict.fromkeys(("jpeg", "jpg"), "image/jpeg") | {k: f"image/{k}" for k in ("webp", "png")}
_HREF = r"""(?i)\b((?:xlink:)?href)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def resolved(path: Column) -> Column:
    """An absolute path with '.' and '..' worked out; '..' at the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array().cast("array<string>")))
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def inline_images(documents: DataFrame, files: DataFrame, ident: str = "id") -> DataFrame:
    """ident, text, inlined (paths), refused (references) of documents (ident, svg, base_dir): <image> references to files (path, content) as data URIs.

    Data URIs, fragments and other schemes than file: stay, as do references without an image's extension or without a file. References are untrusted: one that leaves base_dir is refused and never joined. Documents without a reference stay as they are.
    """
    from rasterloom.functions.scalar import is_inside

    tags = documents.select(ident, "base_dir", F.explode(F.array_distinct(F.regexp_extract_all("svg", F.lit(r"(?i)(<image\b[^>]*>)"), F.lit(1)))).alias("tag"))
    href = F.trim(F.coalesce(F.nullif(F.regexp_extract("tag", _HREF, 2), F.lit("")), F.regexp_extract("tag", _HREF, 3)))
    t = tags.withColumns({"attr": F.regexp_extract("tag", _HREF, 1), "href": href}).filter("href != ''")
    t = t.filter(~F.col("href").rlike("(?i)^(?:data:|#)") & (~F.col("href").rlike("(?i)^[a-z][a-z0-9+.-]*:") | F.col("href").rlike("(?i)^file:")))
    local = F.coalesce(F.try_url_decode(F.replace(F.regexp_replace("href", r"(?i)^file:(?://[^/]*)?", ""), F.lit("+"), F.lit("%2B"))), F.col("href"))
    t = t.withColumn("rel", local).withColumn("path", resolved(F.when(F.col("rel").startswith("/"), F.col("rel")).otherwise(F.concat("base_dir", F.lit("/"), "rel"))))
    kinds = F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv])
    t = t.withColumn("mime", F.element_at(kinds, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))).filter("mime is not null")
    t = t.withColumn("inside", is_inside(resolved(F.col("base_dir")), F.col("path")))
    found = t.join(files.select("path", F.col("content").alias("bytes")), (t["path"] == files["path"]) & t["inside"], "left").drop(files["path"])
    uri = F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.regexp_replace(F.base64("bytes"), r"\s", ""))
    new = F.replace("tag", F.regexp_extract("tag", _HREF, 0), F.concat("attr", F.lit('="'), uri, F.lit('"')))
    g = found.withColumn("new", F.when(F.col("bytes").isNotNull(), new)).groupBy(ident).agg(
        F.sort_array(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("tag", "new")))).alias("swaps"),
        F.sort_array(F.collect_set(F.when(F.col("new").isNotNull(), F.col("path")))).alias("inlined"),
        F.sort_array(F.collect_set(F.when(~F.col("inside"), F.col("href")))).alias("refused"),
    )
    out = documents.select(ident, "svg").join(g, ident, "left")
    none = F.array().cast("array<string>")
    text = F.coalesce(F.aggregate("swaps", F.col("svg"), lambda s, x: F.replace(s, x["tag"], x["new"])), F.col("svg"))
    return out.select(ident, text.alias("text"), F.coalesce("inlined", none).alias("inlined"), F.coalesce("refused", none).alias("refused"))


def pdf_page_count(content: Column) -> Column:
    """Pages of a PDF: its page objects, or, where they lie in compressed streams, the largest /Count of a page tree that doesn't; null if there is neither or it is no PDF."""
    text = F.decode(content, "ISO-8859-1")
    pages = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    counts = F.transform(F.regexp_extract_all(text, F.lit(r"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b"), F.lit(0)), lambda s: F.regexp_extract(s, r"/Count\s+(\d+)", 1).cast("int"))
    return F.when(is_pdf(content), F.when(pages > 0, pages).otherwise(F.array_max(counts)))
