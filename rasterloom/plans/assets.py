"""Sets of files from images: icons with their manifest, traced animations, tiny traced placeholders, layers between colours, and PDFs of encoded pages."""

from __future__ import annotations

import json
import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.colour import blend_pair, short_hex
from rasterloom.functions.markup import animated, rounded3
from rasterloom.operators.images import Planes
from rasterloom.operators.quantize import palette_of
from rasterloom.operators.whole import per_raster
from rasterloom.plans.vectorize import Options, traced
from rasterloom.session import ensure_importable
from rasterloom.sources.codecs import encode_ico, encode_png

ICO_SIDES, PNG_ICONS, SAFE = (16, 32, 48), {"apple-touch-icon.png": 180, "icon-192.png": 192, "icon-512.png": 512, "icon-maskable-512.png": 512}, 0.8


def _taps(source: int, target: int) -> np.ndarray:
    """(target, source) weights of a Lanczos kernel of three lobes, wider when shrinking; each row sums to 1."""
    ratio = source / target
    t = ((np.arange(target)[:, None] + 0.5) * ratio - (np.arange(source) + 0.5)) / max(1.0, ratio)
    w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resized(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """An RGBA image in another size; colours are weighted by alpha."""
    v = p.astype(float)
    v[..., :3] *= v[..., 3:] / 255
    v = np.einsum("yh,hwc->ywc", _taps(p.shape[0], height), v)
    v = np.einsum("xw,ywc->yxc", _taps(p.shape[1], width), v)
    a = v[..., 3:]
    v[..., :3] = np.where(a > 0, v[..., :3] * 255 / np.where(a > 0, a, 1), 0)
    return np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8)


def covering(p: np.ndarray, side: int) -> np.ndarray:
    """The middle square of an image in another size."""
    h, w = p.shape[:2]
    n = min(h, w)
    y, x = (h - n) // 2, (w - n) // 2
    return resized(p[y : y + n, x : x + n], side, side)


def maskable(p: np.ndarray, side: int, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """The icon at 80 % on a filled square, so that a round mask cuts nothing off."""
    inner = math.floor(side * SAFE + 0.5)
    pad = math.floor((side - inner) / 2 + 0.5)
    out = np.empty((inner + 2 * pad, inner + 2 * pad, 4), np.uint8)
    out[...] = (*background, 255)
    out[pad : pad + inner, pad : pad + inner] = covering(p, inner)
    return out


def manifest(name: str = "App", short_name: str | None = None, theme: str = "#ffffff", background: str = "#ffffff") -> str:
    icons = [{"src": f"/{f}", "sizes": f"{s}x{s}", "type": "image/png"} | ({"purpose": "maskable"} if "maskable" in f else {}) for f, s in PNG_ICONS.items() if f.startswith("icon-")]
    return json.dumps({"name": name, "short_name": short_name or name, "icons": icons, "theme_color": theme, "background_color": background, "display": "standalone"}, indent=2)


def favicon_set(rasters: DataFrame, name: str = "App", short_name: str | None = None, theme: str = "#ffffff", background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """img_id, file, width, bytes of every image's icon set: favicon.ico (16, 32 and 48 pixels), four PNGs, the web manifest and the head's HTML (width is null for these two)."""
    link = lambda rel, href, **more: "<link " + " ".join(f'{k}="{v}"' for k, v in {"rel": rel, "href": href, **more}.items()) + ">"
    links = [link("icon", "/favicon.ico", sizes="any"), link("icon", "/icon-192.png", type="image/png"), link("apple-touch-icon", "/apple-touch-icon.png"), link("manifest", "/manifest.webmanifest")]
    page = "\n".join([*links, f'<meta name="theme-color" content="{theme}">'])
    text = manifest(name, short_name, theme, "#" + bytes(background).hex())

    def run(p: np.ndarray) -> dict:
        files = {"favicon.ico": (max(ICO_SIDES), encode_ico([covering(p, s) for s in ICO_SIDES]))}
        for f, side in PNG_ICONS.items():
            files[f] = (side, encode_png(maskable(p, side, background) if "maskable" in f else covering(p, side)))
        files |= {"manifest.webmanifest": (None, text.encode()), "head.html": (None, page.encode())}
        return {"file": list(files), "width": [s for s, _ in files.values()], "bytes": [b for _, b in files.values()]}

    return per_raster(rasters, run, "file string, width int, bytes binary")


def planes(p: np.ndarray) -> Planes:
    return {c: p[..., k].astype(np.int32) for k, c in enumerate("rgba")}


def shared_palette(frames: list[np.ndarray], colours: int, rounds: int = 4) -> np.ndarray:
    """One palette for all frames, from the pixels of the whole stack with alpha from 8 on."""
    c = np.concatenate([f.reshape(-1, 4) for f in frames]).astype(np.int64)
    c = c[c[:, 3] >= 8][:, :3]
    if not len(c):
        return np.zeros((0, 3), np.int64)
    rb, at = np.unique(c >> 3, axis=0, return_inverse=True)
    at = at.ravel()
    sums = np.stack([np.bincount(at, c[:, k]) for k in range(3)], 1)
    return palette_of(rb, np.bincount(at).astype(float), sums, np.bincount(at, (c * c).sum(1)), colours, rounds)


def traced_frames(frames: DataFrame, options: Options | None = None) -> DataFrame:
    """img_id, frame, svg: each frame (img_id, frame, width, height, data) traced with one palette for its animation, so a colour that drifts stays one colour. An animation is traced in one task."""
    o = options or Options()
    ensure_importable(frames.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        px = [np.frombuffer(d, np.uint8).reshape(h, w, 4) for w, h, d in zip(*(t.column(c).to_pylist() for c in ("width", "height", "data")))]
        pal = tuple(tuple(int(v) for v in c) for c in shared_palette(px, o.colours, o.refine))
        svg = [traced(planes(p), replace(o, palette=pal))[0] for p in px]
        return pa.table({"img_id": t.column("img_id"), "frame": t.column("frame"), "svg": pa.array(svg, pa.string())})

    kind = frames.schema["img_id"].dataType.simpleString()
    return frames.select("img_id", F.col("frame").cast("int").alias("frame"), "width", "height", "data").groupBy("img_id").applyInArrow(run, f"img_id {kind}, frame int, svg string")


def traced_animation(frames: DataFrame, options: Options | None = None, fps: float | None = None) -> DataFrame:
    """img_id, text, frames, duration: each animation (img_id, frame, delay_ms, width, height, data) as one animated document. duration: seconds of a loop, from the delays (100 ms a frame if they sum to nothing); the frames share it equally."""
    total = frames.groupBy("img_id").agg(F.count("*").alias("frames"), F.sum("delay_ms").alias("ms"))
    total = total.select("img_id", "frames", (F.when(F.col("ms") > 0, F.col("ms")).otherwise(F.col("frames") * 100) / 1000.0).alias("duration"))
    return animated(traced_frames(frames, options), "img_id", "frame", "svg", fps or 10.0).join(total, "img_id")


def placeholder_svg(rasters: DataFrame, max_pixels: int = 1600, colours: int = 4) -> DataFrame:
    """img_id, svg: a tiny document of each image: reduced to max_pixels by nearest neighbours, blurred, and traced to a handful of shapes."""
    from rasterloom.functions.colour import gaussian
    from rasterloom.operators.whole import _along

    o = Options(colours=colours, tolerance=2.0, fit_error=2.0, min_area=1, refine=0)
    kernel = gaussian(2, 2 / 3)

    def run(p: np.ndarray) -> dict:
        h, w = p.shape[:2]
        scale = min(1.0, math.sqrt(max_pixels / (h * w)))
        y, x = ((np.arange(max(1, int(n * scale))) * n // max(1, int(n * scale))) for n in (h, w))
        small = p[y][:, x]
        if min(small.shape[:2]) >= 4:
            small = np.floor(_along(_along(small.astype(float), kernel, 0), kernel, 1) + 0.5).astype(np.uint8)
        return {"svg": [traced(planes(small), o)[0]]}

    return per_raster(rasters, run, "svg string")


# -- layers between colours


def stroke_attributes(r: Column, g: Column, b: Column, a: Column, width: Column) -> Column:
    """Attributes of a stroke; none for a width that isn't positive, and an opacity only below full alpha."""
    base = F.concat(F.lit(' stroke="'), short_hex(r, g, b), F.lit('" stroke-width="'), rounded3(width.cast("double")), F.lit('"'))
    alpha = F.when(a < 255, F.concat(F.lit(' stroke-opacity="'), rounded3(a / 255.0), F.lit('"'))).otherwise("")
    return F.when(width > 0, F.concat(base, alpha)).otherwise("")


def clip_path(path_id: Column) -> Column:
    return F.concat(F.lit('<clipPath id="c'), path_id, F.lit('"><use href="#'), path_id, F.lit('"/></clipPath>'))


def blend_layer(adjacency: DataFrame, classes: DataFrame, background: DataFrame | None = None, width: float = 1.0, least: int = 8) -> DataFrame:
    """img_id, text, clips (sorted classes that need a clip path): strokes in the mean colour of each pair of classes (img_id, lo, hi, border) with a border of `least` or more, to be painted under the fills. Each outline is clipped to the other class; along the image's background class (img_id, class) the other outline is stroked whole. classes: img_id, class, path_id, r, g, b, a; a class without path_id is left out."""
    rgba = ("r", "g", "b", "a")
    lo, hi = (classes.select("img_id", F.col("class").alias(s), F.col("path_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in rgba]) for s in ("lo", "hi"))
    e = adjacency.filter(F.col("border") >= least).join(lo, ["img_id", "lo"]).join(hi, ["img_id", "hi"])
    e = e.join(background.select("img_id", F.col("class").alias("ground")), "img_id", "left") if background is not None else e.withColumn("ground", F.lit(None).cast("int"))
    r, g, b, a = blend_pair(tuple(F.col(f"lo_{c}") for c in rgba), tuple(F.col(f"hi_{c}") for c in rgba))
    alpha = F.when(a < 255, F.concat(F.lit(' stroke-opacity="'), rounded3(a / 255.0), F.lit('"'))).otherwise("")
    e = e.withColumns({"colour": short_hex(r, g, b), "alpha": alpha})
    use = lambda ident: F.concat(F.lit('<use href="#'), ident, F.lit('" stroke="'), F.col("colour"), F.lit('"'), F.col("alpha"), F.lit("/>"))
    part = lambda clip, clip_id, text: F.struct(clip.cast("int").alias("clip"), clip_id.alias("clip_id"), text.alias("text"))
    none = F.lit(None)
    apart = F.array(part(F.col("hi"), F.col("hi_id"), use(F.col("lo_id"))), part(F.col("lo"), F.col("lo_id"), use(F.col("hi_id"))))
    other = F.when(F.col("ground") == F.col("lo"), F.col("hi_id")).otherwise(F.col("lo_id"))
    whole = F.array(part(F.lit(-1), none.cast("string"), use(other)))
    touching = F.coalesce((F.col("ground") == F.col("lo")) | (F.col("ground") == F.col("hi")), F.lit(False))
    pieces = e.select("img_id", "lo", "hi", F.posexplode(F.when(touching, whole).otherwise(apart)).alias("k", "p")).select("img_id", "lo", "hi", "k", "p.*")
    # a pair of which one class has no outline gives nothing, as either half needs both
    both = pieces.filter("text is not null and (clip = -1 or clip_id is not null)").withColumn("n", F.count("*").over(W.partitionBy("img_id", "lo", "hi"))).filter("clip = -1 or n = 2")
    groups = both.groupBy("img_id", "clip").agg(F.max("clip_id").alias("clip_id"), F.array_sort(F.collect_list(F.struct("lo", "hi", "k", "text"))).alias("s"))
    inner = F.array_join(F.transform("s", lambda x: x["text"]), "")
    text = F.when(F.col("clip") == -1, inner).otherwise(F.concat(F.lit('<g clip-path="url(#c'), F.col("clip_id"), F.lit(')">'), inner, F.lit("</g>")))
    out = groups.withColumn("t", text).groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("clip", "t"))).alias("g"))
    body = F.array_join(F.transform("g", lambda x: x["t"]), "")
    head = f'<g fill="none" stroke-width="{width:g}" stroke-linejoin="round">'
    return out.select("img_id", F.concat(F.lit(head), body, F.lit("</g>")).alias("text"), F.filter(F.transform("g", lambda x: x["clip"]), lambda c: c >= 0).alias("clips"))


# -- PDF of encoded pages


def image_pdf(pages: list[tuple[bytes, int, int]], dpi: float = 96) -> bytes:
    """A PDF of JPEG pages (bytes, width, height), each as large as its pixels are at the resolution. ValueError without pages or for a resolution that isn't positive and finite."""
    if not pages:
        raise ValueError("a document needs one page at least")
    if not (dpi > 0 and math.isfinite(dpi)):
        raise ValueError(f"not a resolution: {dpi}")
    size = lambda n: f"{math.floor(n * 72 / dpi * 1000 + 0.5) / 1000:g}"
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Count {len(pages)}/Kids[{' '.join(f'{3 + 3 * k} 0 R' for k in range(len(pages)))}]>>".encode()]
    for k, (jpeg, w, h) in enumerate(pages):
        n = 3 + 3 * k
        draw = f"q {size(w)} 0 0 {size(h)} 0 0 cm /I Do Q".encode()
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {size(w)} {size(h)}]/Contents {n + 1} 0 R/Resources<</XObject<</I {n + 2} 0 R>>>>>>".encode())
        objects.append(b"<</Length %d>>stream\n%b\nendstream" % (len(draw), draw))
        objects.append(f"<</Type/XObject/Subtype/Image/Width {w}/Height {h}/BitsPerComponent 8/ColorSpace/DeviceRGB/Filter/DCTDecode/Length {len(jpeg)}>>stream\n".encode() + jpeg + b"\nendstream")
    out, at = bytearray(b"%PDF-1.7\n%\xb5\xed\xae\xfb\n"), []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % v for v in at)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def page_documents(pages: DataFrame, dpi: float = 96) -> DataFrame:
    """doc, n_pages, bytes: encoded JPEG pages (doc, page, width, height, jpeg) as one PDF a document, pages in order. A document is put together in one task."""
    ensure_importable(pages.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("page")
        own = list(zip(*(t.column(c).to_pylist() for c in ("jpeg", "width", "height"))))
        return pa.table({"doc": t.column("doc").slice(0, 1), "n_pages": pa.array([len(own)], pa.int32()), "bytes": pa.array([image_pdf(own, dpi)], pa.binary())})

    kind = pages.schema["doc"].dataType.simpleString()
    return pages.select("doc", F.col("page").cast("int").alias("page"), "width", "height", "jpeg").filter("jpeg is not null").groupBy("doc").applyInArrow(run, f"doc {kind}, n_pages int, bytes binary")
