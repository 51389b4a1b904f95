"""From rasters to vector documents: exact meshes and contours, traced curves, the choice between them, and their verification."""

from __future__ import annotations

import gzip
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.geometry import compact_path, contours, detect_primitive, detect_sector, fit_loop, number, path_text
from rasterloom.operators.images import Planes, per_image
from rasterloom.operators.outline import dense, face_curves, refined
from rasterloom.operators.paint import definition, paint_of
from rasterloom.operators.quantize import palette_of
from rasterloom.operators.regions import _oklab, despeckled, label
from rasterloom.operators.whole import noise_of

RGBA = dict.fromkeys("rgba", 0)
MAX_RECTS, MAX_REGIONS, PER_PIXEL, REFUSE_FROM = 4_000_000, 200_000, 0.5, 250_000
#: Interior noise up to which outlines may be refined.
NOISE_LIMIT = 0.3


class TooMuch(ValueError):
    """Exact geometry of this image would take too many shapes."""


def keys_of(p: Planes) -> np.ndarray:
    """32-bit colour keys; 0 where alpha is 0."""
    k = p["r"].astype(np.int64) << 24 | p["g"].astype(np.int64) << 16 | p["b"].astype(np.int64) << 8 | p["a"]
    return np.where(p["a"] == 0, 0, k)


def mesh(keys: np.ndarray, void: int = 0, budget: int = MAX_RECTS) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, key) of greedy maximal rectangles: in raster order each free pixel grows right, then down over whole rows of its width."""
    h, w = keys.shape
    free = keys != void
    run = np.ones((h, w), np.int64)  # equal pixels from here to the right
    for x in range(w - 2, -1, -1):
        run[:, x] = np.where(keys[:, x] == keys[:, x + 1], run[:, x + 1] + 1, 1)
    out = []
    for y in range(h):
        x = 0
        while x < w:
            if not free[y, x]:
                x += 1
                continue
            n = int(run[y, x])
            stop = np.flatnonzero(~free[y, x : x + n])
            n = int(stop[0]) if len(stop) else n
            m = 1
            while y + m < h and run[y + m, x] >= n and keys[y + m, x] == keys[y, x] and free[y + m, x : x + n].all():
                m += 1
            free[y : y + m, x : x + n] = False
            out.append((x, y, n, m, int(keys[y, x])))
            if len(out) > budget:
                raise TooMuch(f"more than {budget} rectangles: a photograph is no case for exact geometry")
            x += n
    return out


def mesh_rectangles(px: DataFrame, value: str = "class", void: int = -1) -> DataFrame:
    """img_id, x, y, w, h, value: rectangles that cover every pixel whose value isn't void, each once and of one value."""

    def run(w: int, h: int, p: Planes) -> dict:
        r = mesh(p[value].astype(np.int64), void)
        return {k: [t[i] for t in r] for i, k in enumerate(("x", "y", "w", "h", value))}

    return per_image(px, run, f"x int, y int, w int, h int, {value} int", {value: void})


def rebuilt(rects: DataFrame, value: str = "class") -> DataFrame:
    """The pixels that rectangles cover: img_id, x, y, value."""
    e = rects.withColumn("px", F.explode(F.expr("sequence(x, x + w - 1)"))).withColumn("py", F.explode(F.expr("sequence(y, y + h - 1)")))
    return e.select("img_id", F.col("px").alias("x"), F.col("py").alias("y"), value)


@dataclass(frozen=True)
class Options:
    """What tracing may be asked for."""

    colours: int = 16
    tolerance: float = 0.4
    fit_error: float = 0.4
    corner: float = 75.0
    precision: int = 1
    min_area: int = 0
    refine: int = 4
    primitives: bool = True
    primitive_error: float = 1.0
    policy: str = "left"
    subpixel: bool | None = False  # refine outlines below the pixel; None: where the interior is quiet enough
    palette: tuple[tuple[int, int, int], ...] = field(default=())
    gradients: bool = False  # regions whose colour runs along a line or out from a point are painted so


PRESETS = {
    "logo": Options(colours=8, tolerance=0.65),
    "lineart": Options(colours=6, tolerance=0.6),
    "poster": Options(colours=32, tolerance=0.5),
    "clean": Options(colours=16, tolerance=0.4),
    "photo": Options(colours=48),
    "detailed": Options(colours=48, tolerance=0.3),
}


def _attrs(key: int) -> str:
    r, g, b, a = key >> 24 & 255, key >> 16 & 255, key >> 8 & 255, key & 255
    text = f"#{r:02x}{g:02x}{b:02x}"
    if all(c % 17 == 0 for c in (r, g, b)):
        text = f"#{r // 17:x}{g // 17:x}{b // 17:x}"
    return f' fill="{text}"' + (f' fill-opacity="{number(a / 255, 3)}"' if a < 255 else "")


def _document(w: int, h: int, body: list[str], crisp: bool) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}"' + (' shape-rendering="crispEdges"' if crisp else "") + f">{''.join(body)}</svg>"


def _background(w: int, h: int, key: int) -> str:
    return f'<path d="M0 0h{w}v{h}h-{w}z"{_attrs(key)}/>'


def by_rectangles(p: Planes) -> tuple[str, int]:
    """(document, shapes) of a mesh: a path a colour, large ones first; the most frequent colour of an opaque image is one rectangle below."""
    k = keys_of(p)
    h, w = k.shape
    rects = mesh(k, 0)
    area: dict[int, int] = {}
    for _, _, a, b, key in rects:
        area[key] = area.get(key, 0) + a * b
    ground = max(area, key=lambda c: area[c]) if len(area) > 1 and bool((p["a"] == 255).all()) else 0
    body = [_background(w, h, ground)] if ground else []
    for key in sorted((c for c in area if c != ground), key=lambda c: (-area[c], c)):
        d = "".join(f"M{x} {y}h{a}v{b}h-{a}z" for x, y, a, b, c in rects if c == key)
        body.append(f'<path d="{d}"{_attrs(key)}/>')
    return _document(w, h, body, True), len(body)


def by_contours(p: Planes) -> tuple[str, int]:
    """The same pixels by the boundary loops of their components."""
    k = keys_of(p)
    h, w = k.shape
    lab = label(k, 0)
    if lab.max() + 1 > MAX_REGIONS:
        raise TooMuch(f"more than {MAX_REGIONS} regions: a photograph is no case for exact geometry")
    loops: dict[int, list[str]] = {}
    key_of = {int(c): int(v) for c, v in zip(lab[lab >= 0], k[lab >= 0])}
    values, counts = np.unique(k[k != 0], return_counts=True)
    area = dict(zip(values.tolist(), counts.tolist()))
    for c, pts, _ in contours(lab):
        q = pts.tolist()
        d, (x, y) = f"M{q[0][0]} {q[0][1]}", q[0]
        for i, j in q[1:]:
            d += f"h{i - x}" if j == y else f"v{j - y}"
            x, y = i, j
        loops.setdefault(key_of[c], []).append(d + "z")
    ground = max(area, key=lambda c: area[c]) if len(area) > 1 and bool((p["a"] > 0).all()) else 0
    body = [_background(w, h, ground)] if ground else []
    for key in sorted((c for c in area if c != ground), key=lambda c: (-area[c], c)):
        body.append(f'<path fill-rule="evenodd" d="{"".join(loops[key])}"{_attrs(key)}/>')
    return _document(w, h, body, True), len(body)


def classes_of(p: Planes, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Class of each pixel (-1: alpha below 8) and the palette."""
    ink = p["a"] >= 8
    c = np.stack([p[k][ink] for k in "rgb"], 1).astype(np.int64)
    if not len(c):
        return np.full(p["r"].shape, -1, np.int64), np.zeros((0, 3), np.int64)
    if o.palette:
        pal = np.array(o.palette, np.int64)
    else:
        rb, inv = np.unique(c >> 3, axis=0, return_inverse=True)
        n = np.bincount(inv.ravel())
        sums = np.stack([np.bincount(inv.ravel(), c[:, i]) for i in range(3)], 1)
        pal = palette_of(rb, n.astype(float), sums.astype(float), np.bincount(inv.ravel(), (c * c).sum(1)).astype(float), o.colours, o.refine)
    colours, inv = np.unique(c, axis=0, return_inverse=True)
    lab, plab = _oklab(*colours.T), _oklab(*pal.T)
    near = ((lab[:, None] - plab[None]) ** 2).sum(-1).argmin(1)
    out = np.full(p["r"].shape, -1, np.int64)
    out[ink] = near[inv.ravel()]
    return out, pal


def traced(p: Planes, o: Options) -> tuple[str, dict]:
    """(document, counts): palette, classes, specks absorbed, then each class's loops as primitives or fitted paths, large classes first."""
    h, w = p["r"].shape
    cls, pal = classes_of(p, o)
    merged = 0
    least = o.min_area or max(2, min(16, math.floor(h * w / 50_000 + 0.5)))
    for _ in range(2):
        cls, m = despeckled(cls, least)
        merged += m
    lab = label(cls)
    regions = int(lab.max()) + 1
    owner = {int(a): int(b) for a, b in zip(lab[lab >= 0], cls[lab >= 0])}
    paths: dict[int, list[str]] = {}
    shapes: dict[int, list[str]] = {}
    ls = contours(lab, o.policy)
    holes = {c for c, _, a in ls if a < 0}
    px = _stacked(p) if _refines(p, o) else None
    paints = _paints(p, lab) if o.gradients else {}
    nodes = 0
    for c, pts, _ in ls:
        k = owner[c]
        to = k if c not in paints else -1 - c
        prim = (detect_primitive(pts, o.primitive_error) or detect_sector(pts, o.primitive_error)) if o.primitives and c not in holes else None
        if prim:
            nodes += 4
            shapes.setdefault(to, []).append(primitive_text(prim, o.precision))
            continue
        q = pts if px is None else refined(dense(pts), px, cls, k)[0]
        seg = fit_loop(q, o.tolerance, o.fit_error, o.corner)
        nodes += len(seg)
        if seg:
            paths.setdefault(to, []).append(path_text(seg, o.precision))
    area = np.bincount(cls[cls >= 0], minlength=len(pal))
    body = []
    ground = int(np.argmax(area)) if len(area) and (cls >= 0).all() else -1
    if ground >= 0:
        body.append(_background(w, h, _key(pal[ground])))
    for k in sorted((i for i in range(len(pal)) if area[i] and i != ground), key=lambda i: (-area[i], i)):
        a = _attrs(_key(pal[k]))
        if k in paths:
            body.append(f'<path fill-rule="evenodd" d="{"".join(paths[k])}"{a}/>')
        body += [s.replace("/>", f"{a}/>") for s in shapes.get(k, [])]
    for c, paint in paints.items():
        a = f' fill="url(#g{c})"'
        body += [f'<path fill-rule="evenodd" d="{"".join(paths[-1 - c])}"{a}/>'] if -1 - c in paths else []
        body += [s.replace("/>", f"{a}/>") for s in shapes.get(-1 - c, [])]
    if paints:
        body.insert(0, "<defs>" + "".join(definition(g, f"g{c}", o.precision) for c, g in paints.items()) + "</defs>")
    return _document(w, h, body, False), {"shapes": len(body), "colours": int((area > 0).sum()), "regions": regions, "despeckled": merged, "nodes": nodes}


def _paints(p: Planes, lab: np.ndarray) -> dict[int, dict]:
    """The gradients of components, by component."""
    rgb = _stacked(p).reshape(-1, 4)[:, :3].astype(np.int64)
    ids, w = lab.ravel(), lab.shape[1]
    order = np.argsort(ids, kind="stable")
    found = {int(ids[own[0]]): paint_of(own % w + 0.5, own // w + 0.5, rgb[own]) for own in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(own) and ids[own[0]] >= 0}
    return {c: g for c, g in found.items() if g}


def _stacked(p: Planes) -> np.ndarray:
    return np.stack([p[c] for c in "rgba"], -1)


def _refines(p: Planes, o: Options) -> bool:
    return noise_of(_stacked(p)) <= NOISE_LIMIT if o.subpixel is None else o.subpixel


def mosaic(p: Planes, o: Options) -> tuple[str, int]:
    """(document, paths) without gaps or overlaps: classes as in traced(), but every boundary is one curve that both of its sides use."""
    h, w = p["r"].shape
    cls, pal = classes_of(p, o)
    cls, _ = despeckled(cls, o.min_area or max(2, min(16, math.floor(h * w / 50_000 + 0.5))))
    lab = label(cls)
    owner = {int(a): int(b) for a, b in zip(lab[lab >= 0], cls[lab >= 0])}
    paths: dict[int, list[list[tuple]]] = {}
    for comp, _, segments in face_curves(lab, o.tolerance, o.fit_error, o.corner, _stacked(p) if _refines(p, o) else None):
        paths.setdefault(owner[comp], []).append(segments)
    area = np.bincount(cls[cls >= 0], minlength=len(pal))
    body = [f'<path fill-rule="evenodd" d="{compact_path(paths[k], o.precision)}"{_attrs(_key(pal[k]))}/>' for k in sorted(paths, key=lambda i: (-area[i], i))]
    return _document(w, h, body, False), len(body)


def _key(rgb: np.ndarray) -> int:
    r, g, b = (int(v) for v in rgb)
    return r << 24 | g << 16 | b << 8 | 255


def primitive_text(p: dict, precision: int = 2) -> str:
    n = lambda k: number(p[k], precision)
    if p["kind"] == "circle":
        return f'<circle cx="{n("cx")}" cy="{n("cy")}" r="{n("r")}"/>'
    if p["kind"] == "ellipse":
        return f'<ellipse cx="{n("cx")}" cy="{n("cy")}" rx="{n("rx")}" ry="{n("ry")}"/>'
    if p["kind"] == "sector":
        ends = [tuple(number(v, precision) for v in (p["cx"] + p["r"] * math.cos(a), p["cy"] + p["r"] * math.sin(a))) for a in (p["from"], p["from"] + p["sweep"])]
        return f'<path d="M{n("cx")} {n("cy")}L{" ".join(ends[0])}A{n("r")} {n("r")} 0 {int(p["sweep"] > math.pi)} 1 {" ".join(ends[1])}Z"/>'
    rx = f' rx="{n("r")}"' if p["kind"] == "roundrect" else ""
    return f'<rect x="{n("x")}" y="{n("y")}" width="{n("w")}" height="{n("h")}"{rx}/>'


def choose_mode(flat: DataFrame) -> DataFrame:
    """mode of each image from flatness(): 'pixel' where exact geometry folds pixels (no cap hit, at most 600,000 runs, and few runs or 64 colours at most), else 'trace'."""
    few = F.col("run_ratio") * F.col("pixels") <= 600_000
    exact = ~F.col("capped") & few & ((F.col("run_ratio") <= 0.12) | (F.col("colours") <= 64))
    return flat.withColumn("mode", F.when(exact, "pixel").otherwise("trace"))


def refine_gate(noise: Column, limit: float = NOISE_LIMIT) -> Column:
    """Whether sub-pixel refinement may run: images with interior noise are better without."""
    return noise <= limit


def auto_options(flat: DataFrame, limit: float = NOISE_LIMIT) -> DataFrame:
    """img_id, colours, gradients, subpixel, lattice of tracing without a preset, from flatness(): 48 colours and gradients for photographs (the colour count hit its cap), 32 above 64 colours, else 16; outlines are neither refined nor straightened where the interior is noisy. Noise counts to six places, so an image at the limit isn't decided by the rounding errors of its mean."""
    colours = F.when(F.col("capped"), 48).when(F.col("colours") > 64, 32).otherwise(16)
    clear = refine_gate(F.round("noise", 6), limit)
    return flat.select("img_id", colours.alias("colours"), F.col("capped").alias("gradients"), clear.alias("subpixel"), clear.alias("lattice"))


def dominated(traces: DataFrame, exact: DataFrame, sources: DataFrame, ratio: float = 4.0) -> DataFrame:
    """img_id, switch, strategy: whether an exact copy replaces a trace (img_id, svg): where the trace has no curve, is larger than its source file (img_id, bytes), and is more than `ratio` times as large, gzipped, as an exact candidate (img_id, strategy, gzip_bytes, exact: lossless_candidates). The smallest such candidate is taken."""

    @F.arrow_udf("int")
    def zipped(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(gzip.compress(t.encode(), mtime=0)) for t in texts.to_pylist()], pa.int32())

    drawn = F.regexp_extract_all("svg", F.lit(r'\sd="([^"]*)"'), F.lit(1))
    t = traces.select("img_id", F.octet_length("svg").alias("size"), zipped(F.col("svg")).alias("zip"), F.exists(drawn, lambda d: d.rlike("[CcSsQqTtAa]")).alias("curves"))
    t = t.join(sources.select("img_id", F.col("bytes").alias("source")), "img_id", "left")
    c = exact.filter("exact").select("img_id", "strategy", "gzip_bytes")
    better = t.join(c, "img_id").filter(~F.col("curves") & (F.col("size") > F.col("source")) & (F.col("gzip_bytes") * ratio < F.col("zip")))
    best = better.groupBy("img_id").agg(F.min_by("strategy", F.struct("gzip_bytes", "strategy")).alias("strategy"))
    return t.select("img_id").join(best, "img_id", "left").select("img_id", F.col("strategy").isNotNull().alias("switch"), "strategy")


SCHEMA = "mode string, svg string, bytes int, shapes int, error string"


def vectorize(px: DataFrame, mode: str = "auto", preset: str | None = None, options: Options | None = None) -> DataFrame:
    """img_id, mode, svg, bytes, shapes, error: every image as a document (null, with an error, where exact geometry would take more shapes than MAX_RECTS or MAX_REGIONS). auto measures each image first; 'pixel' and 'exact' are lossless (exact takes the smaller of rectangles and contours), 'trace' approximates, and so does 'mosaic', whose neighbouring shapes share their curves. A named preset means trace."""
    o = options or PRESETS.get(preset or "", Options())
    if preset and preset not in PRESETS:
        raise ValueError(f"no preset {preset}")

    def trace(p: Planes) -> tuple[str, int]:
        svg, counts = traced(p, o)
        return svg, counts["shapes"]

    make = {"pixel": by_rectangles, "exact": lambda p: min((by_rectangles(p), by_contours(p)), key=lambda t: len(t[0])), "mosaic": lambda p: mosaic(p, o), "trace": trace}
    if mode != "auto" and mode not in make:
        raise ValueError(f"no mode {mode}")

    def run(w: int, h: int, p: Planes) -> dict:
        m = "trace" if preset and mode == "auto" else mode
        if m == "auto":
            k = keys_of(p)
            n = len(np.unique(k))
            runs = int((k[:, 1:] != k[:, :-1]).sum()) + h
            m = "pixel" if n <= 4096 and runs <= 600_000 and (runs / (w * h) <= 0.12 or n <= 64) else "trace"
        try:
            svg, shapes = make[m](p)
        except TooMuch as e:
            return {"mode": [m], "svg": [None], "bytes": [None], "shapes": [None], "error": [str(e)]}
        return {"mode": [m], "svg": [svg], "bytes": [len(svg.encode())], "shapes": [shapes], "error": [None]}

    return per_image(px, run, SCHEMA, RGBA)


def separations(px: DataFrame, options: Options | None = None) -> DataFrame:
    """img_id, class, area, svg: one document for each colour of a traced image."""
    o = options or Options()

    def run(w: int, h: int, p: Planes) -> dict:
        cls, pal = classes_of(p, o)
        out = []
        for k in range(len(pal)):
            mask = np.where(cls == k, 0, -1)
            n = int((mask == 0).sum())
            if n:
                d = "".join(path_text(fit_loop(q, o.tolerance, o.fit_error, o.corner), o.precision) for _, q, _ in contours(label(mask)))
                out.append((k, n, _document(w, h, [f'<path fill-rule="evenodd" d="{d}"{_attrs(_key(pal[k]))}/>'], False)))
        return {"class": [r[0] for r in out], "area": [r[1] for r in out], "svg": [r[2] for r in out]}

    return per_image(px, run, "class int, area int, svg string", RGBA)


def within_budget(px: DataFrame, max_bytes: int, options: Options | None = None, steps: int = 8) -> DataFrame:
    """img_id, strength, svg, bytes, met: tracing relaxed just enough to fit a size, by bisection on the strength in [0, 1] for each image."""
    from rasterloom.functions.scalar import relaxed

    o = options or Options()
    base = {"tolerance": o.tolerance, "fit_error": o.fit_error, "precision": o.precision, "min_area": o.min_area, "colours": o.colours}

    def at(p: Planes, t: float) -> str:
        return traced(p, replace(o, **relaxed(t, base)))[0]

    def run(w: int, h: int, p: Planes) -> dict:
        best, low, high = (0.0, at(p, 0.0)), 0.0, 1.0
        if len(best[1].encode()) > max_bytes:
            best = (1.0, at(p, 1.0))
            for _ in range(steps):
                if len(best[1].encode()) > max_bytes:
                    break
                mid = (low + high) / 2
                s = at(p, mid)
                if len(s.encode()) <= max_bytes:
                    best, high = (mid, s), mid
                else:
                    low = mid
        n = len(best[1].encode())
        return {"strength": [best[0]], "svg": [best[1]], "bytes": [n], "met": [n <= max_bytes]}

    return per_image(px, run, "strength double, svg string, bytes int, met boolean", RGBA)


def lossless_candidates(px: DataFrame) -> DataFrame:
    """img_id, strategy, bytes, gzip_bytes, exact: rectangles, contours and an embedded PNG, each rendered again and compared."""
    from rasterloom.sources.codecs import encode_png

    def run(w: int, h: int, p: Planes) -> dict:
        import base64

        k = keys_of(p)
        rows = []
        for name, make in (("rectangles", by_rectangles), ("contours", by_contours)):
            try:
                svg, _ = make(p)
            except TooMuch:  # the other candidates remain
                continue
            rows.append((name, svg, bool((rendered(svg, w, h) == k).all())))
        png = encode_png(np.stack([p[c] for c in "rgba"], -1).astype(np.uint8))
        rows.append(("embed", f'<svg xmlns="http://www.w3.org/2000/svg"><image href="data:image/png;base64,{base64.b64encode(png).decode()}"/></svg>', True))
        return {"strategy": [r[0] for r in rows], "bytes": [len(r[1]) for r in rows], "gzip_bytes": [len(gzip.compress(r[1].encode(), mtime=0)) for r in rows], "exact": [r[2] for r in rows]}

    return per_image(px, run, "strategy string, bytes int, gzip_bytes int, exact boolean", RGBA)


def choose_lossless(candidates: DataFrame, prefer: str = "contours", ratio: float = 1.0) -> DataFrame:
    """The smallest exact candidate of each image; one of the preferred strategy may be `ratio` times as large."""
    cost = F.col("bytes") / F.when(F.col("strategy") == prefer, F.lit(ratio)).otherwise(1.0)
    return candidates.filter("exact").groupBy("img_id").agg(F.min_by(F.struct("strategy", "bytes"), F.struct(cost.alias("c"), "strategy")).alias("m")).select("img_id", "m.*")


def rendered(svg: str, w: int, h: int) -> np.ndarray:
    """Colour keys of a document of lattice paths (M, h, v, z, even-odd), painted in order: enough to verify what by_rectangles and by_contours write."""
    import re

    out = np.zeros((h, w), np.int64)
    for tag in re.findall(r"<path [^>]*/>", svg):
        d, fill = re.search(r' d="([^"]*)"', tag)[1], re.search(r'fill="#([0-9a-f]+)"', tag)[1]
        alpha = re.search(r'fill-opacity="([^"]*)"', tag)
        fill = "".join(c * 2 for c in fill) if len(fill) == 3 else fill
        key = int(fill, 16) << 8 | (int(float(alpha[1]) * 255 + 0.5) if alpha else 255)
        cross = np.zeros((h, w + 1), np.int64)
        x = y = x0 = y0 = 0
        for op, nums in re.findall(r"([MmhvzZ])([^MmhvzZ]*)", d):
            v = [int(n) for n in re.findall(r"-?\d+", nums)]
            if op == "M":
                x, y = x0, y0 = v
            elif op == "h":
                x += v[0]
            elif op == "v":
                cross[min(y, y + v[0]) : max(y, y + v[0]), x] += 1
                y += v[0]
            else:
                if y != y0:
                    cross[min(y, y0) : max(y, y0), x0] += 1
                x, y = x0, y0
        out[np.cumsum(cross, 1)[:, :w] % 2 == 1] = key
    return out
