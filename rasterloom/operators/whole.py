"""Operators on whole images in a binary column (img_id, width, height, data: RGBA bytes, as sources.rasters decodes them): one row an image, no pixel rows and no shuffle but a pair's join. Their results are those of the pixel relation's operators, which stay for images that no task can hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.colour import gaussian
from rasterloom.operators import fullref
from rasterloom.operators.compare import composite
from rasterloom.operators.regions import label
from rasterloom.session import ensure_importable

Result = dict[str, list | np.ndarray]


def per_raster(rasters: DataFrame, fn: Callable[..., Result], schema: str, data: tuple[str, ...] = ("data",)) -> DataFrame:
    """img_id and what fn returns for each row: columns of equal length in the order of schema (without img_id). fn gets an array (height, width, 4) for each of the data columns. Rows without data, width or height give nothing."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    ensure_importable(rasters.sparkSession)
    full = f"img_id {rasters.schema['img_id'].dataType.simpleString()}, {schema}"
    arrow = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(full)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w, h, *raw = (b.column(c)[i].as_py() for c in ("width", "height", *data))
                if None in (w, h, *raw):
                    continue
                out = fn(*[np.frombuffer(x, np.uint8).reshape(h, w, 4) for x in raw])
                n = len(next(iter(out.values())))
                if n:
                    yield pa.RecordBatch.from_arrays([b.column("img_id").take(pa.array(np.full(n, i))), *[pa.array(v, arrow[k]) for k, v in out.items()]], ["img_id", *out])

    return rasters.select("img_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *data).mapInArrow(run, full)


def keys(p: np.ndarray) -> np.ndarray:
    """The colour key of every pixel; all transparent ones are 0."""
    v = np.ascontiguousarray(p).view(">u4")[..., 0].astype(np.uint32)
    return np.where(p[..., 3] == 0, np.uint32(0), v)


def counted(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs; by the high half first, so that only pixels of one such are sorted together."""
    s = np.sort(k, axis=None, kind="stable")
    at = np.flatnonzero(np.concatenate((np.ones(min(1, s.size), bool), s[1:] != s[:-1])))
    return s[at].astype(np.int64), np.diff(np.append(at, s.size))


def colour_histogram(rasters: DataFrame) -> DataFrame:
    """img_id, key, n, as histogram.colour_histogram."""

    def run(p: np.ndarray) -> Result:
        key, n = counted(keys(p))
        return {"key": key, "n": n}

    return per_raster(rasters, run, "key long, n long")


def luma709(p: np.ndarray) -> np.ndarray:
    return 0.2126 * p[..., 0] + 0.7152 * p[..., 1] + 0.0722 * p[..., 2]


def otsu_of(hist: np.ndarray) -> int:
    """Otsu's threshold of 256 counts; the lowest of equal ones, 128 without a split."""
    t = np.arange(256)
    wb, sb = np.cumsum(hist), np.cumsum(hist * t)
    wf = wb[-1] - wb
    ok = (hist > 0) & (wf > 0)
    if not ok.any():
        return 128
    with np.errstate(divide="ignore", invalid="ignore"):
        diff = sb / wb - (sb[-1] - sb) / wf
        v = np.where(ok, wb.astype(float) * wf * diff * diff, -1.0)
    return int(v.argmax())


def otsu(rasters: DataFrame) -> DataFrame:
    """img_id, threshold, as histogram.otsu."""

    def run(p: np.ndarray) -> Result:
        t = np.floor(luma709(p) + 0.5).astype(np.int64)
        return {"threshold": [otsu_of(np.bincount(t[p[..., 3] >= 128], minlength=256))]}

    return per_raster(rasters, run, "threshold int")


def noise_of(p: np.ndarray) -> float:
    """Mean distance of a pixel's luminance from its 3x3 mean, over inner pixels on no edge."""
    v = p.astype(np.float64)
    lum = (v[..., 0] + v[..., 1] + v[..., 2]) / 3.0 * (v[..., 3] / 255.0)
    if min(lum.shape) < 3:
        return 0.0
    flat = np.hypot(lum[1:-1, 2:] - lum[1:-1, :-2], lum[2:, 1:-1] - lum[:-2, 1:-1]) <= 24
    rows = lum[:, :-2] + lum[:, 1:-1] + lum[:, 2:]
    far = np.abs(lum[1:-1, 1:-1] - (rows[:-2] + rows[1:-1] + rows[2:]) / 9)[flat]
    return float(far.mean()) if far.size else 0.0


def flatness(rasters: DataFrame, cap: int = 4096) -> DataFrame:
    """img_id, colours, capped, run_ratio, pixels, noise, as histogram.flatness."""

    def run(p: np.ndarray) -> Result:
        k = keys(p)
        n = len(counted(k)[0])
        starts = p.shape[0] + int((k[:, 1:] != k[:, :-1]).sum()) if k.size else 0
        return {"colours": [min(n, cap + 1)], "capped": [n > cap], "run_ratio": [starts / k.size], "pixels": [k.size], "noise": [noise_of(p)]}

    return per_raster(rasters, run, "colours long, capped boolean, run_ratio double, pixels long, noise double")


def _along(v: np.ndarray, kernel: list[float], axis: int) -> np.ndarray:
    half = len(kernel) // 2
    padded = np.pad(v, [(half, half) if k == axis else (0, 0) for k in range(v.ndim)], mode="edge")
    n = v.shape[axis]
    return sum(w * np.take(padded, range(i, i + n), axis) if axis else w * padded[i : i + n] for i, w in enumerate(kernel))


def selective_blur(rasters: DataFrame, radius: int, delta: int = 20) -> DataFrame:
    """img_id, width, height, data, as stencil.selective_blur."""
    kernel = gaussian(radius, radius / 3 if radius else 1.0)

    def run(p: np.ndarray) -> Result:
        soft = np.ascontiguousarray(p.transpose(2, 0, 1)).astype(np.float64)
        soft = np.ascontiguousarray(_along(soft.transpose(2, 0, 1), kernel, 0).transpose(1, 2, 0))  # along x
        soft = _along(np.ascontiguousarray(soft.transpose(1, 0, 2)), kernel, 0)  # along y: (y, channel, x)
        soft = soft.transpose(0, 2, 1)
        far = (np.abs(soft - p).max(-1) > delta)[..., None]
        out = np.where(far, p, np.floor(np.round(soft, 9) + 0.5).astype(np.uint8))
        return {"width": [p.shape[1]], "height": [p.shape[0]], "data": [out.tobytes()]}

    return per_raster(rasters, run, "width int, height int, data binary")


def components(rasters: DataFrame, classes: Callable[[np.ndarray], np.ndarray], void: int = -1) -> DataFrame:
    """img_id, comp, class, area and bounds of the 4-connected components of equal class, as regions.components. classes: from pixels to an integer array; void belongs to none."""

    def run(p: np.ndarray) -> Result:
        c = np.asarray(classes(p)).astype(np.int64)
        ids = label(c, void)
        y, x = np.nonzero(ids >= 0)
        own = ids[y, x]
        m = int(own.max()) + 1 if len(own) else 0
        low = lambda v: np.minimum.reduceat(v[by], start) if m else v[:0]
        high = lambda v: np.maximum.reduceat(v[by], start) if m else v[:0]
        by = np.argsort(own, kind="stable")
        start = np.searchsorted(own[by], np.arange(m))
        return {"comp": np.arange(m), "class": low(c[y, x]), "area": np.bincount(own, minlength=m), "x0": low(x), "y0": low(y), "x1": high(x), "y1": high(y)}

    return per_raster(rasters, run, "comp int, class int, area long, x0 int, y0 int, x1 int, y1 int")


def pairs(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """img_id, width, height, p, q: the data of both sides of every image that both have in one size."""
    q = candidate.select("img_id", F.col("width").alias("qw"), F.col("height").alias("qh"), F.col("data").alias("q"))
    both = reference.withColumnRenamed("data", "p").join(q, "img_id").filter("width = qw and height = qh")
    return both.select("img_id", "width", "height", "p", "q")


def report(both: DataFrame) -> DataFrame:
    """The comparison report of pairs, as compare.report."""

    def run(p: np.ndarray, q: np.ndarray) -> Result:
        return fullref.figures({f"{s}_{c}": v[..., k] for s, v in (("p", p), ("q", q)) for k, c in enumerate("rgba")})

    out = per_raster(both, run, fullref._SCHEMA, ("p", "q"))
    return out.withColumn("composite", F.when(F.col("lossless"), 1.0).otherwise(composite(F.col("psnr"), F.col("ssim"), F.col("score"))))


def flattened(p: np.ndarray, background: int = 255) -> np.ndarray:
    """RGB over an opaque background."""
    if (p[..., 3] == 255).all():
        return p[..., :3].astype(np.int64)
    f = p[..., 3:] / 255
    return np.floor(p[..., :3] * f + background * (1 - f) + 0.5).astype(np.int64)


def heat_of(p: np.ndarray, q: np.ndarray, threshold: float = 2.0, keep: float = 0.1, colour: tuple[int, int, int] = (255, 40, 40)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CIEDE2000, whether it is a change, and the difference image."""
    fp, fq = flattened(p), flattened(q)
    de = np.zeros(fp.shape[:2])
    differ = (fp != fq).any(-1)
    if differ.any():
        de[differ] = fullref.delta_e2000(fullref.lab(fp[differ]), fullref.lab(fq[differ]))
    changed = np.maximum(de, np.abs(p[..., 3].astype(int) - q[..., 3]) / 255.0 * 100) > threshold
    gray = np.floor(255 * (1 - keep) + luma709(fp) * keep + 0.5)[..., None]
    return de, changed, np.where(changed[..., None], np.array(colour), gray).astype(np.uint8)


def heat_map(both: DataFrame, threshold: float = 2.0) -> DataFrame:
    """img_id, changed, n, fraction, de_max, de_mean, as compare.heat_summary, and the difference image (width, height, data; opaque), as compare.heat_map."""

    def run(p: np.ndarray, q: np.ndarray) -> Result:
        de, changed, image = heat_of(p, q, threshold)
        n = int(changed.sum())
        opaque = np.concatenate([image, np.full((*image.shape[:2], 1), 255, np.uint8)], -1)
        return {"changed": [n], "n": [de.size], "fraction": [n / de.size], "de_max": [de.max()], "de_mean": [de.mean()], "width": [p.shape[1]], "height": [p.shape[0]], "data": [opaque.tobytes()]}

    return per_raster(both, run, "changed long, n long, fraction double, de_max double, de_mean double, width int, height int, data binary", ("p", "q"))


#: Ringing: pixels walked to flat colour, the squared step below which it is flat, the least squared contrast of the two sides, how far from their line a spike may lie, the least squared overshoot, how different the channels of a gray are, and by what share of the contrast grays may overshoot before they are a line of their own.
WALK, FLAT, SIDES, ASIDE, OVERSHOOT, GRAY, LINE = 6, 16, 3000, 300, 500, 2, 0.5


def despiked(p: np.ndarray) -> np.ndarray:
    """An image whose ringing is clipped: a pixel between two flat colours (along a row, column or diagonal) that overshoots one of them, on the line through both in premultiplied RGBA, becomes that one; of several directions the largest overshoot counts. Pixels like all their neighbours stay, and so do overshoots of gray lines between grays."""
    h, w = p.shape[:2]
    if min(h, w) < 3:
        return p.copy()
    m = WALK + 2
    v = p.astype(float)
    v[..., :3] *= v[..., 3:] / 255
    wide = np.pad(v, ((m, m), (m, m), (0, 0)), constant_values=np.nan)
    tone = np.pad((np.ptp(p[..., :3].astype(int), axis=-1) <= GRAY), m)
    raw = np.pad(p.astype(np.int16), ((1, 1), (1, 1), (0, 0)), constant_values=-1)
    at = lambda a, dx, dy, r=m: a[r + dy : r + dy + h, r + dx : r + dx + w]
    alike = np.ones((h, w), bool)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            q = at(raw, dx, dy, 1)
            alike &= (q == p).all(-1) | (q[..., 3] < 0)

    def plateau(dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of three like colours in a row along a direction (nan without), and whether it is gray."""
        steps = [at(wide, dx * k, dy * k) for k in range(1, m + 1)]
        still = [((a - b) ** 2).sum(-1) <= FLAT for a, b in zip(steps, steps[1:])]
        out, gray = np.full((h, w, 4), np.nan), np.zeros((h, w), bool)
        for k in range(m - 3, -1, -1):
            ok = still[k] & still[k + 1]
            out[ok], gray[ok] = steps[k][ok], at(tone, dx * (k + 1), dy * (k + 1))[ok]
        return out, gray

    best, new = np.zeros((h, w)), v.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
            (a, ga), (b, gb) = plateau(-dx, -dy), plateau(dx, dy)
            ab = b - a
            n2 = (ab * ab).sum(-1)
            t = ((v - a) * ab).sum(-1) / n2
            aside = ((v - a - t[..., None] * ab) ** 2).sum(-1)
            over = np.where(t < 0, t * t, (t - 1) ** 2) * n2
            lines = ga & gb & at(tone, 0, 0) & (over > LINE * n2)
            hit = ~alike & (n2 >= SIDES) & ((t < 0) | (t > 1)) & (aside <= ASIDE) & (over >= OVERSHOOT) & ~lines & (over > best)
            best = np.where(hit, over, best)
            new = np.where(hit[..., None], np.where((t < 0)[..., None], a, b), new)
    out, hit = p.copy(), best > 0
    alpha = new[hit][:, 3:]
    colour = np.where(alpha > 0, new[hit][:, :3] * 255 / np.where(alpha > 0, alpha, 1), 0)
    out[hit] = np.clip(np.rint(np.concatenate([colour, alpha], 1)), 0, 255).astype(np.uint8)
    return out


def despike(rasters: DataFrame) -> DataFrame:
    """img_id, width, height, data, despiked(); touched: pixels that changed."""

    def run(p: np.ndarray) -> Result:
        out = despiked(p)
        return {"width": [p.shape[1]], "height": [p.shape[0]], "data": [out.tobytes()], "touched": [int((out != p).any(-1).sum())]}

    return per_raster(rasters, run, "width int, height int, data binary, touched long")
