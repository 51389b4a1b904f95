"""The comparison report with each pair of images in one task: the same figures as compare.report, for images that fit into a worker. One join and one shuffle, whatever the figures; compare.report stays for images that don't fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.colour import gaussian
from rasterloom.operators.compare import C1, C2, composite, pairs, window_for
from rasterloom.operators.images import Planes, per_image
from rasterloom.operators.regions import label

_M = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.072175], [0.0193339, 0.119192, 0.9503041]])
_LIN = np.array([c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in np.arange(256) / 255])


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIELAB of integer sRGB (..., 3)."""
    t = _LIN[rgb] @ _M.T / np.array([0.95047, 1.0, 1.08883])
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def delta_e2000(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """CIEDE2000 of CIELAB arrays (..., 3)."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(p, -1, 0), np.moveaxis(q, -1, 0)
    c7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 1 + 0.5 * (1 - np.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = a1 * g, a2 * g
    k1, k2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    gray = k1 * k2 == 0
    d, s = h2 - h1, h1 + h2
    dh = np.where(gray, 0, np.where(np.abs(d) <= 180, d, np.where(d > 180, d - 360, d + 360)))
    hm = np.where(gray, s, np.where(np.abs(d) <= 180, s / 2, np.where(s < 360, (s + 360) / 2, (s - 360) / 2)))
    cos = lambda x: np.cos(np.radians(x))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.2 * cos(4 * hm - 63)
    lm, cm = (l1 + l2) / 2, (k1 + k2) / 2
    off = (lm - 50) ** 2
    x = (l2 - l1) / (1 + 0.015 * off / np.sqrt(20 + off))
    y = (k2 - k1) / (1 + 0.045 * cm)
    z = 2 * np.sqrt(k1 * k2) * np.sin(np.radians(dh / 2)) / (1 + 0.015 * cm * t)
    rt = -np.sin(np.radians(60 * np.exp(-(((hm - 275) / 25) ** 2)))) * 2 * np.sqrt(cm**7 / (cm**7 + 25.0**7))
    return np.sqrt(np.maximum(x * x + y * y + z * z + rt * y * z, 0))


def _valid(a: np.ndarray, k: list[float]) -> np.ndarray:
    """A separable convolution where all taps exist."""
    n = len(k) - 1
    a = sum(w * a[:, i : a.shape[1] - n + i] for i, w in enumerate(k))
    return sum(w * a[i : a.shape[0] - n + i] for i, w in enumerate(k))


def ssim(x: np.ndarray, y: np.ndarray) -> float:
    h, w = x.shape
    if min(h, w) < 3:
        return float((x == y).all())
    k = gaussian(window_for(w, h) // 2, 1.5)
    x, y = x.astype(float), y.astype(float)
    mx, my, xx, yy, xy = (_valid(v, k) for v in (x, y, x * x, y * y, x * y))
    return float(((2 * mx * my + C1) * (2 * (xy - mx * my) + C2) / ((mx * mx + my * my + C1) * ((xx - mx * mx) + (yy - my * my) + C2))).mean())


def _coherence(de: np.ndarray, threshold: float = 2.0, neighbours: int = 4) -> tuple[int, int, int, int, float]:
    bad = de > threshold
    p = np.pad(bad.astype(np.int8), 1)
    h, w = bad.shape
    around = sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)) - bad
    kept = bad & (around >= neighbours)
    if not kept.any():
        return int(bad.sum()), 0, 0, 0, 0.0
    lab_ = label(np.where(kept, 1, -1))
    area = np.bincount(lab_[lab_ >= 0])
    return int(bad.sum()), int(kept.sum()), len(area), int(area.max()), min(1.0, float(np.sqrt((area.astype(float) ** 2).sum())) / de.size)


def figures(p: Planes) -> dict[str, list]:
    """One row of figures of a pair: channels p_* and q_*."""
    a, b = (np.stack([p[f"{s}_{c}"] for c in "rgba"], -1).astype(np.int64) for s in "pq")

    def premultiplied(v: np.ndarray) -> np.ndarray:
        alpha = v[..., 3:]
        return np.concatenate([np.where(alpha == 255, v[..., :3], np.floor(v[..., :3] * alpha / 255 + 0.5).astype(np.int64)), alpha], -1)

    def flat(v: np.ndarray) -> np.ndarray:
        f = v[..., 3:] / 255
        return np.floor(v[..., :3] * f + 255 * (1 - f) + 0.5).astype(np.int64)

    x, y = premultiplied(a), premultiplied(b)
    d = np.abs(x - y)
    n, exact, sq = d.shape[0] * d.shape[1], int((d.max(-1) == 0).sum()), int((d * d).sum())
    mse = sq / (4 * n)
    lossless = exact == n
    fa, fb = flat(a), flat(b)
    de = np.zeros(fa.shape[:2])
    differ = (fa != fb).any(-1)
    if differ.any():
        de[differ] = delta_e2000(lab(fa[differ]), lab(fb[differ]))
    bins = np.bincount(np.minimum(10000, np.floor(de * 100 + 0.5).astype(np.int64)).ravel())
    p95 = int(np.searchsorted(np.cumsum(bins), np.ceil(n * 0.95))) / 100
    differing, coherent, clusters, largest, mass = _coherence(de)
    if lossless:
        all_, luma = 1.0, 1.0
    else:
        s = [ssim(x[..., c], y[..., c]) for c in range(3)]
        ca, cb = x[..., 3].min() == x[..., 3].max(), y[..., 3].min() == y[..., 3].max()
        if not ca or (cb and x[0, 0, 3] != y[0, 0, 3]):
            s.append(ssim(x[..., 3], y[..., 3]))
        weights = np.array([0.2126, 0.7152, 0.0722])
        all_, luma = float(np.mean(s)), ssim(x[..., :3] @ weights, y[..., :3] @ weights)
    row = {
        "n": n, "exact": exact, "exact_ratio": exact / n, "max_diff": int(d.max()), "mse": mse, "rmse": mse**0.5, "psnr": None if mse == 0 else float(10 * np.log10(65025.0 / mse)), "lossless": lossless, "ssim": all_, "ssim_luma": luma,
        "de_mean": float(de.mean()), "de_p95": p95, "de_max": float(de.max()), "differing": differing, "coherent": coherent, "clusters": clusters, "largest": largest, "mass": mass, "score": 1 - mass,
    }
    return {k: [v] for k, v in row.items()}


_SCHEMA = "n long, exact long, exact_ratio double, max_diff int, mse double, rmse double, psnr double, lossless boolean, ssim double, ssim_luma double, de_mean double, de_p95 double, de_max double, differing long, coherent long, clusters long, largest long, mass double, score double"


def report(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """The columns of compare.report for dense images of any sizes, one row a pair."""
    both = pairs(reference, candidate)
    out = per_image(both, lambda w, h, p: figures(p), _SCHEMA, {f"{s}_{c}": 0 for s in "pq" for c in "rgba"})
    return out.withColumn("composite", F.when(F.col("lossless"), 1.0).otherwise(composite(F.col("psnr"), F.col("ssim"), F.col("score"))))
