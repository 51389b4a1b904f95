"""Gradient paint: regions whose colour runs along a line or out from a point, as stops that a renderer interpolates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from rasterloom.operators.geometry import number
from rasterloom.operators.images import Planes, per_image
from rasterloom.operators.outline import rendered_stops, select_stops, solve3, top_eigenvector
from rasterloom.operators.quantize import _to_srgb
from rasterloom.operators.regions import _oklab

#: Samples along a ramp, pixels that a region needs, stops at most, the mean squared Oklab error that stops aim at, and what share of the flat colour's error a gradient may leave.
FINE, LEAST, STOPS, TARGET, SHARE = 64, 64, 8, 2e-5, 0.25


def ramp(t: np.ndarray, lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean colour (8-bit sRGB, FINE rows) and weight of samples at t in [0, 1]; where there are none the colour is interpolated."""
    k = np.minimum((t * FINE).astype(np.int64), FINE - 1)
    n = np.bincount(k, minlength=FINE)
    have = np.flatnonzero(n)
    mean = np.stack([np.interp(np.arange(FINE), have, (np.bincount(k, lab[:, c], FINE)[have] / n[have])) for c in range(3)], 1)
    return _to_srgb(mean).astype(np.int64), n.astype(float)


def left_over(t: np.ndarray, lab: np.ndarray, rgb: np.ndarray, chosen: list[int]) -> float:
    """Mean squared Oklab error of pixels under the stops."""
    at = np.array(chosen) / (FINE - 1)
    got = np.floor(rendered_stops(at, rgb[chosen].astype(float), t) + 0.5).astype(np.int64)
    return float(((_oklab(*got.T) - lab) ** 2).sum(1).mean())


def linear_axis(x: np.ndarray, y: np.ndarray, lab: np.ndarray) -> tuple[float, float] | None:
    """The direction along which colours change most: of the planes fitted to the three channels the common gradient."""
    u, v = x - x.mean(), y - y.mean()
    a, b, c = (u * u).sum(), (u * v).sum(), (v * v).sum()
    det = a * c - b * b
    if abs(det) < 1e-9:
        return top_eigenvector(a, b, c)
    p, q = u @ lab, v @ lab
    gx, gy = (c * p - b * q) / det, (a * q - b * p) / det
    return top_eigenvector(float(gx @ gx), float(gx @ gy), float(gy @ gy))


def centre_of(x: np.ndarray, y: np.ndarray, lab: np.ndarray) -> tuple[float, float] | None:
    """Where colour contours are centred, if they are circles: by least squares the point from which the strongest channel is a function of squared distance, v = a (x^2 + y^2) + b x + c y + d."""
    k = int(lab.var(0).argmax())
    s = x * x + y * y
    m = np.stack([s, x, y], 1)
    m = m - m.mean(0)
    w = solve3(m.T @ m, m.T @ (lab[:, k] - lab[:, k].mean()))
    return None if w is None or abs(w[0]) < 1e-12 else (float(-w[1] / (2 * w[0])), float(-w[2] / (2 * w[0])))


def paint_of(x: np.ndarray, y: np.ndarray, rgb: np.ndarray) -> dict | None:
    """The gradient of a region's pixels (centres x, y): kind, four numbers (x1, y1, x2, y2, or cx, cy, r, 0), stops (offset, r, g, b), its error and the flat colour's. None if the region is small or flat, or no gradient leaves less than SHARE of the error."""
    if len(x) < LEAST:
        return None
    lab = _oklab(*rgb.T)
    flat = float(((lab - lab.mean(0)) ** 2).sum(1).mean())
    if flat <= TARGET:
        return None
    best = None
    tries = []
    if axis := linear_axis(x, y, lab):
        t = x * axis[0] + y * axis[1]
        low, high = float(t.min()), float(t.max())
        if high > low:
            mid = float(x.mean() * -axis[1] + y.mean() * axis[0])  # across the axis, through the middle
            ends = [(axis[0] * s - axis[1] * mid, axis[1] * s + axis[0] * mid) for s in (low, high)]
            tries.append(("linear", (*ends[0], *ends[1]), (t - low) / (high - low)))
    if centre := centre_of(x, y, lab):
        r = np.hypot(x - centre[0], y - centre[1])
        if r.max() > 0 and math.isfinite(r.max()):
            tries.append(("radial", (*centre, float(r.max()), 0.0), r / r.max()))
    for kind, place, t in tries:
        ramp_rgb, weight = ramp(t, lab)
        chosen = select_stops(ramp_rgb, weight, STOPS, TARGET)
        error = left_over(t, lab, ramp_rgb, chosen)
        if error < SHARE * flat and (best is None or error < 0.8 * best["error"]):  # the simpler one unless the other is clearly better
            best = {"kind": kind, "place": place, "stops": [(k / (FINE - 1), *map(int, ramp_rgb[k])) for k in chosen], "error": error, "flat": flat}
    return best


def definition(paint: dict, ident: str, precision: int = 2) -> str:
    """The paint as an SVG element."""
    n = lambda v: number(v, precision)
    names = ("x1", "y1", "x2", "y2") if paint["kind"] == "linear" else ("cx", "cy", "r")
    place = "".join(f' {k}="{n(v)}"' for k, v in zip(names, paint["place"]))
    stops = "".join(f'<stop offset="{number(o, 4)}" stop-color="#{r:02x}{g:02x}{b:02x}"/>' for o, r, g, b in paint["stops"])
    return f'<{paint["kind"]}Gradient id="{ident}" gradientUnits="userSpaceOnUse"{place}>{stops}</{paint["kind"]}Gradient>'


def gradients(labels: DataFrame) -> DataFrame:
    """img_id, comp, kind, stops (how many), error, flat_error, svg of the components of a labelled image (comp, r, g, b) that a gradient paints better than one colour."""

    def run(w: int, h: int, p: Planes) -> dict:
        ids = p["comp"].ravel()
        order = np.argsort(ids, kind="stable")
        rgb = np.stack([p[c].ravel() for c in "rgb"], 1).astype(np.int64)
        rows: dict[str, list] = {k: [] for k in ("comp", "kind", "stops", "error", "flat_error", "svg")}
        for own in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
            c = int(ids[own[0]])
            g = paint_of(own % w + 0.5, own // w + 0.5, rgb[own]) if c >= 0 else None
            if g:
                for k, v in zip(rows, (c, g["kind"], len(g["stops"]), g["error"], g["flat"], definition(g, f"g{c}"))):
                    rows[k].append(v)
        return rows

    return per_image(labels, run, "comp int, kind string, stops int, error double, flat_error double, svg string", {"comp": -1, "r": 0, "g": 0, "b": 0})
