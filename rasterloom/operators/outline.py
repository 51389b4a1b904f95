"""Finishing of outlines: smoothing that neighbours agree on, square corners, quadratic reduction, curves fitted once for each shared arc, displacements measured below the pixel, and paint stops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from rasterloom.operators.geometry import _bezier, _unit, arcs_of, contours, douglas_peucker, fit_cubics, fit_loop, path_text
from rasterloom.operators.images import Planes, per_image
from rasterloom.operators.regions import _oklab

#: Segments are ('L', x, y), ('Q', x1, y1, x, y) or ('C', x1, y1, x2, y2, x, y).
Segment = tuple


# -- smoothing


def smoothed(points: np.ndarray, band: float = 0.75, passes: int = 2, pinned: np.ndarray | None = None) -> np.ndarray:
    """A closed loop relaxed: in each pass every free vertex goes half way to the middle of its neighbours, but never farther than `band` from where it was at first. Fewer than four vertices stay."""
    home = np.asarray(points, float)
    if len(home) < 4 or passes <= 0 or band <= 0:
        return home.copy()
    free = np.ones(len(home), bool) if pinned is None else ~pinned.astype(bool)
    now = home.copy()
    for _ in range(passes):
        off = (now + (np.roll(now, 1, 0) + np.roll(now, -1, 0)) / 2) / 2 - home
        far = np.hypot(off[:, 0], off[:, 1])
        off *= np.where(far > band, band / np.maximum(far, 1e-300), 1.0)[:, None]
        now = np.where(free[:, None], home + off, now)
    return now


def crack_degrees(labels: np.ndarray) -> np.ndarray:
    """For each lattice vertex (height + 1, width + 1) how often the label changes around it."""
    pad = np.pad(labels.astype(np.int64), 1, constant_values=-999)
    around = (pad[:-1, :-1], pad[:-1, 1:], pad[1:, 1:], pad[1:, :-1])
    return sum((a != b).astype(int) for a, b in zip(around, around[1:] + around[:1]))


def pins(points: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Which vertices must not move: those on the frame and junctions of more than two outlines."""
    h, w = degrees.shape[0] - 1, degrees.shape[1] - 1
    x, y = points[:, 0], points[:, 1]
    return (x <= 0) | (y <= 0) | (x >= w) | (y >= h) | (degrees[y, x] != 2)


def dense(points: np.ndarray) -> np.ndarray:
    """Every lattice vertex along a closed rectilinear loop."""
    p = np.asarray(points, np.int64)
    step = np.roll(p, -1, 0) - p
    n = np.abs(step).max(1)
    at = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(n.sum()) - at
    return np.repeat(p, n, 0) + np.repeat(np.sign(step), n, 0) * k[:, None]


def agreeing_outlines(labels: DataFrame, band: float = 0.75, passes: int = 2) -> DataFrame:
    """img_id, comp, loop, seq, lx, ly, pinned, x, y of every lattice vertex on an outline of a labelled image (comp): where it was and where it goes. What two components share moves alike, as junctions stay."""

    def run(w: int, h: int, p: Planes) -> dict:
        degrees = crack_degrees(p["comp"])
        rows: dict[str, list] = {k: [] for k in ("comp", "loop", "seq", "lx", "ly", "pinned", "x", "y")}
        for number, (comp, pts, _) in enumerate(contours(p["comp"])):
            d = dense(pts)
            fixed = pins(d, degrees)
            new = smoothed(d, band, passes, fixed)
            for k, v in zip(rows, (np.full(len(d), comp), np.full(len(d), number), np.arange(len(d)), d[:, 0], d[:, 1], fixed, new[:, 0], new[:, 1])):
                rows[k].append(v)
        return {k: np.concatenate(v) if v else np.zeros(0, bool if k == "pinned" else float if k in "xy" else np.int64) for k, v in rows.items()}

    return per_image(labels, run, "comp int, loop int, seq int, lx int, ly int, pinned boolean, x double, y double", {"comp": -1})


def square_corners(points: np.ndarray, anchors: list[int], degrees: float = 5.0) -> tuple[np.ndarray, set[int]]:
    """The loop with corners that are nearly right and nearly on the axes made exactly so, and the anchors that were: such a corner goes to the crossing of the axis-parallel lines through its neighbours. Corners are taken in order, each with what the ones before it did."""
    p, forced = np.asarray(points, float).copy(), set()
    slack = math.sin(math.radians(max(0.0, degrees)))
    m = len(anchors)
    if m < 3:
        return p, forced
    for i, c in enumerate(anchors):
        a, b = anchors[i - 1], anchors[(i + 1) % m]
        u, v = p[c] - p[a], p[b] - p[c]
        lu, lv = math.hypot(*u), math.hypot(*v)
        if not lu or not lv or abs(float(u @ v)) / (lu * lv) > slack:
            continue
        for axis in (0, 1):  # in along `axis`, out across it
            if abs(u[1 - axis]) / lu <= slack and abs(v[axis]) / lv <= slack:
                p[c, 1 - axis], p[c, axis] = p[a, 1 - axis], p[b, axis]
                forced.add(c)
                break
    return p, forced


# -- curves


def reversed_path(start: tuple[float, float], segments: list[Segment]) -> tuple[tuple[float, float], list[Segment]]:
    """The same curve from its other end: a cubic's handles change places, a quadratic's stays."""
    ends = [tuple(start), *[tuple(s[-2:]) for s in segments]]
    out = []
    for s, to in zip(segments[::-1], ends[-2::-1]):
        handles = s[1:-2]
        out.append((s[0], *handles[2:], *handles[:2], *to) if s[0] == "C" else (s[0], *handles, *to))
    return ends[-1], out


def fit_open(points: np.ndarray, tolerance: float = 0.4, error: float = 0.4, corner: float = 75.0) -> tuple[tuple[float, float], list[Segment]]:
    """An open arc as lines and cubics: simplified with its ends held, split at sharp turns."""
    p = np.asarray(points, float)
    q = p[douglas_peucker(p, tolerance)] if tolerance > 0 else p
    d = np.diff(q, axis=0)
    turn = np.abs(np.degrees(np.arctan2(d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0], (d[:-1] * d[1:]).sum(1))))
    cuts = [0, *(np.flatnonzero(turn >= corner) + 1).tolist(), len(q) - 1]
    out: list[Segment] = []
    for i, j in zip(cuts, cuts[1:]):
        run = q[i : j + 1]
        if len(run) == 2:
            out.append(("L", *run[1]))
        elif len(run) > 2:
            out += [("C", *b[1], *b[2], *b[3]) for b in fit_cubics(run, _unit(run[1] - run[0]), _unit(run[-2] - run[-1]), error)]
    return tuple(q[0]), out


def flattened_path(start: tuple[float, float], segments: list[Segment], steps: int = 10) -> np.ndarray:
    """Points of a path: each curve in `steps` equal steps of its parameter, lines by their end."""
    out, at = [np.array([start], float)], np.array(start, float)
    t = np.arange(1, steps + 1) / steps
    for s in segments:
        c = np.array([at, *np.reshape(s[1:], (-1, 2))], float)
        if s[0] == "L":
            out.append(c[1:])
        else:
            out.append(_bezier(c if s[0] == "C" else np.array([c[0], c[0] + (c[1] - c[0]) * 2 / 3, c[2] + (c[1] - c[2]) * 2 / 3, c[2]]), t))
        at = c[-1]
    return np.concatenate(out)


def distance_to(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Each point's distance to a polyline."""
    a, d = line[:-1], np.diff(line, axis=0)
    n2 = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((points[:, None] - a) * d).sum(-1) / n2, 0, 1)
    return np.sqrt((((a + t[..., None] * d) - points[:, None]) ** 2).sum(-1).min(1))


def quadratic_of(c: np.ndarray) -> np.ndarray:
    """The handle of the quadratic that meets a cubic's ends and middle."""
    return (3 * c[1] + 3 * c[2] - c[0] - c[3]) / 4


def quadratic_deviation(c: np.ndarray) -> float:
    """How far, at most, that quadratic lies from the cubic: sqrt(3)/36 of the length of the third difference."""
    return math.sqrt(3) / 36 * math.hypot(*(c[3] - 3 * c[2] + 3 * c[1] - c[0]))


def as_quadratics(start: tuple[float, float], segments: list[Segment], points: np.ndarray, error: float = 0.4) -> list[Segment]:
    """Cubics as quadratics where the points still lie within `error` of the path: what the cubic is off already and what the quadratic adds may not exceed it together. points: those that the path was fitted to."""
    pts, out, at = np.asarray(points, float), [], np.array(start, float)
    ends = np.array([start, *[s[-2:] for s in segments]], float)
    near = [int(np.argmin(((pts - e) ** 2).sum(1))) for e in ends]
    for k, s in enumerate(segments):
        if s[0] == "C":
            c = np.array([at, *np.reshape(s[1:], (-1, 2))], float)
            i, j = near[k], near[k + 1]
            own = pts[i : j + 1] if i < j else np.concatenate([pts[i:], pts[: j + 1]])
            spent = float(distance_to(own, _bezier(c, np.linspace(0, 1, 33))).max()) if len(own) else 0.0
            if spent + quadratic_deviation(c) <= error:
                s = ("Q", *quadratic_of(c), *s[-2:])
        out.append(s)
        at = np.array(s[-2:], float)
    return out


def rebuilt_face(uses: list[tuple[np.ndarray, bool]]) -> np.ndarray:
    """The vertices of a loop from its arcs in order, each given as it is stored and whether it is run backwards; an arc's last vertex is the next one's first."""
    return np.concatenate([(a[::-1] if back else a)[:-1] for a, back in uses])


def faces_of(labels: np.ndarray) -> tuple[list[np.ndarray], dict[int, tuple[int, list[tuple[int, bool]]]]]:
    """The arcs, and for each loop its component and the arcs along it, in order, with whether they are run backwards."""
    arcs = arcs_of(labels)
    points = [np.array(a["points"], np.int64) for a in arcs]
    begin: dict[tuple, tuple[int, bool, int]] = {}
    whole: dict[int, int] = {}
    for k, a in enumerate(arcs):
        for comp, loop, back in a["faces"]:
            p = points[k][::-1] if back else points[k]
            begin[loop, *p[0].tolist(), *p[1].tolist()] = (k, back, comp)
            whole[loop] = whole.get(loop, 0) + len(p) - 1
    faces: dict[int, tuple[int, list[tuple[int, bool]]]] = {}
    for number, (comp, pts, _) in enumerate(contours(labels)):
        d = dense(pts)
        n, uses, i = len(d), [], 0
        hits = [j for j in range(n) if (number, *d[j].tolist(), *d[(j + 1) % n].tolist()) in begin]
        i, left = hits[0], n
        while left > 0:
            k, back, _ = begin[number, *d[i].tolist(), *d[(i + 1) % n].tolist()]
            uses.append((k, back))
            i, left = (i + len(points[k]) - 1) % n, left - len(points[k]) + 1
        faces[number] = (comp, uses)
    return points, faces


def face_curves(labels: np.ndarray, tolerance: float = 0.4, error: float = 0.4, corner: float = 75.0, px: np.ndarray | None = None) -> list[tuple[int, int, list[Segment]]]:
    """(component, arcs, path from its 'M' on) of every outline, in the order of contours(), from curves that are fitted once for each arc. With px, arcs between two components are refined below the pixel first; their ends stay."""
    points, faces = faces_of(labels)
    fitted = []
    for a in points:
        closed = bool((a[0] == a[-1]).all())
        q = a.astype(float)
        if px is not None:
            own = _left_of(labels, a)
            q = np.concatenate([refined(a[:-1], px, labels, own)[0], q[:1]]) if closed else refined(a, px, labels, own, False)[0]
            if closed:
                q[-1] = q[0]
        if closed:
            loop = fit_loop(q[:-1], tolerance, error, corner) or [("M", *q[0]), *[("L", *v) for v in q[1:]]]
            fitted.append((loop[0][1:], loop[1:]))
        else:
            fitted.append(fit_open(q, tolerance, error, corner))
    out = []
    for comp, uses in faces.values():
        parts = [reversed_path(*fitted[k]) if back else fitted[k] for k, back in uses]
        out.append((comp, len(uses), [("M", *parts[0][0]), *[s for _, ss in parts for s in ss]]))
    return out


def _left_of(labels: np.ndarray, arc: np.ndarray) -> int:
    """The label on one side of an arc's first step (that of a pixel inside the image)."""
    (x, y), (u, v) = arc[0].tolist(), arc[1].tolist()
    h, w = labels.shape
    for i, j in ((min(x, u), y - 1), (min(x, u), y)) if y == v else ((x - 1, min(y, v)), (x, min(y, v))):
        if 0 <= i < w and 0 <= j < h:
            return int(labels[j, i])
    return -1


def fitted_faces(labels: DataFrame, tolerance: float = 0.4, error: float = 0.4, corner: float = 75.0, precision: int = 2) -> DataFrame:
    """img_id, comp, loop, arcs, d: every outline of a labelled image as path data, put together from curves that are fitted once for each arc. Two components run their shared arc in either direction along the very same curve, so no gap or overlap lies between them."""

    def run(w: int, h: int, p: Planes) -> dict:
        rows = face_curves(p["comp"], tolerance, error, corner)
        return {"comp": [c for c, _, _ in rows], "loop": list(range(len(rows))), "arcs": [n for _, n, _ in rows], "d": [path_text(s, precision) for _, _, s in rows]}

    return per_image(labels, run, "comp int, loop int, arcs int, d string", {"comp": -1})


# -- displacements below the pixel


def corner_cuts(directions: np.ndarray, wrap: bool, least: int = 4) -> np.ndarray:
    """Which vertices separate two straight runs of `least` unit steps or more. directions: (n, 2) unit steps; vertex i lies before step i (an open chain has one more at the end)."""
    n = len(directions)
    out = np.zeros(n if wrap else n + 1, bool)
    if not n:
        return out
    turn = (directions != np.roll(directions, 1, 0)).any(1)
    if not turn.any():
        return out
    if not wrap:
        turn[0] = True
    first = np.flatnonzero(turn)
    size = np.diff(np.append(first, first[0] + n if wrap else n))
    ok = (size >= least) & (np.roll(size, 1) >= least)
    out[first[ok]] = True
    if not wrap:
        out[0] = False
    return out


def combine_axes(sums: tuple[float, float], hits: tuple[int, int], saturated: tuple[bool, bool]) -> tuple[float, float]:
    """A vertex's displacement from what its steps measured along x and y: an axis that was not measured, or alone ran into its limit, counts as still; else both are averaged over all measurements."""
    (x, y), (m, n), (sx, sy) = sums, hits, saturated
    if m and (not n or (sy and not sx)):
        return x / m, 0.0
    if n and (not m or (sx and not sy)):
        return 0.0, y / n
    return (x / (m + n), y / (m + n)) if m + n else (0.0, 0.0)


#: Pixels walked towards a side's pure colour, the squared step below which it counts as pure, the least squared contrast of the two sides, and the farthest that a step may move.
REACH, PURE, CONTRAST, SHIFT = 12, 16, 36, 0.5
#: Vertices on either side that the median looks at, and the displacement from which two neighbours may be said to disagree.
WINDOW, NOISE = 2, 0.25


def plateau(px: np.ndarray, labels: np.ndarray, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The purest colour that each walk finds: from (x, y) along (dx, dy) inside the start's label, until a step changes little; the farthest one if none does."""
    h, w = labels.shape
    own, here = labels[y, x], px[y, x].astype(np.int64)
    on = np.ones(len(x), bool)
    for k in range(1, REACH + 1):
        i, j = x + dx * k, y + dy * k
        on &= (i >= 0) & (j >= 0) & (i < w) & (j < h)
        on[on] = labels[j[on], i[on]] == own[on]
        if not on.any():
            break
        there = px[j[on], i[on]].astype(np.int64)
        still = ((there - here[on]) ** 2).sum(1) <= PURE
        here[on] = there
        on[np.flatnonzero(on)[still]] = False
    return here


def median_displacements(moves: np.ndarray, valid: np.ndarray, cuts: np.ndarray, wrap: bool) -> np.ndarray:
    """Displacements (n, 2) of vertices along a line, where neighbours contradict each other replaced by the window's median: only between vertices with a measurement and not across a corner."""
    n = len(moves)
    out = np.where(valid[:, None], moves, 0.0)
    if not n:
        return out
    offsets = np.arange(-WINDOW, WINDOW + 1)
    at = np.arange(n)[:, None] + offsets
    inside = np.ones(at.shape, bool) if wrap else (at >= 0) & (at < n)
    at = at % n
    c = cuts[:n][at] & inside
    # leftwards a cut at any vertex from the middle on blocks what lies behind it, rightwards one at the vertex itself does too
    blocked = np.zeros(at.shape, bool)
    for r in range(1, WINDOW + 1):
        blocked[:, WINDOW - r] = c[:, WINDOW - r + 1 : WINDOW + 1].any(1)
        blocked[:, WINDOW + r] = c[:, WINDOW + 1 : WINDOW + r + 1].any(1)
    use = inside & ~blocked & valid[at]
    for i in np.flatnonzero(valid):
        v = moves[at[i][use[i]]]
        big = np.abs(v).sum(1) >= NOISE
        if (big[1:] & big[:-1] & ((v[1:] * v[:-1]).sum(1) < 0)).any():
            out[i] = np.median(v, axis=0)
    return out


def refined(points: np.ndarray, px: np.ndarray, labels: np.ndarray, own: int, closed: bool = True) -> tuple[np.ndarray, int]:
    """A lattice outline moved to where antialiasing says that it runs, and how many vertices moved.

    points: every lattice vertex along the loop (or along an open arc, whose ends stay). Each unit step lies between a pixel of label `own` and another one; what the two cover, between the pure colours of either side, tells how far along its normal the edge really is (half a pixel at most). Steps on the frame, between colours too alike, or with `own` on both sides or none measure nothing.
    """
    p = np.asarray(points, np.int64)
    n = len(p)
    if n < 2:
        return p.astype(float), 0
    h, w = labels.shape
    a, b = (np.arange(n), np.roll(np.arange(n), -1)) if closed else (np.arange(n - 1), np.arange(1, n))
    d = np.sign(p[b] - p[a])
    level = d[:, 1] == 0
    low = np.minimum(p[a], p[b])
    one = low - np.where(level[:, None], (0, 1), (1, 0))  # the pixel above or on the left; `low` is the other
    within = lambda q: (q[:, 0] >= 0) & (q[:, 1] >= 0) & (q[:, 0] < w) & (q[:, 1] < h)
    both = within(one) & within(low)
    first, second = (np.full(len(d), -(10**9)) for _ in range(2))
    first[both], second[both] = labels[one[both, 1], one[both, 0]], labels[low[both, 1], low[both, 0]]
    ok = np.flatnonzero(both & ((first == own) != (second == own)))
    swap = (first[ok] == own)[:, None]
    inner, outer = np.where(swap, one[ok], low[ok]), np.where(swap, low[ok], one[ok])
    normal = outer - inner
    pure = plateau(px, labels, inner[:, 0], inner[:, 1], -normal[:, 0], -normal[:, 1])
    other = plateau(px, labels, outer[:, 0], outer[:, 1], normal[:, 0], normal[:, 1])
    axis = pure - other
    contrast = (axis * axis).sum(1)
    cover = lambda q: np.clip(((px[q[:, 1], q[:, 0]].astype(np.int64) - other) * axis).sum(1) / np.maximum(contrast, 1), 0, 1)
    raw = cover(inner) + cover(outer) - 1
    moved = np.clip(raw, -SHIFT, SHIFT)
    good = (contrast >= CONTRAST) & (moved != 0)
    ok, normal, moved, full = ok[good], normal[good], moved[good], (np.abs(raw) >= SHIFT)[good]
    sums, hits, limit = np.zeros((n, 2)), np.zeros((n, 2), int), np.zeros((n, 2), bool)
    side = (normal[:, 0] == 0).astype(int)
    for ends in (a[ok], b[ok]):
        np.add.at(sums, (ends, side), moved * normal.sum(1))
        np.add.at(hits, (ends, side), 1)
        np.logical_or.at(limit, (ends, side), full)
    valid = hits.any(1)
    if not closed:
        valid[[0, -1]] = False
    moves = np.zeros((n, 2))
    for i in np.flatnonzero(valid):
        moves[i] = combine_axes(tuple(sums[i]), tuple(hits[i]), tuple(limit[i]))
    moves = median_displacements(moves, valid, corner_cuts(d, closed), closed)
    return p + moves, int((moves != 0).any(1).sum())


def refined_outlines(labels: DataFrame) -> DataFrame:
    """img_id, comp, loop, seq, lx, ly, x, y of every lattice vertex on an outline of a labelled image (comp, r, g, b, a): where it was and where the edge runs below the pixel."""

    def run(w: int, h: int, p: Planes) -> dict:
        px = np.stack([p[c] for c in "rgba"], -1)
        rows: dict[str, list] = {k: [] for k in ("comp", "loop", "seq", "lx", "ly", "x", "y")}
        for number, (comp, pts, _) in enumerate(contours(p["comp"])):
            d = dense(pts)
            new, _ = refined(d, px, p["comp"], comp)
            for k, v in zip(rows, (np.full(len(d), comp), np.full(len(d), number), np.arange(len(d)), d[:, 0], d[:, 1], new[:, 0], new[:, 1])):
                rows[k].append(v)
        return {k: np.concatenate(v) if v else np.zeros(0, float if k in "xy" else np.int64) for k, v in rows.items()}

    return per_image(labels, run, "comp int, loop int, seq int, lx int, ly int, x double, y double", {"comp": -1} | dict.fromkeys("rgba", 0))


# -- paint stops and small systems


def solve3(m: np.ndarray, r: np.ndarray) -> np.ndarray | None:
    """The solution of a 3 x 3 system; None if it is near-singular (determinant below 1e-9)."""
    return np.linalg.solve(m, r) if abs(np.linalg.det(m)) >= 1e-9 else None


def top_eigenvector(a: float, b: float, c: float) -> tuple[float, float] | None:
    """The unit eigenvector of the larger eigenvalue of [[a, b], [b, c]]; None if there is no variation."""
    if a + c < 1e-12:
        return None
    if abs(b) <= 1e-12:
        return (1.0, 0.0) if a >= c else (0.0, 1.0)
    top = (a + c) / 2 + math.hypot((a - c) / 2, b)
    n = math.hypot(top - c, b)
    return ((top - c) / n, b / n) if n >= 1e-12 else None


def rendered_stops(offsets: np.ndarray, rgb: np.ndarray, at: np.ndarray) -> np.ndarray:
    """sRGB between stops, linear in each channel and constant beyond the ends, as renderers do it."""
    return np.stack([np.interp(at, offsets, rgb[:, k]) for k in range(3)], -1)


def select_stops(rgb: np.ndarray, weight: np.ndarray, most: int = 8, target: float = 1e-5) -> list[int]:
    """Samples of a colour ramp (n, 3) to make stops of: both ends, then again and again the sample that the stops so far render worst (squared Oklab distance times weight; the first of equal ones), until the weighted mean is `target` or less or there are `most`."""
    n = len(rgb)
    at = np.arange(n) / max(1, n - 1)
    want = _oklab(*rgb.T)
    chosen = [0, n - 1]
    while len(chosen) < most:
        now = np.floor(rendered_stops(at[chosen], rgb[chosen].astype(float), at) + 0.5).astype(np.int64)
        got = _oklab(*now.T)
        e = ((got - want) ** 2).sum(-1) * weight
        if weight.sum() > 0 and e.sum() / weight.sum() <= target:
            break
        e[chosen] = -1
        e[weight <= 0] = -1
        k = int(e.argmax())
        if e[k] < 0:
            break
        chosen = sorted([*chosen, k])
    return chosen
