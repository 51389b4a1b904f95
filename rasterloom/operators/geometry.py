"""Contours, simplification, curve and primitive fitting, thinning and centrelines."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators.images import Planes, per_image
from rasterloom.operators.stencil import column, row, at

Point = tuple[float, float]


# -- relations


def boundary_edges(labels: DataFrame) -> DataFrame:
    """img_id, comp, x, y, side (n, e, s, w), other: the unit edges of every component, where the neighbour is another component, void (-1) or outside (-2)."""
    near = {"n": at("comp", -1, column()), "s": at("comp", 1, column()), "w": at("comp", -1, row()), "e": at("comp", 1, row())}
    p = labels.withColumns({f"__{k}": F.coalesce(v, F.lit(-2)) for k, v in near.items()})
    e = p.select("img_id", "comp", "x", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"__{k}").alias("other")) for k in near])).alias("e"))
    return e.filter((F.col("comp") >= 0) & (F.col("e.other") != F.col("comp"))).select("img_id", "comp", "x", "y", "e.side", "e.other")


def crack_degree(labels: DataFrame) -> DataFrame:
    """img_id, x, y, degree: number of label changes among the four cells around each inner lattice vertex (the corner right below pixel x, y)."""
    two = labels.select("img_id", "x", "y", "comp", at("comp", 1, row()).alias("r"))
    p = two.select("*", at("comp", 1, column()).alias("d"), at("r", 1, column()).alias("rd")).filter("r is not null and d is not null")
    a, b, c, d = F.col("comp"), F.col("r"), F.col("rd"), F.col("d")
    ne = lambda i, j: F.when(i != j, 1).otherwise(0)
    return p.select("img_id", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), (ne(a, b) + ne(b, c) + ne(c, d) + ne(d, a)).alias("degree"))


def loop_areas(edges: DataFrame) -> DataFrame:
    """img_id, comp, area: the signed area that the boundary encloses, by the shoelace formula over its directed unit edges; it equals the number of pixels, holes counting negative."""
    x, y = F.col("x"), F.col("y")
    # clockwise edges: n from (x,y) to (x+1,y); e down; s back; w up
    cross = F.when(F.col("side") == "n", -y).when(F.col("side") == "e", x + 1).when(F.col("side") == "s", y + 1).otherwise(-x)
    return edges.groupBy("img_id", "comp").agg((F.sum(cross) / 2).alias("area"))


def shoelace(points: DataFrame, loop: list[str]) -> DataFrame:
    """Signed area of each closed polygon of points (loop columns, seq, px, py)."""
    w = W.partitionBy(*loop).orderBy("seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("px", "py"))
    return points.withColumn("t", F.col("px") * ny - nx * F.col("py")).groupBy(*loop).agg((F.sum("t") / 2).alias("area"))


def polyline_length(points: DataFrame, line: list[str]) -> DataFrame:
    w = W.partitionBy(*line).orderBy("seq")
    step = F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w))
    return points.withColumn("d", step).groupBy(*line).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def fit_circle(points: DataFrame, loop: list[str]) -> DataFrame:
    """loop columns, n, cx, cy, radius, err: the least-squares circle (Kasa, 1976) by one aggregate of moments and Cramer's rule, and its worst radial residual. Null for points on a line."""
    x, y = F.col("px"), F.col("py")
    z = x * x + y * y
    s = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y), "sxz": F.sum(x * z), "syz": F.sum(y * z), "sz": F.sum(z)}
    m = points.groupBy(*loop).agg(*[v.cast("double").alias(k) for k, v in s.items()])
    n, sx, sy, sxx, syy, sxy, sxz, syz, sz = (F.col(k) for k in s)
    # centred moments make it a 2x2 system
    a, b, c = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    d, e = (sxz - sx * sz / n) / 2, (syz - sy * sz / n) / 2
    det = a * c - b * b
    ok = F.abs(det) > 1e-9
    cx, cy = F.when(ok, (d * c - b * e) / det), F.when(ok, (a * e - b * d) / det)
    m = m.select(*loop, "n", cx.alias("cx"), cy.alias("cy"), *[F.col(k) for k in ("sx", "sy", "sz")])
    r2 = F.col("sz") / F.col("n") - 2 * (F.col("cx") * F.col("sx") + F.col("cy") * F.col("sy")) / F.col("n") + F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")
    m = m.select(*loop, "n", "cx", "cy", F.sqrt(F.greatest(r2, F.lit(0.0))).alias("radius"))
    worst = F.max(F.abs(F.hypot(x - F.col("cx"), y - F.col("cy")) - F.col("radius")))
    return points.join(m, loop).groupBy(*loop).agg(F.max("n").cast("long").alias("n"), F.max("cx").alias("cx"), F.max("cy").alias("cy"), F.max("radius").alias("radius"), worst.alias("err"))


def fit_rect(points: DataFrame, loop: list[str]) -> DataFrame:
    """loop columns, x0, y0, x1, y1, err: the bounding rectangle and the largest distance of a point to its outline."""
    b = points.groupBy(*loop).agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))
    x, y = F.col("px"), F.col("py")
    d = F.least(x - F.col("x0"), F.col("x1") - x, y - F.col("y0"), F.col("y1") - y)
    return points.join(b, loop).groupBy(*loop, "x0", "y0", "x1", "y1").agg(F.max(d).alias("err"))


def sample_quad(p0: tuple[Column, Column], q: tuple[Column, Column], p2: tuple[Column, Column], steps: int) -> Column:
    """array<struct<x, y>> along a quadratic curve, without its start."""
    t = F.sequence(F.lit(1), F.lit(steps))

    def value(k: Column) -> Column:
        u = k / float(steps)
        return F.struct(*[((1 - u) * (1 - u) * a + 2 * (1 - u) * u * b + u * u * c).alias(n) for a, b, c, n in zip(p0, q, p2, "xy")])

    return F.transform(t, value)


def sample_cubic(p0: tuple[Column, Column], c1: tuple[Column, Column], c2: tuple[Column, Column], p3: tuple[Column, Column], steps: int) -> Column:
    t = F.sequence(F.lit(1), F.lit(steps))

    def value(k: Column) -> Column:
        u = k / float(steps)
        v = 1 - u
        return F.struct(*[(v * v * v * a + 3 * v * v * u * b + 3 * v * u * u * c + u * u * u * d).alias(n) for a, b, c, d, n in zip(p0, c1, c2, p3, "xy")])

    return F.transform(t, value)


def elevate_quad(p0: tuple[Column, Column], q: tuple[Column, Column], p2: tuple[Column, Column]) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The cubic handles of the same curve."""
    return tuple(a + 2 * (b - a) / 3 for a, b in zip(p0, q)), tuple(c + 2 * (b - c) / 3 for c, b in zip(p2, q))  # type: ignore[return-value]


# -- contours


def contours(labels: np.ndarray, policy: str = "left") -> list[tuple[int, np.ndarray, float]]:
    """(component, corner points, signed area) of all boundary loops. A component lies to the right of its loops: outer ones run clockwise (y down), holes the other way. Where a component meets itself at a corner, 'left' and 'white' part it there, 'right' and 'black' run through; 'minority' and 'majority' run through if the component has the smaller or larger share of the 8x8 cells around."""
    h, w = labels.shape
    pad = np.full((h + 2, w + 2), -2, np.int64)
    pad[1:-1, 1:-1] = labels
    own = pad[1:-1, 1:-1]
    sides = ((pad[:-2, 1:-1], 0), (pad[1:-1, 2:], 1), (pad[2:, 1:-1], 2), (pad[1:-1, :-2], 3))
    start: dict[tuple[int, int, int], list[int]] = {}
    edges = []
    for other, d in sides:
        y, x = np.nonzero((own != other) & (own >= 0))
        sx, sy = x + (d in (1, 2)), y + (d in (2, 3))
        for c, i, j in zip(own[y, x].tolist(), sx.tolist(), sy.tolist()):
            start.setdefault((c, i, j), []).append(d)
            edges.append((c, j, i, d))
    step = ((1, 0), (0, 1), (-1, 0), (0, -1))

    def through(c: int, x: int, y: int) -> bool:
        if policy in ("right", "black"):
            return True
        if policy in ("majority", "minority"):
            box = labels[max(0, y - 4) : y + 4, max(0, x - 4) : x + 4]
            return (2 * (box == c).sum() > box.size) == (policy == "majority")
        return False

    used: set[tuple[int, int, int, int]] = set()
    out = []
    for c, y, x, d in sorted(edges):
        if (c, x, y, d) in used:
            continue
        pts: list[tuple[int, int]] = []
        area, px, py, pd = 0, x, y, d
        last = None
        while True:
            used.add((c, px, py, pd))
            if last != pd:
                pts.append((px, py))
            last = pd
            nx, ny = px + step[pd][0], py + step[pd][1]
            area += px * ny - nx * py
            px, py = nx, ny
            free = [e for e in start[(c, px, py)] if (c, px, py, e) not in used]
            if not free:
                break
            if len(free) == 1:
                pd = free[0]
            else:
                turn = (pd + 1) % 4 if not through(c, px, py) else (pd + 3) % 4
                pd = turn if turn in free else free[0]
        if len(pts) > 1 and last == d and pts[0] == (x, y):
            pts = pts[1:]
        out.append((c, np.array(pts, np.int64), area / 2))
    return out


def trace_contours(labels: DataFrame, policy: str = "left") -> DataFrame:
    """img_id, loop, comp, signed_area, points (array of struct<x, y>): contours() of every image."""

    def run(w: int, h: int, p: Planes) -> dict:
        ls = contours(p["comp"], policy)
        return {"loop": list(range(len(ls))), "comp": [c for c, _, _ in ls], "signed_area": [a for _, _, a in ls], "points": [[{"x": int(x), "y": int(y)} for x, y in q] for _, q, _ in ls]}

    return per_image(labels, run, "loop int, comp int, signed_area double, points array<struct<x:int,y:int>>", {"comp": -1})


# -- simplification and fitting


def douglas_peucker(p: np.ndarray, tolerance: float) -> list[int]:
    """Indices that stay of an open polyline; a point leaves if its distance to the chord is not above the tolerance."""
    keep = {0, len(p) - 1}
    todo = [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        q, d = p[i + 1 : j] - p[i], p[j] - p[i]
        n2 = float(d @ d)
        t = np.clip(q @ d / n2, 0, 1) if n2 else np.zeros(len(q))
        dist = np.hypot(*(q - t[:, None] * d).T)
        k = int(np.argmax(dist))
        if dist[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return sorted(keep)


def simplify_closed(p: np.ndarray, tolerance: float) -> list[int]:
    """The same of a closed loop, anchored at its first point and the one farthest from it."""
    if len(p) < 4:
        return list(range(len(p)))
    far = int(np.argmax(np.hypot(*(p - p[0]).T)))
    if not far:
        return [0]
    a = douglas_peucker(p[: far + 1], tolerance)
    b = douglas_peucker(np.concatenate([p[far:], p[:1]]), tolerance)
    return a + [far + i for i in b[1:-1]]


def _bezier(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    u = 1 - t
    return (u**3)[:, None] * c[0] + (3 * u * u * t)[:, None] * c[1] + (3 * u * t * t)[:, None] * c[2] + (t**3)[:, None] * c[3]


def _unit(v: np.ndarray) -> np.ndarray:
    n = math.hypot(*v)
    return v / n if n else v


def fit_cubics(p: np.ndarray, t1: np.ndarray, t2: np.ndarray, error: float, depth: int = 0) -> list[np.ndarray]:
    """Cubic curves through an open run of points by Schneider's method (1990): least-squares handles along the end tangents, Newton steps on the parameters, a split at the worst point."""
    if len(p) == 2:
        d = math.hypot(*(p[1] - p[0])) / 3
        return [np.array([p[0], p[0] + t1 * d, p[1] + t2 * d, p[1]])]
    along = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))))
    u = along / along[-1] if along[-1] else np.linspace(0, 1, len(p))
    best, split = None, len(p) // 2
    for _ in range(6):
        b1, b2 = 3 * u * (1 - u) ** 2, 3 * u * u * (1 - u)
        b0, b3 = (1 - u) ** 3, u**3
        A1, A2 = b1[:, None] * t1, b2[:, None] * t2
        c11, c12, c22 = (A1 * A1).sum(), (A1 * A2).sum(), (A2 * A2).sum()
        rest = p - (b0 + b1)[:, None] * p[0] - (b2 + b3)[:, None] * p[-1]
        x1, x2 = (A1 * rest).sum(), (A2 * rest).sum()
        det = c11 * c22 - c12 * c12
        chord = math.hypot(*(p[-1] - p[0]))
        l1, l2 = ((x1 * c22 - x2 * c12) / det, (c11 * x2 - c12 * x1) / det) if abs(det) > 1e-12 else (0.0, 0.0)
        if l1 < 1e-6 * chord or l2 < 1e-6 * chord:
            l1 = l2 = chord / 3
        c = np.array([p[0], p[0] + t1 * l1, p[-1] + t2 * l2, p[-1]])
        d = _bezier(c, u) - p
        dist = (d * d).sum(1)
        split = min(max(int(np.argmax(dist)), 1), len(p) - 2)
        worst = math.sqrt(dist.max())
        if worst <= error:
            return [c]
        best = worst
        if worst > 4 * error:
            break
        q1, q2 = 3 * np.diff(c, axis=0), 6 * np.diff(c, 2, axis=0)
        v = 1 - u
        f1 = (v * v)[:, None] * q1[0] + (2 * v * u)[:, None] * q1[1] + (u * u)[:, None] * q1[2]
        f2 = v[:, None] * q2[0] + u[:, None] * q2[1]
        den = (f1 * f1).sum(1) + (d * f2).sum(1)
        u = np.clip(np.where(np.abs(den) > 1e-12, u - (d * f1).sum(1) / np.where(den == 0, 1, den), u), 0, 1)
    if depth >= 24 or best is None:
        return [np.array([p[0], p[0] + t1 * math.hypot(*(p[-1] - p[0])) / 3, p[-1] + t2 * math.hypot(*(p[-1] - p[0])) / 3, p[-1]])]
    mid = _unit(p[split - 1] - p[split + 1])
    return fit_cubics(p[: split + 1], t1, mid, error, depth + 1) + fit_cubics(p[split:], -mid, t2, error, depth + 1)


def fit_loop(points: np.ndarray, tolerance: float = 0.4, error: float = 0.4, corner: float = 75.0) -> list[tuple]:
    """Segments of a closed lattice loop: ('M', x, y), then ('L', x, y) and ('C', x1, y1, x2, y2, x, y). The loop is simplified; turns sharper than `corner` degrees are corners, and what lies between two corners is one run of cubics, or a line if it has no inner point."""
    p = points.astype(float)
    keep = simplify_closed(p, tolerance) if tolerance > 0 else list(range(len(p)))
    q = p[keep]
    n = len(q)
    if n < 3:
        return []
    before, after = q - np.roll(q, 1, 0), np.roll(q, -1, 0) - q
    turn = np.abs(np.degrees(np.arctan2(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0], (before * after).sum(1))))
    corners = np.flatnonzero(turn >= corner).tolist() or [0]
    out: list[tuple] = [("M", *q[corners[0]])]
    for i, c in enumerate(corners):
        e = corners[(i + 1) % len(corners)]
        idx = [(c + k) % n for k in range((e - c) % n + 1 or n + 1)] if e != c else [(c + k) % n for k in range(n + 1)]
        run = q[idx]
        if len(run) == 2:
            out.append(("L", *run[1]))
            continue
        if len(corners) == 1 and turn[c] < corner:
            t = _unit(q[(c + 1) % n] - q[c - 1])
            t1, t2 = t, -t
        else:
            t1, t2 = _unit(run[1] - run[0]), _unit(run[-2] - run[-1])
        for b in fit_cubics(run, t1, t2, error):
            out.append(("C", *b[1], *b[2], *b[3]))
    return out


def path_text(segments: list[tuple], precision: int = 2) -> str:
    return "".join(s[0] + " ".join(number(v, precision) for v in s[1:]) for s in segments) + ("Z" if segments else "")


def compact_path(subpaths: list[list[tuple]], precision: int = 2) -> str:
    """Path data of closed subpaths ([('M', x, y), ('L', x, y), ('Q', ...), ('C', ...)]), as short as it gets: relative to the rounded point before, h and v for axis-parallel lines, no repeated letters or needless separators, no last line back to the start. Rounding errors don't add up, as each difference is taken from where the pen really is."""
    out, last = "", ""
    f = 10.0**precision
    snap = lambda v: math.floor(v * f + 0.5) / f
    pen = (0.0, 0.0)

    def put(letter: str, values: list[float]) -> None:
        nonlocal out, last
        if letter != last or letter in "Mmz":
            out += letter
        for v in values:
            s = number(v, precision)
            tail = re.search(r"[\d.]*$", out)[0]
            if tail and not s.startswith("-") and not (s.startswith(".") and "." in tail):
                out += " "
            out += s
        last = letter

    for sub in subpaths:
        to = (snap(sub[0][1]), snap(sub[0][2]))
        put("M", list(to)) if not out else put("m", [to[0] - pen[0], to[1] - pen[1]])
        pen = start = to
        for k, (kind, *v) in enumerate(sub[1:], 1):
            q = [snap(x) for x in v]
            d = [x - pen[i % 2] for i, x in enumerate(q)]
            if kind == "L":
                back = k == len(sub) - 1 and (q[0], q[1]) == start
                if not back and (round(d[0], 9) or round(d[1], 9)):
                    put("h", d[:1]) if not round(d[1], 9) else put("v", d[1:]) if not round(d[0], 9) else put("l", d)
            else:
                put(kind.lower(), d)
            pen = (q[-2], q[-1])
        put("z", [])
        pen = start
    return out


def number(v: float, precision: int) -> str:
    """Rounded, without an exponent, trailing zeros or the zero before the point."""
    s = f"{math.floor(v * 10**precision + 0.5) / 10**precision:.{precision}f}"
    s = s.rstrip("0").rstrip(".") if "." in s else s
    s = "0" if s in ("-0", "") else s
    return s.replace("0.", ".", 1) if s.startswith("0.") else s.replace("-0.", "-.", 1) if s.startswith("-0.") else s


def circle_of(p: np.ndarray) -> tuple[float, float, float, float] | None:
    """Centre, radius and worst residual of the least-squares circle."""
    m = p.mean(0)
    q = p - m
    z = (q * q).sum(1)
    a = np.array([[(q[:, 0] ** 2).sum(), (q[:, 0] * q[:, 1]).sum()], [(q[:, 0] * q[:, 1]).sum(), (q[:, 1] ** 2).sum()]])
    if abs(np.linalg.det(a)) < 1e-9:
        return None
    c = np.linalg.solve(a, np.array([(q[:, 0] * z).sum(), (q[:, 1] * z).sum()]) / 2)
    r = math.sqrt(c @ c + z.mean())
    return float(c[0] + m[0]), float(c[1] + m[1]), r, float(np.abs(np.hypot(*(q - c).T) - r).max())


def detect_primitive(points: np.ndarray, max_error: float = 1.0, least_extent: float = 12.0) -> dict | None:
    """The rectangle, circle, ellipse or rounded rectangle with the smallest worst residual within max_error, of loops at least so wide and high; rectangles win ties, then circles."""
    p = points.astype(float)
    x0, y0 = p.min(0)
    x1, y1 = p.max(0)
    w, h = x1 - x0, y1 - y0
    if len(p) < 4 or min(w, h) < least_extent:
        return None
    nxt = np.roll(p, -1, 0)
    area = abs((p[:, 0] * nxt[:, 1] - nxt[:, 0] * p[:, 1]).sum()) / 2
    found = []
    edge = np.minimum.reduce([p[:, 0] - x0, x1 - p[:, 0], p[:, 1] - y0, y1 - p[:, 1]])
    if area >= 0.95 * w * h:
        found.append((float(edge.max()), 0, {"kind": "rect", "x": x0, "y": y0, "w": w, "h": h}))
    mid = (p + nxt) / 2  # corners of a lattice circle lie off it; middles of edges lie nearer
    if (c := circle_of(mid)) and abs(math.pi * c[2] ** 2 - area) <= 0.06 * area:
        found.append((c[3], 1, {"kind": "circle", "cx": c[0], "cy": c[1], "r": c[2]}))
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, w / 2, h / 2
    if abs(math.pi * rx * ry - area) <= 0.06 * area:
        k = np.hypot((mid[:, 0] - cx) / rx, (mid[:, 1] - cy) / ry)
        found.append((float((np.abs(k - 1) * min(rx, ry)).max()), 2, {"kind": "ellipse", "cx": cx, "cy": cy, "rx": rx, "ry": ry}))
    best = None
    for i in range(1, 50):
        r = min(w, h) / 2 * i / 49
        d = np.hypot(np.maximum(np.abs(mid[:, 0] - cx) - rx + r, 0), np.maximum(np.abs(mid[:, 1] - cy) - ry + r, 0)) + np.minimum(np.maximum(np.abs(mid[:, 0] - cx) - rx + r, np.abs(mid[:, 1] - cy) - ry + r), 0) - r
        e = float(np.abs(d).max())
        if best is None or e < best[0]:
            best = (e, 3, {"kind": "roundrect", "x": x0, "y": y0, "w": w, "h": h, "r": r})
    found.append(best)
    err, _, prim = min(found, key=lambda f: (round(f[0], 9), f[1]))
    return {**{k: v if isinstance(v, str) else float(v) for k, v in prim.items()}, "err": err} if err <= max_error else None


def detect_sector(points: np.ndarray, max_error: float = 1.0, least_extent: float = 12.0) -> dict | None:
    """The pie slice that a loop is within max_error: an apex among its corners, two straight sides and an arc around the apex, swept by 15 to 345 degrees and bulging enough to be told from a triangle."""
    p = points.astype(float)
    if len(p) < 6 or min(np.ptp(p, axis=0)) < least_extent / 2 or max(np.ptp(p, axis=0)) < least_extent:
        return None
    mid = (p + np.roll(p, -1, 0)) / 2
    area = abs((p[:, 0] * np.roll(p, -1, 0)[:, 1] - np.roll(p, -1, 0)[:, 0] * p[:, 1]).sum()) / 2
    best = None
    for c in p[simplify_closed(p, 1.0)]:
        found = _sector_around(mid, c)
        for _ in range(2):  # again around the crossing of the lines through the two sides
            if found is None:
                break
            cross = _sides_cross(mid, found)
            again = None if cross is None else _sector_around(mid, cross)
            found = again if again and again["err"] < found["err"] else found
        if found and found["err"] <= max_error and abs(found["sweep"] * found["r"] ** 2 / 2 - area) <= 0.1 * area and found["r"] * (1 - math.cos(min(found["sweep"], math.pi) / 2)) > 3 * max_error and (best is None or found["err"] < best["err"]):
            best = found
    return best


def _polar(mid: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = mid - c
    return np.hypot(d[:, 0], d[:, 1]), np.arctan2(d[:, 1], d[:, 0])


def _sector_around(mid: np.ndarray, c: np.ndarray) -> dict | None:
    """The slice with this apex that fits points best: its sides' directions are those of the outer points, its radius the median of the arc."""
    far, turn = _polar(mid, c)
    outer = np.sort(turn[far > 0.5 * far.max()])
    if len(outer) < 6:
        return None
    gap = np.diff(np.append(outer, outer[0] + 2 * math.pi))
    k = int(gap.argmax())
    first, sweep = float(outer[(k + 1) % len(outer)]), float(2 * math.pi - gap[k])
    at = (turn - first) % (2 * math.pi)
    inner = (at > 0.15 * sweep) & (at < 0.85 * sweep) & (far > 0.5 * far.max())
    if not math.radians(15) <= sweep <= math.radians(345) or inner.sum() < 4:
        return None
    r = float(np.median(far[inner]))
    error = float(np.minimum.reduce([np.abs(far - r), _off(far, at, 0.0), _off(far, at, sweep)]).max())
    return {"kind": "sector", "cx": float(c[0]), "cy": float(c[1]), "r": r, "from": first, "sweep": sweep, "err": error}


def _off(far: np.ndarray, at: np.ndarray, angle: float) -> np.ndarray:
    """Distance from a ray."""
    return np.where(np.cos(at - angle) > 0, np.abs(far * np.sin(at - angle)), far)


def _sides_cross(mid: np.ndarray, s: dict) -> np.ndarray | None:
    """Where the lines through the points nearest to the two sides cross."""
    far, turn = _polar(mid, np.array([s["cx"], s["cy"]]))
    at = (turn - s["from"]) % (2 * math.pi)
    lines = []
    for angle in (0.0, s["sweep"]):
        own = mid[(_off(far, at, angle) < 2.5) & (far < 0.9 * s["r"])]
        if len(own) < 3:
            return None
        m = own.mean(0)
        way = np.linalg.svd(own - m)[2][0]
        lines.append((m, way))
    (a, u), (b, v) = lines
    det = u[0] * v[1] - u[1] * v[0]
    return a + u * ((b - a)[0] * v[1] - (b - a)[1] * v[0]) / det if abs(det) > 0.05 else None


# -- thinning


def thin(m: np.ndarray) -> np.ndarray:
    """Guo and Hall's (1989) thinning of a 0/1 mask, all pixels at once, two sub-iterations until nothing changes."""
    m = np.pad(m.astype(np.int8), 1)
    while True:
        changed = False
        for odd in (0, 1):
            c = m[1:-1, 1:-1]
            n, ne, e, se, s, sw, w, nw = m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]
            cross = ((1 - n) & (ne | e)) + ((1 - e) & (se | s)) + ((1 - s) & (sw | w)) + ((1 - w) & (nw | n))
            n1 = (nw | n) + (ne | e) + (se | s) + (sw | w)
            n2 = (n | ne) + (e | se) + (s | sw) + (w | nw)
            least = np.minimum(n1, n2)
            edge = ((s | sw | (1 - nw)) & w) if odd == 0 else ((n | ne | (1 - se)) & e)
            gone = (c == 1) & (cross == 1) & (least >= 2) & (least <= 3) & (edge == 0)
            if gone.any():
                changed = True
                m = m.copy()
                m[1:-1, 1:-1][gone] = 0
        if not changed:
            return m[1:-1, 1:-1].astype(np.int32)


def skeleton_lines(m: np.ndarray) -> list[list[tuple[int, int]]]:
    """Open polylines along a skeleton: from ends and branch points on, then what is left as loops."""
    pts = {(int(x), int(y)) for y, x in zip(*np.nonzero(m))}

    def near(p: tuple[int, int]) -> list[tuple[int, int]]:
        x, y = p
        four = [q for q in ((x, y - 1), (x + 1, y), (x, y + 1), (x - 1, y)) if q in pts]
        # a diagonal that two steps would reach is no edge of its own
        return four + [(x + i, y + j) for i, j in ((1, -1), (1, 1), (-1, 1), (-1, -1)) if (x + i, y + j) in pts and (x + i, y) not in pts and (x, y + j) not in pts]

    graph = {p: near(p) for p in sorted(pts, key=lambda q: (q[1], q[0]))}
    done: set[frozenset] = set()
    lines = []

    def walk(a: tuple[int, int], b: tuple[int, int]) -> None:
        line = [a]
        while frozenset((a, b)) not in done:
            done.add(frozenset((a, b)))
            line.append(b)
            if len(graph[b]) != 2:
                break
            a, b = b, next((q for q in graph[b] if q != a), a)
        if len(line) > 1:
            lines.append(line)

    for only_nodes in (True, False):
        for p, qs in graph.items():
            if len(qs) != 2 or not only_nodes:
                for q in qs:
                    if frozenset((p, q)) not in done:
                        walk(p, q)
    return lines


def thinned(px: DataFrame, ink: str) -> DataFrame:
    """img_id, x, y of the skeleton of the pixels whose column `ink` is 1."""

    def run(w: int, h: int, p: Planes) -> dict:
        y, x = np.nonzero(thin(p[ink] == 1))
        return {"x": x, "y": y}

    return per_image(px, run, "x int, y int", {ink: 0})


def centrelines(px: DataFrame, ink: str, tolerance: float = 0.75, least: float = 0.0) -> DataFrame:
    """img_id, line, points, length: simplified polylines along the skeleton, longer than `least`."""

    def run(w: int, h: int, p: Planes) -> dict:
        rows = []
        for line in skeleton_lines(thin(p[ink] == 1)):
            q = np.array(line, float) + 0.5
            q = q[douglas_peucker(q, tolerance)]
            length = float(np.hypot(*np.diff(q, axis=0).T).sum())
            if length > least:
                rows.append((q, length))
        return {"line": list(range(len(rows))), "points": [[{"x": float(a), "y": float(b)} for a, b in q] for q, _ in rows], "length": [n for _, n in rows]}

    return per_image(px, run, "line int, points array<struct<x:double,y:double>>, length double", {ink: 0})


# -- arcs


def arcs_of(labels: np.ndarray) -> list[dict]:
    """Boundary loops split at junctions (corners where more than two labels change), each shared run once: points in canonical direction, left and right component, and by which loops it is used and how."""
    h, w = labels.shape
    pad = np.full((h + 2, w + 2), -2, np.int64)
    pad[1:-1, 1:-1] = labels
    a, b, c, d = pad[:-1, :-1], pad[:-1, 1:], pad[1:, 1:], pad[1:, :-1]
    degree = (a != b).astype(int) + (b != c) + (c != d) + (d != a)
    arcs: dict[tuple, dict] = {}
    for number_, (comp, pts, _) in enumerate(contours(labels)):
        dense = []
        n = len(pts)
        for i in range(n):
            p, q = pts[i], pts[(i + 1) % n]
            k = int(np.abs(q - p).max())
            dense += [tuple((p + (q - p) * j // k).tolist()) for j in range(k)]
        cuts = [i for i, (x, y) in enumerate(dense) if degree[y, x] > 2]
        if not cuts:
            i = dense.index(min(dense))
            runs = [dense[i:] + dense[: i + 1]]
        else:
            runs = [[dense[(i + k) % len(dense)] for k in range(((j - i) % len(dense) or len(dense)) + 1)] for i, j in zip(cuts, cuts[1:] + cuts[:1])]
        for r in runs:
            back = r[::-1]
            flip = back < r
            key = tuple(back if flip else r)
            e = arcs.setdefault(key, {"points": list(key), "faces": []})
            e["faces"].append((comp, number_, flip))
    return list(arcs.values())


def decompose_to_arcs(labels: DataFrame) -> DataFrame:
    """img_id, arc, length, points, faces (array of struct<comp, loop, reversed>)."""

    def run(w: int, h: int, p: Planes) -> dict:
        a = arcs_of(p["comp"])
        return {
            "arc": list(range(len(a))),
            "length": [len(x["points"]) - 1 for x in a],
            "points": [[{"x": int(i), "y": int(j)} for i, j in x["points"]] for x in a],
            "faces": [[{"comp": int(c), "loop": int(n), "reversed": bool(f)} for c, n, f in x["faces"]] for x in a],
        }

    return per_image(labels, run, "arc int, length int, points array<struct<x:int,y:int>>, faces array<struct<comp:int,loop:int,reversed:boolean>>", {"comp": -1})


def verify_twins(arcs: DataFrame) -> DataFrame:
    """img_id, arcs, interior, twinned, unmatched: an interior arc is used once in each direction."""
    n = F.size("faces")
    both = F.exists("faces", lambda f: f["reversed"]) & F.exists("faces", lambda f: ~f["reversed"])
    return arcs.groupBy("img_id").agg(F.count("*").alias("arcs"), F.count(F.when(n == 2, 1)).alias("interior"), F.count(F.when((n == 2) & both, 1)).alias("twinned"), F.count(F.when((n > 2) | ((n == 2) & ~both), 1)).alias("unmatched"))
