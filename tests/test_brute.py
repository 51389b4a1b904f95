"""Sequential algorithms against plain loops on small random images."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.operators import geometry, quantize, regions
from rasterloom.plans import vectorize
from rasterloom.plans.assets import planes

seeds = st.integers(0, 10**6)
sides = st.integers(1, 9)


def classes(seed, h, w, k=3):
    return np.random.default_rng(seed).integers(-1, k, (h, w))


def flood(c):
    """Components as sets of (y, x), in raster order; -1 belongs to none."""
    h, w = c.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if c[y, x] < 0 or (y, x) in seen:
                continue
            own, todo = set(), [(y, x)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < h and 0 <= j < w and (i, j) not in own and c[i, j] == c[y, x]:
                    own.add((i, j))
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
            seen |= own
            out.append(own)
    return out


@settings(max_examples=80, deadline=None)
@given(seeds, sides, sides)
def test_mesh_is_the_greedy_one(seed, h, w):
    c = classes(seed, h, w)
    free, want = c >= 0, []
    for y in range(h):
        for x in range(w):
            if not free[y, x]:
                continue
            n = 1
            while x + n < w and free[y, x + n] and c[y, x + n] == c[y, x]:
                n += 1
            m = 1
            while y + m < h and all(free[y + m, x + k] and c[y + m, x + k] == c[y, x] for k in range(n)):
                m += 1
            free[y : y + m, x : x + n] = False
            want.append((x, y, n, m, int(c[y, x])))
    assert vectorize.mesh(c.astype(np.int64), -1) == want


@settings(max_examples=80, deadline=None)
@given(seeds, sides, sides)
def test_contours_are_all_boundary_edges_once(seed, h, w):
    lab = regions.label(classes(seed, h, w))
    want = set()
    for y in range(h):
        for x in range(w):
            for dx, dy, a, b in ((0, -1, (x, y), (x + 1, y)), (1, 0, (x + 1, y), (x + 1, y + 1)), (0, 1, (x + 1, y + 1), (x, y + 1)), (-1, 0, (x, y + 1), (x, y))):
                other = lab[y + dy, x + dx] if 0 <= y + dy < h and 0 <= x + dx < w else -2
                if lab[y, x] >= 0 and other != lab[y, x]:
                    want.add((int(lab[y, x]), a, b))
    got, area = [], {}
    for comp, pts, signed in geometry.contours(lab):
        loop = pts.tolist()
        twice = 0
        for (x, y), (u, v) in zip(loop, loop[1:] + loop[:1]):
            n = max(abs(u - x), abs(v - y))
            sx, sy = (u - x) // n, (v - y) // n
            got += [(comp, (x + sx * k, y + sy * k), (x + sx * (k + 1), y + sy * (k + 1))) for k in range(n)]
            twice += x * v - u * y
        assert signed * 2 == twice or signed == twice
        area[comp] = area.get(comp, 0) + twice / 2
    assert len(got) == len(set(got)) and set(got) == want
    assert area == {k: int((lab == k).sum()) for k in set(lab[lab >= 0].tolist())}


def plain_reduce(p, tolerance):
    """Indices that Douglas and Peucker keep, by recursion."""
    if len(p) < 3:
        return list(range(len(p)))
    (ax, ay), (bx, by) = p[0], p[-1]
    n2 = (bx - ax) ** 2 + (by - ay) ** 2

    def far(q):
        t = max(0.0, min(1.0, ((q[0] - ax) * (bx - ax) + (q[1] - ay) * (by - ay)) / n2)) if n2 else 0.0
        return math.hypot(q[0] - ax - t * (bx - ax), q[1] - ay - t * (by - ay))

    d = [far(q) for q in p]
    k = max(range(1, len(p) - 1), key=lambda i: (d[i], -i))
    if d[k] <= tolerance:
        return [0, len(p) - 1]
    return plain_reduce(p[: k + 1], tolerance)[:-1] + [k + i for i in plain_reduce(p[k:], tolerance)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=2, max_size=20), st.floats(0.1, 5))
def test_polylines_are_reduced_like_the_recursion(pts, tolerance):
    assert geometry.douglas_peucker(np.array(pts, float), tolerance) == plain_reduce(pts, tolerance)


def plain_thin(m):
    h, w = m.shape
    m = m.copy()
    at = lambda y, x: int(m[y, x]) if 0 <= y < h and 0 <= x < w else 0
    while True:
        before = m.copy()
        for odd in (0, 1):
            gone = []
            for y in range(h):
                for x in range(w):
                    if not m[y, x]:
                        continue
                    p2, p3, p4, p5, p6, p7, p8, p9 = (at(y + i, x + j) for i, j in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)))
                    c = (not p2 and (p3 or p4)) + (not p4 and (p5 or p6)) + (not p6 and (p7 or p8)) + (not p8 and (p9 or p2))
                    n = min((p9 or p2) + (p3 or p4) + (p5 or p6) + (p7 or p8), (p2 or p3) + (p4 or p5) + (p6 or p7) + (p8 or p9))
                    e = ((p6 or p7 or not p9) and p8) if odd == 0 else ((p2 or p3 or not p5) and p4)
                    if c == 1 and 2 <= n <= 3 and not e:
                        gone.append((y, x))
            for y, x in gone:
                m[y, x] = 0
        if (m == before).all():
            return m


@settings(max_examples=60, deadline=None)
@given(seeds, sides, sides, st.floats(0.3, 0.95))
def test_thinning_is_that_of_guo_and_hall(seed, h, w, share):
    m = (np.random.default_rng(seed).random((h, w)) < share).astype(np.int64)
    assert (geometry.thin(m) == plain_thin(m)).all()


@settings(max_examples=80, deadline=None)
@given(seeds, sides, sides, st.integers(0, 8), st.booleans())
def test_despeckling_is_that_of_a_plain_loop(seed, h, w, least, isolated):
    c = classes(seed, h, w)
    out = c.copy()
    comps = flood(c)
    of = {p: k for k, own in enumerate(comps) for p in own}
    small = sorted((k for k, own in enumerate(comps) if len(own) < least), key=lambda k: (len(comps[k]), k)) if least > 1 else []

    def near(k):
        return [(i, j) for y, x in sorted(comps[k]) for i, j in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= i < h and 0 <= j < w and (i, j) not in comps[k]]

    if isolated:
        small = [k for k in small if len({int(c[p]) for p in near(k)}) <= 1]
    waiting, merged = set(small), 0
    for k in small:
        votes = {}
        for p in near(k):
            if of.get(p) not in waiting:
                v = int(out[p]) if p in of else -1
                votes[v] = votes.get(v, 0) + 1
        if votes:
            for p in comps[k]:
                out[p] = max(votes, key=votes.get)
            waiting.discard(k)
            merged += 1
    got, n = regions.despeckled(c, least, isolated=isolated)
    assert (got == out).all() and n == merged


@settings(max_examples=60, deadline=None)
@given(seeds, sides, sides)
def test_exact_documents_are_lossless(seed, h, w):
    r = np.random.default_rng(seed)
    px = r.choice(np.array([[0, 0, 0, 0], [250, 10, 0, 255], [17, 34, 51, 255], [9, 9, 200, 128]], np.uint8), (h, w))
    p = planes(px)
    for make in (vectorize.by_rectangles, vectorize.by_contours):
        assert (vectorize.rendered(make(p)[0], w, h) == vectorize.keys_of(p)).all()


@settings(max_examples=60, deadline=None)
@given(seeds, sides, sides)
def test_arcs_hold_every_edge_once(seed, h, w):
    lab = regions.label(classes(seed, h, w, 2))
    edges = {}
    for a in geometry.arcs_of(lab):
        for p, q in zip(a["points"], a["points"][1:]):
            assert abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1
            edges[frozenset((p, q))] = edges.get(frozenset((p, q)), 0) + 1
        assert len(a["faces"]) in (1, 2) and len({back for _, _, back in a["faces"]}) == len(a["faces"])
    want = set()
    pad = np.pad(lab, 1, constant_values=-2)
    for y in range(h + 1):
        for x in range(w + 1):
            a, b, c = pad[y, x + 1], pad[y + 1, x + 1], pad[y + 1, x]
            if x < w and a != b and max(a, b) >= 0:
                want.add(frozenset(((x, y), (x + 1, y))))
            if y < h and c != b and max(c, b) >= 0:
                want.add(frozenset(((x, y), (x, y + 1))))
    assert set(edges) == want and set(edges.values()) <= {1}


@settings(max_examples=60, deadline=None)
@given(seeds, st.integers(1, 12), st.integers(2, 40))
def test_alpha_levels_cover_what_occurs(seed, most, used):
    r = np.random.default_rng(seed)
    hist = np.zeros(256, np.int64)
    hist[r.choice(256, used, replace=False)] = r.integers(1, 50, used)
    levels = quantize.levels_of(hist, most)
    assert levels == sorted(set(levels)) and len(levels) <= max(most + 2, 2)
    assert all(v in levels for v in (0, 255) if hist[v] and used > most)
    if used <= most:
        assert levels == np.flatnonzero(hist).tolist()
