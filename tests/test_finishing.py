"""Outlines, curves, stops, icon sets, animations, PDFs and whole-image operators, against plain loops and against SQL."""

import io
import math
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.functions import markup
from rasterloom.operators import fullref, outline, regions, whole
from rasterloom.operators.geometry import contours
from rasterloom.plans import assets, vectorize
from rasterloom.queries import finishing, misc
from rasterloom.queries import whole as whole_queries
from rasterloom.sources import codecs

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")


# -- against SQL


@needs_data
@pytest.mark.parametrize("module", [whole_queries, finishing])
def test_queries_against_sql(spark, module):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "part", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in module.ORACLE.items():
        got = module.QUERIES[name](spark, SF).toPandas()
        want = c.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        rows = [sorted(map(repr, ([None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float, np.number, np.bool_)) else str(v) for v in r] for r in d[sorted(d.columns)].to_numpy().tolist()))) for d in (got, want)]
        assert rows[0] == rows[1], name


#: Images whose interior noise is the limit of auto_options, 9.
AT_THE_LIMIT = [
    [114, 133, 125, 149, 94, 121, 112, 137, 131, 130, 134, 125, 122, 130, 142, 107, 120, 133, 139, 148, 141, 117, 135, 103, 104, 131, 106, 122, 124, 110, 127, 116, 161, 114, 119, 132, 131, 172, 150, 112, 140, 162, 143, 122, 129, 139, 128, 121, 104, 121, 130, 109, 123, 115, 101, 147, 120, 148, 160, 147, 126, 139, 128, 120],
    [123, 134, 137, 145, 113, 123, 124, 113, 130, 103, 142, 146, 137, 148, 147, 106, 93, 137, 112, 151, 139, 146, 139, 138, 115, 118, 137, 118, 117, 119, 112, 117, 111, 122, 129, 121, 115, 108, 111, 123, 108, 149, 157, 127, 121, 128, 141, 107, 93, 93, 142, 157, 127, 114, 137, 134, 105, 113, 122, 108, 139, 141, 112, 124],
]


def _against_sql(spark, tmp_path, module, name, vectors):
    duckdb = pytest.importorskip("duckdb")
    at = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(at)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{at}/*.parquet'")
    return [sorted(map(tuple, d[sorted(d.columns)].to_numpy().tolist())) for d in (module.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(module.ORACLE[name]).df())]


def test_noise_at_the_limit_is_not_decided_by_rounding(spark, tmp_path):
    got, want = _against_sql(spark, tmp_path, finishing, "auto_options", [[v / 127.5 - 1 for v in image] for image in AT_THE_LIMIT])
    assert got == want and all(r[-1] for r in got)
    flat = spark.createDataFrame([(k, 3, False, 9 + d) for k, d in enumerate((-1e-14, 2e-15, 1e-14, 1e-5))], "img_id int, colours int, capped boolean, noise double")
    assert [r["subpixel"] for r in vectorize.auto_options(flat, 9.0).orderBy("img_id").collect()] == [True, True, True, False]


def test_gcode_keeps_the_sign_of_zero_as_sql_does(spark, tmp_path):
    firsts = [-0.00003, 0.00003, -0.0, 0.0, -0.00004999, -0.0000501, 0.64, 0.6400003]
    got, want = _against_sql(spark, tmp_path, misc, "gcode_lines", [[x, y, *[0.125] * 62] for x in firsts for y in firsts])
    assert got == want and any("X-0 " in r[0] for r in got) and any("X0 " in r[0].split("M3")[0] for r in got)
    lines = spark.createDataFrame([(1, 0, [(-0.0001, 1.0), (2.0, 64.0)])], "id int, line int, points array<struct<x:double,y:double>>")
    assert "G0 X0 Y63" in markup.gcode(lines, "id", 64).first()["text"], "the operator writes 0"


# -- outlines


def plain_smooth(pts, band, passes, pinned):
    home = [tuple(map(float, p)) for p in pts]
    now = list(home)
    n = len(home)
    for _ in range(passes):
        new = []
        for i, (x, y) in enumerate(now):
            if pinned[i]:
                new.append((x, y))
                continue
            (ax, ay), (bx, by) = now[i - 1], now[(i + 1) % n]
            dx, dy = (x + (ax + bx) / 2) / 2 - home[i][0], (y + (ay + by) / 2) / 2 - home[i][1]
            d = math.hypot(dx, dy)
            k = band / d if d > band else 1.0
            new.append((home[i][0] + dx * k, home[i][1] + dy * k))
        now = new
    return now


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=4, max_size=20), st.floats(0.1, 2), st.integers(1, 5), st.data())
def test_smoothing_is_that_of_a_plain_loop(pts, band, passes, data):
    pinned = [data.draw(st.booleans()) for _ in pts]
    got = outline.smoothed(np.array(pts), band, passes, np.array(pinned))
    assert np.allclose(got, plain_smooth(pts, band, passes, pinned))
    assert np.allclose(outline.smoothed(np.array(pts), band, passes), plain_smooth(pts, band, passes, [False] * len(pts)))
    assert (np.hypot(*(got - np.array(pts)).T) <= band + 1e-9).all()


def test_little_or_nothing_to_smooth():
    tri = np.array([[0, 0], [4, 0], [0, 4]])
    assert (outline.smoothed(tri) == tri).all() and (outline.smoothed(np.zeros((9, 2)), 0.5, 0) == 0).all() and len(outline.smoothed(np.zeros((0, 2)))) == 0


def areas(seed, h=14, w=17):
    r = np.random.default_rng(seed)
    return regions.label(np.kron(r.integers(0, 3, ((h + 2) // 3, (w + 2) // 3)), np.ones((3, 3), int))[:h, :w])


def test_neighbours_agree_on_their_outline():
    for seed in range(6):
        lab = areas(seed)
        degrees = outline.crack_degrees(lab)
        places = {}
        for _, pts, _ in contours(lab):
            d = outline.dense(pts)
            assert (np.abs(np.diff(np.vstack([d, d[:1]]), axis=0)).sum(1) == 1).all()
            new = outline.smoothed(d, 0.75, 3, outline.pins(d, degrees))
            for p, q in zip(map(tuple, d.tolist()), new):
                places.setdefault(p, []).append(q)
        assert all(np.allclose(v, v[0]) for v in places.values()) and any(not np.allclose(v[0], k) for k, v in places.items())


def test_faces_are_rebuilt_from_their_arcs():
    for seed in range(6):
        lab = areas(seed)
        points, faces = outline.faces_of(lab)
        loops = contours(lab)
        assert len(faces) == len(loops)
        for number, (comp, uses) in faces.items():
            got = outline.rebuilt_face([(points[k], back) for k, back in uses])
            want = outline.dense(loops[number][1])
            i = next(i for i in range(len(want)) if (np.roll(want, -i, 0) == got).all())
            assert loops[number][0] == comp and i >= 0


def test_shared_arcs_have_one_curve(spark):
    rows, labels = [], {s: areas(s) for s in range(3)}
    for s, lab in labels.items():
        rows += [(s, lab.shape[1], lab.shape[0], x, y, int(lab[y, x])) for y in range(lab.shape[0]) for x in range(lab.shape[1])]
    px = spark.createDataFrame(rows, "img_id int, width int, height int, x int, y int, comp int")
    got = outline.fitted_faces(px, precision=3).collect()
    assert len(got) == sum(len(contours(lab)) for lab in labels.values())
    for s, lab in labels.items():
        area = {}
        for r in got:
            if r["img_id"] == s:  # flattened, the faces still tile the image
                nums = [float(v) for v in re.findall(r"-?\d*\.?\d+", r["d"])]
                assert r["d"].startswith("M") and r["d"].endswith("Z") and len(nums) >= 6
                start, segs = tuple(nums[:2]), [(c, *[float(v) for v in re.findall(r"-?\d*\.?\d+", body)]) for c, body in re.findall(r"([LC])([^LCZ]*)", r["d"])]
                p = outline.flattened_path(start, segs, 24)
                q = np.roll(p, -1, 0)
                area[r["comp"]] = area.get(r["comp"], 0) + float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)
        assert sum(area.values()) == pytest.approx(lab.size, rel=1e-3)


def test_a_mosaic_tiles_the_image():
    from rasterloom.plans.vectorize import Options, mosaic, traced

    p = pictures()[0].copy()
    p[4:15, 6:20] = (250, 30, 30, 255)
    for subpixel in (False, True, None):
        o = Options(colours=5, subpixel=subpixel, precision=3)
        svg, n = mosaic(assets.planes(p), o)
        area = 0.0
        for d in re.findall(r' d="([^"]*)"', svg):
            area += _signed(d)
        assert n == svg.count("<path") and abs(area) == pytest.approx(p.shape[0] * p.shape[1], rel=2e-2)
        assert traced(assets.planes(p), o)[0].startswith("<svg")


def test_traced_gradients():
    from rasterloom.plans.vectorize import Options, traced

    y, x = np.mgrid[0:40, 0:60]
    p = np.stack([40 + 3 * x, 60 + x, 200 - 3 * x, np.full_like(x, 255)], -1).astype(np.uint8)
    p[10:25, 20:40] = (250, 240, 20, 255)
    plain, _ = traced(assets.planes(p), Options(colours=2))
    svg, counts = traced(assets.planes(p), Options(colours=2, gradients=True))
    assert "Gradient" not in plain and svg.count("<linearGradient") >= 1
    ids = set(re.findall(r'<linearGradient id="(g\d+)"', svg)) | set(re.findall(r'<radialGradient id="(g\d+)"', svg))
    assert ids and ids == set(re.findall(r'fill="url\(#(g\d+)\)"', svg)) and "#faf014" in svg


def _signed(d):
    """The area that compact path data encloses, curves by their chords and handles."""
    total, at, start = 0.0, (0.0, 0.0), (0.0, 0.0)
    for letter, body in re.findall(r"([Mmhvlcqz])([^Mmhvlcqz]*)", d):
        n = [float(x) for x in re.findall(r"-?(?:\d+\.?\d*|\.\d+)", body)]
        if letter in "Mm":
            at = start = (n[0], n[1]) if letter == "M" else (at[0] + n[0], at[1] + n[1])
            continue
        if letter == "z":
            total += at[0] * start[1] - start[0] * at[1]
            at = start
            continue
        step = {"h": 1, "v": 1, "l": 2, "c": 6}[letter]
        for i in range(0, len(n), step):
            v = n[i : i + step]
            v = [v[0], 0] if letter == "h" else [0, v[0]] if letter == "v" else v
            q = [(at[0] + x, at[1] + y) for x, y in zip(v[::2], v[1::2])]
            line = outline.flattened_path(at, [("C", *[x for p in q for x in p])], 24) if letter == "c" else np.array([at, q[-1]])
            total += float((line[:-1, 0] * line[1:, 1] - line[1:, 0] * line[:-1, 1]).sum())
            at = q[-1]
    return total / 2


@pytest.mark.parametrize(("start", "sweep"), [(0.3, 1.2), (2.0, 2.6), (-0.4, 4.4), (4.0, 0.9)])
def test_sectors_are_found(start, sweep):
    from rasterloom.operators.geometry import detect_primitive, detect_sector
    from rasterloom.plans.vectorize import primitive_text

    y, x = np.mgrid[0:90, 0:90] + 0.5
    d, a = np.hypot(x - 44, y - 46), (np.arctan2(y - 46, x - 44) - start) % (2 * math.pi)
    (loop,) = [p for c, p, _ in contours(((d <= 38) & (a <= sweep)).astype(np.int64)) if c == 1]
    s = detect_sector(loop)
    assert detect_primitive(loop) is None and abs(s["r"] - 38) < 1.5 and abs(s["sweep"] - sweep) < 0.12 and math.hypot(s["cx"] - 44, s["cy"] - 46) < 2.5
    assert re.fullmatch(rf'<path d="M[-\d. ]+L[-\d. ]+A[\d.]+ [\d.]+ 0 {int(sweep > math.pi)} 1 [-\d. ]+Z"/>', primitive_text(s))


def test_what_is_no_sector():
    from rasterloom.operators.geometry import detect_sector

    y, x = np.mgrid[0:60, 0:60] + 0.5
    for mask in ((x > 8) & (x < 50) & (y > 8) & (y < 50), (y > 8) & (x > 8) & (x + y < 60), np.hypot(x - 30, y - 30) < 22, (np.abs(x - 30) < 4) | (np.abs(y - 30) < 4)):
        loops = [p for c, p, _ in contours(mask.astype(np.int64)) if c == 1]
        assert all(detect_sector(p) is None for p in loops)


def test_square_corners():
    p = np.array([[0, 0.2], [10, 0], [10.3, 8], [0, 8.1]])
    q, forced = outline.square_corners(p, [0, 1, 2, 3], 5)
    assert forced and all(q[c, 0] == q[c - 1, 0] or q[c, 1] == q[c - 1, 1] or q[c, 0] == q[(c + 1) % 4, 0] for c in forced)
    slanted = np.array([[0, 0], [5, 5], [0, 10], [-5, 5]])
    assert outline.square_corners(slanted, [0, 1, 2, 3], 5)[1] == set() and outline.square_corners(p, [0, 1])[1] == set()


def test_reversed_paths_run_along_the_same_points():
    start, segs = (0.0, 1.0), [("L", 3.0, 1.0), ("Q", 4.0, 2.0, 5.0, 0.0), ("C", 6.0, 1.0, 7.0, -1.0, 8.0, 4.0)]
    end, back = outline.reversed_path(start, segs)
    assert end == (8.0, 4.0) and back[-1][-2:] == start
    assert np.allclose(outline.flattened_path(start, segs)[::-1][:11], outline.flattened_path(end, back)[:11])
    assert outline.reversed_path(end, back) == (start, segs)


def test_quadratics_stay_within_the_error():
    t = np.linspace(0, math.pi, 60)
    pts = np.stack([20 * np.cos(t), 20 * np.sin(t)], 1)
    start, segs = outline.fit_open(pts, 0.0, 0.1)
    assert {s[0] for s in segs} == {"C"} and outline.distance_to(pts, outline.flattened_path(start, segs, 64)).max() < 0.2
    for error in (0.01, 0.3, 2.0):
        got = outline.as_quadratics(start, segs, pts, error)
        assert [s[-2:] for s in got] == [s[-2:] for s in segs]
        if any(s[0] == "Q" for s in got):
            assert outline.distance_to(pts, outline.flattened_path(start, got, 64)).max() <= max(error, 0.2) + 0.02
    assert all(s[0] == "Q" for s in outline.as_quadratics(start, segs, pts, 2.0)) and all(s[0] == "C" for s in outline.as_quadratics(start, segs, pts, 1e-6))
    c = np.array([[0, 0], [1, 3], [4, -2], [6, 1]], float)
    q = np.array([c[0], c[0] + (outline.quadratic_of(c) - c[0]) * 2 / 3, c[3] + (outline.quadratic_of(c) - c[3]) * 2 / 3, c[3]])
    far = np.hypot(*(outline._bezier(c, np.linspace(0, 1, 500)) - outline._bezier(q, np.linspace(0, 1, 500))).T).max()
    assert far == pytest.approx(outline.quadratic_deviation(c), rel=1e-3)


def test_open_arcs_keep_their_ends():
    p = np.array([[0, 0], [0, 4], [1, 4], [1, 8], [6, 8]])
    start, segs = outline.fit_open(p)
    assert start == (0, 0) and segs[-1][-2:] == (6, 8)
    assert outline.fit_open(np.array([[1, 1], [5, 1]])) == ((1.0, 1.0), [("L", 5.0, 1.0)])


def test_corner_cuts_separate_long_runs():
    right, down = (1, 0), (0, 1)
    steps = np.array([right] * 5 + [down] * 5 + [right, down, right, down] + [right] * 5)
    assert np.flatnonzero(outline.corner_cuts(steps, False)).tolist() == [5]
    square = np.array([right] * 5 + [down] * 5 + [(-1, 0)] * 5 + [(0, -1)] * 5)
    assert np.flatnonzero(outline.corner_cuts(square, True)).tolist() == [0, 5, 10, 15]
    assert np.flatnonzero(outline.corner_cuts(np.roll(square, 2, 0), True)).tolist() == [2, 7, 12, 17], "a run over the seam is one"
    assert not outline.corner_cuts(np.array([right] * 9), True).any() and len(outline.corner_cuts(np.zeros((0, 2)), False)) == 1


def test_a_disc_is_found_below_the_pixel():
    n, c, r = 40, 20.3, 12.4
    sub = (np.arange(n * 8) + 0.5) / 8
    cover = ((sub[:, None] - c) ** 2 + (sub[None] - c) ** 2 <= r * r).reshape(n, 8, n, 8).mean((1, 3))
    ink, paper = np.array([20, 40, 200, 255]), np.array([250, 240, 230, 255])
    px = np.floor(cover[..., None] * ink + (1 - cover[..., None]) * paper + 0.5).astype(int)
    lab = (cover >= 0.5).astype(np.int64)
    far = {}
    for own, pts, _ in contours(lab):
        if own == 1:
            d = outline.dense(pts)
            new, moved = outline.refined(d, px, lab, 1)
            far = {k: np.abs(np.hypot(*(v - c).T) - r).mean() for k, v in (("lattice", d), ("refined", new))}
            arc, kept = outline.refined(d[:20], px, lab, 1, closed=False)
            assert (arc[[0, -1]] == d[[0, 19]]).all() and kept and np.allclose(arc[3:17], new[3:17])
            assert moved > len(d) / 2 and np.abs(new - d).max() <= outline.SHIFT + 1e-9
    assert far["refined"] < 0.75 * far["lattice"]
    flat = np.where(lab[..., None] == 1, ink, paper)
    new, moved = outline.refined(d, flat, lab, 1)
    assert moved == 0 and (new == d).all(), "hard edges stay on the lattice"
    assert outline.refined(d, np.full((n, n, 4), 9), lab, 1)[1] == 0 and outline.refined(d[:1], px, lab, 1)[1] == 0


def test_contradicting_displacements_give_way_to_the_median():
    moves = np.array([[0.3, 0], [0.4, 0], [-0.4, 0], [0.3, 0], [0.3, 0], [0.0, 0.1]])
    on, none = np.ones(6, bool), np.zeros(6, bool)
    got = outline.median_displacements(moves, on, none, False)
    assert got[2, 0] == 0.3 and got[5].tolist() == [0.0, 0.1]
    steady = np.full((6, 2), 0.3)
    assert (outline.median_displacements(steady, on, none, True) == steady).all()
    cut = none.copy()
    cut[2] = True
    assert outline.median_displacements(moves, on, cut, False)[0].tolist() == [0.3, 0], "the window ends at a corner"
    assert (outline.median_displacements(moves, none, none, True) == 0).all() and len(outline.median_displacements(np.zeros((0, 2)), none[:0], none[:0], True)) == 0


def test_axes_are_combined():
    c = outline.combine_axes
    assert c((3.0, 0.0), (2, 0), (False, False)) == (1.5, 0.0) and c((0.0, 3.0), (0, 2), (True, True)) == (0.0, 1.5)
    assert c((4.0, 1.0), (1, 1), (True, False)) == (0.0, 1.0) and c((1.0, 4.0), (1, 1), (False, True)) == (1.0, 0.0)
    assert c((1.0, 3.0), (1, 1), (True, True)) == c((1.0, 3.0), (1, 1), (False, False)) == (0.5, 1.5) and c((0.0, 0.0), (0, 0), (False, False)) == (0.0, 0.0)


def test_stops_go_where_the_ramp_bends():
    bend = np.concatenate([np.linspace((255, 0, 0), (0, 255, 0), 11), np.linspace((0, 255, 0), (0, 0, 255), 11)[1:]])
    got = outline.select_stops(bend.astype(int), np.ones(21))
    assert got[:1] == [0] and 10 in got and got[-1] == 20
    assert outline.select_stops(np.linspace((0, 0, 0), (200, 200, 200), 21).astype(int), np.ones(21), target=1e-4) == [0, 20]
    assert len(outline.select_stops(np.random.default_rng(1).integers(0, 256, (40, 3)), np.ones(40), most=5)) == 5
    stops = outline.rendered_stops(np.array([0.25, 0.75]), np.array([[0, 10, 20], [100, 10, 0]]), np.array([0.0, 0.5, 1.0]))
    assert stops.tolist() == [[0, 10, 20], [50, 10, 10], [100, 10, 0]]


def test_gradients_are_found():
    from rasterloom.operators import paint

    y, x = (v.ravel() + 0.5 for v in np.mgrid[0:40, 0:60])
    t = (x * 0.8 + y * 0.6) / (60 * 0.8 + 40 * 0.6)
    line = np.floor(np.outer(1 - t, (250, 40, 10)) + np.outer(t, (20, 60, 220)) + 0.5).astype(int)
    g = paint.paint_of(x, y, line)
    x1, y1, x2, y2 = g["place"]
    n = math.hypot(x2 - x1, y2 - y1)
    assert g["kind"] == "linear" and abs(abs((x2 - x1) / n) - 0.8) < 0.03 and g["error"] < 0.05 * g["flat"]
    r = np.hypot(x - 25, y - 18) / 45
    disc = np.floor(np.outer(1 - r, (255, 250, 200)) + np.outer(r, (30, 10, 90)) + 0.5).clip(0, 255).astype(int)
    g = paint.paint_of(x, y, disc)
    assert g["kind"] == "radial" and abs(g["place"][0] - 25) < 1.5 and abs(g["place"][1] - 18) < 1.5 and g["error"] < 0.1 * g["flat"]
    assert re.fullmatch(r'<radialGradient id="a" gradientUnits="userSpaceOnUse" cx="[\d.]+" cy="[\d.]+" r="[\d.]+">(<stop offset="[\d.]+" stop-color="#[0-9a-f]{6}"/>)+</radialGradient>', paint.definition(g, "a"))
    noise = np.random.default_rng(2).integers(0, 256, (len(x), 3))
    assert paint.paint_of(x, y, noise) is None and paint.paint_of(x, y, np.full((len(x), 3), 9)) is None and paint.paint_of(x[:20], y[:20], line[:20]) is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=3))
def test_top_eigenvector_is_that_of_numpy(v):
    m = np.array([[v[0] ** 2 + v[1] ** 2, v[0] * v[2]], [v[0] * v[2], v[2] ** 2 + 0.1]])
    got = np.array(outline.top_eigenvector(m[0, 0], m[0, 1], m[1, 1]))
    values = np.linalg.eigvalsh(m)
    assert np.allclose(m @ got, values[-1] * got, atol=1e-6) or values[1] - values[0] < 1e-6
    assert outline.top_eigenvector(0, 0, 0) is None
    assert np.allclose(outline.solve3(np.diag([1.0, 2, 4]), np.array([1.0, 2, 4])), 1) and outline.solve3(np.zeros((3, 3)), np.ones(3)) is None


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9))
def test_only_enclosed_runts_are_absorbed(seed, least):
    r = np.random.default_rng(seed)
    lab = regions.label(r.integers(0, 3, (7, 8)))
    idx = np.arange(lab.size).reshape(lab.shape)
    u = np.concatenate([idx[:, :-1].ravel(), idx[:-1].ravel()])
    v = np.concatenate([idx[:, 1:].ravel(), idx[1:].ravel()])
    first = np.array([np.flatnonzero(lab.ravel() == k)[0] for k in range(lab.max() + 1)])
    roots = first[lab.ravel()]
    got = regions.without_runts(roots, u, v, least)
    for k in set(got.tolist()):
        inside = set(roots[got == k].tolist())
        assert k in inside
    size = {k: int((roots == k).sum()) for k in set(roots.tolist())}
    for k in set(roots.tolist()):
        around = [int(b if a == k else a) for a, b in zip(roots[u].tolist(), roots[v].tolist()) if (a == k) != (b == k)]
        most = max((around.count(x) for x in set(around)), default=0)
        joined = bool((got[roots == k] != k).any())
        if joined:
            assert size[k] < least and most >= 0.67 * len(around)


# -- whole images


def pictures(n=3, h=23, w=31):
    r = np.random.default_rng(4)
    return [np.where(r.random((h, w, 1)) < 0.15 * k, r.integers(0, 256, (h, w, 4)), np.stack([np.add.outer(np.arange(h) * 5, np.arange(w) * 3) % 256] * 3 + [np.full((h, w), 255)], -1)).astype(np.uint8) for k in range(n)]


@pytest.fixture(scope="module")
def images(spark):
    rows = [(k, p.shape[1], p.shape[0], p.tobytes()) for k, p in enumerate(pictures())]
    return spark.createDataFrame([*rows, (90, None, None, None)], "img_id int, width int, height int, data binary")


def test_whole_images_give_what_pixel_rows_give(spark, images):
    from rasterloom.operators import compare, histogram, stencil
    from rasterloom.sources.rasters import to_pixels

    px = to_pixels(images, "img_id").cache()
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(whole.colour_histogram(images), histogram.colour_histogram(px))
    assert same(whole.otsu(images), histogram.otsu(px))
    a, b = (d.orderBy("img_id").toPandas() for d in (whole.flatness(images, 50), histogram.flatness(px, cap=50)))
    assert np.allclose(a[b.columns].astype(float), b.astype(float))
    soft = whole.selective_blur(images, 2)
    assert same(to_pixels(soft, "img_id"), stencil.selective_blur(px, 2).select("img_id", "width", "height", "x", "y", "r", "g", "b", "a"))
    both = whole.pairs(images, soft)
    for got, want in ((whole.report(both), fullref.report(px, to_pixels(soft, "img_id"))), (whole.heat_map(both).drop("width", "height", "data"), compare.heat_summary(compare.heat_map(compare.pairs(px, to_pixels(soft, "img_id")))))):
        a, b = (d.orderBy("img_id").toPandas() for d in (got, want))
        assert len(a) == 3 and np.allclose(a[b.columns].fillna(-1).astype(float), b.fillna(-1).astype(float), atol=1e-7)
    parts = whole.components(images, lambda p: p[..., 0] >> 6)
    want = regions.components(regions.label_components(px.selectExpr("*", "shiftright(r, 6) as class")))
    assert same(parts, want.select(*parts.columns))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 3), st.integers(0, 10**6))
def test_labels_are_those_of_a_flood(h, w, k, seed):
    c = np.random.default_rng(seed).integers(-1, k, (h, w))
    want, n = np.full((h, w), -1), 0
    for y in range(h):
        for x in range(w):
            if c[y, x] >= 0 and want[y, x] < 0:
                todo = [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < h and 0 <= j < w and want[i, j] < 0 and c[i, j] == c[y, x]:
                        want[i, j] = n
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
                n += 1
    assert (regions.label(c) == want).all()


def plain_despiked(p):
    """Pixel by pixel."""
    h, w = p.shape[:2]
    pm = lambda y, x: [float(p[y, x, c]) * p[y, x, 3] / 255 for c in range(3)] + [float(p[y, x, 3])]
    gap = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    gray = lambda y, x: int(max(p[y, x, :3])) - int(min(p[y, x, :3])) <= 2

    def walk(y, x, dx, dy):
        line = []
        for k in range(1, 9):
            i, j = y + dy * k, x + dx * k
            if not (0 <= i < h and 0 <= j < w):
                break
            line.append((i, j))
        for a, b, c in zip(line, line[1:], line[2:]):
            if gap(pm(*a), pm(*b)) <= 16 and gap(pm(*b), pm(*c)) <= 16:
                return a

    out = p.copy()
    for y in range(h):
        for x in range(w):
            near = [p[i, j] for i in range(max(0, y - 1), min(h, y + 2)) for j in range(max(0, x - 1), min(w, x + 2))]
            if all((q == p[y, x]).all() for q in near):
                continue
            best = (0.0, None)
            for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
                a, b = walk(y, x, -dx, -dy), walk(y, x, dx, dy)
                if not a or not b or gap(pm(*a), pm(*b)) < 3000:
                    continue
                u, v, q = pm(*a), pm(*b), pm(y, x)
                d = [j - i for i, j in zip(u, v)]
                n2 = sum(k * k for k in d)
                t = sum((k - i) * m for k, i, m in zip(q, u, d)) / n2
                over = (t * t if t < 0 else (t - 1) ** 2) * n2
                aside = gap(q, [i + t * m for i, m in zip(u, d)])
                if 0 <= t <= 1 or aside > 300 or over < 500 or (gray(*a) and gray(*b) and gray(y, x) and over > 0.5 * n2):
                    continue
                if over > best[0]:
                    best = (over, u if t < 0 else v)
            if best[1]:
                al = best[1][3]
                out[y, x] = [min(255, max(0, round(c * 255 / al))) for c in best[1][:3]] + [round(al)] if al > 0 else 0
    return out


def test_ringing_is_clipped():
    r = np.random.default_rng(7)
    touched = 0
    for k in range(6):
        p = np.zeros((14, 26, 4), np.uint8)
        left, right = r.integers(60, 200, (2, 3))
        p[:, :13, :3], p[:, 13:, :3], p[..., 3] = left, right, 255
        far = (right.astype(int) - left) * 0.35
        p[:, 12, :3], p[:, 13, :3] = np.clip(left - far, 0, 255), np.clip(right + far, 0, 255)
        if k % 2:
            p[r.random((14, 26)) < 0.06] = r.integers(0, 256, 4)
        if k == 5:
            p[:, 20:, 3] = 0
        got = whole.despiked(p)
        assert (got == plain_despiked(p)).all()
        touched += int((got != p).any())
    assert touched >= 3
    assert (whole.despiked(p[:2]) == p[:2]).all() and (whole.despiked(np.full((5, 5, 4), 7, np.uint8)) == 7).all()


# -- markup


def points_of(d):
    """Absolute points of relative path data, by a plain reader."""
    out, at, start, i = [], (0.0, 0.0), (0.0, 0.0), 0
    for letter, body in re.findall(r"([MmhvlcqzZ])([^MmhvlcqzZ]*)", d):
        n = [float(x) for x in re.findall(r"-?(?:\d+\.?\d*|\.\d+)", body)]
        if letter in "Mm":
            at = start = (n[0], n[1]) if letter == "M" else (at[0] + n[0], at[1] + n[1])
            out.append(at)
        elif letter == "z":
            at = start
        else:
            step = {"h": 1, "v": 1, "l": 2, "q": 4, "c": 6}[letter]
            for i in range(0, len(n), step):
                v = n[i : i + step]
                v = [v[0], 0] if letter == "h" else [0, v[0]] if letter == "v" else v
                out += [(at[0] + x, at[1] + y) for x, y in zip(v[::2], v[1::2])]
                at = out[-1]
    return out


coordinate = st.floats(-300, 300).map(lambda v: round(v, 3))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.tuples(st.just("L"), *[coordinate] * 2), st.tuples(st.just("Q"), *[coordinate] * 4), st.tuples(st.just("C"), *[coordinate] * 6)), min_size=1, max_size=8), min_size=1, max_size=3), st.integers(0, 3))
def test_compact_paths_keep_their_points(subs, precision):
    from rasterloom.operators.geometry import compact_path

    subs = [[("M", 5.0 * k, -3.0), *s] for k, s in enumerate(subs)]
    snap = lambda v: math.floor(v * 10**precision + 0.5) / 10**precision
    want = []
    for s in subs:
        at = start = (snap(s[0][1]), snap(s[0][2]))
        want.append(at)
        for k, (kind, *v) in enumerate(s[1:], 1):
            q = [(snap(x), snap(y)) for x, y in zip(v[::2], v[1::2])]
            if not (kind == "L" and (q[0] == at or (q[0] == start and k == len(s) - 1))):
                want += q
            at = q[-1]
    d = compact_path(subs, precision)
    got = points_of(d)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-6) and d.count("z") == len(subs)


def test_images_are_inlined_from_inside_only(spark):
    import base64

    from rasterloom.functions.markup import inline_images

    svg = '<svg><image href="a.png"/><image xlink:href=\'sub/../b%20c.JPG\' x="1"/><image href="../../etc/x.png"/><image href="/etc/passwd.png"/><image href="data:image/png;base64,AA"/><image href="https://h/a.png"/><image href="#i"/><image href="gone.png"/><image href="notes.txt"/><image/></svg>'
    docs = spark.createDataFrame([(1, svg, "/base/dir"), (2, "<svg/>", "/base"), (3, None, "/base"), (4, '<svg><image href="file:///base/dir/a.png"/></svg>', "/base/dir/")], "id int, svg string, base_dir string")
    files = spark.createDataFrame([("/base/dir/a.png", b"one"), ("/base/dir/b c.JPG", b"two"), ("/base/etc/x.png", b"no"), ("/etc/x.png", b"no"), ("/etc/passwd.png", b"no"), ("/base/dir/notes.txt", b"no")], "path string, content binary")
    r = {x["id"]: x for x in inline_images(docs, files).collect()}
    b64 = lambda b: base64.b64encode(b).decode()
    want = svg.replace('href="a.png"', f'href="data:image/png;base64,{b64(b"one")}"').replace("xlink:href='sub/../b%20c.JPG'", f'xlink:href="data:image/jpeg;base64,{b64(b"two")}"')
    assert r[1]["text"] == want and r[1]["inlined"] == ["/base/dir/a.png", "/base/dir/b c.JPG"] and r[1]["refused"] == ["../../etc/x.png", "/etc/passwd.png"]
    assert (r[2]["text"], r[3]["text"], r[2]["inlined"]) == ("<svg/>", None, []) and b64(b"one") in r[4]["text"]


def test_pdf_pages_are_counted(spark):
    from pyspark.sql import functions as F

    from rasterloom.functions.markup import pdf_page_count

    three = assets.image_pdf([(b"j", 5, 5)] * 3)
    tree = b"%PDF-1.5\n1 0 obj<</Type /Pages /Kids 3 0 R /Count 12>>endobj 2 0 obj<</Count 4/Type/Pages>>endobj"
    d = spark.createDataFrame([(1, three), (2, tree), (3, b"no pdf /Type /Page"), (4, None), (5, b"%PDF-1.7 nothing")], "id int, content binary")
    assert [x["n"] for x in d.select("id", pdf_page_count(F.col("content")).alias("n")).orderBy("id").collect()] == [3, 12, None, None, None]


def test_circles_stay_circles(spark):
    from pyspark.sql import functions as F

    from rasterloom.sources import export

    rows = [(1, 0, 100, 80, [(1.0, 2.0), (30.0, 2.0), (30.0, 40.0)], 255, 0, 51, 255, None, None, None), (1, 1, 100, 80, None, 0, 0, 255, 255, 50.0, 30.0, 12.5)]
    d = spark.createDataFrame(rows, "img_id int, ord int, width int, height int, points array<struct<x:double,y:double>>, r int, g int, b int, a int, cx double, cy double, radius double")
    text = {f.__name__: f(d).first()["text"] for f in (export.svg, export.dxf, export.eps, export.pdf)}
    assert '<circle cx="50" cy="30" r="12.5" fill="#0000ff"/>' in text["svg"] and text["svg"].count("<path") == 1
    assert "0\nCIRCLE\n8\nC0000FF\n" in text["dxf"] and "\n10\n50\n20\n50\n40\n12.5\n" in text["dxf"] and text["dxf"].count("LWPOLYLINE") == 1
    assert "50 50 12.5 0 360 arc" in text["eps"]
    pdf = text["pdf"]
    start = int(re.search(r"startxref\n(\d+)\n", pdf)[1])
    assert pdf[start : start + 4] == "xref" and pdf.count(" c\n") == 4 and "62.5 50 m" in pdf
    plain = d.drop("cx", "cy", "radius").filter("ord = 0")
    assert all(f(plain).first()["text"] == f(d.filter("ord = 0").withColumn("radius", F.lit(None).cast("double"))).first()["text"] for f in (export.svg, export.dxf, export.eps, export.pdf))


# -- sets of files


def test_icon_set(images):
    rows = assets.favicon_set(images.filter("img_id < 2"), "Name", theme="#123456", background=(1, 2, 3)).collect()
    files = {(r["img_id"], r["file"]): r for r in rows}
    assert len(files) == len(rows) == 14
    ico = codecs.icon_entries(bytes(files[0, "favicon.ico"]["bytes"]))
    assert [e.width for e in ico] == [16, 32, 48]
    for f, side in assets.PNG_ICONS.items():
        assert codecs.decode_png(bytes(files[1, f]["bytes"])).shape == (side, side, 4)
    masked = codecs.decode_png(bytes(files[0, "icon-maskable-512.png"]["bytes"]))
    assert (masked[:50, :, :3] == (1, 2, 3)).all() and (masked[..., 3] == 255).all()
    text = bytes(files[0, "manifest.webmanifest"]["bytes"]).decode()
    assert '"background_color": "#010203"' in text and text.count('"src"') == 3 and "#123456" in bytes(files[0, "head.html"]["bytes"]).decode()


def test_resizing_keeps_flat_colours_and_size():
    flat = np.full((5, 7, 4), (10, 200, 30, 255), np.uint8)
    assert (assets.resized(flat, 13, 3) == (10, 200, 30, 255)).all() and assets.resized(flat, 13, 3).shape == (3, 13, 4)
    p = pictures()[0]
    assert (assets.resized(p, p.shape[1], p.shape[0]) == p).all()
    clear = flat.copy()
    clear[:, :3] = (255, 0, 0, 0)
    assert (assets.resized(clear, 14, 10)[..., 0][assets.resized(clear, 14, 10)[..., 3] > 0] <= 12).all(), "what is transparent lends no colour"


def test_animation_has_one_palette(spark):
    frames = [np.full((12, 12, 4), (200 + k, 30, 30, 255), np.uint8) for k in range(3)]
    for f in frames:
        f[3:9, 3:9] = (20, 20, 220, 255)
    rows = [(7, k, 0, 12, 12, f.tobytes()) for k, f in enumerate(frames)]
    d = spark.createDataFrame(rows[::-1], "img_id int, frame int, delay_ms int, width int, height int, data binary")
    (r,) = assets.traced_animation(d).collect()
    assert (r["frames"], r["duration"]) == (3, 0.3) and r["text"].count('class="fr"') == 3
    svgs = [x["svg"] for x in assets.traced_frames(d).orderBy("frame").collect()]
    assert len(set(svgs)) == 1, "a drift of one level is one colour"


def test_placeholders_are_small(images):
    rows = assets.placeholder_svg(images).collect()
    assert len(rows) == 3 and all(r["svg"].startswith("<svg") and len(r["svg"]) < 4000 for r in rows)


def test_image_pdf_offsets(spark):
    pages = [(b"\xff\xd8one\xff\xd9", 96, 48), (b"\xff\xd8endobj 2 0 obj\xff\xd9", 10, 20)]
    pdf = assets.image_pdf(pages)
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", pdf)[1])
    assert pdf[start : start + 4] == b"xref"
    at = [int(m) for m in re.findall(rb"\n(\d{10}) 00000 n ", pdf[start:])]
    assert len(at) == 8 and all(pdf[p:].startswith(b"%d 0 obj\n" % k) for k, p in enumerate(at, 1))
    assert b"/MediaBox[0 0 72 36]" in pdf and b"/Count 2" in pdf and all(j in pdf for j, _, _ in pages)
    for bad in ({"pages": []}, {"pages": pages, "dpi": 0}, {"pages": pages, "dpi": float("nan")}):
        with pytest.raises(ValueError):
            assets.image_pdf(**bad)
    d = spark.createDataFrame([("b", 2, 10, 20, pages[1][0]), ("b", 1, 96, 48, pages[0][0]), ("c", 0, 1, 1, None)], "doc string, page int, width int, height int, jpeg binary")
    (r,) = assets.page_documents(d).collect()
    assert (r["doc"], r["n_pages"], bytes(r["bytes"])) == ("b", 2, pdf) and io.BytesIO(pdf).read(5) == b"%PDF-"
