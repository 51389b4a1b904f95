"""Queries: comparison, histograms, flatness, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import bindings as B
from rasterloom.functions.colour import gaussian
from rasterloom.operators import compare as C
from rasterloom.operators import fullref as R
from rasterloom.operators import histogram as H
from rasterloom.operators import stencil as S
from rasterloom.plans.vectorize import choose_mode, refine_gate
from rasterloom.queries.sql import GRAY, HEAT, PAIRS4, PAIRS8, RGBA4, SHEET, MIXED4, blur_cte, de2000_cte, half, lab_cte, luma

R6 = lambda c: F.round(c, 6).alias(c)


def _next(px: DataFrame) -> DataFrame:
    """Each image as the candidate of the one before it."""
    return px.withColumn("img_id", F.col("img_id") - 1)


def _pairs8(s: SparkSession, d: str) -> DataFrame:
    g = B.gray8(s, d)
    return C.pairs(g, _next(g), ("v",)).withColumnsRenamed({"p_v": "p", "q_v": "q"})


def _pairs4(s: SparkSession, d: str) -> DataFrame:
    p = B.rgba4(s, d, True)
    return C.pairs(p, _next(p))


def px_compare_basic(s: SparkSession, d: str) -> DataFrame:
    """Errors of each gray image against the next one."""
    both = _pairs8(s, d).withColumnsRenamed({"p": "p_v", "q": "q_v"})
    e = C.errors(both, ("v",))
    return e.select("img_id", "n", "exact", "max_diff", R6("mse"), R6("rmse"), R6("psnr"), "lossless")


def px_compare_rgba(s: SparkSession, d: str) -> DataFrame:
    """Errors of premultiplied RGBA pairs."""
    e = C.errors(C.premultiply_pairs(_pairs4(s, d)))
    return e.select("img_id", "n", "exact", "max_diff", R6("mse"), R6("psnr"))


def ssim_plane(s: SparkSession, d: str) -> DataFrame:
    return C.ssim(_pairs8(s, d), 8, 8).select("img_id", R6("ssim"))


def ssim_luma(s: SparkSession, d: str) -> DataFrame:
    return C.ssim_rgba(C.premultiply_pairs(_pairs4(s, d)), 4, 4).select("img_id", R6("ssim"), R6("ssim_luma"))


def delta_e_stats(s: SparkSession, d: str) -> DataFrame:
    return C.delta_e_stats(C.delta_e_field(_pairs4(s, d))).select("img_id", R6("de_mean"), R6("de_p95"), R6("de_max"))


def diff_heatmap(s: SparkSession, d: str) -> DataFrame:
    return C.heat_map(_pairs4(s, d)).select("img_id", "x", "y", R6("de"), "changed", "r", "g", "b")


def diff_summary(s: SparkSession, d: str) -> DataFrame:
    return C.heat_summary(C.heat_map(_pairs4(s, d))).select("img_id", "changed", "n", R6("fraction"), R6("de_max"), R6("de_mean"))


def _heat_field(s: SparkSession, d: str) -> DataFrame:
    return B.heat(s, d).withColumn("de", F.col("n").cast("double"))


def severity(s: SparkSession, d: str) -> DataFrame:
    """Coherence of an error field: the events' counts of an hour stand for delta E."""
    return C.severity(_heat_field(s, d), threshold=0.0).select("img_id", "differing", "coherent", "clusters", "largest", R6("mass"), R6("score"))


def composite_score(s: SparkSession, d: str) -> DataFrame:
    both = _pairs8(s, d)
    e = C.errors(both.withColumnsRenamed({"p": "p_v", "q": "q_v"}), ("v",)).join(C.ssim(both, 8, 8), "img_id")
    return e.select("img_id", F.round(C.composite(F.col("psnr"), F.col("ssim"), F.lit(1.0)), 6).alias("composite"))


def compare_report(s: SparkSession, d: str) -> DataFrame:
    """The full report; its parts have their own oracles."""
    p = B.rgba4(s, d, True)
    return C.report(p, _next(p), 4, 4)


def compare_report_by_image(s: SparkSession, d: str) -> DataFrame:
    """The same report with each pair in one task."""
    p = B.rgba4(s, d, True)
    return R.report(p, _next(p)).select("img_id", "n", "exact", "max_diff", R6("mse"), R6("psnr"), R6("ssim"), R6("ssim_luma"), R6("de_mean"), R6("de_p95"), R6("de_max"))


def hist_colours(s: SparkSession, d: str) -> DataFrame:
    return H.colour_histogram(B.sheet(s, d))


def hist_distinct(s: SparkSession, d: str) -> DataFrame:
    return H.distinct_colours(B.sheet(s, d), 1000)


def hist_dominant(s: SparkSession, d: str) -> DataFrame:
    return H.dominant_colour(B.sheet(s, d))


def hist_opaque(s: SparkSession, d: str) -> DataFrame:
    return H.is_opaque(B.rgba4(s, d).withColumn("a", F.when(F.col("img_id") % 3 == 0, 255).otherwise(F.col("a"))))


def _heat_gray(s: SparkSession, d: str) -> DataFrame:
    return B.heat(s, d).withColumn("v", F.least(F.col("n") * 20, F.lit(255)).cast("int"))


def flatness(s: SparkSession, d: str) -> DataFrame:
    f = H.flatness(_heat_gray(s, d), key=F.col("class"), luma=F.col("v"))
    return f.select("img_id", "colours", "capped", R6("run_ratio"), R6("noise"))


def interior_noise(s: SparkSession, d: str) -> DataFrame:
    return S.interior_noise(B.gray8(s, d), F.col("v")).select("img_id", R6("noise"))


def mode_select(s: SparkSession, d: str) -> DataFrame:
    return choose_mode(H.flatness(B.gray8(s, d), key=F.col("v"), luma=F.col("v"))).select("img_id", "colours", R6("run_ratio"), "mode")


def refine_gate_query(s: SparkSession, d: str) -> DataFrame:
    n = S.interior_noise(B.gray8(s, d), F.col("v"))
    return n.select("img_id", refine_gate(F.col("noise"), 20.0).alias("refine"))


def otsu(s: SparkSession, d: str) -> DataFrame:
    return H.otsu(B.gray8(s, d), F.col("v"), F.lit(255))


def threshold_apply(s: SparkSession, d: str) -> DataFrame:
    return H.apply_threshold(B.rgba4(s, d)).select("img_id", "x", "y", "threshold", "r", "g", "b", "a")


def bradley_mask(s: SparkSession, d: str) -> DataFrame:
    return H.bradley(B.gray8(s, d), F.col("v"), F.lit(255)).select("img_id", "x", "y", "ink")


def bg_detect(s: SparkSession, d: str) -> DataFrame:
    return H.background_colour(B.gray_rgba(B.gray8(s, d).withColumn("v", (F.floor(F.col("v") / 16) * 16).cast("int"))))


_PSNR = "CASE WHEN mse > 0 THEN 10 * log10(65025.0::DOUBLE / mse) END"


def _noise(src: str) -> str:
    across = f"SELECT img_id, x, y, CAST(v AS DOUBLE) AS v, lag(CAST(v AS DOUBLE)) OVER r AS w, lead(CAST(v AS DOUBLE)) OVER r AS e FROM {src} WINDOW r AS (PARTITION BY img_id, y ORDER BY x)"
    taps = ", ".join(f"{f}({c}) OVER k AS {n}" for f, names in (("lag", ("nw", "n", "ne")), ("lead", ("sw", "s", "se"))) for c, n in zip(("w", "v", "e"), names))
    mean = "(nw + n + ne + w + v + e + sw + s + se) / 9.0::DOUBLE"
    flat = "sqrt(power(e - w, 2) + power(s - n, 2)) <= 24"
    return f"(SELECT img_id, coalesce(avg(CASE WHEN {flat} THEN abs(v - {mean}) END), 0) AS noise FROM (SELECT *, {taps} FROM ({across}) WINDOW k AS (PARTITION BY img_id, x ORDER BY y)) WHERE nw + ne + sw + se IS NOT NULL GROUP BY img_id)"


_FLAT = """SELECT k.img_id, least(count(DISTINCT k.key), 4097) AS colours, count(DISTINCT k.key) > 4096 AS capped, round(sum(k.run) / CAST(count(*) AS DOUBLE), 6) AS run_ratio
  FROM (SELECT img_id, key, CASE WHEN lag(key) OVER (PARTITION BY img_id, y ORDER BY x) = key THEN 0 ELSE 1 END AS run FROM {src}) k GROUP BY k.img_id"""
_G3 = gaussian(3, 1.5)
_G1 = gaussian(1, 1.5)


def _ssim(src: str, name: str, p: str, q: str, k: list[float]) -> str:
    base = f"{name}_b AS (SELECT img_id, x, y, CAST({p} AS DOUBLE) AS mx, CAST({q} AS DOUBLE) AS my, CAST({p} AS DOUBLE)*{p} AS xx, CAST({q} AS DOUBLE)*{q} AS yy, CAST({p} AS DOUBLE)*{q} AS xy FROM {src})"
    out = f"""{name} AS (SELECT img_id, avg((2*mx*my + 6.5025)*(2*(xy - mx*my) + 58.5225) / ((mx*mx + my*my + 6.5025)*((xx - mx*mx) + (yy - my*my) + 58.5225))) AS ssim FROM {name}_f GROUP BY img_id)"""
    return f"{base}, {blur_cte(name + '_b', name + '_f', ['mx', 'my', 'xx', 'yy', 'xy'], k)}, {out}"


def _pre(s: str, c: str) -> str:
    return f"CASE WHEN {s}_a = 255 THEN {s}_{c} WHEN {s}_a = 0 THEN 0 ELSE CAST(floor({s}_{c} * {s}_a / 255.0::DOUBLE + 0.5) AS INTEGER) END AS {s}_{c}"


_PRE = "pre AS (SELECT img_id, x, y, " + ", ".join(_pre(s, c) for s in "pq" for c in "rgb") + ", p_a, q_a FROM pairs)"
_OVER = lambda s, c: f"CASE WHEN {s}_a = 255 THEN {s}_{c} WHEN {s}_a = 0 THEN 255 ELSE CAST(floor({s}_{c} * ({s}_a / 255.0::DOUBLE) + 255 * (1 - {s}_a / 255.0::DOUBLE) + 0.5) AS INTEGER) END AS f{s}_{c}"
_FIELD = (
    "flat AS (SELECT img_id, x, y, p_a, q_a, " + ", ".join(_OVER(s, c) for s in "pq" for c in "rgb") + " FROM pairs),\n"
    + lab_cte("flat", "lu", "u", ("fp_r", "fp_g", "fp_b")) + ",\n" + lab_cte("lu", "lv", "v", ("fq_r", "fq_g", "fq_b")) + ",\n" + de2000_cte("lv", "dd")
    + ",\nfield AS MATERIALIZED (SELECT img_id, x, y, p_a, q_a, fp_r, fp_g, fp_b, CASE WHEN fp_r = fq_r AND fp_g = fq_g AND fp_b = fq_b THEN 0 ELSE de END AS de FROM dd)"
)
_W4 = f"WITH {MIXED4}, {PAIRS4}"
_HM = f"""hm AS MATERIALIZED (SELECT img_id, x, y, de, CASE WHEN greatest(de, abs(p_a - q_a) / 255.0::DOUBLE * 100) > 2 THEN 1 ELSE 0 END AS changed, CAST({half('255 * (1 - 0.1::DOUBLE) + ' + luma('fp_r', 'fp_g', 'fp_b') + ' * 0.1::DOUBLE')} AS INTEGER) AS gray FROM field)"""
_ERR = lambda d: " + ".join(f"power(p_{c} - q_{c}, 2)" for c in d)
_OTSU = """ot AS (SELECT img_id, arg_max(t, (v, -t)) AS threshold FROM (
  SELECT *, wb::DOUBLE * (w - wb) * power(sb / wb::DOUBLE - (s - sb) / (w - wb)::DOUBLE, 2) AS v FROM (
    SELECT img_id, t, sum(n) OVER a AS wb, sum(n * t) OVER a AS sb, sum(n) OVER (PARTITION BY img_id) AS w, sum(n * t) OVER (PARTITION BY img_id) AS s
    FROM (SELECT img_id, CAST({t} AS INTEGER) AS t, count(*) AS n FROM {src} GROUP BY 1, 2) WINDOW a AS (PARTITION BY img_id ORDER BY t)) WHERE w > wb) GROUP BY img_id)"""

QUERIES = {f.__name__: f for f in (px_compare_basic, px_compare_rgba, ssim_plane, ssim_luma, delta_e_stats, diff_heatmap, diff_summary, severity, composite_score, compare_report, compare_report_by_image, hist_colours, hist_distinct, hist_dominant, hist_opaque, flatness, interior_noise, mode_select, otsu, threshold_apply, bradley_mask, bg_detect)} | {"refine_gate": refine_gate_query}
ORACLE = {
    "px_compare_basic": f"WITH {GRAY}, {PAIRS8}, e AS (SELECT img_id, count(*) AS n, count(*) FILTER (p = q) AS exact, max(abs(p - q)) AS max_diff, avg(power(p - q, 2)) AS mse FROM pairs GROUP BY img_id) SELECT img_id, n, exact, max_diff, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round({_PSNR}, 6) AS psnr, exact = n AS lossless FROM e",
    "px_compare_rgba": f"{_W4}, {_PRE}, e AS (SELECT img_id, count(*) AS n, count(*) FILTER ({' AND '.join(f'p_{c} = q_{c}' for c in 'rgba')}) AS exact, max(greatest({', '.join(f'abs(p_{c} - q_{c})' for c in 'rgba')})) AS max_diff, sum({_ERR('rgba')}) / (count(*) * 4) AS mse FROM pre GROUP BY img_id) SELECT img_id, n, exact, max_diff, round(mse, 6) AS mse, round({_PSNR}, 6) AS psnr FROM e",
    "ssim_plane": f"WITH {GRAY}, {PAIRS8}, {_ssim('pairs', 's', 'p', 'q', _G3)} SELECT img_id, round(ssim, 6) AS ssim FROM s",
    "ssim_luma": f"""{_W4}, {_PRE}, {', '.join(_ssim('pre', 's' + c, f'p_{c}', f'q_{c}', _G1) for c in 'rgba')}, {_ssim('pre', 'sl', luma('p_r', 'p_g', 'p_b'), luma('q_r', 'q_g', 'q_b'), _G1)},
al AS (SELECT img_id, (min(p_a) <> max(p_a)) OR (min(q_a) = max(q_a) AND min(p_a) <> min(q_a)) AS counts FROM pre GROUP BY img_id)
SELECT img_id, round(CASE WHEN counts THEN (sr.ssim + sg.ssim + sb.ssim + sa.ssim) / 4 ELSE (sr.ssim + sg.ssim + sb.ssim) / 3 END, 6) AS ssim, round(sl.ssim, 6) AS ssim_luma
FROM sr JOIN sg USING (img_id) JOIN sb USING (img_id) JOIN sa USING (img_id) JOIN sl USING (img_id) JOIN al USING (img_id)""",
    "delta_e_stats": f"""{_W4}, {_FIELD}, per AS (SELECT img_id, avg(de) AS m, max(de) AS mx, count(*) AS n FROM field GROUP BY img_id),
cum AS (SELECT img_id, bin, sum(k) OVER (PARTITION BY img_id ORDER BY bin) AS c FROM (SELECT img_id, CAST(least(10000, floor(de * 100 + 0.5)) AS INTEGER) AS bin, count(*) AS k FROM field GROUP BY 1, 2))
SELECT per.img_id, round(m, 6) AS de_mean, round(min(bin) / 100.0::DOUBLE, 6) AS de_p95, round(mx, 6) AS de_max FROM per JOIN cum ON cum.img_id = per.img_id AND c >= ceil(n * 0.95) GROUP BY per.img_id, m, mx""",
    "diff_heatmap": f"{_W4}, {_FIELD}, {_HM} SELECT img_id, x, y, round(de, 6) AS de, changed, CASE WHEN changed = 1 THEN 255 ELSE gray END AS r, CASE WHEN changed = 1 THEN 40 ELSE gray END AS g, CASE WHEN changed = 1 THEN 40 ELSE gray END AS b FROM hm",
    "diff_summary": f"{_W4}, {_FIELD}, {_HM} SELECT img_id, CAST(sum(changed) AS BIGINT) AS changed, count(*) AS n, round(sum(changed) / CAST(count(*) AS DOUBLE), 6) AS fraction, round(max(de), 6) AS de_max, round(avg(de), 6) AS de_mean FROM hm GROUP BY img_id",
    "severity": f"""WITH RECURSIVE {HEAT}, m AS MATERIALIZED (SELECT img_id, x, y, CASE WHEN n > 0 THEN 1 ELSE 0 END AS bad FROM heat),
k AS (SELECT a.img_id, a.x, a.y, a.bad, CASE WHEN a.bad = 1 AND (SELECT sum(b.bad) FROM m b WHERE b.img_id = a.img_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1) - a.bad >= 4 THEN 1 ELSE 0 END AS kept FROM m a),
on_ AS MATERIALIZED (SELECT img_id, x, y, y * 24 + x AS i FROM k WHERE kept = 1),
reach AS (SELECT img_id, i AS root, x, y, i FROM on_ UNION SELECT r.img_id, r.root, o.x, o.y, o.i FROM reach r JOIN on_ o ON o.img_id = r.img_id AND abs(o.x - r.x) + abs(o.y - r.y) = 1),
lab AS (SELECT img_id, i, min(root) AS root FROM reach GROUP BY img_id, i), ar AS (SELECT img_id, root, count(*) AS area FROM lab GROUP BY 1, 2),
ag AS (SELECT img_id, count(*) AS clusters, max(area) AS largest, sum(area * area) AS sq FROM ar GROUP BY img_id),
per AS (SELECT img_id, sum(bad) AS differing, sum(kept) AS coherent, count(*) AS n FROM k GROUP BY img_id)
SELECT per.img_id, CAST(differing AS BIGINT) AS differing, CAST(coherent AS BIGINT) AS coherent, CAST(coalesce(clusters, 0) AS BIGINT) AS clusters, CAST(coalesce(largest, 0) AS BIGINT) AS largest,
  round(least(1.0::DOUBLE, sqrt(coalesce(sq, 0)::DOUBLE) / n), 6) AS mass, round(1 - least(1.0::DOUBLE, sqrt(coalesce(sq, 0)::DOUBLE) / n), 6) AS score FROM per LEFT JOIN ag USING (img_id)""",
    "composite_score": f"WITH {GRAY}, {PAIRS8}, {_ssim('pairs', 's', 'p', 'q', _G3)}, e AS (SELECT img_id, avg(power(p - q, 2)) AS mse FROM pairs GROUP BY img_id) SELECT img_id, round(power(CASE WHEN mse > 0 THEN least(1, greatest(0, 10 * log10(65025.0::DOUBLE / mse) / 40)) ELSE 1 END * least(1, greatest(0, ssim)) * least(1, greatest(0, ssim)), 0.25), 6) AS composite FROM e JOIN s USING (img_id)",
    "hist_colours": f"WITH {SHEET} SELECT img_id, (CAST(r AS BIGINT) << 24) + (g << 16) + (b << 8) + a AS key, count(*) AS n FROM sheet GROUP BY 1, 2",
    "hist_distinct": f"WITH {SHEET}, d AS (SELECT img_id, count(DISTINCT (r, g, b, a)) AS n FROM sheet GROUP BY 1) SELECT img_id, least(n, 1001) AS colours, n > 1000 AS capped FROM d",
    "hist_dominant": f"WITH {SHEET}, k AS (SELECT img_id, r, g, b, a, count(*) AS n, min(y * 50 + x) AS f FROM sheet GROUP BY 1, 2, 3, 4, 5) SELECT img_id, n, r, g, b, a FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, f) AS rn FROM k) WHERE rn = 1",
    "hist_opaque": f"WITH {RGBA4} SELECT img_id, bool_and(CASE WHEN img_id % 3 = 0 THEN 255 ELSE a END = 255) AS opaque FROM rgba GROUP BY 1",
    "flatness": f"WITH {HEAT}, src AS MATERIALIZED (SELECT img_id, x, y, class AS key, CAST(least(n * 20, 255) AS INTEGER) AS v FROM heat), f AS ({_FLAT.format(src='src')}), nz AS {_noise('src')} SELECT f.img_id, colours, capped, run_ratio, round(noise, 6) AS noise FROM f JOIN nz USING (img_id)",
    "interior_noise": f"WITH {GRAY}, nz AS {_noise('gray')} SELECT img_id, round(noise, 6) AS noise FROM nz",
    "mode_select": f"WITH {GRAY}, src AS MATERIALIZED (SELECT *, v AS key FROM gray), f AS ({_FLAT.format(src='src')}) SELECT img_id, colours, run_ratio, CASE WHEN NOT capped AND (run_ratio <= 0.12 OR colours <= 64) THEN 'pixel' ELSE 'trace' END AS mode FROM f",
    "refine_gate": f"WITH {GRAY}, nz AS {_noise('gray')} SELECT img_id, noise <= 20 AS refine FROM nz",
    "otsu": f"WITH {GRAY}, {_OTSU.format(src='gray', t='v')} SELECT i.img_id, coalesce(threshold, 128) AS threshold FROM (SELECT DISTINCT img_id FROM gray) i LEFT JOIN ot USING (img_id)",
    "threshold_apply": f"WITH {RGBA4}, op AS (SELECT * FROM rgba WHERE a >= 128), {_OTSU.format(src='op', t=half(luma()))}, t AS (SELECT r.*, coalesce(threshold, 128) AS threshold, {half(luma())} <= coalesce(threshold, 128) AS dark FROM rgba r LEFT JOIN ot USING (img_id)) SELECT img_id, x, y, threshold, " + ", ".join(f"CASE WHEN a < 128 OR dark THEN 0 ELSE 255 END AS {c}" for c in "rgb") + ", CASE WHEN a < 128 THEN 0 ELSE 255 END AS a FROM t",
    "bradley_mask": f"WITH {GRAY} SELECT a.img_id, a.x, a.y, CASE WHEN a.v::DOUBLE <= sum(b.v)::DOUBLE / count(*) * (85 / 100.0::DOUBLE) THEN 1 ELSE 0 END AS ink FROM gray a JOIN gray b ON b.img_id = a.img_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY a.img_id, a.x, a.y, a.v",
    "bg_detect": f"""WITH {GRAY}, e AS (SELECT img_id, CAST(v // 16 * 16 AS INTEGER) AS v, CASE WHEN y = 0 THEN 2 * x WHEN y = 7 THEN 2 * x + 1 WHEN x = 0 THEN 16 + 2 * (y - 1) ELSE 17 + 2 * (y - 1) END AS o FROM gray WHERE x IN (0, 7) OR y IN (0, 7)),
k AS (SELECT img_id, v, count(*) AS n, min(o) AS f FROM e GROUP BY 1, 2) SELECT img_id, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, f) AS rn FROM k) WHERE rn = 1""",
}
ORACLE["compare_report_by_image"] = f"SELECT a.*, s.ssim, s.ssim_luma, d.de_mean, d.de_p95, d.de_max FROM ({ORACLE['px_compare_rgba']}) a JOIN ({ORACLE['ssim_luma']}) s USING (img_id) JOIN ({ORACLE['delta_e_stats']}) d USING (img_id)"
