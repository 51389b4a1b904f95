"""Pieces of SQL that the oracles share: the bindings as common table expressions, and formulas as text."""

from __future__ import annotations


def q(e: str) -> str:
    return f"CAST(least(255, greatest(0, floor((CAST({e} AS DOUBLE) + 1) * 127.5 + 0.5))) AS INTEGER)"


def half(e: str) -> str:
    return f"floor(({e}) + 0.5)"


GRAY = f"gray AS MATERIALIZED (SELECT vec_id AS img_id, CAST((p - 1) % 8 AS INTEGER) AS x, CAST((p - 1) // 8 AS INTEGER) AS y, {q('embedding[p]')} AS v FROM embeddings, range(1, 65) t(p))"
RGBA4 = f"rgba AS MATERIALIZED (SELECT vec_id AS img_id, CAST(k % 4 AS INTEGER) AS x, CAST(k // 4 AS INTEGER) AS y, {q('embedding[4*k+1]')} AS r, {q('embedding[4*k+2]')} AS g, {q('embedding[4*k+3]')} AS b, {q('embedding[4*k+4]')} AS a FROM embeddings, range(0, 16) t(k))"
MIXED4 = RGBA4.replace("rgba AS", "rgba0 AS", 1) + ", rgba AS MATERIALIZED (SELECT img_id, x, y, r, g, b, CASE (x + y) % 4 WHEN 0 THEN 255 WHEN 2 THEN 0 ELSE a END AS a FROM rgba0)"
SHEET = """sheet AS MATERIALIZED (SELECT l_returnflag || l_linestatus AS img_id, CAST(l_quantity - 1 AS INTEGER) AS x, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS y,
  CAST(least(255, count(*) * 40) AS INTEGER) AS r, CAST(least(255, floor(max(l_extendedprice) / 400)) AS INTEGER) AS g, CAST(sum(l_linenumber) % 256 AS INTEGER) AS b, 255 AS a FROM lineitem GROUP BY 1, 2, 3)"""
HEAT = """heat AS MATERIALIZED (SELECT e.event_type AS img_id, CAST(h AS INTEGER) AS x, CAST(d AS INTEGER) AS y, coalesce(c.n, 0) AS n, CAST(least(coalesce(c.n, 0), 2) AS INTEGER) AS class
  FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN range(0, 24) a(h) CROSS JOIN range(0, 31) b(d)
  LEFT JOIN (SELECT event_type, hour(ts) AS hh, day(ts) - 1 AS dd, count(*) AS n FROM events GROUP BY 1, 2, 3) c ON c.event_type = e.event_type AND c.hh = h AND c.dd = d)"""
COLOURS = """colours AS (SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN '#' || six WHEN 1 THEN '#' || left(six, 3) WHEN 2 THEN ' #' || upper(six) || '80'
  WHEN 3 THEN 'rgb(' || (v >> 16) || ', ' || ((v >> 8) & 255) || ', ' || (v & 255) || ')'
  WHEN 4 THEN 'rgba(' || (v >> 16) || ' ' || ((v >> 8) & 255) || ' ' || ((v & 255) % 101) || '% / 50%)'
  ELSE ['black', 'white', 'red', 'tomato', 'gray', 'transparent', 'none'][p_partkey % 7 + 1] END AS css
  FROM (SELECT p_partkey, v, lpad(lower(to_hex(v)), 6, '0') AS six FROM (SELECT p_partkey, (p_partkey * 2654435761) % 16777216 AS v FROM part)))"""
PAIRS8 = "pairs AS MATERIALIZED (SELECT p.img_id, p.x, p.y, p.v AS p, c.v AS q FROM gray p JOIN gray c ON c.img_id = p.img_id + 1 AND c.x = p.x AND c.y = p.y)"
PAIRS4 = "pairs AS MATERIALIZED (SELECT p.img_id, p.x, p.y, " + ", ".join(f"p.{c} AS p_{c}, c.{c} AS q_{c}" for c in "rgba") + " FROM rgba p JOIN rgba c ON c.img_id = p.img_id + 1 AND c.x = p.x AND c.y = p.y)"


def linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


def oklab_cte(src: str, name: str = "ok", keep: str = "*", prefix: str = "", cols: tuple[str, str, str] = ("r", "g", "b")) -> str:
    """CTEs that add L, A, B (with a prefix) to a relation."""
    r, g, b = (linear(f"CAST({c} AS DOUBLE)") for c in cols)
    p = prefix
    return f"""{name}_1 AS MATERIALIZED (SELECT {keep}, {r} AS {p}lr, {g} AS {p}lg, {b} AS {p}lb FROM {src}),
{name}_2 AS MATERIALIZED (SELECT *, cbrt(0.4122214708*{p}lr + 0.5363325363*{p}lg + 0.0514459929*{p}lb) AS {p}cl, cbrt(0.2119034982*{p}lr + 0.6806995451*{p}lg + 0.1073969566*{p}lb) AS {p}cm, cbrt(0.0883024619*{p}lr + 0.2817188376*{p}lg + 0.6299787005*{p}lb) AS {p}cs FROM {name}_1),
{name} AS (SELECT *, 0.2104542553*{p}cl + 0.793617785*{p}cm - 0.0040720468*{p}cs AS {p}L, 1.9779984951*{p}cl - 2.428592205*{p}cm + 0.4505937099*{p}cs AS {p}A, 0.0259040371*{p}cl + 0.7827717662*{p}cm - 0.808675766*{p}cs AS {p}B FROM {name}_2)"""


def lab_cte(src: str, name: str, p: str, cols: tuple[str, str, str]) -> str:
    r, g, b = (linear(f"CAST({c} AS DOUBLE)") for c in cols)
    f = lambda t: f"(CASE WHEN {t} > 216.0/24389 THEN cbrt({t}) ELSE ((24389.0/27) * {t} + 16) / 116 END)"
    return f"""{name}_1 AS MATERIALIZED (SELECT *, {r} AS {p}lr, {g} AS {p}lg, {b} AS {p}lb FROM {src}),
{name}_2 AS MATERIALIZED (SELECT *, (0.4124564*{p}lr + 0.3575761*{p}lg + 0.1804375*{p}lb)/0.95047 AS {p}tx, 0.2126729*{p}lr + 0.7151522*{p}lg + 0.072175*{p}lb AS {p}ty, (0.0193339*{p}lr + 0.119192*{p}lg + 0.9503041*{p}lb)/1.08883 AS {p}tz FROM {name}_1),
{name} AS (SELECT *, 116*{f(p + "ty")} - 16 AS {p}L, 500*({f(p + "tx")} - {f(p + "ty")}) AS {p}A, 200*({f(p + "ty")} - {f(p + "tz")}) AS {p}B FROM {name}_2)"""


def de2000_cte(src: str, name: str = "de") -> str:
    """CTEs that add de between (uL, uA, uB) and (vL, vA, vB)."""
    hyp = lambda a, b: f"sqrt({a}*{a} + {b}*{b})"
    hue = lambda a, b: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END)"
    return f"""{name}_a AS MATERIALIZED (SELECT *, power(({hyp("uA", "uB")} + {hyp("vA", "vB")})/2, 7) AS c7 FROM {src}),
{name}_b AS MATERIALIZED (SELECT *, uA*(1 + 0.5*(1 - sqrt(c7/(c7 + 6103515625.0)))) AS a1, vA*(1 + 0.5*(1 - sqrt(c7/(c7 + 6103515625.0)))) AS a2 FROM {name}_a),
{name}_c AS MATERIALIZED (SELECT *, {hyp("a1", "uB")} AS k1, {hyp("a2", "vB")} AS k2, {hue("a1", "uB")} AS h1, {hue("a2", "vB")} AS h2 FROM {name}_b),
{name}_d AS MATERIALIZED (SELECT *, CASE WHEN k1*k2 = 0 THEN 0 WHEN abs(h2-h1) <= 180 THEN h2-h1 WHEN h2-h1 > 180 THEN h2-h1-360 ELSE h2-h1+360 END AS dh,
  CASE WHEN k1*k2 = 0 THEN h1+h2 WHEN abs(h2-h1) <= 180 THEN (h1+h2)/2 WHEN h1+h2 < 360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS hm, (uL+vL)/2 AS lm, (k1+k2)/2 AS cm FROM {name}_c),
{name}_e AS MATERIALIZED (SELECT *, 2*sqrt(k1*k2)*sin(radians(dh/2)) AS bigh, 1 - 0.17*cos(radians(hm-30)) + 0.24*cos(radians(2*hm)) + 0.32*cos(radians(3*hm+6)) - 0.2*cos(radians(4*hm-63)) AS t,
  -sin(radians(60*exp(-power((hm-275)/25, 2))))*2*sqrt(power(cm,7)/(power(cm,7)+6103515625.0)) AS rt FROM {name}_d),
{name} AS (SELECT *, sqrt(greatest(0, power((vL-uL)/(1+0.015*power(lm-50,2)/sqrt(20+power(lm-50,2))),2) + power((k2-k1)/(1+0.045*cm),2) + power(bigh/(1+0.015*cm*t),2) + rt*((k2-k1)/(1+0.045*cm))*(bigh/(1+0.015*cm*t)))) AS de FROM {name}_e)"""


def blur_cte(src: str, name: str, cols: list[str], kernel: list[float], keep: str = "img_id, x, y", clamp: bool = False, w: int = 8, h: int = 8) -> str:
    """CTEs with cols convolved along x and y as joins with kernel rows; without clamp only where all taps exist."""
    n = len(kernel) // 2
    ks = ", ".join(f"({i - n}, {k!r}::DOUBLE)" for i, k in enumerate(kernel))

    def axis(s: str, out: str, a: str, o: str, size: int) -> str:
        on = f"t.{a} = least({size - 1}, greatest(0, s.{a} + k.d))" if clamp else f"t.{a} = s.{a} + k.d"
        sums = ", ".join(f"sum(t.{c} * k.w) AS {c}" for c in cols)
        have = "" if clamp else f" HAVING count(*) = {2 * n + 1}"
        return f"{out} AS (SELECT s.img_id, s.x, s.y, {sums} FROM {s} s CROSS JOIN {name}_k k JOIN {s} t ON t.img_id = s.img_id AND t.{o} = s.{o} AND {on} GROUP BY s.img_id, s.x, s.y{have})"

    return f"{name}_k AS (SELECT * FROM (VALUES {ks}) v(d, w)), {axis(src, name + '_x', 'x', 'y', w)}, {axis(name + '_x', name, 'y', 'x', h)}"


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(0.2126::DOUBLE*{r} + 0.7152::DOUBLE*{g} + 0.0722::DOUBLE*{b})"
