"""Queries: colour functions and per-pixel scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import bindings as B
from rasterloom.functions import colour as K
from rasterloom.functions import scalar as N
from rasterloom.queries.sql import COLOURS, MIXED4, PAIRS4, RGBA4, de2000_cte, lab_cte, luma, oklab_cte

R6 = lambda c, n=None: F.round(c, 6).alias(n or c)
RGBA = ("r", "g", "b", "a")


def _c(*names: str):
    return [F.col(n) for n in names]


def px_premultiply(s: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return B.rgba4(s, d, True).select("img_id", "x", "y", *[K.premultiplied(F.col(c), a).alias(c) for c in "rgb"], "a")


def px_composite_over(s: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return B.rgba4(s, d, True).select("img_id", "x", "y", *[K.over(F.col(c), a, v).alias(c) for c, v in zip("rgb", (255, 200, 10))])


def px_pack_unpack(s: SparkSession, d: str) -> DataFrame:
    p = B.rgba4(s, d).withColumn("key", K.pack_rgba(*_c(*RGBA)))
    return p.select("img_id", "x", "y", "key", *[u.alias(c) for u, c in zip(K.unpack_rgba(F.col("key")), RGBA)])


def colour_oklab(s: SparkSession, d: str) -> DataFrame:
    p = K.with_oklab(B.rgba4(s, d), ("L", "ca", "cb"))
    return p.select("img_id", "x", "y", R6("L"), R6("ca"), R6("cb"))


def colour_oklab_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Back from Oklab: the same 8-bit colours."""
    p = K.with_oklab(B.rgba4(s, d), ("L", "ca", "cb"))
    return p.select("img_id", "x", "y", *[v.alias(c) for v, c in zip(K.oklab_to_srgb(*_c("L", "ca", "cb")), "rgb")])


def colour_lab(s: SparkSession, d: str) -> DataFrame:
    p = K.with_lab(B.rgba4(s, d), ("L", "ca", "cb"))
    return p.select("img_id", "x", "y", R6("L"), R6("ca"), R6("cb"))


def colour_luma(s: SparkSession, d: str) -> DataFrame:
    r, g, b, a = _c(*RGBA)
    return B.rgba4(s, d).select("img_id", "x", "y", F.round(K.luma709(r, g, b), 6).alias("l709"), F.round(K.luma601(r, g, b, a), 6).alias("l601"), F.round(K.mean_luma(r, g, b, a), 6).alias("mean"))


def colour_linear(s: SparkSession, d: str) -> DataFrame:
    """All 256 levels to linear light and back."""
    v = s.range(256).select(F.col("id").cast("int").alias("v")).withColumn("lin", K.srgb_to_linear(F.col("v")))
    return v.select("v", F.round("lin", 9).alias("lin"), K.linear_to_srgb(F.col("lin")).alias("back"))


def colour_delta_e2000(s: SparkSession, d: str) -> DataFrame:
    """Each pixel against the same one of the next image."""
    p = B.rgba4(s, d)
    both = p.join(p.select((F.col("img_id") - 1).alias("img_id"), "x", "y", *[F.col(c).alias(f"q_{c}") for c in "rgb"]), ["img_id", "x", "y"])
    both = K.with_lab(K.with_lab(both, ("uL", "uA", "uB")), ("vL", "vA", "vB"), ("q_r", "q_g", "q_b"))
    return K.with_delta_e2000(both, "de", ("uL", "uA", "uB"), ("vL", "vA", "vB")).select("img_id", "x", "y", R6("de"))


def colour_parse_css(s: SparkSession, d: str) -> DataFrame:
    return B.colours(s, d).select("p_partkey", "css", K.parse_css(F.col("css")).alias("c")).select("p_partkey", "css", "c.*")


def colour_hex(s: SparkSession, d: str) -> DataFrame:
    p = B.rgba4(s, d).withColumns({c: (F.floor(F.col(c) / 51) * 51).cast("int") if c == "r" else (F.floor(F.col(c) / 17) * 17).cast("int") for c in "rgb"})
    p = p.withColumn("b", F.when(F.col("x") == 0, F.col("b") + 1).otherwise(F.col("b")))
    return p.select("img_id", "x", "y", K.hex_of(*_c("r", "g", "b")).alias("hex"), K.short_hex(*_c("r", "g", "b")).alias("short"))


def colour_blend_pair(s: SparkSession, d: str) -> DataFrame:
    p = B.rgba4(s, d, True)
    both = p.join(p.select((F.col("img_id") - 1).alias("img_id"), "x", "y", *[F.col(c).alias(f"q_{c}") for c in RGBA]), ["img_id", "x", "y"])
    m = K.blend_pair(tuple(_c(*RGBA)), tuple(_c("q_r", "q_g", "q_b", "q_a")))
    return both.select("img_id", "x", "y", *[v.alias(c) for v, c in zip(m, RGBA)])


def colour_cmyk(s: SparkSession, d: str) -> DataFrame:
    p = B.rgba4(s, d)
    return p.select("img_id", "x", "y", *[F.round(v, 6).alias(n) for v, n in zip(N.rgb_to_cmyk(*_c("r", "g", "b")), ("cy", "ma", "ye", "k"))], N.acad_colour(*_c("r", "g", "b")).alias("aci"))


_O = lambda c, v: f"CASE WHEN a = 255 THEN {c} WHEN a = 0 THEN {v} ELSE CAST(floor({c} * (a / 255.0::DOUBLE) + {v} * (1 - a / 255.0::DOUBLE) + 0.5) AS INTEGER) END AS {c}"
_NAMED = "CASE trim(lower(css)) WHEN 'black' THEN '000000ff' WHEN 'white' THEN 'ffffffff' WHEN 'red' THEN 'ff0000ff' WHEN 'gray' THEN '808080ff' WHEN 'transparent' THEN '00000000' WHEN 'none' THEN '00000000' END"
_HEX = lambda e, i: f"CAST('0x' || substr({e}, {1 + 2 * i}, 2) AS INTEGER)"
_FN = lambda i: f"CAST(least(255, greatest(0, floor(CASE WHEN p[{i}] LIKE '%\\%' ESCAPE '\\' THEN CAST(replace(p[{i}], '%', '') AS DOUBLE) / 100 * 255 ELSE CAST(p[{i}] AS DOUBLE) END + 0.5))) AS INTEGER)"

QUERIES = {f.__name__: f for f in (px_premultiply, px_composite_over, px_pack_unpack, colour_oklab, colour_oklab_round_trip, colour_lab, colour_luma, colour_linear, colour_delta_e2000, colour_parse_css, colour_hex, colour_blend_pair, colour_cmyk)}
ORACLE = {
    "px_premultiply": f"WITH {MIXED4} SELECT img_id, x, y, " + ", ".join(f"CASE WHEN a = 255 THEN {c} WHEN a = 0 THEN 0 ELSE CAST(floor({c} * a / 255.0::DOUBLE + 0.5) AS INTEGER) END AS {c}" for c in "rgb") + ", a FROM rgba",
    "px_composite_over": f"WITH {MIXED4} SELECT img_id, x, y, {_O('r', 255)}, {_O('g', 200)}, {_O('b', 10)} FROM rgba",
    "px_pack_unpack": f"WITH {RGBA4} SELECT img_id, x, y, r::BIGINT * 16777216 + g * 65536 + b * 256 + a AS key, r, g, b, a FROM rgba",
    "colour_oklab": f"WITH {RGBA4}, {oklab_cte('rgba')} SELECT img_id, x, y, round(L, 6) AS L, round(ok.A, 6) AS ca, round(ok.B, 6) AS cb FROM (SELECT img_id, x, y, L, AA AS A, BB AS B FROM (SELECT * FROM ok)) ok".replace("L, AA AS A, BB AS B", "L, cA AS A, cB AS B"),
    "colour_oklab_round_trip": f"WITH {RGBA4} SELECT img_id, x, y, r, g, b FROM rgba",
    "colour_luma": f"WITH {RGBA4} SELECT img_id, x, y, round({luma()}, 6) AS l709, round((0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b) * (a / 255.0::DOUBLE), 6) AS l601, round((r + g + b) / 3.0::DOUBLE * (a / 255.0::DOUBLE), 6) AS mean FROM rgba",
    "colour_linear": "SELECT CAST(v AS INTEGER) AS v, round(CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE power((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END, 9) AS lin, CAST(v AS INTEGER) AS back FROM range(0, 256) t(v)",
    "colour_parse_css": f"""WITH {COLOURS}, n AS (SELECT p_partkey, css, {_NAMED} AS named, CASE WHEN trim(css) LIKE '#%' THEN lower(substr(trim(css), 2)) END AS h, string_split_regex(regexp_extract(css, '\\(([^)]*)\\)', 1), '[\\s,/]+') AS p FROM colours),
e AS (SELECT *, coalesce(named, CASE length(h) WHEN 3 THEN h[1]||h[1]||h[2]||h[2]||h[3]||h[3]||'ff' WHEN 6 THEN h || 'ff' WHEN 8 THEN h END) AS e8 FROM n)
SELECT p_partkey, css, """ + ", ".join(f"CASE WHEN e8 IS NOT NULL THEN {_HEX('e8', i)} WHEN css LIKE 'rgb%' THEN {_FN(i + 1)} END AS {c}" for i, c in enumerate("rgb")) + f", CASE WHEN e8 IS NOT NULL THEN {_HEX('e8', 3)} WHEN css LIKE 'rgba%' THEN 128 WHEN css LIKE 'rgb%' THEN 255 END AS a FROM e",
    "colour_hex": f"WITH {RGBA4}, q AS (SELECT img_id, x, y, r // 51 * 51 AS r, g // 17 * 17 AS g, b // 17 * 17 + CASE WHEN x = 0 THEN 1 ELSE 0 END AS b FROM rgba), t AS (SELECT *, '#' || printf('%02x%02x%02x', r, g, b) AS hex FROM q) SELECT img_id, x, y, hex, CASE WHEN r % 17 = 0 AND g % 17 = 0 AND b % 17 = 0 THEN '#' || hex[2] || hex[4] || hex[6] ELSE hex END AS short FROM t",
    "colour_blend_pair": f"WITH {MIXED4}, {PAIRS4} SELECT img_id, x, y, " + ", ".join(f"CASE WHEN p_a + q_a = 0 THEN 0 ELSE CAST(floor(p_{c} * (p_a / (p_a + q_a)::DOUBLE) + q_{c} * (q_a / (p_a + q_a)::DOUBLE) + 0.5) AS INTEGER) END AS {c}" for c in "rgb") + ", CASE WHEN p_a + q_a = 0 THEN 0 ELSE CAST(floor((p_a + q_a) / 2.0::DOUBLE + 0.5) AS INTEGER) END AS a FROM pairs",
    "colour_cmyk": f"WITH {RGBA4}, k AS (SELECT *, 1 - greatest(r, g, b) / 255.0::DOUBLE AS k, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgba) SELECT img_id, x, y, " + ", ".join(f"round(CASE WHEN k >= 1 THEN 0 ELSE (1 - {c} / 255.0::DOUBLE - k) / (1 - k) END, 6) AS {n}" for c, n in zip("rgb", ("cy", "ma", "ye"))) + ", round(k, 6) AS k, CASE WHEN hi - lo < 24 THEN CASE WHEN hi > 200 THEN 7 WHEN hi < 50 THEN 250 ELSE 8 END WHEN r = hi THEN CASE WHEN g > b + 40 THEN 2 ELSE 1 END WHEN g = hi THEN 3 WHEN r > g + 40 THEN 6 ELSE 5 END AS aci FROM k",
}
_SWAP = {"colour_lab": lab_cte("rgba", "lb", "c_", ("r", "g", "b"))}
ORACLE["colour_lab"] = f"WITH {RGBA4}, {_SWAP['colour_lab']} SELECT img_id, x, y, round(c_L, 6) AS L, round(c_A, 6) AS ca, round(c_B, 6) AS cb FROM lb"
ORACLE["colour_oklab"] = f"WITH {RGBA4}, {oklab_cte('rgba', prefix='c_')} SELECT img_id, x, y, round(c_L, 6) AS L, round(c_A, 6) AS ca, round(c_B, 6) AS cb FROM ok"
ORACLE["colour_delta_e2000"] = f"WITH {RGBA4}, {PAIRS4}, {lab_cte('pairs', 'lu', 'u', ('p_r', 'p_g', 'p_b'))}, {lab_cte('lu', 'lv', 'v', ('q_r', 'q_g', 'q_b'))}, {de2000_cte('lv')} SELECT img_id, x, y, round(de, 6) AS de FROM de"
