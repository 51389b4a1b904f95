"""Colour as Column expressions: everything stays inside code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_up(x: Column) -> Column:
    """floor(x + 0.5), also below zero; SQL's round goes away from zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def stored(x: Column) -> Column:
    """What an 8-bit channel holds of a double: clamped, ties to the even neighbour."""
    return F.bround(clamp(x, 0.0, 255.0)).cast("int")


def srgb_to_linear(c8: Column) -> Column:
    c = c8.cast("double") / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    c = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return clamp(half_up(c * 255.0), 0, 255).cast("int")


def _linear(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b)


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Oklab of 8-bit sRGB (Ottosson, 2020)."""
    lr, lg, lb = _linear(r, g, b)
    l = F.cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb)  # noqa: E741
    m = F.cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb)
    s = F.cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb)
    return (
        0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s,
        1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s,
        0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s,
    )


def oklab_to_srgb(L: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    l, m, s = L + 0.3963377774 * a + 0.2158037573 * b, L - 0.1055613458 * a - 0.0638541728 * b, L - 0.0894841775 * a - 1.291485548 * b  # noqa: E741
    l, m, s = l * l * l, m * m * m, s * s * s  # noqa: E741
    return (
        linear_to_srgb(4.0767416621 * l - 3.3077115913 * m + 0.2309699292 * s),
        linear_to_srgb(-1.2684380046 * l + 2.6097574011 * m - 0.3413193965 * s),
        linear_to_srgb(-0.0041960863 * l - 0.7034186147 * m + 1.707614701 * s),
    )


_EPS, _KAPPA = 216 / 24389, 24389 / 27


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB (D65) of 8-bit sRGB."""
    lr, lg, lb = _linear(r, g, b)

    def f(t: Column) -> Column:
        return F.when(t > _EPS, F.cbrt(t)).otherwise((_KAPPA * t + 16) / 116)

    fx = f((0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047)
    fy = f(0.2126729 * lr + 0.7151522 * lg + 0.072175 * lb)
    fz = f((0.0193339 * lr + 0.119192 * lg + 0.9503041 * lb) / 1.08883)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def with_oklab(df: DataFrame, names: tuple[str, str, str], rgb: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """df with the Oklab of three 8-bit columns. The steps are columns of their own, so no step is written out twice in the plan."""
    t = [f"__lin{i}" for i in range(3)]
    d = df.withColumns({n: srgb_to_linear(F.col(c)) for n, c in zip(t, rgb)})
    lr, lg, lb = (F.col(c) for c in t)
    lms = {
        "__lms0": F.cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb),
        "__lms1": F.cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb),
        "__lms2": F.cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb),
    }
    l, m, s = (F.col(c) for c in lms)  # noqa: E741
    out = (0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s, 1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s, 0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s)
    return d.withColumns(lms).withColumns(dict(zip(names, out))).drop(*t, *lms)


def with_lab(df: DataFrame, names: tuple[str, str, str], rgb: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """df with the CIELAB of three 8-bit columns, in steps."""
    t, u, v = ([f"__{k}{i}" for i in range(3)] for k in ("lin", "xyz", "f"))
    d = df.withColumns({n: srgb_to_linear(F.col(c)) for n, c in zip(t, rgb)})
    lr, lg, lb = (F.col(c) for c in t)
    xyz = ((0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047, 0.2126729 * lr + 0.7151522 * lg + 0.072175 * lb, (0.0193339 * lr + 0.119192 * lg + 0.9503041 * lb) / 1.08883)
    d = d.withColumns(dict(zip(u, xyz)))
    d = d.withColumns({n: F.when(F.col(c) > _EPS, F.cbrt(c)).otherwise((_KAPPA * F.col(c) + 16) / 116) for n, c in zip(v, u)})
    fx, fy, fz = (F.col(c) for c in v)
    return d.withColumns(dict(zip(names, (116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz))))).drop(*t, *u, *v)


def with_delta_e2000(df: DataFrame, out: str, p: tuple[str, str, str], q: tuple[str, str, str]) -> DataFrame:
    """df with the CIEDE2000 difference (unit weights; Sharma, Wu and Dalal, 2005) of two CIELAB triples of columns, in steps."""
    l1, a1, b1, l2, a2, b2 = (F.col(c) for c in (*p, *q))
    C = lambda n: F.col(f"__{n}")  # noqa: E731, N806
    steps = []

    def step(**cols: Column) -> None:
        steps.append({f"__{k}": v for k, v in cols.items()})

    step(c7=F.pow((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2, F.lit(7.0)))
    step(g=1 + 0.5 * (1 - F.sqrt(C("c7") / (C("c7") + 25.0**7))))
    step(p1=a1 * C("g"), p2=a2 * C("g"))
    step(k1=F.hypot(C("p1"), b1), k2=F.hypot(C("p2"), b2), d1=F.degrees(F.atan2(b1, C("p1"))), d2=F.degrees(F.atan2(b2, C("p2"))))
    turn = lambda x, b, d: F.when((x == 0) & (b == 0), F.lit(0.0)).when(d < 0, d + 360).otherwise(d)
    step(h1=turn(C("p1"), b1, C("d1")), h2=turn(C("p2"), b2, C("d2")), gray=(C("k1") * C("k2")) == 0, lm=(l1 + l2) / 2, cm=(C("k1") + C("k2")) / 2)
    step(diff=C("h2") - C("h1"), total=C("h1") + C("h2"))
    step(
        dh=F.when(C("gray"), F.lit(0.0)).when(F.abs(C("diff")) <= 180, C("diff")).when(C("diff") > 180, C("diff") - 360).otherwise(C("diff") + 360),
        hm=F.when(C("gray"), C("total")).when(F.abs(C("diff")) <= 180, C("total") / 2).when(C("total") < 360, (C("total") + 360) / 2).otherwise((C("total") - 360) / 2),
    )
    hm = C("hm")
    step(t=1 - 0.17 * F.cos(F.radians(hm - 30)) + 0.24 * F.cos(F.radians(2 * hm)) + 0.32 * F.cos(F.radians(3 * hm + 6)) - 0.2 * F.cos(F.radians(4 * hm - 63)), bell=(hm - 275) / 25, m7=F.pow(C("cm"), F.lit(7.0)), off=(C("lm") - 50) * (C("lm") - 50))
    step(
        x=(l2 - l1) / (1 + 0.015 * C("off") / F.sqrt(20 + C("off"))),
        y=(C("k2") - C("k1")) / (1 + 0.045 * C("cm")),
        z=2 * F.sqrt(C("k1") * C("k2")) * F.sin(F.radians(C("dh") / 2)) / (1 + 0.015 * C("cm") * C("t")),
        rt=-F.sin(F.radians(60 * F.exp(-C("bell") * C("bell")))) * 2 * F.sqrt(C("m7") / (C("m7") + 25.0**7)),
    )
    names: list[str] = []
    for cols in steps:
        df = df.withColumns(cols)
        names += cols
    x, y, z = C("x"), C("y"), C("z")
    return df.withColumn(out, F.sqrt(F.greatest(x * x + y * y + z * z + C("rt") * y * z, F.lit(0.0)))).drop(*names)


def luma709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def luma601(r: Column, g: Column, b: Column, a: Column) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b) * (a / 255.0)


def mean_luma(r: Column, g: Column, b: Column, a: Column) -> Column:
    return ((r + g + b) / 3.0) * (a / 255.0)


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)]))


def short_hex(r: Column, g: Column, b: Column) -> Column:
    """#rgb where that is the same colour."""
    h = hex_of(r, g, b)
    twice = reduce(lambda u, v: u & v, [c % 17 == 0 for c in (r, g, b)])
    return F.when(twice, F.concat(F.lit("#"), *[F.substring(h, i, 1) for i in (2, 4, 6)])).otherwise(h)


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """The unsigned 32-bit key, as a long."""
    return F.shiftleft(r.cast("long"), 24) + F.shiftleft(g.cast("long"), 16) + F.shiftleft(b.cast("long"), 8) + a.cast("long")


def unpack_rgba(key: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.shiftright(key, s).bitwiseAND(F.lit(255)).cast("int") for s in (24, 16, 8, 0))  # type: ignore[return-value]


def key_of(r: Column, g: Column, b: Column, a: Column) -> Column:
    """The key under which pixels count as one colour: all transparent ones share 0."""
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(pack_rgba(r, g, b, a))


def premultiplied(c: Column, a: Column) -> Column:
    return F.when(a == 255, c).when(a == 0, F.lit(0)).otherwise(half_up(c * a / 255.0).cast("int"))


def over(c: Column, a: Column, background: Num) -> Column:
    """A channel flattened over an opaque background."""
    bg = col(background)
    return F.when(a == 255, c).when(a == 0, bg.cast("int")).otherwise(half_up(c * (a / 255.0) + bg * (1 - a / 255.0)).cast("int"))


def blend_pair(p: tuple[Column, ...], q: tuple[Column, ...]) -> tuple[Column, ...]:
    """Mean of two RGBA colours, weighted by alpha."""
    total = p[3] + q[3]
    mean = [F.when(total == 0, F.lit(0)).otherwise(half_up(i * (p[3] / total) + j * (q[3] / total))).cast("int") for i, j in zip(p[:3], q[:3])]
    return (*mean, F.when(total == 0, F.lit(0)).otherwise(half_up(total / 2.0)).cast("int"))


_NAMES = {"black": "000000ff", "white": "ffffffff", "red": "ff0000ff", "green": "008000ff", "blue": "0000ffff", "yellow": "ffff00ff", "cyan": "00ffffff", "magenta": "ff00ffff", "gray": "808080ff", "grey": "808080ff", "silver": "c0c0c0ff", "transparent": "00000000", "none": "00000000"}


def parse_css(text: Column) -> Column:
    """struct<r, g, b, a> of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba() and thirteen names; null for all else."""
    s = F.lower(F.trim(text))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), s)
    digits = F.regexp_extract(s, "^#([0-9a-f]+)$", 1)
    n = F.length(digits)
    long = F.when(n.isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).when(n.isin(6, 8), digits)
    eight = F.coalesce(named, F.when(F.length(long) == 6, F.concat(long, F.lit("ff"))).otherwise(long))
    from_hex = [F.conv(F.substring(eight, 1 + 2 * i, 2), 16, 10).cast("int") for i in range(4)]
    inner = F.regexp_extract(s, r"^rgba?\(([^)]*)\)$", 1)
    parts = F.filter(F.split(inner, r"[\s,/]+"), lambda x: x != "")
    fits = (F.size(parts) >= 3) & F.forall(parts, lambda x: x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)%?$"))

    def channel(i: int, full: float) -> Column:
        v = F.get(parts, F.lit(i))
        number = F.regexp_replace(v, "%$", "").cast("double")
        return clamp(half_up(F.when(v.endswith("%"), number / 100 * 255).otherwise(number * full)), 0, 255).cast("int")

    alpha = F.when(F.size(parts) >= 4, channel(3, 255.0)).otherwise(F.lit(255))
    named_struct = [F.when(eight.isNotNull(), h).when(fits, c).alias(k) for h, c, k in zip(from_hex, [channel(0, 1), channel(1, 1), channel(2, 1), alpha], "rgba")]
    return F.when(eight.isNotNull() | fits, F.struct(*named_struct))


def gaussian(radius: int, sigma: float) -> list[float]:
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [v / sum(k) for v in k]
