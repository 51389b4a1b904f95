"""Small scalar functions of the pipelines, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.colour import clamp, half_up

FORMATS = {
    "png": "png", "apng": "png", "jpg": "jpeg", "jpeg": "jpeg", "jfif": "jpeg", "webp": "webp", "avif": "avif", "tif": "tiff", "tiff": "tiff", "gif": "gif",
    "bmp": "bmp", "dib": "bmp", "ico": "ico", "cur": "ico", "pnm": "pnm", "ppm": "pnm", "pgm": "pnm", "pbm": "pnm", "tga": "tga", "targa": "tga", "icb": "tga", "vda": "tga", "vst": "tga",
}
OFFICE = ("doc", "docx", "odt", "rtf", "txt", "html", "xls", "xlsx", "ods", "csv", "ppt", "pptx", "odp", "pdf")
DIGITS83 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole text without one."""
    return F.trim(F.lower(F.regexp_extract(name, r"([^.]*)$", 1)))


def format_of(ext: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.element_at(m, F.lower(F.regexp_replace(ext, r"^\.", "")))


def is_raster_extension(ext: Column) -> Column:
    return format_of(ext).isNotNull()


def safe_extension(name: Column, fallback: str, allowed: tuple[str, ...] = OFFICE) -> Column:
    e = extension(F.coalesce(name, F.lit("")))
    return F.when(e.isin(*allowed), e).otherwise(F.lit(fallback))


def is_office(path: Column) -> Column:
    return path.contains(".") & extension(path).isin(*OFFICE)


def convert_route(ext: Column, is_svg: Column) -> Column:
    e = F.lower(ext)
    return F.when(e == ".svg", "vectorize").when(e.isin(".dxf", ".eps", ".pdf"), "vector-export").when(is_svg, "rasterize").otherwise("raster-convert")


def byte_size(text: Column) -> Column:
    """'40KB' and '1.5MB' in bytes (decimal units); null for what is no size."""
    p = r"(?i)^\s*(\d+\.?\d*|\.\d+)\s*(b|kb|mb)?\s*$"
    n = F.when(text.rlike(p), F.regexp_extract(text, p, 1).cast("double"))
    unit = F.lower(F.regexp_extract(text, p, 2))
    v = half_up(n * F.when(unit == "kb", 1000).when(unit == "mb", 1_000_000).otherwise(1))
    return F.when(v > 0, v)


def page_indices(spec: Column, most: int = 100_000) -> Column:
    """'1,3-5' as zero-based indices in the order given; parts that are no range are left out, and so is what comes after the first `most` pages (a guard against '1-999999999')."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda s: F.trim(s)), lambda s: s.rlike(r"^\d{1,9}(-\d{1,9})?$"))

    def pages(s: Column) -> Column:
        a = F.regexp_extract(s, r"^(\d+)", 1).cast("int")
        b = F.when(s.contains("-"), F.regexp_extract(s, r"-(\d+)$", 1).cast("int")).otherwise(a)
        low = F.greatest(F.lit(1), F.least(a, b))
        high = F.least(F.greatest(a, b), low + most)
        return F.when(low <= high, F.sequence(low - 1, high - 1)).otherwise(F.array().cast("array<int>"))

    return F.slice(F.flatten(F.transform(parts, pages)), 1, most)


def resolve_pages(count: Column, pages: Column) -> Column:
    """Pages that exist, each once, sorted; all if none is asked for."""
    asked = F.array_sort(F.filter(F.array_distinct(pages), lambda p: (p >= 0) & (p < count)))
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(pages.isNull() | (F.size(pages) == 0), every).otherwise(asked)


def aspect(spec: Column) -> Column:
    """'16:9', '16x9', '16/9' or '1.5' as a ratio; null for all else."""
    pair = r"^\s*([\d.]+)\s*[:x/]\s*([\d.]+)\s*$"
    two = F.try_divide(F.regexp_extract(spec, pair, 1).try_cast("double"), F.regexp_extract(spec, pair, 2).try_cast("double"))
    one = F.trim(spec).try_cast("double")
    return F.when(spec.rlike(pair), two).when(one > 0, one)


def auto_min_area(pixels: Column) -> Column:
    return clamp(half_up(pixels / 50_000.0), 2, 16).cast("int")


def clean_min_area(width: Column, height: Column) -> Column:
    return F.when(width.cast("long") * height >= 2_000_000, 40).otherwise(4)


def encode83(value: Column, length: int) -> Column:
    """Base-83 text of fixed width."""
    digit = lambda i: F.pmod(F.floor(value / F.lit(83 ** (length - i))), F.lit(83)).cast("int")
    return F.concat(*[F.substring(F.lit(DIGITS83), digit(i) + 1, F.lit(1)) for i in range(1, length + 1)])


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    k = 1 - F.greatest(r, g, b) / 255.0
    part = lambda c: F.when(k >= 1, F.lit(0.0)).otherwise((1 - c / 255.0 - k) / (1 - k))
    return part(r), part(g), part(b), k


def acad_colour(r: Column, g: Column, b: Column) -> Column:
    """A coarse index of the ACI palette: grays by lightness, else by the leading channel."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    gray = F.when(top > 200, 7).when(top < 50, 250).otherwise(8)
    return F.when(top - low < 24, gray).when(r == top, F.when(g > b + 40, 2).otherwise(1)).when(g == top, 3).otherwise(F.when(r > g + 40, 6).otherwise(5))


def title_of(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def base_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", ""))


def is_inside(base: Column, target: Column) -> Column:
    """Whether a normalised absolute path lies in a directory."""
    b = F.regexp_replace(base, r"/+$", "")
    return (target == b) | target.startswith(F.concat(b, F.lit("/")))


def is_loopback(host: Column) -> Column:
    name = F.lower(F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"^\[|\]$", ""))
    return F.coalesce(name.isin("localhost", "127.0.0.1", "::1"), F.lit(False))


def is_allowed_origin(origin: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a request may be served: without an origin (no browser sent it), or from one that is named; being local isn't enough."""
    named = origin.isin(*allowed) if allowed else F.lit(False)
    return F.coalesce(origin == "", F.lit(True)) | F.coalesce(named, F.lit(False))


def memory_refusal(projected: Column, limit: Column, used: Column) -> Column:
    """Why a job that needs so many bytes is refused: null where the limit leaves them free, or is unknown (not positive)."""
    free = limit - used
    mb = lambda v: F.format_number(half_up(v / 1048576.0), 0)
    text = F.concat(F.lit("outlines need about "), mb(projected), F.lit(" MB, but only "), mb(free), F.lit(" MB of "), mb(limit), F.lit(" MB are free"))
    return F.when((limit > 0) & (projected > free), text)


def outline_bytes(edges: Column) -> Column:
    """What tracing so many boundary edges is expected to take: 72 bytes each."""
    return edges.cast("long") * 72


def office_arguments(path: Column, kind: Column, folder: Column) -> Column:
    """The arguments with which a headless office program converts a file."""
    return F.array(F.lit("--headless"), F.lit("--norestore"), F.lit("--convert-to"), kind, F.lit("--outdir"), folder, path)


def normal_delay(delay: Column, first: Column) -> Column:
    """A frame's delay: its own, else the animation's first, else 100 ms; what isn't positive is 100."""
    d = F.coalesce(delay, first, F.lit(100))
    return F.when(d > 0, d).otherwise(100)


def sample_frames(pages: Column, most: int) -> Column:
    """At most `most` evenly spaced frame numbers; the middle one if it is one."""
    if most == 1:
        some = F.array(half_up((pages - 1) / 2.0).cast("int"))
    else:
        some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: half_up(i * (pages - 1) / float(most - 1)).cast("int")))
    return F.when(pages <= most, F.sequence(F.lit(0), (pages - 1).cast("int"))).otherwise(some)


def clean_diagnostics(message: Column) -> Column:
    """A codec's lines, trimmed, without empty and repeated ones, joined by '; '."""
    lines = F.filter(F.transform(F.split(message, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.array_distinct(lines), "; ")


def explain_failure(message: Column) -> Column:
    """What three usual codec failures mean, else null."""
    return (
        F.when(message.rlike("(?i)pixel limit|too large"), "the image declares more pixels than the limit allows")
        .when(message.rlike("(?i)premature end|truncat|unexpected end"), "the file is cut short")
        .when(message.rlike("(?i)unsupported|unknown format"), "no codec reads this format")
    )


def relaxed(t: float, base: dict | None = None) -> dict:
    """Tracing parameters relaxed by t in [0, 1]: the fit's tolerance grows up to 8 times; from .2 to .55 decimals go, from .55 specks, from .75 colours."""
    b = {"tolerance": 0.4, "fit_error": 0.4, "precision": 2, "min_area": 0, "colours": 16} | (base or {})
    half = lambda v: int(v + 0.5)
    k = 1 + 7 * t
    fewer, specks, palette = min(max((t - 0.2) / 0.35, 0), 1), max((t - 0.55) / 0.45, 0), max((t - 0.75) / 0.25, 0)
    return b | {"tolerance": min(8, b["tolerance"] * k), "fit_error": min(8, b["fit_error"] * k), "precision": max(0, half(b["precision"] * (1 - fewer))), "min_area": half(b["min_area"] + 64 * specks), "colours": max(2, half(b["colours"] * (1 - 0.6 * palette)))}


def escalated(o: dict, most: int) -> dict | None:
    """The next finer parameters: twice the colours, 0.6 of the tolerances (0.05 at least), half the smallest area; None if nothing changes."""
    n = o | {"colours": min(most, o["colours"] * 2), "tolerance": max(0.05, o["tolerance"] * 0.6), "fit_error": max(0.05, o["fit_error"] * 0.6), "min_area": o["min_area"] // 2}
    return None if n == o else n
