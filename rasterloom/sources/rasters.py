"""Rasters from and to files: binaryFile scans decoded in Arrow batches, and encoded columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ensure_importable
from rasterloom.sources import codecs

LIMIT = "spark.rasterloom.maxInputPixels"
#: Bytes of decoded images that a worker holds at once (one image that is larger is held alone), and pixels in a batch of rows.
HELD, STRIP = 1 << 24, 1 << 14


def pixel_limit(spark: SparkSession) -> int | None:
    """The session's ceiling of declared pixels; 'false' is none."""
    v = spark.conf.get(LIMIT, str(codecs.MAX_PIXELS))
    return None if v == "false" else int(v)


def _typed(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _decode(keys: list[str], limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of keys and a content the keys, format, width, height, data, has_alpha and error, HELD bytes of data or one image at a time."""
    types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.string())
    names = [*keys, "format", "width", "height", "data", "has_alpha", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            begun = have = 0
            for i in range(b.num_rows):
                try:
                    kind, px = codecs.decode(b.column(len(keys))[i].as_py() or b"", limit)
                    rows.append((kind, px.shape[1], px.shape[0], px.tobytes(), bool((px[..., 3] < 255).any()), None))
                    have += px.nbytes
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, None, None, None, str(e) or type(e).__name__))
                if have >= HELD or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(begun, len(rows)).columns[: len(keys)], *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names)
                    rows, begun, have = [], i + 1, 0

    return run


def _pixels(keys: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of decoded rasters the rows of pixels, STRIP at a time: many small images together, a large one in parts. keys: columns that go along, under these names."""

    def rows(b: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(p[4]) for p in held])
        which, w, h, first = (np.repeat([p[k] for p in held], size) for k in range(4))
        px = np.concatenate([p[4] for p in held]).astype(np.int32)
        at = np.arange(len(px)) - np.repeat(np.cumsum(size) - size, size) + first
        which = pa.array(which)
        return pa.RecordBatch.from_arrays([*(b.column(k).take(which) for k in keys), *[pa.array(v.astype(np.int32)) for v in (w, h, at % w, at // w)], *[pa.array(px[:, c].copy()) for c in range(4)]], [*names, "width", "height", "x", "y", "r", "g", "b", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            have = 0
            for i in range(b.num_rows):
                w, h, raw = b.column("width")[i].as_py(), b.column("height")[i].as_py(), b.column("data")[i].as_buffer()
                if raw is None:
                    continue
                px = np.frombuffer(raw, np.uint8).reshape(h * w, 4)
                for at in range(0, h * w, STRIP):
                    held.append((i, w, h, at, px[at : at + STRIP]))
                    have += len(held[-1][4])
                    if have >= STRIP:
                        yield rows(b, held)
                        held, have = [], 0
            if held:
                yield rows(b, held)

    return run


_PIXEL = "width int, height int, x int, y int, r int, g int, b int, a int"


def decoded(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, format, width, height, data (RGBA bytes), has_alpha, error: one row a file; what can't be read has an error instead of failing the job."""
    ensure_importable(files.sparkSession)
    return files.select(key, content).mapInArrow(_decode([key], pixel_limit(files.sparkSession)), f"{_typed(files, [key])}, format string, width int, height int, data binary, has_alpha boolean, error string")


def decoded_pixels(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, format, width, height, x, y, r, g, b, a: to_pixels(decoded()) in one pass; files that can't be read have no rows."""
    ensure_importable(files.sparkSession)
    decode, pixels = _decode(keys, pixel_limit(files.sparkSession)), _pixels([*keys, "format"], [*keys, "format"])
    return files.select(*keys, content).mapInArrow(lambda batches: pixels(decode(batches)), f"{_typed(files, keys)}, format string, {_PIXEL}")


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All images under a path."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return decoded((r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content"))


def to_pixels(rasters: DataFrame, key: str = "path") -> DataFrame:
    """The pixel relation of decoded rasters."""
    ensure_importable(rasters.sparkSession)
    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "width", "height", "data").mapInArrow(_pixels([key], ["img_id"]), f"img_id {kind}, {_PIXEL}")


def from_pixels(px: DataFrame) -> DataFrame:
    """img_id, width, height, data: dense RGBA bytes of pixel rows; missing pixels are void."""
    from rasterloom.operators.images import per_image

    def run(w: int, h: int, p: dict[str, np.ndarray]) -> dict:
        return {"width": [w], "height": [h], "data": [np.stack([p[c] for c in "rgba"], -1).astype(np.uint8).tobytes()]}

    return per_image(px, run, "width int, height int, data binary", dict.fromkeys("rgba", 0))


def to_files(px: DataFrame, kinds: list[str]) -> DataFrame:
    """img_id, kind, content: the images of pixel rows in each of these file formats, as encoded() of from_pixels(), in one pass."""
    from rasterloom.operators.images import per_image

    def run(w: int, h: int, p: dict[str, np.ndarray]) -> dict:
        image = np.stack([p[c] for c in "rgba"], -1).astype(np.uint8)
        return {"kind": list(kinds), "content": [codecs.encode(image, k) for k in kinds]}

    return per_image(px, run, "kind string, content binary", dict.fromkeys("rgba", 0))


def encoded(data: Column, width: Column, height: Column, kind: str) -> Column:
    """The bytes of RGBA data in a file format."""

    @F.arrow_udf("binary")
    def run(d: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([None if (x := y.as_buffer()) is None else codecs.encode(np.frombuffer(x, np.uint8).reshape(j, i, 4), kind) for y, i, j in zip(d, w.to_pylist(), h.to_pylist())], pa.binary())

    return run(data, width, height)


def apng_frames(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, frame, delay_ms, width, height, data of animated PNGs, composed."""
    ensure_importable(files.sparkSession)
    limit = pixel_limit(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column(1).to_pylist()):
                if not raw or not codecs.is_apng(raw):
                    continue
                fs = codecs.compose_apng(raw, limit)
                ids = pa.array([b.column(0)[i].as_py()] * len(fs), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(fs)), pa.int32()), pa.array([d for _, d in fs], pa.int32()), *[pa.array([p.shape[k] for p, _ in fs], pa.int32()) for k in (1, 0)], pa.array([p.tobytes() for p, _ in fs])], [key, "frame", "delay_ms", "width", "height", "data"])

    return files.select(key, content).mapInArrow(run, f"`{key}` string, frame int, delay_ms int, width int, height int, data binary")
