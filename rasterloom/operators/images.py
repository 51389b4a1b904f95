"""Running an algorithm that is sequential inside an image on every image in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import ensure_importable

Planes = dict[str, np.ndarray]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each image of batches sorted by img_id."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        ids = b.column("img_id").to_pylist()
        at = 0
        for i in range(1, len(ids) + 1):
            if i < len(ids) and ids[i] == ids[at]:
                continue
            piece = b.slice(at, i - at)
            if held and ids[at] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            last = ids[at]
            at = i
    if held:
        yield pa.Table.from_batches(held)


def per_image(px: DataFrame, fn: Callable[[int, int, Planes], dict[str, list | np.ndarray]], schema: str, values: dict[str, int | float]) -> DataFrame:
    """img_id and what fn returns for each image: columns of equal length, in the order of schema (without img_id). fn gets width, height and a (height, width) array for each of values, filled with its default where a pixel is missing. Images meet in one task each; a task streams over its images and holds one."""
    ensure_importable(px.sparkSession)
    kind = px.schema["img_id"].dataType.simpleString()
    names = list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            w, h = t.column("width")[0].as_py(), t.column("height")[0].as_py()
            x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
            planes = {}
            for n in names:
                c = t.column(n).to_numpy()
                planes[n] = np.full((h, w), values[n], c.dtype)
                planes[n][y, x] = c
            out = fn(w, h, planes)
            m = len(next(iter(out.values())))
            if m:
                ids = pa.array([t.column("img_id")[0].as_py()] * m, t.schema.field("img_id").type)
                yield pa.RecordBatch.from_arrays([ids, *[v if isinstance(v, pa.Array) else pa.array(v, arrow[k]) for k, v in out.items()]], ["img_id", *out])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    full = f"img_id {kind}, {schema}"
    arrow = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(full)}
    src = px.select("img_id", *[F.col(c).cast("int").alias(c) for c in ("width", "height", "x", "y")], *names)
    return src.repartition("img_id").sortWithinPartitions("img_id").mapInArrow(run, full)


def grid(w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[0:h, 0:w]
    return x.ravel(), y.ravel()
