"""Codecs and sources: round trips, sniffing, hand-made bytes, refusals."""

import importlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import codecs as X
from rasterloom.sources import rasters
from tests.fixtures import alpha_blob, flat_artwork, pixels


def gray_noise(h=9, w=13, seed=3, alpha=True):
    o = np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)
    if not alpha:
        o[..., 3] = 255
    return o


@pytest.mark.parametrize("kind", ["png", "bmp", "tga", "ico"])
@pytest.mark.parametrize("alpha", [True, False])
def test_round_trip(kind, alpha):
    o = gray_noise(alpha=alpha)
    got, px = X.decode(X.encode(o, kind))
    assert got == kind
    if kind == "ico" and alpha:
        o = o.copy()
    assert (px == o).all()


def test_tga_run_lengths():
    o = np.repeat(np.repeat(gray_noise(3, 4), 5, 0), 50, 1)
    assert (X.decode_tga(X.encode_tga(o, True)) == o).all()
    assert len(X.encode_tga(o, True)) < len(X.encode_tga(o)) / 5


@pytest.mark.parametrize("kind", [4, 5, 6])
def test_pnm(kind):
    o = gray_noise(alpha=False)
    o[..., 1] = o[..., 0]
    o[..., 2] = o[..., 0]
    if kind == 4:
        o[..., :3] = np.where(o[..., :3] < 128, 0, 255)
    assert (X.decode_pnm(X.encode_pnm(o, kind)) == o).all()
    assert (X.decode_pnm(b"P2 # c\n2 1\n4\n 0 2")[0, :, 0] == [0, 128]).all()
    assert (X.decode_pnm(b"P1\n3 1\n101")[0, :, 0] == [0, 255, 0]).all()
    assert X.decode_pnm(b"P5 1 1 65535 \xff\xff")[0, 0, 0] == 255


def test_bmp_depths():
    pal = struct.pack("<4B", 10, 20, 30, 0) + struct.pack("<4B", 40, 50, 60, 0)
    head = struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 1, 0, 4, 0, 0, 2, 0)
    b = b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + 40 + 8) + head + pal + b"\x40\0\0\0"
    assert X.decode_bmp(b)[0].tolist() == [[30, 20, 10, 255], [60, 50, 40, 255]]
    rle = struct.pack("<IiiHHIIiiII", 40, 4, 1, 1, 8, 1, 0, 0, 0, 2, 0)
    b = b"BM" + struct.pack("<IHHI", 0, 0, 0, 62) + rle + pal + b"\x03\x01\x01\x00\x00\x01"
    assert X.decode_bmp(b)[0, :, 0].tolist() == [60, 60, 60, 30]


def test_apng_composition():
    a, b = np.zeros((4, 4, 4), np.uint8), np.zeros((4, 4, 4), np.uint8)
    a[..., 3] = 255
    b[1, 1] = (255, 0, 0, 128)
    data = X.encode_apng([(a, 40), (b, 60)])
    assert X.is_apng(data) and not X.is_apng(X.encode_png(a))
    out = X.compose_apng(data)
    assert [d for _, d in out] == [40, 60] and (out[0][0] == a).all() and (out[1][0] == b).all()
    with pytest.raises(X.CodecError):
        X.compose_apng(data, limit=16)


def test_refusals_and_registry():
    for bad in (b"", b"BM", b"\x89PNG\r\n\x1a\n", b"P6\n2 2\n255\nx", b"nothing at all"):
        with pytest.raises(Exception):
            X.decode(bad)
    with pytest.raises(X.CodecError):
        X.decode(X.encode_png(gray_noise()), limit=10)
    X.register(X.Codec("dot", accepts=lambda b: b[:3] == b"DOT", decode=lambda b: np.full((1, 1, 4), 9, np.uint8)))
    assert X.decode(b"DOT")[0] == "dot" and "dot" in X.registered()["decode"]
    assert X.unregister("dot") and not X.unregister("dot")


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(X.encode_png(flat_artwork(8, 6).astype(np.uint8)))
    (tmp_path / "b.tga").write_bytes(X.encode_tga(alpha_blob().astype(np.uint8)[:5, :7]))
    (tmp_path / "c.bin").write_bytes(b"none")
    r = {x["path"].rsplit("/", 1)[1]: x for x in rasters.read(spark, str(tmp_path)).collect()}
    assert (r["a.png"]["format"], r["a.png"]["width"], r["a.png"]["height"]) == ("png", 8, 6)
    assert r["b.tga"]["format"] == "tga" and r["c.bin"]["error"] == "unknown format"
    px = rasters.to_pixels(rasters.read(spark, str(tmp_path), "*.png"))
    back = rasters.from_pixels(px).first()
    assert (np.frombuffer(back["data"], np.uint8).reshape(6, 8, 4) == flat_artwork(8, 6)).all()


def test_a_worker_holds_bounded_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rasters, "HELD", 4 * 500, raising=False)
    monkeypatch.setattr(rasters, "STRIP", 100, raising=False)
    shapes = [(3, 4)] * 60 + [(40, 30)] + [(1, 1)] * 5
    images = [gray_noise(h, w, k) for k, (h, w) in enumerate(shapes)]
    d = tmp_path / "f"
    d.mkdir()
    for k, o in enumerate(images):
        (d / f"{k:03}.png").write_bytes(X.encode_png(o))
    (d / "bad.png").write_bytes(b"none")
    sizes = []
    seen = spark.createDataFrame([(p.name, p.read_bytes()) for p in sorted(d.iterdir())], "path string, content binary").coalesce(1)
    whole = pa.RecordBatch.from_pylist([{"path": r["path"], "content": bytes(r["content"])} for r in seen.collect()])

    class Rows:  # in place of the table: runs what would run in a worker
        sparkSession, schema = spark, seen.schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            out = list(run(iter([whole])))
            sizes.append([b.num_rows for b in out])
            return pa.Table.from_batches(out)

    files = rasters.decoded(Rows())
    assert files.num_rows == len(images) + 1 and files.column("error").null_count == len(images)
    assert max(sizes[0]) <= 42 and len(sizes[0]) > 2, "not all images of a batch decoded at once"
    px = rasters.decoded_pixels(Rows(), ["path"])
    assert max(sizes[1]) < 200, "many small images together, a large one in parts"
    back = {k: np.zeros((h, w, 4), np.uint8) for k, (h, w) in enumerate(shapes)}
    for r in px.to_pylist():
        back[int(r["path"][:3])][r["y"], r["x"]] = [r[c] for c in "rgba"]
    assert px.num_rows == sum(h * w for h, w in shapes) and all((back[k] == o).all() for k, o in enumerate(images))


@pytest.mark.parametrize("module, name", [("misc", "codec_round_trip"), ("finishing", "codec_kinds")])
def test_round_trips_take_two_passes(spark, tmp_path, module, name):
    at = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(7 + k, [((k + 3 * j) % 64) / 32 - 1 for j in range(64)]) for k in range(5)], "vec_id long, embedding array<float>").write.parquet(at)
    df = importlib.import_module(f"rasterloom.queries.{module}").QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 2, "each one keeps a Python worker a task"
    assert df.count() == 5 * 64 * (4 if name == "codec_kinds" else 1)


def test_edit_order_and_names(spark):
    from rasterloom.operators import edit as E

    p = pixels(spark, {"f": flat_artwork(6, 4)})
    a = E.edit(p, {"negate": True, "flip": True}).orderBy("y", "x").select("r").collect()
    b = E.flip(E.negate(p)).orderBy("y", "x").select("r").collect()
    assert a == b and E.has_ops({"flip": True}) and not E.has_ops({"flip": False})
    with pytest.raises(ValueError, match="no such"):
        E.edit(p, {"melt": True})
    assert E.edit(p, {"rotate": {"quarter_turns": 4}}).exceptAll(p).count() == 0
    c = E.edit(p, {"crop": {"x": 1, "y": 1, "width": 99, "height": 2}}).agg(F.max("width"), F.max("height"), F.count("*")).first()
    assert tuple(c) == (5, 2, 10)
