"""Small rasters by formula, and pixel relations of them."""

import numpy as np


def flat_artwork(w=120, h=90):
    y, x = np.mgrid[0:h, 0:w]
    d = np.hypot(x - w / 2, y - h / 2)
    o = np.zeros((h, w, 4), int) + 255
    o[...] = (40, 150, 110, 255)
    o[x < 2 * w / 3] = (250, 244, 232, 255)
    o[x < w / 3] = (32, 96, 160, 255)
    o[d < 34] = (214, 69, 65, 255)
    o[d < 18] = (250, 244, 232, 255)
    return o


def alpha_blob():
    y, x = np.mgrid[0:64, 0:64]
    d = np.hypot(x - 32, y - 32)
    o = np.zeros((64, 64, 4), int)
    o[..., :3] = (30, 110, 200)
    o[..., 3] = np.where(d > 26, 0, np.where(d > 18, np.floor(255 * (1 - (d - 18) / 8) + 0.5), 255))
    return o


def pinch():
    o = np.full((4, 4, 4), 255)
    o[:2, :2, :3] = 0
    o[2:, 2:, :3] = 0
    return o


def photo(w=96, h=72, seed=7):
    state = seed & 0xFFFFFFFF

    def rand():
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    o = np.zeros((h, w, 4), int)
    for y in range(h):
        for x in range(w):
            u, v = x / (w - 1), y / (h - 1)
            r = 40 + 180 * u + 20 * np.sin(9 * v) + 12 * rand()
            g = 30 + 150 * v + 30 * np.cos(7 * u) + 12 * rand()
            b = 200 - 120 * u * v + 12 * rand()
            o[y, x] = [*(int(np.clip(np.floor(c + 0.5), 0, 255)) for c in (r, g, b)), 255]
    return o


def planes(o):
    return {c: o[..., i] for i, c in enumerate("rgba")}


def pixels(spark, images):
    """images: {img_id: (h, w, 4)}"""
    import pandas as pd

    parts = []
    for k, o in images.items():
        h, w, _ = o.shape
        y, x = np.mgrid[0:h, 0:w]
        parts.append(pd.DataFrame({"img_id": k, "width": w, "height": h, "x": x.ravel(), "y": y.ravel(), **{c: o[..., i].ravel() for i, c in enumerate("rgba")}}))
    return spark.createDataFrame(pd.concat(parts), "img_id string, width int, height int, x int, y int, r int, g int, b int, a int")
