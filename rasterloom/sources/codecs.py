"""Raster codecs in numpy and the standard library: BMP, ICO, PNM, TGA, PNG and APNG. Each decoder gives (height, width, 4) RGBA of bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

MAX_PIXELS = 268_402_689


class CodecError(ValueError):
    """Bytes that no codec can read."""


def check_size(w: int, h: int, limit: int | None = MAX_PIXELS) -> None:
    if w < 1 or h < 1:
        raise CodecError("an image needs a width and a height")
    if limit is not None and w * h > limit:
        raise CodecError(f"{w}x{h} is over the pixel limit of {limit}")


def sniff(b: bytes) -> str | None:
    """The format by its first bytes; TGA has none and is tried last."""
    if b[:2] == b"BM":
        return "bmp"
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if b[:4] in (b"\0\0\1\0", b"\0\0\2\0") and len(b) >= 6 and b[4] + 256 * b[5]:
        return "ico"
    if b[:1] == b"P" and b[1:2] in b"123456" and b[2:3] in b" \t\r\n#":
        return "pnm"
    return None


# -- BMP


def _channel(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(v.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return ((((v & mask) >> shift).astype(np.int64) * 255 * 2 + top) // (2 * top)).astype(np.uint8)


def decode_bmp(b: bytes, embedded: bool = False) -> np.ndarray:
    """All usual depths: 1, 4, 8 (RLE4, RLE8), 16, 24, 32 bits, BITFIELDS, either row order; embedded: a headerless DIB of an icon with its AND mask."""
    at = 0 if embedded else 14
    if len(b) < at + 12:
        raise CodecError("unexpected end of BMP header")
    size = struct.unpack_from("<I", b, at)[0]
    masks = [0, 0, 0, 0]
    if size == 12:
        w, h, _, depth = struct.unpack_from("<HHHH", b, at + 4)
        comp, used = 0, 0
    else:
        w, h, _, depth, comp, _, _, _, used, _ = struct.unpack_from("<iiHHIIiiII", b, at + 4)
    down = h < 0
    h = abs(h) // (2 if embedded else 1)
    check_size(w, h)
    table = at + size
    if comp in (3, 6):
        n = 4 if comp == 6 or size >= 56 else 3
        masks[:n] = struct.unpack_from(f"<{n}I", b, at + 40)
        if size == 40:
            table += 4 * n
    elif depth == 16:
        masks = [0x7C00, 0x3E0, 0x1F, 0]
    elif depth == 32:
        masks = [0xFF0000, 0xFF00, 0xFF, 0xFF000000]
    if depth <= 8:
        step = 3 if size == 12 else 4
        n = min(used or 1 << depth, 1 << depth, max(0, (len(b) - table) // step))
        pal = np.zeros((256, 3), np.uint8)
        pal[:n] = np.frombuffer(b, np.uint8, n * step, table).reshape(n, step)[:, 2::-1][:, :3]
        end = table + n * step
    else:
        end = table
    pos = end if embedded else struct.unpack_from("<I", b, 10)[0]
    out = np.zeros((h, w, 4), np.uint8)
    if comp in (1, 2):
        idx, ink = _rle(b, pos, w, h, comp == 2)
        out[..., :3], out[..., 3] = pal[idx], np.where(ink, 255, 0)
    else:
        stride = (w * depth + 31) // 32 * 4
        if len(b) < pos + stride * h:
            raise CodecError("unexpected end of BMP pixels")
        raw = np.frombuffer(b, np.uint8, stride * h, pos).reshape(h, stride)
        if depth <= 8:
            bits = np.unpackbits(raw, axis=1)[:, : w * depth].reshape(h, w, depth)
            out[..., :3] = pal[bits @ (1 << np.arange(depth)[::-1])]
            out[..., 3] = 255
        elif depth == 24:
            out[..., :3], out[..., 3] = raw[:, : w * 3].reshape(h, w, 3)[..., ::-1], 255
        elif depth in (16, 32):
            v = raw[:, : w * depth // 8].copy().view("<u2" if depth == 16 else "<u4").astype(np.int64)
            for i in range(3):
                out[..., i] = _channel(v, masks[i])
            a = _channel(v, masks[3])
            out[..., 3] = a if masks[3] and a.any() else 255
        else:
            raise CodecError(f"unsupported BMP depth {depth}")
        pos += stride * h
    if not down:
        out = out[::-1].copy()
    if embedded and depth < 32:
        stride = (w + 31) // 32 * 4
        if len(b) >= pos + stride * h:
            mask = np.unpackbits(np.frombuffer(b, np.uint8, stride * h, pos).reshape(h, stride), axis=1)[::-1, :w]
            out[..., 3] = np.where(mask == 1, 0, 255)
    return out


def _rle(b: bytes, i: int, w: int, h: int, four: bool) -> tuple[np.ndarray, np.ndarray]:
    out, ink = np.zeros((h, w), np.uint8), np.zeros((h, w), bool)
    x = y = 0
    while i + 1 < len(b) and y < h:
        n, v = b[i], b[i + 1]
        i += 2
        if n:
            row = [(v >> 4) if k % 2 == 0 else v & 15 for k in range(n)] if four else [v] * n
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            x, y = x + b[i], y + b[i + 1]
            i += 2
            continue
        else:
            size = (v + 1) // 2 if four else v
            raw = b[i : i + size]
            row = [(raw[k // 2] >> 4) if k % 2 == 0 else raw[k // 2] & 15 for k in range(v)] if four else list(raw)
            i += size + size % 2
        m = max(0, min(len(row), w - x))
        out[y, x : x + m], ink[y, x : x + m] = row[:m], True
        x += len(row)
    return out, ink


def encode_bmp(px: np.ndarray) -> bytes:
    """24 bits for opaque images, else 32 bits with masks (V4 header)."""
    h, w, _ = px.shape
    opaque = bool((px[..., 3] == 255).all())
    if opaque:
        stride = (w * 3 + 3) // 4 * 4
        rows = np.zeros((h, stride), np.uint8)
        rows[:, : w * 3] = px[::-1, :, 2::-1].reshape(h, w * 3)
        head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0)
    else:
        rows = px[::-1][..., [2, 1, 0, 3]].copy()
        head = struct.pack("<IiiHHIIiiII4I", 108, w, h, 1, 32, 3, w * h * 4, 2835, 2835, 0, 0, 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body


# -- ICO


@dataclass
class IconEntry:
    width: int
    height: int
    depth: int
    offset: int
    size: int


def icon_entries(b: bytes) -> list[IconEntry]:
    out = []
    for i in range(struct.unpack_from("<H", b, 4)[0]):
        if 6 + 16 * (i + 1) > len(b):
            break
        w, h, _, _, _, depth, size, offset = struct.unpack_from("<BBBBHHII", b, 6 + 16 * i)
        out.append(IconEntry(w or 256, h or 256, depth, offset, size))
    return out


def decode_ico(b: bytes, index: int | None = None) -> np.ndarray:
    """The largest entry, deepest of equal ones, or that of an index."""
    entries = icon_entries(b)
    if not entries:
        raise CodecError("an icon without entries")
    e = entries[index] if index is not None else max(entries, key=lambda e: (e.width * e.height, e.depth))
    data = b[e.offset : e.offset + e.size]
    return decode_png(data) if sniff(data) == "png" else decode_bmp(data, True)


def encode_ico(images: list[np.ndarray]) -> bytes:
    """An icon; PNG for entries above 48 pixels or where it is smaller, else a DIB with mask."""
    blobs = []
    for px in images:
        h, w, _ = px.shape
        mask = np.zeros((h, (w + 31) // 32 * 4 * 8), np.uint8)
        mask[:, :w] = px[::-1, :, 3] == 0
        dib = struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 32, 0, 0, 0, 0, 0, 0) + px[::-1][..., [2, 1, 0, 3]].tobytes() + np.packbits(mask, axis=1).tobytes()
        png = encode_png(px)
        blobs.append(png if max(w, h) > 48 or len(png) < len(dib) else dib)
    head, at = struct.pack("<HHH", 0, 1, len(blobs)), 6 + 16 * len(blobs)
    for px, blob in zip(images, blobs):
        h, w, _ = px.shape
        head += struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, 1, 32, len(blob), at)
        at += len(blob)
    return head + b"".join(blobs)


# -- PNM


def decode_pnm(b: bytes) -> np.ndarray:
    """P1 to P6; values scale to 255 with rounding, more than 255 levels are two bytes, in bitmaps 1 is black."""
    kind = b[1] - 48
    pos, nums = 2, []
    while len(nums) < (2 if kind in (1, 4) else 3):
        while pos < len(b) and b[pos : pos + 1].isspace():
            pos += 1
        if b[pos : pos + 1] == b"#":
            while pos < len(b) and b[pos] not in b"\r\n":
                pos += 1
            continue
        end = pos
        while end < len(b) and b[end : end + 1].isdigit():
            end += 1
        if end == pos:
            raise CodecError("bad PNM header")
        nums.append(int(b[pos:end]))
        pos = end
    w, h = nums[:2]
    top = nums[2] if len(nums) > 2 else 1
    check_size(w, h)
    if not 0 < top < 65536:
        raise CodecError("bad PNM maximum")
    ch = 3 if kind in (3, 6) else 1
    n = w * h * ch
    if kind < 4:
        text = b"\n".join(line.split(b"#")[0] for line in b[pos:].splitlines())
        v = np.array([c - 48 for c in text if 48 <= c <= 49] if kind == 1 else [int(t) for t in text.split()], np.int64)
    elif kind == 4:
        stride = (w + 7) // 8
        rows = np.frombuffer(b[pos + 1 : pos + 1 + stride * h].ljust(stride * h, b"\0"), np.uint8).reshape(h, stride)
        v = np.unpackbits(rows, axis=1)[:, :w].ravel().astype(np.int64)
    else:
        wide = 2 if top > 255 else 1
        have = min(n, (len(b) - pos - 1) // wide)
        v = np.frombuffer(b, ">u2" if wide == 2 else np.uint8, max(have, 0), pos + 1).astype(np.int64) if have > 0 else np.zeros(0, np.int64)
    if len(v) < n:
        raise CodecError("unexpected end of PNM pixels")
    v = v[:n].reshape(h, w, ch)
    v = 255 * (1 - v) if kind in (1, 4) else (np.minimum(v, top) * 510 + top) // (2 * top)
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = v
    return out


def flat(px: np.ndarray, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    a = px[..., 3:].astype(float) / 255
    return np.floor(px[..., :3] * a + np.array(background) * (1 - a) + 0.5).astype(np.uint8)


def encode_pnm(px: np.ndarray, kind: int = 6) -> bytes:
    """P4, P5 or P6, flattened over white."""
    rgb = flat(px)
    h, w, _ = rgb.shape
    if kind == 6:
        return f"P6\n{w} {h}\n255\n".encode() + rgb.tobytes()
    gray = np.floor(rgb @ np.array([0.2126, 0.7152, 0.0722]) + 0.5).astype(np.uint8)
    if kind == 5:
        return f"P5\n{w} {h}\n255\n".encode() + gray.tobytes()
    return f"P4\n{w} {h}\n".encode() + np.packbits(gray < 128, axis=1).tobytes()


# -- TGA


def is_tga(b: bytes) -> bool:
    if len(b) < 18:
        return False
    if b[-18:-2] == b"TRUEVISION-XFILE":
        return True
    kind, depth, pal = b[2], b[16], b[1]
    w, h = struct.unpack_from("<HH", b, 12)
    return pal in (0, 1) and kind in (1, 2, 3, 9, 10, 11) and w > 0 and h > 0 and depth in (8, 15, 16, 24, 32) and (kind in (1, 9)) == (pal == 1)


def _tga_colours(v: np.ndarray, depth: int, attribute: int) -> np.ndarray:
    out = np.full((len(v), 4), 255, np.uint8)
    if depth == 8:
        out[:, :3] = v
    elif depth in (15, 16):
        k = v[:, 0].astype(int) | v[:, 1].astype(int) << 8
        for i, s in enumerate((10, 5, 0)):
            out[:, i] = ((k >> s & 31) * 255 + 15) // 31
        if depth == 16 and attribute:
            out[:, 3] = np.where(k >> 15, 255, 0)
    else:
        out[:, :3] = v[:, 2::-1][:, :3]
        if depth == 32 and attribute:
            out[:, 3] = v[:, 3]
    return out


def decode_tga(b: bytes) -> np.ndarray:
    """True colour, gray and colour-mapped, plain or run-length coded, any origin."""
    ident, _, kind, first, count, pal_depth, _, _, w, h, depth, desc = struct.unpack_from("<BBBHHBHHHHBB", b)
    check_size(w, h)
    pos = 18 + ident
    attribute = desc & 15
    pal = None
    if b[1]:
        step = (pal_depth + 7) // 8
        pal = _tga_colours(np.frombuffer(b, np.uint8, count * step, pos).reshape(count, step), pal_depth, 8 if pal_depth == 32 else attribute)
        pos += count * step
    step, n = (depth + 7) // 8, w * h
    if kind < 8:
        if len(b) < pos + n * step:
            raise CodecError("unexpected end of TGA pixels")
        raw = np.frombuffer(b, np.uint8, n * step, pos).reshape(n, step)
    else:
        parts, have = [], 0
        while have < n and pos < len(b):
            c = b[pos]
            k = (c & 127) + 1
            if c & 128:
                parts.append(b[pos + 1 : pos + 1 + step] * k)
                pos += 1 + step
            else:
                parts.append(b[pos + 1 : pos + 1 + step * k])
                pos += 1 + step * k
            have += k
        data = b"".join(parts)
        if len(data) < n * step:
            raise CodecError("unexpected end of TGA pixels")
        raw = np.frombuffer(data[: n * step], np.uint8).reshape(n, step)
    if pal is not None:
        idx = raw[:, 0].astype(int) | (raw[:, 1].astype(int) << 8 if step > 1 else 0)
        out = pal[np.clip(idx - first, 0, len(pal) - 1)]
    else:
        out = _tga_colours(raw, depth, attribute)
    out = out.reshape(h, w, 4)
    if not desc & 32:
        out = out[::-1]
    return (out[:, ::-1] if desc & 16 else out).copy()


def run_length(rows: np.ndarray) -> bytes:
    """TGA packets of pixels (h, w, bytes): runs of 2 to 128 within a row, the rest literally."""
    out = bytearray()
    for row in rows:
        w = len(row)
        same = (row[1:] == row[:-1]).all(axis=1)
        cuts = np.concatenate(([0], np.flatnonzero(~same) + 1, [w]))
        literal: list[int] = []

        def flush(row: np.ndarray, literal: list[int]) -> None:
            for k in range(0, len(literal), 128):
                part = literal[k : k + 128]
                out.append(len(part) - 1)
                out.extend(row[part].tobytes())
            literal.clear()

        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i == 1:
                literal.append(int(i))
                continue
            flush(row, literal)
            for k in range(i, j, 128):
                out.append(127 + min(128, j - k))
                out.extend(row[k].tobytes())
        flush(row, literal)
    return bytes(out)


def encode_tga(px: np.ndarray, rle: bool = False) -> bytes:
    h, w, _ = px.shape
    opaque = bool((px[..., 3] == 255).all())
    raw = (px[..., 2::-1][..., :3] if opaque else px[..., [2, 1, 0, 3]]).copy()
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10 if rle else 2, 0, 0, 0, 0, 0, w, h, 24 if opaque else 32, 0x20 | (0 if opaque else 8))
    return head + (run_length(raw) if rle else raw.tobytes())


# -- PNG and APNG


def chunks(b: bytes) -> list[tuple[bytes, bytes]]:
    out, i = [], 8
    while i + 12 <= len(b):
        n = struct.unpack_from(">I", b, i)[0]
        kind = b[i + 4 : i + 8]
        if i + 12 + n > len(b):
            break
        out.append((kind, b[i + 8 : i + 8 + n]))
        i += 12 + n
        if kind == b"IEND":
            break
    return out


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _unfilter(raw: bytes, h: int, stride: int, bpp: int) -> np.ndarray:
    out = np.zeros((h + 1, stride + bpp), np.uint8)
    for y in range(h):
        f, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        row, up = out[y + 1], out[y]
        if f == 0:
            row[bpp:] = line
        elif f == 2:
            row[bpp:] = line + up[bpp:]
        elif f == 1:
            for k in range(bpp):
                row[bpp + k :: bpp] = np.cumsum(line[k::bpp], dtype=np.uint64).astype(np.uint8)
        else:
            r, u = row.tolist(), up.tolist()
            for i, v in enumerate(line.tolist()):
                a, b_, c = r[i], u[i + bpp], u[i]
                if f == 3:
                    p = (a + b_) >> 1
                else:
                    pa, pb, pc = abs(b_ - c), abs(a - c), abs(a + b_ - 2 * c)
                    p = a if pa <= pb and pa <= pc else b_ if pb <= pc else c
                r[i + bpp] = (v + p) & 255
            row[:] = r
    return out[1:, bpp:]


def decode_png(b: bytes) -> np.ndarray:
    """Non-interlaced PNG of all colour types; 16 bits keep their high byte."""
    cs = chunks(b)
    if not cs or cs[0][0] != b"IHDR":
        raise CodecError("bad PNG header")
    w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", cs[0][1])
    check_size(w, h)
    if lace:
        raise CodecError("unsupported interlaced PNG")
    ch = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride = (w * ch * depth + 7) // 8
    raw = zlib.decompressobj().decompress(b"".join(d for k, d in cs if k == b"IDAT"), (stride + 1) * h)
    if len(raw) < (stride + 1) * h:
        raise CodecError("unexpected end of PNG pixels")
    px = _unfilter(raw, h, stride, max(1, ch * depth // 8))
    if depth == 16:
        v = px.reshape(h, w, ch, 2)[..., 0]
    elif depth == 8:
        v = px.reshape(h, w, ch)
    else:
        v = (np.unpackbits(px, axis=1)[:, : w * depth].reshape(h, w, depth) @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
        if colour == 0:
            v = (v.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    by = dict(cs)
    out = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        pal = np.frombuffer(by[b"PLTE"], np.uint8).reshape(-1, 3)
        out[..., :3] = pal[np.minimum(v[..., 0], len(pal) - 1)]
        if t := by.get(b"tRNS"):
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(t)] = np.frombuffer(t, np.uint8)
            out[..., 3] = alpha[v[..., 0]]
    else:
        out[..., :3] = v[..., :3] if ch >= 3 else v[..., :1]
        if ch in (2, 4):
            out[..., 3] = v[..., -1]
    return out


def encode_png(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    opaque = bool((px[..., 3] == 255).all())
    body = (px[..., :3] if opaque else px).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), body], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if opaque else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


@dataclass
class Frame:
    x: int
    y: int
    delay_ms: int
    dispose: int
    blend: int
    pixels: np.ndarray


def is_apng(b: bytes) -> bool:
    kinds = [k for k, _ in chunks(b)] if sniff(b) == "png" else []
    return b"acTL" in kinds and (b"IDAT" not in kinds or kinds.index(b"acTL") < kinds.index(b"IDAT"))


def apng_frames(b: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width, height and the frames, each decoded as a PNG of its own."""
    cs = chunks(b)
    head = cs[0][1]
    w, h = struct.unpack(">II", head[:8])
    shared = [(k, d) for k, d in cs if k in (b"PLTE", b"tRNS")]
    raw: list[list] = []
    for k, d in cs:
        if k == b"fcTL":
            raw.append([struct.unpack(">IIIIIHHBB", d), []])
        elif raw and k == b"IDAT":
            raw[-1][1].append(d)
        elif raw and k == b"fdAT":
            raw[-1][1].append(d[4:])
    frames = []
    for (_, fw, fh, x, y, num, den, dispose, blend), parts in raw:
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", fw, fh) + head[8:]) + b"".join(chunk(k, d) for k, d in shared) + chunk(b"IDAT", b"".join(parts)) + chunk(b"IEND", b"")
        frames.append(Frame(x, y, round(1000 * num / (den or 100)), dispose, blend, decode_png(png)))
    return w, h, frames


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Straight-alpha source over."""
    sa, da = above[..., 3:].astype(float) / 255, below[..., 3:].astype(float) / 255
    oa = sa + da * (1 - sa)
    rgb = (above[..., :3] * sa + below[..., :3] * da * (1 - sa)) / np.where(oa == 0, 1, oa)
    return np.concatenate([np.floor(rgb + 0.5), np.floor(oa * 255 + 0.5)], -1).astype(np.uint8)


def compose_apng(b: bytes, limit: int | None = MAX_PIXELS) -> list[tuple[np.ndarray, int]]:
    """Every frame as it shows: (canvas, delay in ms), after blending and the disposal of its predecessor."""
    w, h, frames = apng_frames(b)
    check_size(w, h * max(1, len(frames)), limit)
    canvas, out = np.zeros((h, w, 4), np.uint8), []
    for i, f in enumerate(frames):
        fh, fw, _ = f.pixels.shape
        box = (slice(f.y, f.y + fh), slice(f.x, f.x + fw))
        before = canvas.copy()
        canvas[box] = over(canvas[box], f.pixels) if f.blend == 1 else f.pixels
        out.append((canvas.copy(), f.delay_ms))
        if f.dispose == 1 or (f.dispose == 2 and i == 0):
            canvas[box] = 0
        elif f.dispose == 2:
            canvas = before
    return out


def encode_apng(frames: list[tuple[np.ndarray, int]]) -> bytes:
    h, w, _ = frames[0][0].shape
    out = [b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)), chunk(b"acTL", struct.pack(">II", len(frames), 0))]
    seq = 0
    for i, (px, delay) in enumerate(frames):
        out.append(chunk(b"fcTL", struct.pack(">IIIIIHHBB", seq, w, h, 0, 0, delay, 1000, 0, 0)))
        seq += 1
        body = zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, -1)], 1).tobytes())
        if i:
            out.append(chunk(b"fdAT", struct.pack(">I", seq) + body))
            seq += 1
        else:
            out.append(chunk(b"IDAT", body))
    return b"".join([*out, chunk(b"IEND", b"")])


# -- registry


@dataclass
class Codec:
    name: str
    accepts: Callable[[bytes], bool] | None = None
    decode: Callable[[bytes], np.ndarray] | None = None
    encode: Callable[[np.ndarray], bytes] | None = None


_CUSTOM: list[Codec] = []
_DECODE = {"bmp": decode_bmp, "ico": decode_ico, "pnm": decode_pnm, "png": decode_png}
_ENCODE: dict[str, Callable[[np.ndarray], bytes]] = {"bmp": encode_bmp, "ico": lambda px: encode_ico([px]), "pnm": encode_pnm, "tga": encode_tga, "png": encode_png}


def register(codec: Codec) -> None:
    """The latest comes first."""
    _CUSTOM.insert(0, codec)


def unregister(name: str) -> bool:
    had = [c for c in _CUSTOM if c.name == name]
    for c in had:
        _CUSTOM.remove(c)
    return bool(had)


def find_decoder(b: bytes) -> Codec | None:
    """The first registered decoder that accepts the bytes; one whose test fails is passed over."""
    for c in _CUSTOM:
        try:
            if c.decode and c.accepts and c.accepts(b):
                return c
        except Exception:  # noqa: BLE001, S112
            continue
    return None


def registered() -> dict[str, list[str]]:
    return {"decode": sorted({*_DECODE, "tga", *(c.name for c in _CUSTOM if c.decode)}), "encode": sorted({*_ENCODE, *(c.name for c in _CUSTOM if c.encode)})}


def decode(b: bytes, limit: int | None = MAX_PIXELS) -> tuple[str, np.ndarray]:
    """(format, pixels): by signature, then registered decoders, TGA last."""
    kind = sniff(b)
    if kind:
        px = _DECODE[kind](b)
    elif c := find_decoder(b):
        kind, px = c.name, c.decode(b)
        if px.ndim != 3 or px.shape[2] != 4 or px.dtype != np.uint8:
            raise CodecError(f"decoder {kind} gave no RGBA bytes")
    elif is_tga(b):
        kind, px = "tga", decode_tga(b)
    else:
        raise CodecError("unknown format")
    check_size(px.shape[1], px.shape[0], limit)
    return kind, px


def encode(px: np.ndarray, kind: str) -> bytes:
    for c in _CUSTOM:
        if c.name == kind and c.encode:
            return c.encode(px)
    if kind not in _ENCODE:
        raise CodecError(f"unsupported output format {kind}")
    return _ENCODE[kind](px)
