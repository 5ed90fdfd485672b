"""Page images as NumPy kernels in Arrow batches: clean-up, boxes, layout.

One image is one row; kernels see one image at a time, so memory is bounded by
the largest image.  An image that fails gives success = false and its error.
Skew is found as the angle whose rows differ most in ink, and stable regions
by thresholds in steps, where other libraries use line transforms and
component trees.
"""

from __future__ import annotations

import struct
import sys
import time
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pagemill.config import Detection, Preprocess, Settings


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image; a gray one as it is."""
    if image.ndim == 2:
        return image
    return np.floor(image[..., :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def to_rgb(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)


def shrink(image: np.ndarray, most: int) -> np.ndarray:
    """Area mean so that no side is above ``most``; sizes are cut to whole numbers."""
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    rows, cols = (max(1, int(n * most / max(h, w))) for n in (h, w))

    def bins(size: int, out: int) -> np.ndarray:
        edges = np.linspace(0, size, out + 1)
        at = np.arange(size)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * out / size

    flat = np.tensordot(bins(h, rows), image.astype(float), (1, 0))
    flat = np.moveaxis(np.tensordot(bins(w, cols), flat, (1, 1)), 0, 1)
    return np.floor(flat + 0.5).astype(np.uint8)


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    padded = np.pad(image, size // 2, mode="reflect" if min(image.shape) > size // 2 else "edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size))


def _filter_rows(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = len(kernel) // 2
    padded = np.pad(image, ((half, half), (0, 0)), mode="edge")
    return sum(k * padded[i : i + len(image)] for i, k in enumerate(kernel))


def gaussian(image: np.ndarray, size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    return _filter_rows(_filter_rows(image.astype(float), kernel).T, kernel).T


def denoise(image: np.ndarray, size: int = 3) -> np.ndarray:
    smooth = np.floor(gaussian(image, size) + 0.5).astype(np.uint8)
    return np.median(_windows(smooth, size), axis=(2, 3)).astype(np.uint8)


def otsu_threshold(image: np.ndarray) -> int:
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    first = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = first / below - (first[-1] - first) / (total - below)
        between = np.nan_to_num(below * (total - below) * gap**2)
    return int(between.argmax())


def equalize(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalization by tiles, blended between tile centres."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            maps[i, j] = np.clip(np.floor(np.cumsum(n) * 255 / (th * tw) + 0.5), 0, 255)
    y, x = np.clip(np.arange(h) / th - 0.5, 0, tiles - 1), np.clip(np.arange(w) / tw - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(y.astype(int), tiles - 2), np.minimum(x.astype(int), tiles - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[(y0 + a)[:, None], (x0 + b)[None, :], image]
    mixed = at(0, 0) * (1 - fy) * (1 - fx) + at(0, 1) * (1 - fy) * fx + at(1, 0) * fy * (1 - fx) + at(1, 1) * fy * fx
    return np.floor(mixed + 0.5).astype(np.uint8)


def binarize(image: np.ndarray, method: str = "adaptive", block: int = 31) -> np.ndarray:
    """0 or 255; an unknown method is otsu."""
    block += block % 2 == 0
    if method == "adaptive":
        level = np.floor(gaussian(image, block) + 0.5) - 10
    elif method == "sauvola":
        mean = gaussian(image, block)
        spread = np.sqrt(np.maximum(gaussian(image.astype(float) ** 2, block) - mean**2, 0))
        level = mean * (1 + 0.34 * (spread / 128 - 1))
    else:
        level = otsu_threshold(image)
    return np.where(image > level, 255, 0).astype(np.uint8)


def grow(mask: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    """Dilation by a rectangle."""
    for _ in range(times):
        for axis, n in ((1, width), (0, height)):
            total = np.cumsum(np.pad(mask.astype(np.int32), [(n - n // 2 if a == axis else 0, n // 2 if a == axis else 0) for a in (0, 1)]), axis=axis)
            mask = (np.take(total, np.arange(n, total.shape[axis]), axis) - np.take(total, np.arange(total.shape[axis] - n), axis)) > 0
    return mask


def erode(mask: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    return ~grow(~mask, width, height, times)


def components(mask: np.ndarray) -> np.ndarray:
    """x, y, w, h and pixels of each 8-connected part, top to bottom."""
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]
    parent = np.arange(len(row))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        a, b = int(first[y - 1]), int(first[y])
        while a < first[y] and b < first[y + 1]:
            if start[a] <= end[b] and start[b] <= end[a]:
                i, j = find(a), find(b)
                parent[max(i, j)] = min(i, j)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    if not len(row):
        return np.zeros((0, 5), np.int64)
    root = np.array([find(i) for i in range(len(row))])
    _, part = np.unique(root, return_inverse=True)
    n = part.max() + 1
    low = lambda v: np.minimum.reduceat(v[np.argsort(part, kind="stable")], np.searchsorted(np.sort(part), np.arange(n)))
    high = lambda v: -low(-v)
    x, y = low(start), low(row)
    return np.stack([x, y, high(end) - x, high(row) + 1 - y, np.bincount(part, end - start).astype(np.int64)], axis=1)


def crop_borders(image: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """The box of the largest inked part, 5 pixels wider, and where it starts."""
    h, w = image.shape
    ink = grow(image <= otsu_threshold(image), max(w // 50, 3), max(h // 50, 3), 3)
    parts = components(ink)
    if not len(parts):
        return image, (0, 0)
    x, y, bw, bh, _ = parts[(parts[:, 2] * parts[:, 3]).argmax()]
    x, y = max(0, x - 5), max(0, y - 5)
    return image[y : y + min(h - y, bh + 10), x : x + min(w - x, bw + 10)], (int(x), int(y))


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre on a canvas that holds all of it, edges repeated."""
    h, w = image.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    nh, nw = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    y, x = np.mgrid[:nh, :nw]
    dy, dx = y - nh / 2, x - nw / 2
    sx, sy = np.clip(c * dx - s * dy + w / 2, 0, w - 1), np.clip(s * dx + c * dy + h / 2, 0, h - 1)
    return image[np.floor(sy + 0.5).astype(int).clip(0, h - 1), np.floor(sx + 0.5).astype(int).clip(0, w - 1)]


def skew(binary: np.ndarray, most: float = 45.0, step: float = 0.5) -> float:
    """The angle to turn by so that rows differ most in ink; 0 below half a degree."""
    small = shrink(binary, 400) < 128
    y, x = np.nonzero(small)
    if len(y) < 50:
        return 0.0
    best = (-1.0, 0.0)
    for a in np.arange(-most, most + step, step):
        row = np.floor(y * np.cos(np.radians(a)) - x * np.sin(np.radians(a))).astype(int)
        contrast = float((np.bincount(row - row.min()).astype(float) ** 2).sum())
        if contrast > best[0]:
            best = (contrast, float(a))
    return best[1] if abs(best[1]) >= 0.5 else 0.0


def enhance(image: np.ndarray, config: Preprocess | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Binary and gray images, and crop_x, crop_y and angle; only the binary one is turned."""
    config = config or Preprocess()
    gray, frame = to_gray(image), {"crop_x": 0, "crop_y": 0, "angle": 0.0}
    if config.remove_borders:
        gray, (frame["crop_x"], frame["crop_y"]) = crop_borders(gray)
    if config.denoise:
        gray = denoise(gray, config.denoise_ksize)
    if config.clahe:
        gray = equalize(gray, config.clahe_clip_limit)
    binary = binarize(gray, config.binarize_method, config.binarize_block_size) if config.binarize else gray
    if config.deskew:
        frame["angle"] = skew(binary)
        binary = rotate(binary, frame["angle"]) if frame["angle"] else binary
    return binary, gray, frame


def lite_enhance(image: np.ndarray) -> np.ndarray:
    """At most 2,000 pixels a side, lightness equalized, hue kept."""
    image = shrink(image, 2000)
    if image.ndim == 2:
        return image
    light = to_gray(image)
    return np.clip(np.floor(image * (equalize(light) / np.maximum(light, 1))[..., None] + 0.5), 0, 255).astype(np.uint8)


def contour_boxes(image: np.ndarray, config: Detection | None = None) -> list[tuple[int, int, int, int, float]]:
    """Lines of text: dark pixels grown 30 by 5."""
    config = config or Detection()
    gray = to_gray(image)
    parts = components(grow(gray <= otsu_threshold(gray), 30, 5))
    ok = (parts[:, 4] >= config.min_region_area) & (parts[:, 4] <= 5 * config.max_region_area)
    ratio = parts[:, 2] / np.maximum(parts[:, 3], 1)
    ok &= (ratio >= config.min_aspect_ratio) & (ratio <= config.max_aspect_ratio)
    return [(*map(int, p[:4]), 0.6) for p in parts[ok]]


def stable_boxes(image: np.ndarray, config: Detection | None = None, step: int = 16) -> list[tuple[int, int, int, int, float]]:
    """Dark parts whose size changes by less than a quarter from threshold to threshold."""
    config = config or Detection()
    gray, before, out = to_gray(image), {}, {}
    for level in range(step, 256, step):
        now = {}
        for x, y, w, h, n in components(gray < level).tolist():
            if config.min_region_area <= n <= config.max_region_area:
                now[x, y] = n
                near = before.get((x, y))
                if near and n - near < near / 4 and config.min_aspect_ratio <= w / h <= config.max_aspect_ratio:
                    out[x, y, w, h] = (x, y, w, h, 0.7)
        before = now
    return list(out.values())


def layout_boxes(binary: np.ndarray, rgb: np.ndarray | None = None) -> list[tuple[int, int, int, int, str, float]]:
    """Title, header, footer, tables and seals, in this order."""
    h, w = binary.shape
    out = []
    parts = components(binary[: h // 5] < 128)
    if len(parts):
        x, y = parts[:, 0].min(), parts[:, 1].min()
        bw, bh = (parts[:, 0] + parts[:, 2]).max() - x, (parts[:, 1] + parts[:, 3]).max() - y
        if bw >= w * 0.3:
            out.append((int(x), int(y), int(bw), int(bh), "title", 0.8))
    rows = min(max(h // 20, 20), h)
    if (binary[:rows] == 255).mean() < 0.95:
        out.append((0, 0, w, rows, "header", 0.6))
    if (binary[h - rows :] == 255).mean() < 0.95:
        out.append((0, h - rows, w, rows, "footer", 0.6))
    ink = binary < 128
    across, down = max(w // 3, 1), max(h // 3, 1)
    lines = grow(erode(ink, across, 1), across, 1) & grow(erode(ink, 1, down), 1, down)
    out += [(int(x), int(y), int(bw), int(bh), "table", 0.7) for x, y, bw, bh, n in components(lines) if n >= 1000 and bw >= w * 0.1 and bh >= h * 0.05]
    if rgb is not None and rgb.ndim == 3:
        out += [(int(x), int(y), int(bw), int(bh), "seal", 0.8) for x, y, bw, bh, n in components(red_mask(rgb)) if 200 <= n <= 50_000 and 0.5 < bw / bh < 2.0]
    return out


def red_mask(rgb: np.ndarray) -> np.ndarray:
    """Pixels of red hue, closed and opened by 5 pixels."""
    c = rgb.astype(float)
    top, low = c.max(axis=2), c.min(axis=2)
    spread = np.maximum(top - low, 1e-9)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    hue = np.where(top == r, (g - b) / spread % 6, np.where(top == g, (b - r) / spread + 2, (r - g) / spread + 4)) * 30
    red = ((hue <= 10) | (hue >= 160)) & ((top - low) / np.maximum(top, 1) * 255 >= 70) & (top >= 50)
    red = erode(grow(red, 5, 5, 2), 5, 5, 2)
    return grow(erode(red, 5, 5), 5, 5)


def found_boxes(image: np.ndarray, config: Detection | None = None) -> list[tuple[int, int, int, int, float, str]]:
    """Boxes by the method of the settings; an unknown one is both, stable regions first."""
    config = config or Detection()
    stable = [] if config.method == "contour_only" else [(*b, "mser") for b in stable_boxes(image, config)]
    return stable + ([] if config.method == "mser_only" else [(*b, "contour") for b in contour_boxes(image, config)])


def resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area mean of a gray image to a given size, larger or smaller."""

    def bins(size: int, out: int) -> np.ndarray:
        edges = np.linspace(0, size, out + 1)
        at = np.arange(size)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * out / size

    return np.floor(bins(image.shape[0], rows) @ image.astype(float) @ bins(image.shape[1], cols).T + 0.5).astype(np.uint8)


def difference_hash(image: np.ndarray, n: int = 8) -> str:
    """Bits of n rows of n neighbours, brighter to the right, in hex digits."""
    small = resize(to_gray(image), n, n + 1).astype(int)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return "".join(f"{int(''.join('1' if b else '0' for b in bits[i : i + 4]).ljust(4, '0'), 2):x}" for i in range(0, len(bits), 4))


def decode(data: bytes) -> np.ndarray:
    """A gray or RGB array of a PNG of 8 bits a sample without interlace, or of a BMP of 24 bits.

    Alpha is dropped.  Anything else is a ValueError.
    """
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("cannot decode image")
    at, head, palette, packed = 8, None, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3] if head else -1)
    if channels is None or head[2] != 8 or head[6]:
        raise ValueError("cannot decode image")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out, above = np.empty((height, width, channels), np.uint8), np.zeros((width, channels), np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:].reshape(width, channels), above)
    if head[3] == 3:
        return palette[out[..., 0]]
    return out[..., :3] if channels > 2 else out[..., 0]


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A PNG row from its differences to the left (1), above (2), their mean (3) or the nearest (4)."""
    if kind < 3:
        return [row, np.cumsum(row, axis=0, dtype=np.uint8), row + above][kind]
    out = []
    for c in range(row.shape[1]):
        left, corner, own = 0, 0, []
        for x, up in zip(row[:, c].tolist(), above[:, c].tolist(), strict=True):
            if kind == 3:
                guess = (left + up) // 2
            else:
                near = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                guess = (left, up, corner)[near.index(min(near))]
            left, corner = (x + guess) & 255, up
            own.append(left)
        out.append(own)
    return np.array(out, np.uint8).T


def _decode_bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits != 24 or packed:
        raise ValueError("cannot decode image")
    step = -(-width * 3 // 4) * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * step, start).reshape(abs(height), step)[:, : width * 3].reshape(abs(height), width, 3)
    return rows[:: -1 if height > 0 else 1, :, ::-1]


def png(image: np.ndarray) -> bytes:
    """A gray or RGB image of bytes as a PNG file."""
    h, w = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


SCHEMA = "path string, success boolean, error string, height int, width int, crop_x int, crop_y int, angle double, hash string, timings map<string,double>, regions array<struct<region_idx:bigint,x:int,y:int,w:int,h:int,confidence:double,method:string>>, layout array<struct<layout_idx:int,x:int,y:int,w:int,h:int,region_type:string,confidence:double>>"


def pixels_of(row) -> np.ndarray:
    """An RGB or gray array of an image-source row (BGR order)."""
    if row["height"] is None or row["height"] <= 0:
        raise ValueError("cannot decode image")
    flat = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return flat[..., 0] if row["nChannels"] == 1 else flat[..., 2::-1]


def _analyse(settings: Settings, profile: str):
    def one(row) -> tuple:
        took, began = {}, time.perf_counter()

        def done(stage: str) -> None:
            nonlocal began
            now = time.perf_counter()
            took[stage], began = round((now - began) * 1000, 1), now

        image = pixels_of(row)
        image = lite_enhance(image) if profile == "lite" else shrink(image, settings.image.max_dimension)
        image = to_gray(image) if settings.image.color_mode == "gray" else image
        done("load")
        binary, _, at = enhance(image, settings.preprocess)
        done("preprocess")
        regions = [dict(region_idx=i, x=b[0], y=b[1], w=b[2], h=b[3], confidence=b[4], method=b[5]) for i, b in enumerate(found_boxes(binary, settings.detection))]
        done("detection")
        layout = [dict(layout_idx=i, x=b[0], y=b[1], w=b[2], h=b[3], region_type=b[4], confidence=b[5]) for i, b in enumerate(layout_boxes(binary, image))]
        done("layout")
        return (row["origin"], True, None, binary.shape[0], binary.shape[1], at["crop_x"], at["crop_y"], at["angle"], difference_hash(image), took, regions, layout)

    def run(frames):
        for frame in frames:
            out = []
            for _, row in frame.iterrows():
                try:
                    out.append(one(row))
                except Exception as e:  # one bad image never fails the job
                    out.append((row["origin"], False, f"{type(e).__name__}: {e}", None, None, None, None, None, None, {}, [], []))
            yield pd.DataFrame(out, columns=COLUMNS)

    return run


COLUMNS = ["path", "success", "error", "height", "width", "crop_x", "crop_y", "angle", "hash", "timings", "regions", "layout"]


def analyse(images: DataFrame, settings: Settings | None = None, profile: str = "standard") -> DataFrame:
    """Clean up, find boxes and layout of rows of the image source; timings are milliseconds by stage."""
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(_analyse(settings or Settings(), profile), SCHEMA)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
