"""Signals that need pixels: a frame's layout signature, presenter shares and navigation band, in numpy over decoded images
(the rows of Spark's image source). Everything after them is columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import rules

GRID_WIDTH, GRID_HEIGHT = 24, 14


def _weights(size: int, to: int) -> np.ndarray:
    """Cubic resampling weights (a = -0.5), widened where it shrinks, of each target sample."""
    scale = size / to
    reach = 2.0 * max(scale, 1.0)
    center = (np.arange(to) + 0.5) * scale
    x = np.abs((np.arange(size)[None] + 0.5 - center[:, None]) / max(scale, 1.0))
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    low, high = np.floor(center - reach + 0.5)[:, None], np.floor(center + reach + 0.5)[:, None]
    w = np.where((np.arange(size)[None] >= low) & (np.arange(size)[None] < high), w, 0.0)
    return w / w.sum(1, keepdims=True)


def resized(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image of whole values scaled to a size, columns first, rounded after each direction."""
    round8 = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    x = round8(np.einsum("oi,hi...->ho...", _weights(x.shape[1], width), x.astype(float)))
    return round8(np.einsum("oi,i...->o...", _weights(x.shape[0], height), x)).astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def edges(x: np.ndarray) -> np.ndarray:
    """Eight times a value less its neighbours; the border stays as it is."""
    out = x.copy()
    if min(x.shape) > 2:
        v = x.astype(np.int64)
        around = sum(v[1 + dy : v.shape[0] - 1 + dy, 1 + dx : v.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[1:-1, 1:-1] = np.clip(9 * v[1:-1, 1:-1] - around, 0, 255)
    return out


def layout_signature(rgb: np.ndarray, width: int = 160) -> dict:
    width = max(64, width)
    small = grey(resized(rgb, width, max(1, round(rgb.shape[0] * width / max(rgb.shape[1], 1)))))
    line = edges(small)
    grid, edge_grid = (resized(x, GRID_WIDTH, GRID_HEIGHT) for x in (small, line))
    return {
        "grid": grid.ravel().tolist(), "edge_grid": edge_grid.ravel().tolist(), "row_profile": grid.mean(1).tolist(), "col_profile": grid.mean(0).tolist(),
        "brightness_mean": float(small.mean()) / 255, "edge_strength": float(line.mean()) / 255, "dark_ratio": float((small < 20).mean()), "bright_ratio": float((small >= 236).mean()),
    }


def presenter_shares(rgb: np.ndarray) -> dict:
    h, w = rgb.shape[:2]
    center = rgb[int(h * 0.12) : int(h * 0.78), int(w * 0.28) : int(w * 0.72)]
    r, g, b = (center[..., k].astype(np.int64) for k in range(3))
    spread = center.max(-1).astype(np.int64) - center.min(-1)
    skin = (r > 95) & (g > 40) & (b > 20) & (spread > 15) & (np.abs(r - g) > 8) & (r > g) & (r > b)
    whole = grey(rgb)
    share = lambda x: float(x.mean()) if x.size else 0.0
    return {"skin": share(skin), "center_dark": share((r + g + b) / 3 < 70), "full_dark": share(whole < 70), "upper_dark": share(whole[: int(h * 0.82)] < 70), "center_brightness": share(grey(center))}


def _smoothed(x: np.ndarray, radius: float) -> np.ndarray:
    k = np.exp(-np.arange(-int(3 * radius), int(3 * radius) + 1) ** 2 / (2 * radius * radius))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(len(k) // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)]
        x = np.apply_along_axis(np.convolve, axis, np.pad(x, pad, mode="edge"), k, "valid")
    return x


def nav_band(rgb: np.ndarray, bounds: list[tuple[float, float]] = rules.NAV_BOUNDS) -> dict:
    """The brightness of the lowest 7 percent and of each label's segment there."""
    band = _smoothed(grey(rgb[int(rgb.shape[0] * 0.93) :]).astype(float), 2)
    soft = _smoothed(band, 12)
    cut = [soft[:, int(soft.shape[1] * a) : int(soft.shape[1] * b)] for a, b in bounds]
    return {"nav_width": 2 * rgb.shape[1], "nav_brightness": float(band.mean()), "segment_means": [float(c.mean()) if c.size else 0.0 for c in cut]}


SIGNATURE = "struct<grid:array<int>,edge_grid:array<int>,row_profile:array<double>,col_profile:array<double>,brightness_mean:double,edge_strength:double,dark_ratio:double,bright_ratio:double>"
PRESENTER = "struct<skin:double,center_dark:double,full_dark:double,upper_dark:double,center_brightness:double>"
NAV_BAND = "struct<nav_width:int,nav_brightness:double,segment_means:array<double>>"


def frame_signals(images: DataFrame, image: str = "image", width: int = 160) -> DataFrame:
    """images with signature, presenter and nav_band of the image column (as the image source gives it: height, width,
    nChannels, data in BGR order). Undecodable images have null signals. One pass; pixels never leave the task."""
    i = F.col(image)
    rows = images.withColumns({"__h": i["height"], "__w": i["width"], "__c": i["nChannels"], "__d": i["data"]})
    kept = [c for c in images.columns if c != image]
    out = rows.select(*kept, F.lit(None).cast(SIGNATURE).alias("signature"), F.lit(None).cast(PRESENTER).alias("presenter"), F.lit(None).cast(NAV_BAND).alias("nav_band")).schema

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(out)
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                h, w, c, d = (part.column(k)[0].as_py() for k in ("__h", "__w", "__c", "__d"))
                found = [None, None, None]
                if d and h and w and h > 0 and w > 0 and len(d) == h * w * c:
                    x = np.frombuffer(d, np.uint8).reshape(h, w, c)
                    rgb = x[..., 2::-1] if c >= 3 else np.repeat(x[..., :1], 3, -1)
                    found = [layout_signature(rgb, width), presenter_shares(rgb), nav_band(rgb)]
                cols = [part.column(k) for k in kept] + [pa.array([f], want.field(n).type) for f, n in zip(found, ("signature", "presenter", "nav_band"))]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, "signature", "presenter", "nav_band"])

    return rows.select(*kept, "__h", "__w", "__c", "__d").mapInArrow(signals, out)
