"""Image measures of gray frames: numpy kernels, and pandas UDFs over BINARY frames of known width and height."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType


def laplacian(g: np.ndarray) -> np.ndarray:
    """The four-neighbour Laplacian of the inner pixels."""
    g = g.astype(np.float64)
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]


def sharpness(g: np.ndarray, columns: int = 8, rows: int = 6, flat: float = 0.5, masked: float = 0.6, q: float = 75.0) -> tuple[float, bool]:
    """A high percentile of the tiles' Laplacian variances, and whether too many tiles had no texture to leave them out."""
    e = laplacian(g)
    v = np.array([t.var() for r in np.array_split(e, rows) for t in np.array_split(r, columns, axis=1)])
    textured = v[v >= flat]
    poor = len(textured) < (1 - masked) * len(v)
    return float(np.percentile(v if poor or not len(textured) else textured, q)), bool(poor)


def exposure(g: np.ndarray) -> dict[str, float]:
    return {"mean": float(g.mean()), "dark": float((g <= 5).mean()), "light": float((g >= 250).mean())}


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(g: np.ndarray) -> str:
    """63 bits: the low 8 x 8 frequencies but the first of the frame at 32 x 32, above their median or not."""
    rows, cols = (np.linspace(0, n, 33).astype(int) for n in g.shape)
    small = np.array([[g[a : max(z, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:])] for a, z in zip(rows, rows[1:])])
    low = (_dct(32) @ small @ _dct(32).T)[:8, :8].ravel()[1:]
    return "".join("1" if x > np.median(low) else "0" for x in low)


def block_quality(g: np.ndarray, block: int = 16, active: float = 0.008) -> float:
    """Mean distortion, 0 to 100, of the blocks with structure in the locally normalised frame; NaN where none has any."""
    x = g.astype(np.float64)
    k = np.exp(-(np.arange(-3, 4) ** 2) / (2 * (7 / 6) ** 2))
    k /= k.sum()
    blur = lambda a: np.apply_along_axis(lambda r: np.convolve(np.pad(r, 3, mode="edge"), k, "valid"), 1, np.apply_along_axis(lambda c: np.convolve(np.pad(c, 3, mode="edge"), k, "valid"), 0, a))
    mean = blur(x)
    n = (x - mean) / (np.sqrt(np.clip(blur(x * x) - mean * mean, 0, None)) + 1)
    h, w = (s // block * block for s in n.shape)
    blocks = n[:h, :w].reshape(h // block, block, w // block, block).swapaxes(1, 2).reshape(-1, block, block)
    var = blocks.var(axis=(1, 2))
    use = var > active
    if not use.any():
        return float("nan")
    edges = np.array([min(b[0].std(), b[-1].std(), b[:, 0].std(), b[:, -1].std()) for b in blocks[use]])
    return float(100 * np.clip(np.where(edges < 0.1, 1 - np.clip(var[use], 0, 1), np.clip(var[use], 0, 1)), 0, 1).mean())


def _frames(gray: pd.Series, width: pd.Series, height: pd.Series):
    for b, w, h in zip(gray, width, height):
        a = np.frombuffer(b, dtype=np.uint8) if b is not None else np.empty(0, dtype=np.uint8)
        yield a.reshape(int(h), int(w)) if a.size and a.size == w * h else None


METRICS = StructType([StructField(c, DoubleType()) for c in ("mean", "dark", "light", "laplacian", "sharpness")] + [StructField("masked", BooleanType()), StructField("quality", DoubleType()), StructField("phash", StringType())])


@F.pandas_udf(METRICS)
def frame_metrics(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """The measures of each frame; all NULL for a frame that is NULL or not as large as it says."""
    out = []
    for g in _frames(gray, width, height):
        if g is None or min(g.shape) < 16:
            out.append((None,) * 8)
            continue
        e, (s, poor), q = exposure(g), sharpness(g), block_quality(g)
        out.append((e["mean"], e["dark"], e["light"], float(laplacian(g).var()), s, poor, None if q != q else q, perceptual_hash(g)))
    return pd.DataFrame(out, columns=["mean", "dark", "light", "laplacian", "sharpness", "masked", "quality", "phash"])


def hash_distance(a: Column, b: Column) -> Column:
    """The share of bits in which two bit strings of one length differ."""
    bits = lambda c: F.split(c, "")
    return F.aggregate(F.zip_with(bits(a), bits(b), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.length(a)
