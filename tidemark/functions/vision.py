"""Hashes and statistics of small grey images given as arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def average_bits(pixels: Column) -> Column:
    """One character for each pixel: 1 if it is brighter than the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda x: F.when(x.cast("double") > mean, "1").otherwise("0")), "")


def perceptual_hash(image: np.ndarray, size: int = 16) -> int:
    """Bits of the low square of the cosine transform, in zig-zag order, that are above the median of all but the first; for a square image."""
    n = len(image)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)[:, None]
    low = (basis @ image @ basis.T)[:size, :size]
    order = sorted(((i, j) for i in range(size) for j in range(size)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 else p[0]))
    values = np.array([low[p] for p in order])[:128]
    bits = values > np.median(values[1:])
    return int("".join("1" if b else "0" for b in bits), 2)


def difference_hash(image: np.ndarray) -> int:
    """A bit for each pixel of an 8 x 9 image: whether it is darker than its right neighbour."""
    return int("".join("1" if b else "0" for b in (image[:, :-1] < image[:, 1:]).ravel()), 2)


@F.pandas_udf(T.StructType([*[T.StructField(n, T.StringType()) for n in ("phash", "dhash")], *[T.StructField(n, T.DoubleType()) for n in ("mean", "contrast", "sharpness")]]))
def image_features(pixels: pd.Series) -> pd.DataFrame:
    """Hashes, brightness, contrast and variance of the Laplacian of square images; nulls for other shapes."""
    rows = []
    for p in pixels:
        side = int(round(len(p) ** 0.5)) if p is not None else 0
        if side < 3 or side * side != len(p):
            rows.append((None, None, None, None, None))
            continue
        image = np.asarray(p, float).reshape(side, side)
        around = image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:] - 4 * image[1:-1, 1:-1]
        size = min(16, side)
        rows.append((f"{perceptual_hash(image, size):0{min(128, size * size) // 4}x}", f"{difference_hash(image):x}", float(image.mean()), float(image.std()), float(around.var())))
    return pd.DataFrame(rows, columns=["phash", "dhash", "mean", "contrast", "sharpness"])


def oriented(image: np.ndarray, orientation: int | None) -> np.ndarray:
    """The image as it is to be seen, by its EXIF orientation (1 to 8; others change nothing): turned by quarters, and mirrored where the number says so."""
    turns = {3: 2, 4: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(orientation or 1, 0)
    out = np.rot90(image, turns) if turns else image
    return out[:, ::-1] if orientation in (2, 4, 5, 7) else out


def turned(image: np.ndarray, degrees: int | None) -> np.ndarray:
    """A video's frame by its rotation clockwise in degrees."""
    return np.rot90(image, -(((degrees or 0) % 360) // 90))
