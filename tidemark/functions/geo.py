"""Geographic expressions. All are null where a coordinate is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres, and the rounded one that overlap tests use.
EARTH_M, EARTH_ROUNDED_M = 6371008.8, 6371000.0
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = (F.radians(x) if isinstance(x, Column) else F.radians(F.lit(float(x))) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    # least() skips nulls, so an unknown place must be kept out.
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def floor_cell(lat: Column, lon: Column, step: float) -> Column:
    """Key of the grid cell: the coordinates floored to multiples of the step, four decimals."""
    return F.format_string("%.4f,%.4f", F.floor(lat / step) * step, F.floor(lon / step) * step)


def round_cell(lat: Column, lon: Column, digits: int) -> Column:
    """Key of the coordinates rounded to some decimals."""
    return F.format_string(f"%.{digits}f,%.{digits}f", F.round(lat, digits), F.round(lon, digits))


def world_cell(lat: Column, lon: Column, step: float) -> Column:
    """Key of a grid counted from the south pole and the date line."""
    return F.concat_ws(":", F.floor((lat + 90) / step).cast("string"), F.floor((lon + 180) / step).cast("string"))


def normal_lon(lon: Column) -> Column:
    """Longitude brought into [-180, 180)."""
    return lon - 360 * F.floor((lon + 180) / 360)


def geohash(lat: Column, lon: Column, length: int) -> Column:
    """Standard geohash: the halved intervals' bits are the leading bits of the scaled coordinates."""
    bits = 5 * length
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << lon_bits)), F.lit((1 << lon_bits) - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90) / 180 * (1 << lat_bits)), F.lit((1 << lat_bits) - 1)).cast("bigint")
    chars = []
    for c in range(length):
        value = F.lit(0).cast("bigint")
        for b in range(5 * c, 5 * c + 5):
            source, place = (x, lon_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            value = value * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1).cast("bigint"))
        chars.append(F.substring(F.lit(_BASE32), value.cast("int") + 1, F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*chars))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial heading from the first point to the second, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def heading_delta(a: Column, b: Column) -> Column:
    """Smaller angle between two headings."""
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.least(d, 360 - d)


def distance_saturation(km: Column, scale: float = 400.0) -> Column:
    return 1 - F.exp(-F.greatest(km, F.lit(0.0)) / scale)


#: Per face of the cube: sign of the axis that is positive, and the axes that u and v read.
def cube_cells(lat: np.ndarray, lon: np.ndarray, level: int = 12) -> np.ndarray:
    """Hex tokens of quad-tree cells on the cube's faces along a Hilbert curve. An opaque bucket id: it orders faces and cells but is not interoperable with other cell systems."""
    phi, theta = np.radians(lat), np.radians(lon)
    axes = np.stack([np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)])
    size = np.abs(axes)
    main = np.where((size[0] >= size[1]) & (size[0] >= size[2]), 0, np.where(size[1] >= size[2], 1, 2))
    top = np.take_along_axis(axes, main[None], 0)[0]
    sign = np.where(top >= 0, 1.0, -1.0)
    face = main + 3 * (top < 0)
    x, y, z = axes
    u = np.choose(main, [y, -x, -x]) / np.abs(top) * sign
    v = np.choose(main, [z, z, -y]) / np.abs(top) * sign
    curve = lambda w: np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.maximum(w, 0)), 1 - 0.5 * np.sqrt(1 - 3 * np.minimum(w, 0)))
    most = (1 << 30) - 1
    i, j = (np.clip(np.floor(curve(w) * (1 << 30)), 0, most).astype(np.int64) for w in (u, v))
    d = np.zeros(len(i), np.uint64)
    for k in range(29, -1, -1):
        s = 1 << k
        right, upper = (i & s) > 0, (j & s) > 0
        d += (np.uint64(s) * np.uint64(s)) * ((3 * right.astype(np.uint64)) ^ upper.astype(np.uint64))
        flip = ~upper & right
        i, j = np.where(flip, s - 1 - i, i), np.where(flip, s - 1 - j, j)
        i, j = np.where(upper, i, j), np.where(upper, j, i)
    token = (face.astype(np.uint64) << np.uint64(61)) | (d << np.uint64(1)) | np.uint64(1)
    shift = np.uint64(2 * (30 - max(0, min(30, level))))
    return (token >> shift) << shift


def cube_cell(level: int = 12):
    """cube_cells() as a vectorised function of two columns."""

    @F.pandas_udf("string")
    def token(lat: pd.Series, lon: pd.Series) -> pd.Series:
        known = (np.isfinite(lat.astype(float)) & np.isfinite(lon.astype(float))).to_numpy()
        out = np.full(len(lat), "0" * 16, dtype=object)
        if known.any():
            out[known] = [f"{int(c):016X}" for c in cube_cells(lat.to_numpy(float)[known], lon.to_numpy(float)[known], level)]
        return pd.Series(out)

    return token
