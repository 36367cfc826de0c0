"""EXIF and IPTC of JPEG files, read from their bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Numbers of the tags in the image, EXIF and GPS directories.
IMAGE = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "changed"}
DETAIL = {0x829A: "exposure_s", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x9011: "taken_offset", 0x9291: "taken_fraction", 0x920A: "focal_mm", 0xA002: "width", 0xA003: "height", 0xA405: "focal_35mm", 0xA434: "lens", 0x9209: "flash", 0xA460: "composite"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt", 12: "speed_ref", 13: "speed", 17: "heading"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_CODES = {3: "H", 4: "I", 9: "i"}

SCHEMA = (
    "make string, model string, lens string, orientation int, taken string, taken_offset string, taken_fraction string, width int, height int, aspect double, exposure_s double, f_number double, iso int, focal_mm double, focal_35mm int, "
    "flash boolean, composite int, lat double, lon double, alt double, heading double, speed_kmh double, keywords array<string>"
)
NAMES = [part.strip().split()[0] for part in SCHEMA.split(", ")]


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of a JPEG's header; what is cut off or no JPEG ends the list."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        (size,) = struct.unpack_from(">H", data, at + 2)
        yield data[at + 1], data[at + 4 : at + 2 + size]
        at += 2 + max(size, 2)


def directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """Values of a directory by tag: text, a number or a list of numbers; rationals are floats, None over 0. Damaged entries are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(tiff):
        return out
    (many,) = struct.unpack_from(f"{order}H", tiff, at)
    for k in range(many):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(f"{order}HHI", tiff, entry)
        size = _SIZES.get(kind, 0) * count
        where = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", tiff, entry + 8)[0]
        raw = tiff[where : where + size]
        if not size or len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (1, 7):
            out[tag] = raw[0] if count == 1 else raw
        elif kind in (5, 10):
            parts = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            values = [a / b if b else None for a, b in zip(parts[::2], parts[1::2], strict=True)]
            out[tag] = values[0] if count == 1 else values
        else:
            values = list(struct.unpack(f"{order}{count}{_CODES[kind]}", raw))
            out[tag] = values[0] if count == 1 else values
    return out


def degrees(parts: object, ref: object) -> float | None:
    """Degrees, minutes and seconds with a side; None if one is missing."""
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if str(ref).upper()[:1] in ("S", "W") else value


def keywords(body: bytes) -> list[str]:
    """Keywords of the IPTC records (2:25) in a Photoshop segment."""
    out, at = [], body.find(b"\x1c\x02")
    while 0 <= at and at + 5 <= len(body) and body[at] == 0x1C:
        record, kind, size = struct.unpack_from(">BBH", body, at + 1)
        if (record, kind) == (2, 25):
            out.append(body[at + 5 : at + 5 + size].decode("utf-8", "replace").strip())
        at += 5 + size
    return [w for w in out if w]


def read_exif(data: bytes | None) -> dict[str, object]:
    """All columns of SCHEMA; those a file doesn't tell are None."""
    out: dict[str, object] = dict.fromkeys(NAMES)
    words: list[str] = []
    for marker, body in segments(data or b""):
        if marker == 0xED:
            words += keywords(body)
        if marker != 0xE1 or body[:6] != b"Exif\0\0":
            continue
        tiff = body[6:]
        order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        if not order or len(tiff) < 8:
            continue
        top = directory(tiff, struct.unpack_from(f"{order}I", tiff, 4)[0], order)
        inner = directory(tiff, top[0x8769], order) if isinstance(top.get(0x8769), int) else {}
        place = directory(tiff, top[0x8825], order) if isinstance(top.get(0x8825), int) else {}
        found = {n: top[t] for t, n in IMAGE.items() if t in top} | {n: inner[t] for t, n in DETAIL.items() if t in inner}
        gps = {n: place[t] for t, n in GPS.items() if t in place}
        found["taken"] = found.get("taken") or found.get("changed")
        if isinstance(found.get("iso"), list):
            found["iso"] = found["iso"][0]
        if isinstance(found.get("flash"), int):
            found["flash"] = bool(found["flash"] & 1)
        found |= {"lat": degrees(gps.get("lat"), gps.get("lat_ref")), "lon": degrees(gps.get("lon"), gps.get("lon_ref")), "heading": gps.get("heading")}
        if isinstance(gps.get("alt"), float):
            found["alt"] = -gps["alt"] if gps.get("alt_ref") == 1 else gps["alt"]
        if isinstance(gps.get("speed"), float):
            found["speed_kmh"] = gps["speed"] * {"M": 1.609344, "N": 1.852}.get(str(gps.get("speed_ref", "K")).upper()[:1], 1.0)
        if found.get("width") and found.get("height"):
            found["aspect"] = found["width"] / found["height"]
        out |= {n: v for n, v in found.items() if n in out and v not in (None, "")}
    out["keywords"] = words or None
    return out


def _safe(data: bytes | None) -> dict[str, object]:
    """What a damaged file makes fail concerns this file alone."""
    try:
        found = read_exif(data)
        texts = ("make", "model", "lens", "taken", "taken_offset", "taken_fraction")
        return {k: v if v is None or k == "keywords" or isinstance(v, str) == (k in texts) and not isinstance(v, list | bytes) else None for k, v in found.items()}
    except (ValueError, TypeError, IndexError, struct.error, OverflowError, ZeroDivisionError):
        return dict.fromkeys(NAMES)


def with_exif(files: DataFrame, column: str = "content") -> DataFrame:
    """Files (path and their bytes) with what their headers tell, as the columns of SCHEMA; a file that can't be read has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([_safe(x) for x in batch[column]], columns=NAMES, index=batch.index)
            for part in SCHEMA.split(", "):
                name, kind = part.strip().split(" ", 1)
                if kind in ("int", "boolean", "double"):
                    found[name] = found[name].astype({"int": "Int32", "boolean": "boolean", "double": "float64"}[kind])
            yield pd.concat([batch[["path"]], found], axis=1)

    return files.select("path", column).mapInPandas(run, f"path string, {SCHEMA}")
