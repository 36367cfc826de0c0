"""Runs and sessions: gaps and islands over sorted rows."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.geo import haversine_m


def runs(rows: DataFrame, key: list[str], order: list[str], breaks: Callable[[Callable[[str], Column]], Column], name: str = "run") -> DataFrame:
    """Numbers the runs of each key from 0. `breaks` gets a function that returns a column of the row before and says where a new run begins."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    new = F.when(F.coalesce(breaks(before), F.lit(False)), 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def gap_runs(rows: DataFrame, key: list[str], gap: int, time: str = "t", order: str = "item_id", name: str = "run") -> DataFrame:
    """A new run where more than `gap` seconds have passed."""
    return runs(rows, key, [time, order], lambda before: F.col(time) - before(time) > gap, name)


def gap_distance_runs(rows: DataFrame, key: list[str], gap: int, metres: float, time: str = "t", order: str = "item_id", name: str = "run") -> DataFrame:
    """As gap_runs, and also where two neighbours with a place are further apart than `metres`."""

    def breaks(before):
        far = haversine_m(before("lat"), before("lon"), F.col("lat"), F.col("lon")) > metres
        return (F.col(time) - before(time) > gap) | F.coalesce(far, F.lit(False))

    return runs(rows, key, [time, order], breaks, name)


def day_runs(days: DataFrame, key: list[str], day: str = "day", gap: int = 1, name: str = "run") -> DataFrame:
    """Numbers runs of days (one row per key and day) with at most `gap` days from one to the next."""
    return runs(days, key, [day], lambda before: F.datediff(F.col(day), before(day)) > gap, name)


def scan_sorted(rows: DataFrame, key: list[str], order: list[str], start: Callable, schema: str | T.StructType) -> DataFrame:
    """Runs a sequential function over each key's sorted rows.

    `start(key)` returns a function that gets each row (a dict) and yields output rows, and None at the end. Tasks
    stream over their sorted rows and keep only the function's own state, so a key may have any number of rows.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step, held = object(), None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in key)
                if now != last:
                    if step:
                        held += list(step(None) or ())
                    last, step = now, start(now)
                held += list(step(row) or ())
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, kind)
                    held = []
        if step:
            held += list(step(None) or ())
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)


def _metres(a: dict, b: dict, radius: float = 6371008.8) -> float:
    from math import asin, cos, radians, sin, sqrt

    p, q = radians(a["lat"]), radians(b["lat"])
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * radius * asin(min(1.0, sqrt(h)))


def anchored_windows(rows: DataFrame, key: list[str], seconds: int, metres: float | None = None, time: str = "t", order: str = "item_id") -> DataFrame:
    """Numbers windows that are fixed to their first row: a row belongs to one if it is at most `seconds` after the first and, if asked, at most `metres` from it; else it begins the next. Rows without a place count as near."""

    def start(_):
        anchor, number = None, -1

        def step(row):
            nonlocal anchor, number
            if row is None:
                return
            fits = anchor is not None and row[time] - anchor[time] <= seconds
            if fits and metres is not None and None not in (row["lat"], row["lon"], anchor["lat"], anchor["lon"]):
                fits = _metres(anchor, row) <= metres
            if not fits:
                anchor, number = row, number + 1
            yield {**row, "window": number}

        return step

    return scan_sorted(rows, key, [time, order], start, T.StructType([*rows.schema.fields, T.StructField("window", T.LongType())]))


def staypoints(rows: DataFrame, key: list[str], metres: float = 250.0, dwell: int = 1200, time: str = "t", order: str = "item_id") -> DataFrame:
    """Stays: from a located row on as long as rows are within `metres` of it; kept if they last `dwell` seconds, and the search goes on behind; else it goes on from the next row.

    A stay that goes on is held as sums; before that, the rows of the last `dwell` seconds are. Whether all of them are in reach is asked of their bounding box first, and a row that was out of reach is asked first, so a dense spot costs each row once.
    """
    names = [f for f in rows.schema.fields if f.name in key]
    out = T.StructType([*names, *[T.StructField(n, t) for n, t in (("lat", T.DoubleType()), ("lon", T.DoubleType()), ("start", T.LongType()), ("end", T.LongType()), ("dwell", T.LongType()), ("n", T.LongType()))]])

    def start(now):
        # Rows from the present anchor on (head), and the bounding box of those: ends of lists that fall and rise.
        lat, lon, when = [], [], []
        head, out = 0, -1
        box = [(deque(), 1, lat), (deque(), -1, lat), (deque(), 1, lon), (deque(), -1, lon)]
        stay = None  # the anchor, rows, sums and end of a stay that still goes on

        def add(row):
            lat.append(row["lat"])
            lon.append(row["lon"])
            when.append(row[time])
            for ends, sign, values in box:
                while ends and sign * values[ends[-1]] >= sign * values[-1]:
                    ends.pop()
                ends.append(len(values) - 1)

        def drop(n):
            nonlocal head, out
            head += n
            for ends, _, _ in box:
                while ends and ends[0] < head:
                    ends.popleft()
            if head > 4096 and head * 2 > len(lat):
                for values in (lat, lon, when):
                    del values[:head]
                for k, (ends, sign, values) in enumerate(box):
                    box[k] = (deque(e - head for e in ends), sign, values)
                head, out = 0, out - head

        def far(k):
            return _metres({"lat": lat[head], "lon": lon[head]}, {"lat": lat[k], "lon": lon[k]}) > metres

        def reach():
            """The first row out of the anchor's reach, or the end; None if the row that completes the dwell time isn't reached."""
            nonlocal out
            full = bisect_left(when, when[head] + dwell, head)
            # The completing row, and the row that was out of reach of an anchor before, decide most anchors at once.
            if far(full) or head < out <= full and far(out):
                return None
            south, north, west, east = (values[ends[0]] for ends, _, values in box)
            anchor = {"lat": lat[head], "lon": lon[head]}
            if max(_metres(anchor, {"lat": y, "lon": x}) for y in (south, north) for x in (west, east)) <= 0.999 * metres:
                return len(lat)
            out = next((k for k in range(head + 1, len(lat)) if far(k)), len(lat))
            return out if out > full else None

        def closed():
            n = stay["n"]
            return {**dict(zip(key, now, strict=True)), "lat": stay["lat_sum"] / n, "lon": stay["lon_sum"] / n, "start": stay["start"], "end": stay["end"], "dwell": stay["end"] - stay["start"], "n": n}

        def begun(end):
            part = slice(head, end)
            return {"lat": lat[head], "lon": lon[head], "n": end - head, "lat_sum": sum(lat[part]), "lon_sum": sum(lon[part]), "start": when[head], "end": when[end - 1]}

        def step(row):
            nonlocal stay
            if stay is not None:
                if row is not None and _metres(stay, row) <= metres:
                    stay.update(n=stay["n"] + 1, lat_sum=stay["lat_sum"] + row["lat"], lon_sum=stay["lon_sum"] + row["lon"], end=row[time])
                    return
                yield closed()
                stay = None
            if row is not None:
                add(row)
            # Only an anchor that a row stands behind by the dwell time can begin a stay.
            while head < len(lat) and when[-1] - when[head] >= dwell and stay is None:
                end = reach()
                if end is None:
                    drop(1)
                    continue
                stay = begun(end)
                gone = end == len(lat)
                drop(end - head)
                if not gone:
                    yield closed()
                    stay = None
            if row is None and stay is not None:
                yield closed()

        return step

    return scan_sorted(rows.where("lat is not null and lon is not null").select(*key, "lat", "lon", time, order), key, [time, order], start, out)
