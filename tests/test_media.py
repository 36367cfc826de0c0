"""Headers of files, orientations, and days away from home."""

import datetime as dt
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.vision import oriented, turned
from tidemark.operators import away
from tidemark.sources.exif import read_exif, with_exif


def tiff(order, image, detail=(), gps=()):
    """A TIFF block of directories of (tag, kind, values)."""
    codes = {1: "B", 3: "H", 4: "I", 5: "I", 10: "i"}

    def block(entries, at):
        body, extra = struct.pack(f"{order}H", len(entries)), b""
        base = at + 2 + 12 * len(entries) + 4
        for tag, kind, values in entries:
            raw = values.encode() + b"\0" if kind == 2 else struct.pack(f"{order}{len(values)}{codes[kind]}", *values)
            count = len(raw) if kind == 2 else len(values) // (2 if kind in (5, 10) else 1)
            spot = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", base + len(extra))
            extra += raw if len(raw) > 4 else b""
            body += struct.pack(f"{order}HHI", tag, kind, count) + spot
        return body + b"\0" * 4 + extra

    first = block([*image, (0x8769, 4, [0]), (0x8825, 4, [0])], 8)
    second = block(list(detail), 8 + len(first))
    where = 8 + len(first), 8 + len(first) + len(second)
    first = block([*image, (0x8769, 4, [where[0]]), (0x8825, 4, [where[1]])], 8)
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8) + first + second + block(list(gps), where[1])


def jpeg(*parts):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in parts) + b"\xff\xda\x00\x02"


GPS = [(1, 2, "S"), (2, 5, [48, 1, 30, 1, 36, 1]), (3, 2, "E"), (4, 5, [11, 1, 15, 1, 0, 1]), (5, 1, [1]), (6, 5, [25, 2]), (12, 2, "M"), (13, 5, [10, 1]), (17, 5, [90, 1])]
DETAIL = [(0x9003, 2, "2024:01:02 03:04:05"), (0x9011, 2, "+01:00"), (0x829A, 5, [1, 50]), (0x829D, 5, [28, 10]), (0x8827, 3, [400]), (0xA002, 4, [4000]), (0xA003, 4, [3000]), (0x9209, 3, [1])]


@pytest.mark.parametrize("order", "<>")
def test_exif_of_both_byte_orders(order):
    found = read_exif(jpeg((0xE0, b"JFIF"), (0xE1, b"Exif\0\0" + tiff(order, [(0x010F, 2, "Maker"), (0x0112, 3, [6])], DETAIL, GPS)), (0xED, b"Photoshop 3.0\0" + b"\x1c\x02\x19\x00\x03sea" + b"\x1c\x02\x19\x00\x04sand")))
    assert (found["make"], found["orientation"], found["taken"], found["taken_offset"]) == ("Maker", 6, "2024:01:02 03:04:05", "+01:00")
    assert (found["exposure_s"], found["f_number"], found["iso"], found["flash"], found["aspect"]) == (0.02, 2.8, 400, True, 4 / 3)
    assert found["lat"] == pytest.approx(-48.51) and found["lon"] == 11.25 and found["alt"] == -12.5 and found["speed_kmh"] == pytest.approx(16.09344) and found["heading"] == 90.0
    assert found["keywords"] == ["sea", "sand"] and found["lens"] is None


def test_damaged_headers_tell_what_they_can():
    whole = jpeg((0xE1, b"Exif\0\0" + tiff("<", [(0x010F, 2, "Maker")], DETAIL, GPS)))
    for cut in range(0, len(whole), 7):
        assert set(read_exif(whole[:cut])) == set(read_exif(None))
    rnd = random.Random(2)
    for _ in range(300):
        data = bytearray(whole)
        data[rnd.randrange(len(data))] = rnd.randrange(256)
        read_exif(bytes(data))
    assert read_exif(jpeg((0xE1, b"Exif\0\0" + tiff("<", [], [(0x829A, 5, [1, 0])]))))["exposure_s"] is None


def test_exif_of_a_table(spark):
    good = jpeg((0xE1, b"Exif\0\0" + tiff(">", [(0x0110, 2, "M1")], DETAIL, GPS)))
    rows = with_exif(spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"no image")), ("c", None)], "path string, content binary")).orderBy("path").collect()
    assert (rows[0]["model"], rows[0]["iso"], rows[0]["flash"]) == ("M1", 400, True) and all(v is None for r in rows[1:] for k, v in r.asDict().items() if k != "path")


def test_orientations():
    image = np.array([[1, 2, 3], [4, 5, 6]])
    want = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    assert {k: oriented(image, k).tolist() for k in want} == want and oriented(image, None).tolist() == want[1]
    assert turned(image, 90).tolist() == want[6] and turned(image, 270).tolist() == want[8] and turned(image, 0).tolist() == want[1]


# Days away ----------------------------------------------------------------------------------------------------

FIRST = dt.date(2024, 3, 1)


def close(flags):
    return [f or (0 < i < len(flags) - 1 and flags[i - 1] and flags[i + 1]) for i, f in enumerate(flags)]


@pytest.mark.parametrize("seed", range(3))
def test_away_flags_against_plain_pass(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for u in range(12):
        for k in range(rnd.randint(1, 14)):
            synthetic = rnd.random() < 0.35
            km = lambda p: rnd.choice([5.0, 80.0]) if rnd.random() < p else None
            rows.append((u, FIRST + dt.timedelta(k), km(0.4), None if synthetic else km(0.3), 1.0, 50.0, synthetic, rnd.random() < 0.05))
    df = spark.createDataFrame(rows, "user_id bigint, day date, base_km double, mean_km double, avg_km double, radius_km double, synthetic boolean, night boolean").repartition(3)
    got = {(r["user_id"], r["day"]): r["away"] for r in away.away_flags(df, ["user_id"]).collect()}
    for u in range(12):
        mine = [r for r in rows if r[0] == u]
        base = close([r[2] is not None and r[2] > 50 for r in mine])
        far = [(r[3] if r[3] is not None else r[4]) > 50 for r in mine]
        if any(far):
            a, b = far.index(True), len(far) - 1 - far[::-1].index(True)
            far = [a <= i <= b for i in range(len(far))]
        flags = close([x or y for x, y in zip(base, far, strict=True)])
        for i, r in enumerate(mine):
            if r[6] and (i and flags[i - 1] or i + 1 < len(flags) and flags[i + 1]):
                flags[i] = True
        for i, r in enumerate(mine):
            assert got[u, r[1]] == (flags[i] or r[7])


@pytest.mark.parametrize("seed", range(3))
def test_candidates_and_runs_against_plain_pass(spark, seed):
    rnd = random.Random(seed)
    names = ["n", "mean_km", "max_km", "radius_km", "has_gps", "dwell", "transit", "signal", "hotel", "base_away", "outside", "enough"]
    rows = []
    for u in range(10):
        lively = rnd.random()
        for k in range(40):
            p = lambda x: rnd.random() < x
            transit = p(0.15)
            rows.append((u, FIRST + dt.timedelta(k), rnd.randint(0, 6), rnd.choice([None, 10.0, 70.0, 150.0]), rnd.choice([10.0, 70.0, 150.0]), 100.0, p(0.7), p(0.3), transit, transit or p(0.1), p(0.1), p(lively), rnd.choice([None, None, None, True, False]) if p(0.3) else None, p(0.5)))
    df = spark.createDataFrame(rows, "user_id bigint, day date, n int, mean_km double, max_km double, radius_km double, has_gps boolean, dwell boolean, transit boolean, signal boolean, hotel boolean, base_away boolean, outside boolean, enough boolean").repartition(3)
    made = away.candidate_days(df, ["user_id"])
    got = {(r["user_id"], r["day"]): (r["candidate"], r["soft"]) for r in made.collect()}
    runs = {}
    for r in away.trip_runs(made, ["user_id"]).collect():
        runs.setdefault((r["user_id"], r["run"]), []).append(r["day"])

    def bridge(flags, days, least):
        for i, f in enumerate(days):
            if not flags[i] and 0 < i < len(days) - 1 and flags[i - 1] and flags[i + 1] and f["n"] < least(i) and (f["has_gps"] or f["transit"] or f["dwell"]):
                flags[i] = True
        for i, f in enumerate(days):
            if f["transit"] and (i and flags[i - 1] or i + 1 < len(days) and flags[i + 1]):
                flags[i] = True
        return [x and f["outside"] is not False and (f["has_gps"] or f["transit"] or f["dwell"]) for x, f in zip(flags, days, strict=True)]

    def groups(flags):
        out = []
        for i, x in enumerate(flags):
            if x and i and flags[i - 1]:
                out[-1].append(i)
            elif x:
                out.append([i])
        return out

    for u in range(10):
        mine = [r for r in rows if r[0] == u]
        days = [dict(zip(names, r[2:], strict=True)) for r in mine]
        flags, softs = [], []
        for f in days:
            metric = f["mean_km"] if f["mean_km"] is not None else f["max_km"]
            strict, soft = metric > 120, metric > 60
            beyond = f["mean_km"] is not None and f["mean_km"] > f["radius_km"]
            useful = f["has_gps"] and (f["enough"] or f["n"] >= 2)
            flags.append(bool(beyond or f["base_away"] or f["signal"] and strict or useful and strict or f["outside"] or f["hotel"] and f["dwell"] and soft))
            softs.append(soft and not strict)
        heavy = [f["transit"] for f in days]
        flags = [x or heavy[i] and (i > 0 and heavy[i - 1] or i + 1 < len(days) and heavy[i + 1]) for i, x in enumerate(flags)]
        flags = bridge(flags, days, lambda i: 3)
        for i, r in enumerate(mine):
            assert got[u, r[1]] == (flags[i], softs[i])
        mask = set()
        for g in groups(flags):
            if len(g) >= 10 and sum(days[i]["n"] for i in g) / len(g) >= 2:
                mask |= set(range(g[0] - 1, g[-1] + 2))
        flags = bridge([x or i in mask and softs[i] for i, x in enumerate(flags)], days, lambda i: 2 if i in mask else 3)
        assert sorted(sorted(v) for (k, _), v in runs.items() if k == u) == [[mine[i][1] for i in g] for g in groups(flags)]


def test_base_locations(spark):
    day = lambda k: FIRST + dt.timedelta(k)
    at = lambda k, h: int(dt.datetime(2024, 3, 1, tzinfo=dt.UTC).timestamp()) + 86400 * k + 3600 * h
    home = spark.createDataFrame([(1, 48.0, 11.0, 20.0)], "user_id bigint, home_lat double, home_lon double, radius_km double")
    days = spark.createDataFrame([(1, day(k), 48.0, 11.0) for k in range(5)], "user_id bigint, day date, lat double, lon double")
    # Evening stays: far on day 0; at home on day 1, but the items around the night of day 1 are far; a noon stay on day 3.
    stays = spark.createDataFrame([(1, day(0), 49.0, 11.0, at(0, 19), at(0, 23), 14400, 5), (1, day(0), 48.0, 11.0, at(0, 20), at(0, 21), 3600, 9), (1, day(1), 48.0, 11.0, at(1, 18), at(1, 20), 7200, 5), (1, day(3), 48.01, 11.0, at(3, 11), at(3, 12), 3600, 3)], "user_id bigint, day date, lat double, lon double, start bigint, end bigint, dwell bigint, n bigint")
    ends = spark.createDataFrame([(1, day(1), 48.0, 11.0, 50.0, 11.0), (1, day(2), 50.01, 11.0, 48.0, 11.0), (1, day(3), 48.0, 11.0, 48.0, 11.0)], "user_id bigint, day date, first_lat double, first_lon double, last_lat double, last_lon double")
    got = {r["day"]: (r["base_source"], round(r["base_lat"], 3)) for r in away.base_locations(days, stays, ends, home, ["user_id"]).collect()}
    assert got == {day(0): ("stay", 49.0), day(1): ("sleep_pair", 50.005), day(2): ("sleep_first", 48.0), day(3): ("longest", 48.01), day(4): ("mean", 48.0)}
    far = spark.createDataFrame([(1, day(1), 49.0, 11.0, at(1, 9), at(1, 15), 21600, 5), (1, day(2), 48.0, 11.0, at(2, 1), at(2, 8), 25200, 5), (1, day(3), 49.0, 11.0, at(3, 9), at(3, 19), 36000, 5)], stays.schema)
    assert sorted(r["day"] for r in away.night_away(days, far, home, ["user_id"]).collect()) == [day(0), day(2)]
    assert [r["day"] for r in away.covered_nights(stays.withColumn("end", F.col("start") + 12 * 3600), ["user_id"]).collect()].count(day(0)) == 1
    assert [(r["day"], r["rank"]) for r in away.dominant_stays(stays, ["user_id"], 1).orderBy("day").collect()] == [(day(0), 1), (day(1), 1), (day(3), 1)]
