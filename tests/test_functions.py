import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import geo, hashing, scoring, strings
from tidemark.functions.vision import difference_hash, image_features, perceptual_hash


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_haversine_and_unknown_places(spark):
    r = one(spark, d=geo.haversine_m(48.0, 11.0, 49.0, 11.0), none=geo.haversine_m(F.lit(None).cast("double"), 11.0, 49.0, 11.0), half=geo.haversine_m(0.0, 0.0, 0.0, 180.0))
    assert r.d == pytest.approx(math.radians(1) * 6371008.8)
    assert r.none is None
    assert r.half == pytest.approx(math.pi * 6371008.8)


@pytest.mark.parametrize("lat,lon,want", [(57.64911, 10.40744, "u4pruydqqvj"), (48.8583, 2.2945, "u09tunquc6z"), (-25.382708, -49.265506, "6gkzwgjzn82")])
def test_geohash(spark, lat, lon, want):
    r = one(spark, a=geo.geohash(F.lit(lat), F.lit(lon), 7), b=geo.geohash(F.lit(lat), F.lit(lon), 5))
    assert want.startswith(r.a) and want.startswith(r.b) and len(r.a) == 7


def test_heading(spark):
    r = one(spark, east=geo.bearing_deg(*map(F.lit, (0.0, 0.0, 0.0, 1.0))), south=geo.bearing_deg(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), d=geo.heading_delta(F.lit(350.0), F.lit(20.0)))
    assert (r.east, r.south, r.d) == (pytest.approx(90), pytest.approx(180), pytest.approx(30))


def test_cells_nest_and_tell_faces_apart():
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500)
    fine, coarse = geo.cube_cells(lat, lon, 20), geo.cube_cells(lat, lon, 7)
    shift = np.uint64(2 * (30 - 7))
    assert ((fine >> shift) << shift == coarse).all()
    near = geo.cube_cells(lat + 1e-9, lon, 12)
    assert (near == geo.cube_cells(lat, lon, 12)).mean() > 0.99
    assert len(set((geo.cube_cells(lat, lon, 0) >> np.uint64(61)).tolist())) == 6


def test_cell_function(spark):
    rows = spark.createDataFrame([(48.0, 11.0), (None, 11.0)], "lat double, lon double").select(geo.cube_cell(12)("lat", "lon").alias("c")).collect()
    assert rows[1].c == "0" * 16 and len(rows[0].c) == 16 and rows[0].c != "0" * 16


@pytest.mark.parametrize("year,day", [(1818, "1818-03-22"), (1943, "1943-04-25"), (1954, "1954-04-18"), (1981, "1981-04-19"), (2000, "2000-04-23"), (2024, "2024-03-31"), (2025, "2025-04-20"), (2049, "2049-04-18"), (2076, "2076-04-19")])
def test_easter(spark, year, day):
    assert str(one(spark, e=cal.easter(F.lit(year))).e) == day


def test_holidays_and_seasons(spark):
    days = ["2024-03-29", "2024-04-01", "2024-05-09", "2024-05-20", "2024-05-01", "2024-12-26", "2024-06-03", "2023-12-31"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d")).select("d", cal.holiday(F.col("d")).alias("h"), cal.season(F.col("d")).alias("s"), cal.season_year(F.col("d")).alias("y")).collect()
    assert [r.h for r in rows] == ["Karfreitag", "Ostermontag", "Christi Himmelfahrt", "Pfingstmontag", "Tag der Arbeit", "2. Weihnachtstag", None, None]
    assert (rows[7].s, rows[7].y) == ("winter", 2024)


def test_sun(spark):
    day = F.lit("2024-06-21").cast("date")
    berlin, north = cal.sun(day, F.lit(52.52), F.lit(13.405)), cal.sun(day, F.lit(78.0), F.lit(15.0))
    r = one(spark, rise=berlin["sunrise"], down=berlin["sunset"], up=north["polar_day"], none=north["sunrise"])
    hour = lambda t: (t % 86400) / 3600
    assert hour(r.rise) == pytest.approx(2 + 43 / 60, abs=0.15) and hour(r.down) == pytest.approx(19 + 33 / 60, abs=0.15)
    assert r.up and r.none is None


@pytest.mark.parametrize("name,want", [("a/IMG_20240102_030405.jpg", "2024-01-02 03:04:05"), ("2024-01-02 03.04.05.png", "2024-01-02 03:04:05"), ("PXL20240102030405123.jpg", "2024-01-02 03:04:05"), ("x.jpg", None), ("IMG_20241302_030405.jpg", None)])
def test_names(spark, name, want):
    got = one(spark, t=cal.filename_time(F.lit(name))).t
    assert got == (want and dt.datetime.fromisoformat(want))


def test_scores(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, none=scoring.weighted_mean([(n, 1.0)]), part=scoring.weighted_mean([(n, 0.5), (F.lit(0.4), 0.5)]), iso=scoring.iso_score(F.lit(50)), high=scoring.iso_score(F.lit(99999)), b=scoring.balanced(F.lit(0.55), 0.55, 0.35),
        same=scoring.quantile_normal(*map(F.lit, (0.3, 0.3, 0.3, 0.3, 0.3))), low=scoring.quantile_normal(*map(F.lit, (0.0, 0.0, 0.2, 0.8, 1.0))), mid=scoring.quantile_normal(*map(F.lit, (0.5, 0.0, 0.2, 0.8, 1.0))),
    )
    assert (r.none, r.part, r.iso, r.high, r.b, r.same, r.low) == (None, 0.4, 1.0, 0.0, 1.0, 0.5, 0.1)
    assert r.mid == pytest.approx(0.5)


def test_hamming(spark):
    r = one(spark, same=hashing.hamming_bytes(F.lit("ff00"), F.lit("ff00")), bits=hashing.hamming_bytes(F.lit("ff00"), F.lit("0f01")), short=hashing.hamming_bytes(F.lit("ff"), F.lit("ff00")), bad=hashing.hamming_bytes(F.lit("xy"), F.lit("ff")), nibble=hashing.hamming_nibbles(F.lit("f"), F.lit("e0")), top=hashing.hamming_bytes(F.lit("f" * 16), F.lit("0" * 16)))
    assert (r.same, r.bits, r.short, r.bad, r.nibble, r.top) == (0, 5, 8, 64, 5, 64)


def test_sets(spark):
    a, b = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (3, 2, 4)))
    r = one(spark, j=hashing.array_jaccard(a, b), f=hashing.fingerprint(F.array(*map(F.lit, (3, 1, 3)))), iou=hashing.interval_iou(*map(F.lit, (0, 10, 5, 15))), point=hashing.interval_iou(*map(F.lit, (1, 1, 1, 1))))
    import hashlib

    assert (r.j, r.f, r.iou, r.point) == (0.5, hashlib.sha1(b"1,3").hexdigest(), pytest.approx(1 / 3), 1.0)


def test_strings(spark):
    r = one(spark, half=strings.rational(F.lit("1/2")), none=strings.rational(F.lit("1/0")), plain=strings.rational(F.lit(" 2.5")), south=strings.dms(F.lit("48/1"), F.lit("30/1"), F.lit("36/1"), F.lit("s")), off=strings.offset_minutes(F.lit("-03:30")), z=strings.offset_minutes(F.lit("Z")), label=strings.first_label(F.lit(" "), F.lit(" a ")), key=strings.joined_key(F.lit("a"), F.lit(None).cast("string"), F.lit("b")))
    assert (r.half, r.none, r.plain, r.south, r.off, r.z, r.label, r.key) == (0.5, None, 2.5, pytest.approx(-48.51), -210, 0, "a", "a|b")


def test_image_hashes(spark):
    rng = np.random.default_rng(1)
    image = rng.random((32, 32))
    assert bin(perceptual_hash(image) ^ perceptual_hash(image * 0.5 + 3)).count("1") <= 2
    assert difference_hash(np.tile(np.arange(9), (8, 1))) == (1 << 64) - 1
    rows = spark.createDataFrame([([float(x) for x in image.ravel()],), ([1.0, 2.0],), (None,)], "p array<double>").select(image_features("p").alias("f")).select("f.*").collect()
    assert len(rows[0].phash) == 32 and rows[1].phash is None and rows[2].mean is None
    assert rows[0].mean == pytest.approx(image.mean())
