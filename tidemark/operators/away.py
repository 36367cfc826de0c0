"""Which days are away from home: base locations, flags, candidates and runs.

Days are one row per key and day without gaps (`trips.gap_filled`), stays are rows (key, day, lat, lon, start, end, dwell, n), home is one row
per key (home_lat, home_lon, radius_km). All rules look at neighbouring days only, so they are windows over a key's days, not passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_m
from tidemark.operators.trips import closed

#: Hours of the base window and of the night, cover of a night that counts, least dwell of a stay that bridges, and long runs.
BASE_HOUR, BASE_HOURS = 18, 16
NIGHT_HOUR, NIGHT_HOURS, NIGHT_COVER = 22, 8, 0.75
LONG_DAYS, LONG_ITEMS = 10, 2.0


def dominant_stays(stays: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """The longest stays of each day, with their rank: by dwell, then items, then start."""
    w = Window.partitionBy(*key, "day").orderBy(F.desc("dwell"), F.desc("n"), "start")
    return stays.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _km(lat: Column, lon: Column) -> Column:
    return haversine_m(lat, lon, F.col("home_lat"), F.col("home_lon")) / 1000


def _second(day: Column, hour: int) -> Column:
    return F.unix_timestamp(day.cast("timestamp")) + 3600 * hour


def base_locations(days: DataFrame, stays: DataFrame, ends: DataFrame, home: DataFrame, key: list[str]) -> DataFrame:
    """Days with base_lat, base_lon, base_km and base_source.

    ends: (key, day, first_lat, first_lon, last_lat, last_lon) of the day's first and last located items. A stay of the day or the next one
    that touches the evening and night is the base, the longest first; if it is at home but the place of sleep isn't, that is. The place of sleep lies between the day's
    last item and the next day's first, if both are away and near each other, else it is the farther of the two. Without either, or with a place of sleep at home, it is the longest stay of the
    day, then the day's mean place (lat, lon).
    """
    w = Window.partitionBy(*key).orderBy("day")
    d = days.join(home, key).join(ends, [*key, "day"], "left")
    d = d.withColumns({"__n_lat": F.lead("first_lat").over(w), "__n_lon": F.lead("first_lon").over(w)})
    # A stay is looked at from its own day and from the day before.
    seen = stays.select(*key, F.explode(F.array("day", F.date_sub("day", 1))).alias("day"), F.struct("dwell", (-F.col("start")).alias("early")).alias("o"), F.struct("lat", "lon").alias("p"), "start", "end", F.col("day").alias("own"))
    evening = seen.where((F.col("end") >= _second(F.col("day"), BASE_HOUR)) & (F.col("start") <= _second(F.col("day"), BASE_HOUR + BASE_HOURS)))
    best = evening.groupBy(*key, "day").agg(F.max_by("p", "o").alias("__stay"))
    longest = stays.groupBy(*key, "day").agg(F.max_by(F.struct("lat", "lon"), F.struct("dwell", (-F.col("start")).alias("early"))).alias("__long"))
    d = d.join(best, [*key, "day"], "left").join(longest, [*key, "day"], "left")
    last_km, next_km = _km(F.col("last_lat"), F.col("last_lon")), _km(F.col("__n_lat"), F.col("__n_lon"))
    r = F.col("radius_km")
    apart = haversine_m(F.col("last_lat"), F.col("last_lon"), F.col("__n_lat"), F.col("__n_lon")) / 1000
    place = lambda lat, lon, name: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.lit(name).alias("source"))
    last, after = place(F.col("last_lat"), F.col("last_lon"), "sleep_last"), place(F.col("__n_lat"), F.col("__n_lon"), "sleep_first")
    middle = place((F.col("last_lat") + F.col("__n_lat")) / 2, (F.col("last_lon") + F.col("__n_lon")) / 2, "sleep_pair")
    sleep = F.when((apart <= 2.0) & (last_km > r) & (next_km > r), middle).when(last_km.isNotNull() & (next_km.isNull() | (last_km > next_km)), last).when(next_km.isNotNull(), after)
    d = d.withColumn("__sleep", sleep)
    stay, long = (F.when(F.col(c).isNotNull(), place(F.col(f"{c}.lat"), F.col(f"{c}.lon"), n)) for c, n in (("__stay", "stay"), ("__long", "longest")))
    away = lambda c: F.coalesce(_km(F.col(f"{c}.lat"), F.col(f"{c}.lon")) > r, F.lit(False))
    mean = F.when(F.col("lat").isNotNull(), place(F.col("lat"), F.col("lon"), "mean"))
    base = F.when(F.col("__stay").isNotNull(), F.when(away("__stay"), stay).when(away("__sleep"), F.col("__sleep")).otherwise(stay)).when(away("__sleep"), F.col("__sleep")).otherwise(F.coalesce(long, F.col("__sleep"), mean))
    out = d.withColumn("__base", base)
    out = out.withColumns({"base_lat": F.col("__base.lat"), "base_lon": F.col("__base.lon"), "base_source": F.col("__base.source"), "base_km": _km(F.col("__base.lat"), F.col("__base.lon"))})
    return out.drop(*[c for c in out.columns if c.startswith("__")], "first_lat", "first_lon", "last_lat", "last_lon")


def night_away(days: DataFrame, stays: DataFrame, home: DataFrame, key: list[str], factor: float = 1.5) -> DataFrame:
    """(key, day) of the days whose next day's longest stay is far from home, when no stay at home touches the night between."""
    top = dominant_stays(stays, key, 1).join(home, key).where(_km(F.col("lat"), F.col("lon")) > F.col("radius_km") * factor)
    far = top.select(*key, F.date_sub("day", 1).alias("day"))
    near = stays.join(home, key).where(_km(F.col("lat"), F.col("lon")) <= F.col("radius_km"))
    near = near.select(*key, F.explode(F.array("day", F.date_sub("day", 1))).alias("day"), "start", "end")
    touched = near.where((F.col("end") >= _second(F.col("day"), NIGHT_HOUR)) & (F.col("start") <= _second(F.col("day"), NIGHT_HOUR + NIGHT_HOURS))).select(*key, "day").distinct()
    return days.select(*key, "day").join(far, [*key, "day"], "left_semi").join(touched, [*key, "day"], "left_anti")


def covered_nights(stays: DataFrame, key: list[str]) -> DataFrame:
    """(key, day) of the days with a stay that covers most of the night behind them."""
    a, b = _second(F.col("day"), NIGHT_HOUR), _second(F.col("day"), NIGHT_HOUR + NIGHT_HOURS)
    return stays.where(F.least("end", b) - F.greatest("start", a) >= int(NIGHT_HOURS * 3600 * NIGHT_COVER)).select(*key, "day").distinct()


def away_flags(days: DataFrame, key: list[str]) -> DataFrame:
    """Adds away to days (base_km, mean_km: of the mean place of the located items, null without; avg_km, radius_km, synthetic, night: see `night_away`).

    Bases away from home, with gaps of one day closed, or days between the first and the last that is far by its items; gaps closed again;
    synthetic days as their neighbours are: all behind a day away, and the last one before one; and nights before a day away.
    """
    w = Window.partitionBy(*key).orderBy("day")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = F.col("radius_km")
    d = days.withColumns({"__base": F.coalesce(F.col("base_km") > r, F.lit(False)), "__far": F.coalesce(F.coalesce("mean_km", "avg_km") > r, F.lit(False))})
    d = d.withColumns({"__first": F.min(F.when(F.col("__far"), F.col("day"))).over(whole), "__last": F.max(F.when(F.col("__far"), F.col("day"))).over(whole)})
    d = d.withColumn("__far", F.coalesce(F.col("day").between(F.col("__first"), F.col("__last")), F.lit(False)))
    d = d.withColumn("__both", closed(F.col("__base"), w) | F.col("__far"))
    d = d.withColumn("__flag", closed(F.col("__both"), w))
    real = F.when(~F.col("synthetic"), F.col("__flag"))
    before = F.last(real, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(F.col("__flag")).over(w)
    some = lambda c: F.coalesce(c, F.lit(False))
    # A flagged synthetic day hands its flag on to the synthetic ones behind it, too.
    handed = F.max(F.when(F.col("synthetic") & F.col("__flag"), F.col("day"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last_real = F.max(F.when(~F.col("synthetic"), F.col("day"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("away", F.col("__flag") | (F.col("synthetic") & (some(before) | some(after) | some(handed > last_real) | (handed.isNotNull() & last_real.isNull()))) | some(F.col("night")))
    return d.drop(*[c for c in d.columns if c.startswith("__")])


def candidate_days(days: DataFrame, key: list[str], strict_km: float = 120.0, soft_km: float = 60.0, least: int = 3) -> DataFrame:
    """Adds candidate and soft to days: those that runs of a trip are made of, and those that are only far enough for long runs.

    Columns: n, mean_km (null without located items), max_km, radius_km, has_gps, dwell (a stay long enough to bridge), transit (a heavy transit day), signal (transit,
    airport or high speed), hotel, base_away, outside (the longest stay is outside the home; null without one), enough (samples).
    A day is a candidate by its distance or base; with signs of transport or of a hotel a lesser distance is enough. Streaks of transit days count,
    days with few items between two candidates, and transit days beside one. Days whose longest stay is at home never do, nor days that show nothing.
    """
    w = Window.partitionBy(*key).orderBy("day")
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    metric = F.coalesce("mean_km", "max_km", F.lit(0.0))
    strict, soft, beyond = metric > strict_km, metric > soft_km, no(c("mean_km") > c("radius_km"))
    useful = c("has_gps") & (c("enough") | (c("n") >= 2))
    first = beyond | c("base_away") | (c("signal") & strict) | (useful & strict) | no(c("outside")) | (c("hotel") & c("dwell") & soft)
    near = lambda x: (no(F.lag(x).over(w)), no(F.lead(x).over(w)))
    before, after = near("transit")
    d = days.withColumns({"soft": ~strict & soft, "__c": first | (c("transit") & (before | after))})
    return vetoed(bridged(d, key, F.lit(least)), key).withColumnRenamed("__c", "candidate")


def bridged(days: DataFrame, key: list[str], least: Column) -> DataFrame:
    """Days with few items but some sign between two candidates (__c) become ones, then transit days beside one."""
    w = Window.partitionBy(*key).orderBy("day")
    sign = F.col("has_gps") | F.col("transit") | F.col("dwell")
    sides = lambda: (F.coalesce(F.lag("__c").over(w), F.lit(False)), F.coalesce(F.lead("__c").over(w), F.lit(False)))
    a, b = sides()
    d = days.withColumn("__b", F.col("__c") | (a & b & (F.col("n") < least) & sign)).drop("__c").withColumnRenamed("__b", "__c")
    a, b = sides()
    return d.withColumn("__b", F.col("__c") | (F.col("transit") & (a | b))).drop("__c").withColumnRenamed("__b", "__c")


def vetoed(days: DataFrame, key: list[str]) -> DataFrame:
    home = F.col("outside").isNotNull() & ~F.col("outside")
    sign = F.col("has_gps") | F.col("transit") | F.col("dwell")
    return days.withColumn("__c", F.col("__c") & ~home & sign)


def trip_runs(days: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Candidate days with their run's number. Around runs of LONG_DAYS days with enough items, days that are far enough for long runs count, too, and two items bridge."""
    w = Window.partitionBy(*key).orderBy("day")

    def numbered(d: DataFrame, flag: str) -> DataFrame:
        new = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
        return d.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")

    d = numbered(days, "candidate")
    of = Window.partitionBy(*key, "run", "candidate")
    long = F.col("candidate") & (F.count("*").over(of) >= LONG_DAYS) & (F.avg("n").over(of) >= LONG_ITEMS)
    d = d.withColumn("__long", long)
    beside = F.coalesce(F.lag("__long").over(w), F.lit(False)) | F.coalesce(F.lead("__long").over(w), F.lit(False)) | F.col("__long")
    d = d.withColumn("__mask", beside).withColumn("__c", F.col("candidate") | (F.col("__mask") & F.col("soft")))
    d = vetoed(bridged(d, key, F.when(F.col("__mask"), 2).otherwise(least)), key)
    return numbered(d.drop("run"), "__c").where("__c").drop("__c", "__long", "__mask")
