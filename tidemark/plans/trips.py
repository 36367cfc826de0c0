"""Trips from items: day summaries with stays and base locations, candidate days, runs, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_m
from tidemark.operators import away, trips
from tidemark.operators.islands import staypoints
from tidemark.sources.scratch import Scratch

#: Share of fast legs and speed of a day that is mostly transit, and dwell of a stay that bridges days.
TRANSIT_RATIO, TRANSIT_KMH, BRIDGE_S = 0.6, 90.0, 7200


def transit_ratio(items: DataFrame, key: list[str], fast_kmh: float = TRANSIT_KMH) -> DataFrame:
    """Per key the share of the way between located items that was gone fast."""
    moved = trips.legs(items.where("lat is not null and lon is not null"), key).where("metres > 0")
    fast = F.col("metres") / F.greatest(F.col("seconds"), F.lit(1)) * 3.6 >= fast_kmh
    return moved.groupBy(*key).agg((F.sum(F.when(fast, F.col("metres")).otherwise(0.0)) / F.sum("metres")).alias("transit_ratio"))


def trip_days(items: DataFrame, owner: list[str], home: DataFrame, scratch: Scratch, radius_km: float = 15.0, metres: float = 250.0, dwell: int = 1200, least: int = 3, hotel: Column | None = None, airport: Column | None = None) -> DataFrame:
    """Days without gaps with all that the rules of `away` ask for, away and candidate.

    home: (owner, home_lat, home_lon). hotel and airport: conditions on the items that tell of these places.
    """
    key = [*owner, "day"]
    place = home.withColumn("radius_km", F.lit(radius_km))
    located = items.where("lat is not null and lon is not null")
    stays = staypoints(located, key, metres, dwell)
    stays = scratch.table(stays, "stays")
    days = trips.day_summaries(items, owner, home)
    mean = located.groupBy(*key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    false = F.lit(False)
    signs = items.groupBy(*key).agg(F.max(hotel if hotel is not None else false).alias("hotel"), F.max(airport if airport is not None else false).alias("airport"))
    first, last = (F.struct("t", "item_id"), F.struct("lat", "lon"))
    ends = located.groupBy(*key).agg(F.min_by(last, first).alias("a"), F.max_by(last, first).alias("b")).select(*key, F.col("a.lat").alias("first_lat"), F.col("a.lon").alias("first_lon"), F.col("b.lat").alias("last_lat"), F.col("b.lon").alias("last_lon"))
    d = scratch.table(days.join(mean, key, "left").join(transit_ratio(items, key), key, "left").join(signs, key, "left"), "days")
    based = away.base_locations(d, stays, ends, place, owner)
    nights = away.night_away(d, stays, place, owner).withColumn("night", F.lit(True))
    top = away.dominant_stays(stays, owner, 1).select(*key, F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    bridge = stays.groupBy(*key).agg(F.max(F.col("dwell") >= BRIDGE_S).alias("dwell"))
    d = based.join(nights, key, "left").join(top, key, "left").join(bridge, key, "left")
    km = lambda lat, lon: haversine_m(F.col(lat), F.col(lon), F.col("home_lat"), F.col("home_lon")) / 1000
    no = lambda x: F.coalesce(x, false)
    d = d.withColumns({"mean_km": km("lat", "lon"), "night": no(F.col("night")), "dwell": no(F.col("dwell")), "hotel": no(F.col("hotel")), "airport": no(F.col("airport"))})
    flagged = away.away_flags(scratch.table(d, "based"), owner)
    heavy = F.col("fast") | no(F.col("transit_ratio") >= TRANSIT_RATIO) | no(F.col("avg_kmh") >= TRANSIT_KMH) | no(F.col("max_kmh") >= TRANSIT_KMH)
    made = flagged.withColumns({"base_away": F.col("away"), "has_gps": no(F.col("n_gps") > 0), "transit": heavy, "outside": km("s_lat", "s_lon") > F.col("radius_km"), "enough": F.col("n") >= least})
    made = made.withColumn("signal", F.col("transit") | F.col("airport"))
    return scratch.table(away.candidate_days(made, owner, least=least).drop("s_lat", "s_lon"), "candidates")


def trip_scores(days: DataFrame, owner: list[str], least: int = 3) -> DataFrame:
    """One row per run of candidate days (`trips.trips`)."""
    return trips.trips(away.trip_runs(days, owner, least), owner)
