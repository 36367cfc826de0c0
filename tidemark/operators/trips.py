"""Trips: day summaries, away days, runs of them, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import bearing_deg, distance_saturation, haversine_m
from tidemark.functions.scoring import clamp01
from tidemark.operators.aggregates import zscores


def legs(rows: DataFrame, key: list[str], time: str = "t", order: str = "item_id") -> DataFrame:
    """Adds metres, seconds and heading from the row before."""
    w = Window.partitionBy(*key).orderBy(time, order)
    lat, lon = F.lag("lat").over(w), F.lag("lon").over(w)
    return rows.withColumns({"metres": haversine_m(lat, lon, F.col("lat"), F.col("lon")), "seconds": F.col(time) - F.lag(time).over(w), "heading": bearing_deg(lat, lon, F.col("lat"), F.col("lon"))})


def transport(rows: DataFrame, key: list[str], least_s: int = 300, least_km: float = 10.0, fast_kmh: float = 100.0, far_km: float = 150.0) -> DataFrame:
    """Per key the travelled distance, the largest and mean speed of legs that are long enough, and whether it was fast transit."""
    moved = legs(rows.where("lat is not null"), key)
    long = (F.col("seconds") >= least_s) & (F.col("metres") >= least_km * 1000)
    kmh = F.when(long, F.col("metres") / F.col("seconds") * 3.6)
    g = moved.groupBy(*key).agg((F.coalesce(F.sum("metres"), F.lit(0.0)) / 1000).alias("travel_km"), F.max(kmh).alias("max_kmh"), F.avg(kmh).alias("avg_kmh"))
    return g.withColumn("fast", F.coalesce(F.col("max_kmh") >= fast_kmh, F.lit(False)) | (F.col("travel_km") > far_km))


def gap_filled(days: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """All days from a key's first to its last; days that weren't there are `synthetic`."""
    span = days.groupBy(*key).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return span.join(days.withColumn("__there", F.lit(True)), [*key, day], "left").withColumn("synthetic", F.col("__there").isNull()).drop("__there")


def day_summaries(items: DataFrame, key: list[str], home: DataFrame) -> DataFrame:
    """One row per key and day without gaps: n, km from home (largest and mean), travel, z of the number of items."""
    placed = items.join(home, key).withColumn("km", haversine_m(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) / 1000)
    days = placed.groupBy(*key, "day").agg(F.count("*").alias("n"), F.count("lat").alias("n_gps"), F.max("km").alias("max_km"), F.avg("km").alias("avg_km"))
    moves = transport(items, [*key, "day"])
    days = gap_filled(days.join(moves, [*key, "day"], "left"), key)
    days = days.withColumns({"n": F.coalesce("n", F.lit(0)), "travel_km": F.coalesce("travel_km", F.lit(0.0)), "fast": F.coalesce("fast", F.lit(False))})
    return zscores(days, "n", key)


def closed(flags: Column, w) -> Column:
    """True also where only the neighbours on both sides are."""
    return F.coalesce(flags, F.lit(False)) | (F.coalesce(F.lag(flags).over(w), F.lit(False)) & F.coalesce(F.lead(flags).over(w), F.lit(False)))


def away_days(days: DataFrame, key: list[str], least_km: float) -> DataFrame:
    """Adds away: far from home on average, gaps of one day closed, and synthetic days as their neighbours are: all if the day before is away, else only the last if the day after is."""
    w = Window.partitionBy(*key).orderBy("day")
    raw = days.withColumn("__far", F.coalesce(F.col("avg_km") >= least_km, F.lit(False)))
    raw = raw.withColumn("__closed", closed(F.col("__far"), w))
    # Islands of synthetic days take the flag of the last real day before them.
    before = F.last(F.when(~F.col("synthetic"), F.col("__closed")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(F.when(~F.col("synthetic"), F.col("__closed"))).over(w)
    away = F.when(F.col("synthetic"), F.col("__closed") | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).otherwise(F.col("__closed"))
    return raw.withColumn("away", away).drop("__far", "__closed")


def filled_between(days: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Adds filled: true from the first to the last true day."""
    limits = days.where(flag).groupBy(*key).agg(F.min("day").alias("__a"), F.max("day").alias("__b"))
    return days.join(limits, key, "left").withColumn("filled", F.coalesce(F.col("day").between(F.col("__a"), F.col("__b")), F.lit(False))).drop("__a", "__b")


def runs(days: DataFrame, key: list[str], least: int = 1) -> DataFrame:
    """Numbers runs of away days (run), and extends each by the fast transport day before and after it; keeps runs of `least` days."""
    w = Window.partitionBy(*key).orderBy("day")
    near_away = F.coalesce(F.lag("away").over(w), F.lit(False)) | F.coalesce(F.lead("away").over(w), F.lit(False))
    flagged = days.withColumn("__in", F.col("away") | (F.col("fast") & near_away))
    flagged = flagged.withColumn("__new", F.when(F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False)), 1).otherwise(0))
    flagged = flagged.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__in").drop("__in", "__new")
    size = flagged.groupBy(*key, "run").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return flagged.join(size, [*key, "run"], "left_semi")


def core_days(days: DataFrame, key: list[str], share: float = 0.65) -> DataFrame:
    """Adds core: the best scored days of each run, about two thirds of them, one at least."""
    w = Window.partitionBy(*key, "run")
    score = F.least(F.lit(1.0), F.col("n") / 20) + F.greatest(F.lit(0.0), F.coalesce("z", F.lit(0.0))) * 0.2 - F.when(F.col("fast"), 0.3).otherwise(0.0)
    out = days.withColumn("day_score", F.round(score, 9))
    target = F.greatest(F.lit(1), F.round(F.count("*").over(w) * share).cast("int"))
    return out.withColumn("core", F.row_number().over(w.orderBy(F.desc("day_score"), "day")) <= target)


def trip_class(days: Column, nights: Column) -> Column:
    return F.when(days <= 1, "day_trip").when((nights <= 2) & (days <= 3), "short_trip").otherwise("vacation")


def trips(days: DataFrame, key: list[str]) -> DataFrame:
    """One row per run: days, items, distances, transit share, a score of seven parts (0 to 10) less a penalty for transit, class and storyline; `passes` tells whether it meets its class's threshold."""
    g = days.groupBy(*key, "run").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"), F.sum("n").alias("n"), F.max("max_km").alias("max_km"), F.avg("avg_km").alias("avg_km"), F.avg(F.col("fast").cast("double")).alias("transit"),
        F.avg((F.col("n") > 0).cast("double")).alias("covered"), F.max("z").alias("z"), F.avg(F.weekday("day").isin(5, 6).cast("double")).alias("weekend"),
    )
    c = F.col
    parts = [(F.least(F.lit(1.0), c("days") / 7), 0.28), (distance_saturation(c("max_km")), 0.18), (F.least(F.lit(1.0), c("n") / 60), 0.16), (c("covered"), 0.14), (clamp01(c("z") / 3), 0.10), (c("weekend"), 0.08), (clamp01(c("avg_km") / 200), 0.06)]
    score = 10 * (sum((F.coalesce(p, F.lit(0.0)) * w for p, w in parts), F.lit(0.0)) - 0.1 * c("transit"))
    out = g.withColumns({"score": F.greatest(F.lit(0.0), score), "class": trip_class(c("days"), F.datediff("last", "first"))})
    limit = F.when(c("class") == "day_trip", 4.0).when(c("class") == "short_trip", 5.5).otherwise(7.0)
    limit = F.when(c("weekend") == 1.0, F.least(limit, F.lit(5.0))).otherwise(limit)
    return out.withColumns({"passes": c("score") >= limit, "storyline": F.concat_ws(".", F.lit("trip"), c("class"), F.when(c("transit") >= 0.45, "transit"))})


def cohort_presence(items: DataFrame, key: list[str], important: list[str]) -> DataFrame:
    """Per key and day the share of the important people that are there."""
    people = F.array(*[F.lit(p) for p in important])
    seen = items.select(*key, "day", F.explode(F.array_intersect("persons", people)).alias("p")).groupBy(*key, "day").agg(F.count_distinct("p").alias("c"))
    return items.select(*key, "day").distinct().join(seen, [*key, "day"], "left").withColumn("presence", F.coalesce("c", F.lit(0)) / max(1, len(important))).drop("c")


def least_away_km(home: DataFrame, soft: float = 60.0, strict: float = 120.0, dense: int = 100) -> DataFrame:
    """Adds least_km: how far away counts, less where home has many items."""
    return home.withColumn("least_km", F.when(F.col("n") >= dense, F.lit(soft)).otherwise(strict))


def nearest_center(points: DataFrame, centers: DataFrame, key: list[str]) -> DataFrame:
    """Points with the nearest of their owner's few centers that is valid then (valid_from, valid_until, null: open) and whether they are outside its radius_km."""
    c = centers.select(*key, "center_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "radius_km", "valid_from", "valid_until")
    both = points.join(c, key).where((F.col("valid_from").isNull() | (F.col("t") >= F.col("valid_from"))) & (F.col("valid_until").isNull() | (F.col("t") <= F.col("valid_until"))))
    both = both.withColumn("center_km", haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) / 1000)
    best = both.groupBy(*key, "item_id").agg(F.min_by(F.struct("center_id", "center_km", "radius_km"), F.struct("center_km", "center_id")).alias("b"))
    return best.select(*key, "item_id", "b.center_id", "b.center_km", (F.col("b.center_km") > F.col("b.radius_km")).alias("away"))
