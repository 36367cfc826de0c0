"""Grouping strategies: item relations to drafts.

A draft is one row: algorithm, key, n, t_from, t_to, lat, lon (means of located items) and digest, an order-free hash of
its members. Members aren't gathered in arrays, so a draft may have any number; `members` gives them as rows.
Every strategy takes the owner of the items as a list of columns (`owner`); groups never span owners.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.geo import bearing_deg, floor_cell, haversine_m, heading_delta
from tidemark.functions.hashing import member_digest
from tidemark.operators.islands import anchored_windows, day_runs, gap_distance_runs, gap_runs
from tidemark.operators.scans import located


def drafts(rows: DataFrame, algorithm: str, key: list[str], least: int = 1, extra: dict[str, Column] | None = None, where: Column | str | None = None) -> DataFrame:
    """Groups rows into drafts; keeps those with `least` items that meet the condition on n, t_from, t_to and the extra aggregates."""
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), member_digest(F.col("item_id")).alias("digest"), *[c.alias(n) for n, c in (extra or {}).items()]
    )
    out = out.where(F.col("n") >= least)
    if where is not None:
        out = out.where(where)
    out = out.withColumn("algorithm", F.lit(algorithm))
    if (found := _MEMBERS.get()) is not None:
        found.append(_members(rows, out, key))
    return out


#: Where `with_members` gathers the members of the drafts that are being made.
_MEMBERS: ContextVar[list[DataFrame] | None] = ContextVar("members", default=None)


def _members(rows: DataFrame, made: DataFrame, key: list[str]) -> DataFrame:
    """(algorithm, digest, t_from, n, item_id, t) of the rows that the drafts are made of."""
    k = made.select(*[F.col(c).alias(f"__{c}") for c in key], "algorithm", "digest", "t_from", "n")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key] or [F.lit(True)]
    return rows.join(k, same).select("algorithm", "digest", "t_from", "n", "item_id", "t")


def with_members(strategy: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """What a strategy makes, and the members of its drafts as rows (algorithm, digest, t_from, n, item_id, t)."""
    found: list[DataFrame] = []
    token = _MEMBERS.set(found)
    try:
        made = strategy()
    finally:
        _MEMBERS.reset(token)
    return made, union(*found) if found else None


def is_panorama(least: float = 2.3) -> Column:
    """The flag where it is known, else the shape."""
    return F.coalesce("is_panorama", F.col("width") / F.col("height") >= least)


def is_portrait(least: float = 1.2) -> Column:
    """Upright shape with people."""
    return (F.col("height") / F.col("width") >= least) & (F.size("persons") > 0)


def within(rows: DataFrame, key: list[str], metres: float) -> DataFrame:
    """Rows of the groups whose located items are all within a distance of their mean."""
    mean = rows.groupBy(*key).agg(F.avg("lat").alias("__lat"), F.avg("lon").alias("__lon"))
    far = rows.join(mean, key).where(haversine_m(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")) > metres).select(*key).distinct()
    return rows.join(far, key, "left_anti")


def cross_dimension(items: DataFrame, owner: list[str], gap: int = 5400, metres: float = 130.0, least: int = 5) -> DataFrame:
    """Sessions without a long gap whose places are close together."""
    rows = gap_runs(items, owner, gap)
    return drafts(within(rows, [*owner, "run"], metres), "cross_dimension", [*owner, "run"], least)


def gap_sessions(items: DataFrame, owner: list[str], gap: int, least: int, algorithm: str = "session") -> DataFrame:
    return drafts(gap_runs(items, owner, gap), algorithm, [*owner, "run"], least)


def bursts(items: DataFrame, owner: list[str], gap: int = 90, metres: float = 45.0, least: int = 3) -> DataFrame:
    """Groups by burst id, and sessions by time and distance of items without one."""
    named = drafts(items.where("burst_uuid is not null"), "burst", [*owner, "burst_uuid"], least).withColumnRenamed("burst_uuid", "key")
    runs = gap_distance_runs(items.where("burst_uuid is null"), owner, gap, metres)
    made = drafts(runs, "burst", [*owner, "run"], least).withColumn("key", F.col("run").cast("string")).drop("run")
    return named.unionByName(made)


def golden_hours(items: DataFrame, owner: list[str], hours: tuple[int, ...] = (6, 7, 18, 19), gap: int = 5400, least: int = 4) -> DataFrame:
    """Sessions of items in the golden hours: the solar flag where known, else the local hour."""
    local = F.hour(cal.local_time(F.col("ts"), F.col("offset_min")))
    flag = F.col("golden") if "golden" in items.columns else F.lit(None).cast("boolean")
    return gap_sessions(items.where(F.coalesce(flag, local.isin(*hours))), owner, gap, least, "golden_hour")


def nightlife(items: DataFrame, owner: list[str], gap: int = 9000, metres: float = 260.0, least: int = 5) -> DataFrame:
    """Sessions of the night hours that stay in one place."""
    hour = F.hour(cal.local_time(F.col("ts"), F.col("offset_min")))
    rows = gap_runs(items.where((hour >= 20) | (hour <= 4)), owner, gap)
    return drafts(within(rows, [*owner, "run"], metres), "nightlife_event", [*owner, "run"], least)


def panoramas(items: DataFrame, owner: list[str], gap: int = 9000, least: int = 3) -> DataFrame:
    return gap_sessions(items.where(is_panorama()), owner, gap, least, "panorama")


def portraits(items: DataFrame, owner: list[str], gap: int = 7200, least: int = 4) -> DataFrame:
    return gap_sessions(items.where(is_portrait()), owner, gap, least, "portrait_orientation")


def day_albums(items: DataFrame, owner: list[str], least: int = 7, quality: float = 0.6) -> DataFrame:
    """Local days with enough items and something to tell: people, several places, or quality."""
    local = F.to_date(cal.local_time(F.col("ts"), F.col("offset_min")))
    rows = items.withColumns({"day": local, "cell": floor_cell(F.col("lat"), F.col("lon"), 0.01)})
    extra = {"people": F.max(F.size("persons")), "places": F.count_distinct("cell"), "quality": F.avg("quality")}
    return drafts(rows, "day_album", [*owner, "day"], least, extra, (F.col("people") > 1) | (F.col("places") >= 2) | (F.col("quality") >= quality))


def video_stories(items: DataFrame, owner: list[str], least: int = 2) -> DataFrame:
    return drafts(items.where("is_video"), "video_stories", [*owner, "day"], least)


def device_groups(items: DataFrame, owner: list[str], least: int = 5) -> DataFrame:
    """Items of one device, day and place; items without a time share a group of their own."""
    rows = items.withColumns({"date": F.coalesce(F.col("day").cast("string"), F.lit("undated")), "place": F.coalesce(floor_cell(F.col("lat"), F.col("lon"), 1.0), F.lit("unknown"))})
    return drafts(rows, "device_similarity", [*owner, "device", "date", "place"], least)


def significant_places(items: DataFrame, owner: list[str], step: float = 0.01, least: int = 16, days: int = 3) -> DataFrame:
    """Cells visited often and on several days."""
    rows = located(items).withColumn("cell", floor_cell(F.col("lat"), F.col("lon"), step))
    return drafts(rows, "significant_place", [*owner, "cell"], least, {"days": F.count_distinct("day")}, F.col("days") >= days)


def first_visits(items: DataFrame, owner: list[str], step: float = 0.01, per_day: int = 4, nights: tuple[int, int] = (0, 3), least: int = 7) -> DataFrame:
    """The earliest run of consecutive days in a cell that is long enough and not too long."""
    rows = located(items).withColumn("cell", floor_cell(F.col("lat"), F.col("lon"), step))
    key = [*owner, "cell"]
    days = rows.groupBy(*key, "day").agg(F.count("*").alias("c")).where(F.col("c") >= per_day)
    days = day_runs(days, key)
    size = days.groupBy(*key, "run").agg(F.sum("c").alias("items"), F.min("day").alias("first"), (F.datediff(F.max("day"), F.min("day"))).alias("nights"))
    fits = size.where(F.col("nights").between(*nights) & (F.col("items") >= least))
    chosen = fits.groupBy(*key).agg(F.min_by("run", "first").alias("run"))
    members = rows.join(days.join(chosen, [*key, "run"], "left_semi").select(*key, "day"), [*key, "day"])
    return drafts(members, "first_visit_place", key)


def per_year(items: DataFrame, owner: list[str], least: int, months: int) -> DataFrame:
    """Years with enough items in enough months."""
    rows = items.withColumn("year", F.year("day"))
    return drafts(rows, "year_in_review", [*owner, "year"], least, {"months": F.count_distinct(F.month("day"))}, F.col("months") >= months)


def over_years(items: DataFrame, owner: list[str], algorithm: str, key: list[str], years: int, least: int, days: int = 1) -> DataFrame:
    """Groups that recur in several years, on several days."""
    return drafts(items, algorithm, [*owner, *key], least, {"years": F.count_distinct(F.year("day")), "days": F.count_distinct("day")}, (F.col("years") >= years) & (F.col("days") >= days))


def this_month(items: DataFrame, owner: list[str], as_of: str, years: int = 3, least: int = 20, days: int = 6) -> DataFrame:
    rows = items.where(F.month("day") == F.month(F.lit(as_of).cast("date"))).withColumn("month", F.month("day"))
    return over_years(rows, owner, "this_month_over_years", ["month"], years, least, days)


def on_this_day(items: DataFrame, owner: list[str], as_of: str, window: int = 0, years: int = 3, least: int = 10) -> DataFrame:
    month, day = int(as_of[5:7]), int(as_of[8:10])
    rows = items.where(cal.month_day_distance(F.col("day"), month, day) <= window).withColumn("anchor", F.lit(as_of[5:]))
    return over_years(rows, owner, "on_this_day_over_years", ["anchor"], years, least)


def one_year_ago(items: DataFrame, owner: list[str], as_of: str, days: int = 3, least: int = 6) -> DataFrame:
    then = F.add_months(F.lit(as_of).cast("date"), -12)
    rows = items.where(F.col("day").between(F.date_sub(then, days), F.date_add(then, days))).withColumn("anchor", then)
    return drafts(rows, "one_year_ago", [*owner, "anchor"], least)


def anniversaries(items: DataFrame, owner: list[str], least: int = 5, years: int = 10, top: int = 30) -> DataFrame:
    """Month-days that recur, scored by items, years, items a year, span and the best year; the top ones."""
    per = items.withColumns({"month_day": F.date_format("day", "MM-dd"), "year": F.year("day")}).groupBy(*owner, "month_day", "year").agg(F.count("*").alias("c"))
    g = per.groupBy(*owner, "month_day").agg(F.sum("c").alias("n"), F.count("*").alias("years"), F.max("c").alias("best"), (F.max("year") - F.min("year")).alias("span"))
    g = g.where((F.col("n") >= least) & (F.col("years") >= years))
    score = 5 * F.col("n") + 10 * F.col("years") + 3 * F.col("n") / F.col("years") + 2 * F.col("span") + F.col("best")
    out = g.withColumn("score", score).orderBy(F.desc("score"), *owner, "month_day").limit(top)
    if (found := _MEMBERS.get()) is not None:
        rows = items.withColumn("month_day", F.date_format("day", "MM-dd")).join(out.select(*owner, "month_day"), [*owner, "month_day"], "left_semi")
        found.append(drafts_members(rows, "anniversary", [*owner, "month_day"]))
    return out


def drafts_members(rows: DataFrame, algorithm: str, key: list[str]) -> DataFrame:
    """Members of the groups of rows, for strategies that don't group by `drafts`."""
    made = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("t").alias("t_from"), member_digest(F.col("item_id")).alias("digest")).withColumn("algorithm", F.lit(algorithm))
    return _members(rows, made, key)


def holidays(items: DataFrame, owner: list[str], least: int = 6) -> DataFrame:
    rows = items.withColumn("holiday", cal.holiday(F.col("day"))).where("holiday is not null")
    return drafts(rows, "holiday_event", [*owner, "day", "holiday"], least)


def new_years_eve(items: DataFrame, owner: list[str], least: int = 6) -> DataFrame:
    """The night to the first of January, as one group."""
    h, md = F.hour("ts"), F.date_format("ts", "MM-dd")
    rows = items.where(((md == "12-31") & (h >= 20)) | ((md == "01-01") & (h <= 2))).withColumn("year", F.year(F.col("ts") + F.expr("INTERVAL 6 HOURS")))
    return drafts(rows, "new_year_eve", [*owner, "year"], least)


def seasons(items: DataFrame, owner: list[str], least: int = 18) -> DataFrame:
    rows = items.withColumns({"season": cal.season(F.col("day")), "season_year": cal.season_year(F.col("day"))})
    return drafts(rows, "season", [*owner, "season_year", "season"], least)


def seasons_over_years(items: DataFrame, owner: list[str], least: int = 26, years: int = 3) -> DataFrame:
    return over_years(items.withColumn("season", cal.season(F.col("day"))), owner, "season_over_years", ["season"], years, least)


def panoramas_over_years(items: DataFrame, owner: list[str], per_year: int = 2, years: int = 3, least: int = 10) -> DataFrame:
    rows = items.where(is_panorama()).withColumn("year", F.year("day"))
    enough = rows.groupBy(*owner, "year").agg(F.count("*").alias("c")).where(F.col("c") >= per_year)
    rows = rows.join(enough.select(*owner, "year"), [*owner, "year"], "left_semi")
    return over_years(rows, owner, "panorama_over_years", [], years, least)


def cohorts(items: DataFrame, gap_days: int = 10, least: int = 4) -> DataFrame:
    """Items with the same two or more people, in runs of days."""
    rows = items.withColumn("people", F.array_join(F.array_sort(F.array_distinct("persons")), ",")).where(F.size(F.array_distinct("persons")) >= 2)
    days = day_runs(rows.select("people", "day").distinct(), ["people"], gap=gap_days)
    return drafts(rows.join(days, ["people", "day"]), "people_cohort", ["people", "run"], least)


def at_home(items: DataFrame, owner: list[str], home: DataFrame, weekdays: tuple[int, ...], share: float, per_day: int, least: int, radius_m: float = 500.0, algorithm: str = "at_home") -> DataFrame:
    """Runs of days of some weekdays that are mostly spent near home (owner, home_lat, home_lon)."""
    rows = items.where(cal.iso_weekday(F.col("day")).isin(*weekdays)).join(home, owner)
    near = F.coalesce(haversine_m(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) <= radius_m, F.lit(False))
    days = rows.groupBy(*owner, "day").agg(F.count("*").alias("c"), F.avg(near.cast("double")).alias("share")).where((F.col("share") >= share) & (F.col("c") >= per_day))
    days = day_runs(days, owner).select(*owner, "day", "run")
    return drafts(rows.join(days, [*owner, "day"]), algorithm, [*owner, "run"], least)


def transit_days(items: DataFrame, owner: list[str], least: int = 3, km: float = 50.0, fast_kmh: float = 90.0, fast_legs: int = 1, straight_legs: int = 0) -> DataFrame:
    """Days that cover a long distance, with fast legs and legs that keep their heading."""
    key = [*owner, "day"]
    w = Window.partitionBy(*key).orderBy("t", "item_id")
    lag = lambda c: F.lag(c).over(w)
    legs = located(items).withColumns({"metres": haversine_m(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), "seconds": F.col("t") - lag("t"), "heading": bearing_deg(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))})
    legs = legs.withColumn("turn", heading_delta(F.col("heading"), F.lag("heading").over(w)))
    kmh = F.col("metres") / F.nullif(F.col("seconds"), F.lit(0)) * 3.6
    extra = {"km": F.coalesce(F.sum("metres"), F.lit(0.0)) / 1000, "fast": F.count_if(kmh >= fast_kmh), "straight": F.count_if((F.col("turn") <= 25) & (F.col("metres") > 0))}
    return drafts(legs, "transit_travel_day", key, least, extra, (F.col("km") >= km) & (F.col("fast") >= fast_legs) & (F.col("straight") >= straight_legs))


def weekend_getaways(items: DataFrame, owner: list[str], home: DataFrame, nights: tuple[int, int] = (2, 3), per_day: int = 4, km: tuple[float, float] = (80.0, 400.0), years: int = 3, least: int = 20) -> DataFrame:
    """Per owner and year the best run of days away from home that holds a weekend day; owners with enough such years."""
    rows = located(items).join(home, owner).withColumn("km", haversine_m(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) / 1000)
    days = rows.groupBy(*owner, "day").agg(F.count("*").alias("c"), F.median("km").alias("km")).where((F.col("c") >= per_day) & F.col("km").between(*km))
    runs = day_runs(days, owner)
    size = runs.groupBy(*owner, "run").agg(F.min("day").alias("first"), F.datediff(F.max("day"), F.min("day")).alias("nights"), F.sum("c").alias("c"), F.max(cal.is_weekend(F.col("day"))).alias("weekend"))
    size = size.where(F.col("nights").between(*nights) & F.col("weekend")).withColumn("year", F.year("first"))
    best = size.groupBy(*owner, "year").agg(F.max_by("run", F.struct("c", (-F.unix_date("first")).alias("early"))).alias("run"))
    members = rows.join(runs.join(best, [*owner, "run"]).select(*owner, "day", "year"), [*owner, "day"])
    return drafts(members, "weekend_getaways_over_years", owner, least, {"years": F.count_distinct("year")}, F.col("years") >= years)


def time_similarity(items: DataFrame, owner: list[str], seconds: int = 10800, metres: float = 250.0, least: int = 9) -> DataFrame:
    """Windows of a day that begin with their first item and stay near it."""
    rows = anchored_windows(items.select(*owner, "day", "t", "item_id", "lat", "lon"), [*owner, "day"], seconds, metres)
    return drafts(rows, "time_similarity", [*owner, "day", "window"], least)


def location_similarity(items: DataFrame, owner: list[str], seconds: int = 10800, metres: float = 140.0, least: int = 6, step: float = 0.01) -> DataFrame:
    """The same within one place."""
    rows = located(items).withColumn("place", floor_cell(F.col("lat"), F.col("lon"), step)).select(*owner, "place", "day", "t", "item_id", "lat", "lon")
    return drafts(anchored_windows(rows, [*owner, "place", "day"], seconds, metres), "location_similarity", [*owner, "place", "day", "window"], least)


def monthly_highlights(items: DataFrame, owner: list[str], least: int = 28, days: int = 7, gap_hours: int = 36, most: int = 5) -> DataFrame:
    """Per month with enough items and days: the best scored day albums, 36 hours apart, five at most."""
    rows = items.withColumn("month", F.date_trunc("month", "day").cast("date"))
    fits = rows.groupBy(*owner, "month").agg(F.count("*").alias("n"), F.count_distinct("day").alias("d")).where((F.col("n") >= least) & (F.col("d") >= days)).select(*owner, "month")
    events = rows.join(fits, [*owner, "month"], "left_semi").groupBy(*owner, "month", "day").agg(
        F.count("*").alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"), member_digest(F.col("item_id")).alias("digest"), F.round(0.3 * F.least(F.lit(1.0), F.count("*") / 20) + 0.35 * F.avg("quality") + 0.2 * F.least(F.lit(1.0), F.avg(F.size("persons")) / 2) + 0.15 * F.avg(F.col("is_video").cast("double")), 9).alias("score")
    )
    key = [*owner, "month"]

    def start(_):
        taken: list[dict] = []

        def step(row):
            if row is not None and len(taken) < most and all(abs(row["t_from"] - x["t_from"]) >= gap_hours * 3600 for x in taken):
                taken.append(row)
                yield {k: v for k, v in row.items() if k != "rank"}

        return step

    from tidemark.operators.islands import scan_sorted

    ranked = events.withColumn("rank", -F.col("score"))
    out = scan_sorted(ranked, key, ["rank", "day"], start, events.schema).withColumn("algorithm", F.lit("monthly_highlights"))
    if (found := _MEMBERS.get()) is not None:
        found.append(_members(rows, out, [*key, "day"]))
    return out


def similar_times(items: DataFrame, owner: list[str], scratch, metres: float = 250.0, seconds: int = 10800, least: int = 9) -> DataFrame:
    """Buckets of a day by density, then time."""
    from tidemark.operators.grouping import geo_time_buckets

    found = geo_time_buckets(items, owner, scratch, metres, seconds, least)
    return drafts(items.select("item_id", "t", "lat", "lon").join(found, "item_id"), "time_similarity", [*owner, "day", "bucket"], least)


def similar_places(items: DataFrame, owner: list[str], scratch, metres: float = 140.0, seconds: int = 10800, least: int = 6, step: float = 0.01) -> DataFrame:
    """The same within each place that has enough items; items of no place among themselves."""
    from tidemark.operators.grouping import geo_time_buckets

    rows = items.withColumn("place", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), floor_cell(F.col("lat"), F.col("lon"), step)))
    if "locality" in items.columns:
        rows = rows.withColumn("place", F.coalesce("locality", "place"))
    rows = rows.withColumn("place", F.coalesce("place", F.lit("")))
    full = rows.groupBy(*owner, "place").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    rows = rows.join(full, [*owner, "place"], "left_semi")
    found = geo_time_buckets(rows, [*owner, "place"], scratch, metres, seconds, least)
    return drafts(rows.select("item_id", "t", "lat", "lon").join(found, "item_id"), "location_similarity", [*owner, "place", "day", "bucket"], least)


def vacations(items: DataFrame, owner: list[str], days: DataFrame) -> DataFrame:
    """Trips of runs of days (owner, day, run and what `trips.trips` asks for) that reach the threshold of their class, as drafts of their days' items."""
    from tidemark.operators import trips as T

    made = T.trips(days, owner).where("passes").select(*owner, "run", F.col("class").alias("trip_class"))
    rows = items.join(days.select(*owner, "day", "run"), [*owner, "day"]).join(made, [*owner, "run"])
    return drafts(rows, "vacation", [*owner, "run", "trip_class"])


def phash_groups(items: DataFrame, scratch, prefix: int = 4, bits: int = 5, least: int = 2) -> DataFrame:
    """Components of items whose hashes share a prefix and differ in few bits."""
    from tidemark.operators.density import similar_hash_groups

    return drafts(similar_hash_groups(items, scratch, prefix, bits), "phash_similarity", ["component"], least)


def union(*made: DataFrame) -> DataFrame:
    """All strategies' drafts in one relation, with nulls for columns that one lacks."""
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out
