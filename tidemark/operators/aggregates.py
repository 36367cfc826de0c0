"""Aggregates over the members of drafts: edges (draft_id, item) joined with the items' columns, one row per member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_m


def time_range(members: DataFrame, key: list[str]) -> DataFrame:
    """First and last second, and whether the range can be trusted: three timed members, three in five of all, none before 1990."""
    g = members.groupBy(*key).agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.count("t").alias("timed"), F.count("*").alias("n"))
    return g.withColumn("reliable", (F.col("timed") >= 3) & (F.col("timed") >= 0.6 * F.col("n")) & (F.coalesce(F.col("t_from"), F.lit(0)) >= 631152000))


def centroid(members: DataFrame, key: list[str]) -> DataFrame:
    """Mean place of located members, null without any, and the largest distance from it in metres."""
    mean = members.groupBy(*key).agg(F.avg("lat").alias("lat_c"), F.avg("lon").alias("lon_c"))
    far = members.join(mean, key).groupBy(*key).agg(F.max(haversine_m(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c"))).alias("radius_m"))
    return mean.join(far, key)


def majority(rows: DataFrame, key: list[str], value: str, first: str, name: str = "n") -> DataFrame:
    """Per key the value that most rows have; of equals the one that came first, then the least."""
    votes = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias(name), F.min(first).alias("__first"))
    w = Window.partitionBy(*key).orderBy(F.desc(name), "__first", value)
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__first")


def top_labels(rows: DataFrame, key: list[str], label: str, score: str, most: int = 5) -> DataFrame:
    """Per key the labels with the highest score, then count: (label, score, n, rank)."""
    g = rows.where(F.col(label).isNotNull()).groupBy(*key, label).agg(F.max(score).alias("score"), F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("n"), label)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def keywords(rows: DataFrame, key: list[str], word: str, most: int = 10) -> DataFrame:
    """Per key the most frequent words, case folded."""
    g = rows.where(F.col(word).isNotNull()).groupBy(*key, F.lower(word).alias("word")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "word")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def people(members: DataFrame, key: list[str], persons: str = "persons") -> DataFrame:
    """Share of members with people, distinct people, mentions, and a score of the three (0.4, 0.35, 0.25)."""
    some = F.coalesce(F.size(persons), F.lit(0))
    base = members.groupBy(*key).agg(F.count("*").alias("n"), F.avg((some > 0).cast("double")).alias("coverage"), F.sum(F.greatest(some, F.lit(0))).alias("mentions"))
    unique = members.select(*key, F.explode(persons).alias("p")).groupBy(*key).agg(F.count_distinct("p").alias("unique"))
    out = base.join(unique, key, "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    score = 0.4 * F.col("coverage") + 0.35 * F.least(F.lit(1.0), F.col("unique") / 4) + 0.25 * F.least(F.lit(1.0), F.col("mentions") / F.col("n"))
    return out.withColumn("people_score", score)


def quality(members: DataFrame, key: list[str], column: str) -> DataFrame:
    """Mean of a measure scaled between the group's 10th and 90th percentile; of the plain value where these are equal."""
    limits = members.groupBy(*key).agg(F.percentile(column, 0.1).alias("__p10"), F.percentile(column, 0.9).alias("__p90"))
    width = F.col("__p90") - F.col("__p10")
    scaled = F.when(width > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - F.col("__p10")) / F.nullif(width, F.lit(0.0))))).otherwise(F.col(column))
    # least() and greatest() skip nulls; unknown values must stay out of the mean.
    return members.join(limits, key).groupBy(*key).agg(F.avg(F.when(F.col(column).isNotNull(), scaled)).alias("quality_avg"))


def devices(members: DataFrame, key: list[str], device: str = "device", stable: float = 0.6) -> DataFrame:
    """The main device, its share, the number of devices; `stable` names it if its share is large enough."""
    total = members.groupBy(*key).agg(F.count(device).alias("total"), F.count_distinct(F.lower(device)).alias("variants"))
    named = members.where(F.col(device).isNotNull()).groupBy(*key, device).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*key).orderBy(F.desc("c"), F.lower(device), device)
    top = named.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    out = total.join(top, key)
    share = F.col("c") / F.col("total")
    return out.select(*key, F.col(device).alias("main"), share.alias("share"), "variants", F.when(share >= stable, F.col(device)).alias("stable"))


def calendar_summary(members: DataFrame, key: list[str]) -> DataFrame:
    """weekend is set where all members agree; holiday where all have the same one."""
    g = members.groupBy(*key).agg(F.min("weekend").alias("a"), F.max("weekend").alias("b"), F.count_distinct("holiday").alias("h"), F.max("holiday").alias("holiday"))
    return g.select(*key, F.when(F.col("a") == F.col("b"), F.col("a")).alias("weekend"), F.when(F.col("h") == 1, F.col("holiday")).alias("holiday"))


def zscores(days: DataFrame, value: str, key: list[str] | None = None) -> DataFrame:
    """Adds z: distance from the mean in population deviations; 0 where all are alike. The moments are aggregated, not windowed, so no task sees all rows."""
    key = key or []
    moments = days.groupBy(*key).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    joined = days.join(moments, key) if key else days.crossJoin(F.broadcast(moments))
    return joined.withColumn("z", F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def nearest_rank(rows: DataFrame, key: list[str], value: str, q: float) -> DataFrame:
    """The value at rank ceil(n q)."""
    return rows.groupBy(*key).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("value"))


def frequencies(items: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """How often each value occurs, and the largest count of all."""
    g = items.groupBy((F.col(column) if isinstance(column, str) else column).alias(name)).agg(F.count("*").alias("c")).where(F.col(name).isNotNull())
    return g.crossJoin(F.broadcast(g.agg(F.max("c").alias("most"))))


def series(items: DataFrame, key: list[str]) -> DataFrame:
    """Distinct years and whether they follow one another."""
    g = items.groupBy(*key).agg(F.count_distinct(F.year("day")).alias("years"), F.min(F.year("day")).alias("first"), F.max(F.year("day")).alias("last"))
    return g.withColumn("consecutive", (F.col("years") >= 2) & (F.col("last") - F.col("first") + 1 == F.col("years")))


def waypoints(items: DataFrame, key: list[str], place: str, most: int = 5) -> DataFrame:
    """Per key the places with most items: count, first second, mean place."""
    g = items.where(F.col(place).isNotNull()).groupBy(*key, place).agg(F.count("*").alias("n"), F.min("t").alias("first_seen"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "first_seen", place)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def home_places(items: DataFrame, key: list[str], step: float = 0.01, night: tuple[int, int] = (22, 6)) -> DataFrame:
    """Per key the cell with most night items, then most items; its mean place and the 95th percentile of distances (nearest rank) as radius."""
    from tidemark.functions.calendar import local_time
    from tidemark.functions.geo import floor_cell

    hour = F.hour(local_time(F.col("ts"), F.col("offset_min")))
    rows = items.where("lat is not null").withColumns({"cell": floor_cell(F.col("lat"), F.col("lon"), step), "night": ((hour >= night[0]) | (hour < night[1])).cast("int")})
    g = rows.groupBy(*key, "cell").agg(F.sum("night").alias("nights"), F.count("*").alias("n"), F.avg("lat").alias("home_lat"), F.avg("lon").alias("home_lon"))
    w = Window.partitionBy(*key).orderBy(F.desc("nights"), F.desc("n"), "cell")
    top = g.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    inside = rows.select(*key, "cell", "lat", "lon").join(top, [*key, "cell"]).withColumn("m", haversine_m(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")))
    return top.join(nearest_rank(inside, key, "m", 0.95).withColumnRenamed("value", "radius_m"), key)
