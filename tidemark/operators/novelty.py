"""How new a draft is: six parts, each the rarity of what its members have among all items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import world_cell
from tidemark.operators.aggregates import frequencies, majority
from tidemark.operators.score import rarity

#: Weights of the parts.
WEIGHTS = {"staypoint": 0.30, "rare_staypoint": 0.10, "time": 0.20, "device": 0.20, "content": 0.10, "history": 0.10}


def hash_prefix(phash: Column, nibbles: int = 5) -> Column:
    return F.when(F.length(phash) > 0, F.lower(F.substring(phash, 1, nibbles)))


def day_window(t: Column, hours: int = 6) -> Column:
    """Month, day and slot of the day of an epoch second in UTC."""
    at = F.timestamp_seconds(t)
    return F.concat(F.date_format(at, "MMdd"), F.lit(":"), F.floor(F.hour(at) / hours).cast("string"))


def _days(t_from: Column, t_to: Column, most: int = 7) -> Column:
    """Days of the year of a range, all of up to `most` days, else that many evenly spaced ones."""
    a, b = F.to_date(F.timestamp_seconds(t_from)), F.to_date(F.timestamp_seconds(t_to))
    span = F.datediff(b, a)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.date_add(a, F.floor(F.round(k * span * 86400 / (most - 1)) / 86400).cast("int")))
    return F.array_distinct(F.transform(F.when(span < most, F.sequence(a, b)).otherwise(spaced), F.dayofyear))


def _rarities(rows: DataFrame, on: str, counts: DataFrame) -> DataFrame:
    """Rows (with the column `on`) and the rarity of their value; values that never occur are new, and nothing is known without any."""
    most = counts.agg(F.max("c").alias("most"))
    known = rows.join(counts.select(F.col(on).alias("__v"), "c"), F.col(on) == F.col("__v"), "left").crossJoin(F.broadcast(most))
    return known.withColumn("rarity", F.when(F.coalesce("most", F.lit(0)) <= 0, 0.5).otherwise(rarity(F.coalesce("c", F.lit(0)), F.col("most")))).drop("__v", "c", "most")


def novelty(members: DataFrame, corpus: DataFrame, key: list[str], history: DataFrame | None = None, step: float = 0.3, nibbles: int = 5, rare: int = 6, hours: int = 6, weights: dict[str, float] | None = None) -> DataFrame:
    """Per draft (key): the six parts and novelty, their weighted sum.

    members: key, item_id, t, lat, lon, device, phash, stay (the key of its stay, or null); corpus: the same item columns of all items;
    history: what was shown before, as (kind, value, c) with kinds `phash` (prefixes) and `window` (`day_window`).
    staypoint: its most frequent stay among all drafts' members, without stays the grid cell of its centre; rare_staypoint: share of
    stays that at most `rare` members have; time: days of the year; device and content: its most frequent device and hash prefix; history:
    mean over prefix and windows. Parts about which nothing is known are 0.5. Of equally frequent values the earliest counts.
    """
    weights = weights or WEIGHTS
    rows = members.withColumns({"prefix": hash_prefix(F.col("phash"), nibbles), "window": day_window(F.col("t"), hours)})
    all_rows = corpus.withColumns({"prefix": hash_prefix(F.col("phash"), nibbles), "doy": F.dayofyear(F.timestamp_seconds("t")), "cell": F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), world_cell(F.col("lat"), F.col("lon"), step))})
    base = rows.groupBy(*key).agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.coalesce(F.avg("lat"), F.lit(0.0)).alias("lat"), F.coalesce(F.avg("lon"), F.lit(0.0)).alias("lon"))
    count = lambda frame, column: frequencies(frame.where(F.col(column).isNotNull()), column, column)
    main = lambda column: majority(rows.where(F.col(column).isNotNull()), key, column, "t").select(*key, column)
    part = lambda found, name: found.select(*key, F.col("rarity").alias(name))

    stays = count(rows, "stay")
    by_cell = part(_rarities(base.withColumn("cell", world_cell(F.col("lat"), F.col("lon"), step)), "cell", count(all_rows, "cell")), "by_cell")
    by_stay = part(_rarities(main("stay"), "stay", stays), "by_stay")
    few = rows.where("stay is not null").join(stays.select("stay", "c"), "stay").groupBy(*key).agg(F.avg((F.col("c") <= rare).cast("double")).alias("rare_staypoint"))
    days = base.select(*key, F.explode(_days(F.col("t_from"), F.col("t_to"))).alias("doy"))
    time = _rarities(days, "doy", count(all_rows, "doy")).groupBy(*key).agg(F.avg("rarity").alias("time"))
    device = part(_rarities(main("device"), "device", count(all_rows, "device")), "device_part")
    content = part(_rarities(main("prefix"), "prefix", count(all_rows, "prefix")), "content")
    parts = [by_cell, by_stay, few, time, device, content]
    if history is not None:
        shown = lambda kind, name: history.where(F.col("kind") == kind).select(F.col("value").alias(name), "c")
        for kind, found in (("phash", main("prefix").withColumnRenamed("prefix", "value")), ("window", rows.select(*key, F.col("window").alias("value")).distinct())):
            seen = shown(kind, "value")
            some = found.crossJoin(F.broadcast(seen.agg(F.count("*").alias("__some")))).where("__some > 0").drop("__some")
            parts.append(_rarities(some, "value", seen).groupBy(*key).agg(F.avg("rarity").alias(f"by_{kind}")))
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, base.select(*key))
    if history is not None:
        n = F.when(F.col("by_phash").isNull(), 0).otherwise(1) + F.when(F.col("by_window").isNull(), 0).otherwise(1)
        past = (F.coalesce("by_phash", F.lit(0.0)) + F.coalesce("by_window", F.lit(0.0))) / F.nullif(n, F.lit(0))
    else:
        past = F.lit(None).cast("double")
    half = lambda c: F.coalesce(c, F.lit(0.5))
    found = {"staypoint": F.coalesce("by_stay", "by_cell"), "rare_staypoint": half(F.col("rare_staypoint")), "time": half(F.col("time")), "device": half(F.col("device_part")), "content": half(F.col("content")), "history": half(past)}
    out = out.select(*key, *[c.alias(n) for n, c in found.items()])
    return out.withColumn("novelty", sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)))
