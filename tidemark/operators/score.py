"""Scores of drafts, and their normalisation. `as_of` is always given; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_m
from tidemark.functions.scoring import clamp01, quantile_normal, span_score, weighted_mean

#: Signatures that drafts are compared with, at most.
SIGNATURES = 1000
#: Default weights of the parts.
WEIGHTS = {"quality": 0.22, "aesthetics": 0.08, "people": 0.16, "content": 0.09, "density": 0.10, "novelty": 0.09, "holiday": 0.07, "recency": 0.12, "location": 0.05, "poi": 0.02, "time_coverage": 0.10, "liveliness": 0.08}


def density(n: Column, seconds: Column) -> Column:
    """Items per minute of the draft, over an hour's worth at least."""
    return F.least(F.lit(1.0), n / F.greatest(F.lit(60.0), seconds / 60))


def recency(t_to: Column, as_of: int) -> Column:
    """Falls to 0 over a year."""
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(as_of) - t_to) / 86400) / 365)


def holiday(t_from: Column, t_to: Column) -> Column:
    """1 if a day of the range is a holiday, else half if one is on a weekend."""
    from tidemark.functions.calendar import holiday as name
    from tidemark.functions.calendar import is_weekend

    days = F.sequence(F.to_date(F.timestamp_seconds(t_from)), F.to_date(F.timestamp_seconds(t_to)))
    return F.when(F.exists(days, lambda x: name(x).isNotNull()), 1.0).when(F.exists(days, is_weekend), 0.5).otherwise(0.0)


def content(coverage: Column, unique: Column, total: Column, n: Column) -> Column:
    return 0.4 * coverage + 0.35 * F.least(F.lit(1.0), unique / 8) + 0.25 * F.least(F.lit(1.0), total / n)


def rarity(count: Column, most: Column) -> Column:
    """1 for what never occurs, 0 for the most frequent."""
    return 1 - F.least(count, most) / F.greatest(most, F.lit(1))


def location(coverage: Column, radius_km: Column) -> Column:
    return 0.7 * coverage + 0.3 * clamp01(1 - F.coalesce(radius_km, F.lit(10.0)) / 10)


def poi(label: Column, category: Column, wikidata: Column, website: Column) -> Column:
    flag = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    return F.least(F.lit(1.0), flag(label, 0.45) + flag(category, 0.25) + flag(wikidata, 0.15) + flag(website, 0.05))


def time_coverage(timed_share: Column, seconds: Column) -> Column:
    return 0.55 * timed_share + 0.45 * span_score(seconds / 3600)


def liveliness(video: Column, live: Column, motion: Column, targets: tuple[float, float, float] = (0.3, 0.2, 0.4), weights: tuple[float, float, float] = (0.45, 0.25, 0.3)) -> Column:
    """Shares of videos, live photos and moving items against what is aimed at."""
    return weighted_mean([(F.when(x.isNotNull(), F.least(F.lit(1.0), x / t)), w) for x, t, w in zip((video, live, motion), targets, weights, strict=True)])


def weighted(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Sum of the parts by weight; missing parts count 0, missing aesthetics are the quality."""
    weights = weights or WEIGHTS
    if "aesthetics" not in parts and "quality" in parts:
        parts = {**parts, "aesthetics": parts["quality"]}
    return sum((weights[k] * F.coalesce(c, F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))


def draft_parts(members: DataFrame, key: list[str], as_of: int) -> DataFrame:
    """The parts of the score that a draft's members give (item columns t, lat, lon, quality, persons, is_video, tag)."""
    from tidemark.operators.aggregates import centroid, people

    base = members.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.avg("quality").alias("quality"), F.count("lat").alias("placed"), F.count("tag").alias("tags"), F.count_distinct("tag").alias("unique_tags"),
        F.avg(F.col("is_video").cast("double")).alias("video"),
    )
    out = base.join(people(members, key).select(*key, "people_score"), key).join(centroid(members, key).select(*key, "radius_m"), key)
    seconds, n = F.col("t_to") - F.col("t_from"), F.col("n")
    return out.withColumns(
        {
            "people": F.col("people_score"), "content": content(F.col("tags") / n, F.col("unique_tags"), F.col("tags"), n), "density": density(n, seconds), "holiday": holiday(F.col("t_from"), F.col("t_to")), "recency": recency(F.col("t_to"), as_of),
            "location": location(F.col("placed") / n, F.col("radius_m") / 1000), "time_coverage": time_coverage(F.lit(1.0), seconds), "liveliness": liveliness(F.col("video"), F.lit(0.0), F.col("video")),
        }
    )


def composite(parts: DataFrame) -> DataFrame:
    """Adds score, the weighted sum."""
    names = [c for c in WEIGHTS if c in parts.columns]
    return parts.withColumn("score", weighted({c: F.col(c) for c in names}))


def explained(parts: DataFrame, key: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """What the score is made of, a row for each part that is known: (key, part, value, weight, contribution, rank), the largest contribution first."""
    from pyspark.sql import Window

    weights = weights or WEIGHTS
    listed = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).cast("double").alias("value"), F.lit(float(w)).alias("weight")) for n, w in weights.items() if n in parts.columns])
    rows = parts.select(*key, F.explode(listed).alias("__p")).select(*key, "__p.*").where("value is not null").withColumn("contribution", F.col("value") * F.col("weight"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.round("contribution", 9)), "part")))


def normalise(drafts: DataFrame, by: str = "algorithm", score: str = "score", boost: Column | None = None) -> DataFrame:
    """Adds normalised: the score by the quartiles of its algorithm, times a boost."""
    q = drafts.groupBy(by).agg(F.min(score).alias("__lo"), F.percentile(score, 0.25).alias("__q1"), F.percentile(score, 0.75).alias("__q3"), F.max(score).alias("__hi"))
    value = quantile_normal(F.col(score), F.col("__lo"), F.col("__q1"), F.col("__q3"), F.col("__hi"))
    out = drafts.join(q, by).withColumn("normalised", F.least(F.lit(1.0), value * (boost if boost is not None else F.lit(1.0))))
    return out.drop("__lo", "__q1", "__q3", "__hi")


def iconic(drafts: DataFrame, signatures: DataFrame) -> DataFrame:
    """The most similar of the signatures (name, h) to each draft's hash h, of equals the last name: (draft_id, icon, similarity). Signatures are a list by hand, `SIGNATURES` at most, else an error; they go along as one array, so no pairs are made."""
    from tidemark.functions.hashing import hamming_bits

    listed = signatures.where("h is not null").select("name", "h").limit(SIGNATURES + 1).collect()
    if len(listed) > SIGNATURES:
        raise ValueError(f"more than {SIGNATURES} signatures")
    schema = "array<struct<name:string,h:bigint>>"
    known = F.lit(None).cast(schema) if not listed else F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["h"]).cast("bigint").alias("h")) for r in listed])
    best = F.array_max(F.transform(known, lambda s: F.struct((1 - hamming_bits(F.col("h"), s["h"]) / 64).alias("similarity"), s["name"].alias("name"))))
    return drafts.where("h is not null").withColumn("__best", best).where("__best is not null").select("draft_id", F.col("__best.name").alias("icon"), F.col("__best.similarity").alias("similarity"))


def distance_km(lat: Column, lon: Column, home_lat: Column, home_lon: Column) -> Column:
    return haversine_m(lat, lon, home_lat, home_lon) / 1000
