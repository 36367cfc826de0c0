"""The feed: who sees which drafts, in what order, under which caps."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import Scratch


@dataclass(frozen=True)
class Profile:
    min_score: float = 0.35
    min_members: int = 4
    quality_floor: float = 0.3
    people_coverage: float = 0.2
    max_total: int = 70
    per_day: int = 6
    per_algorithm: int = 12
    per_place_day: int = 2
    per_algorithm_day: int = 2
    young_days: int = 30
    young_bonus: float = 0.03
    old_days: int = 365
    old_malus: float = 0.05


def visible(rows: DataFrame, persons: list[str] = (), days: list[str] = (), tags: list[str] = (), places: list[str] = (), pets: list[str] = ()) -> DataFrame:
    """Rows without hidden people, days, tags, places (column place) or pets (column pets, an array); a null hides nothing."""
    hidden = F.lit(False)
    if persons:
        hidden = hidden | F.coalesce(F.arrays_overlap("persons", F.array(*map(F.lit, persons))), F.lit(False))
    if days:
        hidden = hidden | F.coalesce(F.col("day").isin(*[F.lit(d).cast("date") for d in days]), F.lit(False))
    if tags:
        hidden = hidden | F.coalesce(F.col("tag").isin(*tags), F.lit(False))
    if places:
        hidden = hidden | F.coalesce(F.lower("place").isin(*[p.lower() for p in places]), F.lit(False))
    if pets:
        hidden = hidden | F.coalesce(F.arrays_overlap("pets", F.array(*map(F.lit, pets))), F.lit(False))
    return rows.where(~hidden)


def age_adjusted(score: Column, days: Column, p: Profile) -> Column:
    return score + F.when(days <= p.young_days, p.young_bonus).when(days >= p.old_days, -p.old_malus).otherwise(0.0)


def eligible(drafts: DataFrame, as_of: int, p: Profile) -> DataFrame:
    """Drafts good enough for the feed: score by age, members, quality and people where known."""
    age = F.floor((F.lit(as_of) - F.col("t_to")) / 86400)
    ok = (age_adjusted(F.col("score"), age, p) >= p.min_score) & (F.col("n") >= p.min_members)
    ok = ok & (F.col("quality").isNull() | (F.col("quality") >= p.quality_floor)) & ((F.coalesce("mentions", F.lit(0)) <= 0) | (F.coalesce("coverage", F.lit(0.0)) >= p.people_coverage))
    return drafts.where(ok)


def preferred(drafts: DataFrame, favourites: list[str] = (), blocked: list[str] = (), opted_out: list[str] = (), boost: float = 1.2, penalty: float = 0.35) -> DataFrame:
    """Removes blocked algorithms, weakens the opted-out, strengthens drafts of favourite places."""
    factor = F.when(F.col("algorithm").isin(*opted_out), penalty).otherwise(1.0) if opted_out else F.lit(1.0)
    if favourites:
        factor = factor * F.when(F.col("place").isin(*favourites), boost).otherwise(1.0)
    out = drafts.where(~F.col("algorithm").isin(*blocked)) if blocked else drafts
    return out.withColumn("score", F.col("score") * factor)


def build(drafts: DataFrame, p: Profile, look: int = 5) -> DataFrame:
    """The feed's drafts with their rank, best first, until max_total are found or no more fit.

    The caps on days, algorithms and places act on one another, so drafts are gone through in order on the driver,
    `look` times max_total at a time. Caps only fill up; the next block is the best of what the full ones still let in,
    so each begins with a draft that fits, and the driver holds one block.
    """
    spark = drafts.sparkSession
    known = Scratch(spark, "feed").table(drafts.where("day is not null"), "drafts")
    days, algorithms, places, both, out = Counter(), Counter(), Counter(), Counter(), []
    block = look * p.max_total
    while len(out) < p.max_total:
        full = [F.col("draft_id").eqNullSafe(r["draft_id"]) for r, _ in out]
        full += [F.col("day") == d for d, n in days.items() if n >= p.per_day]
        full += [F.col("algorithm").eqNullSafe(a) for a, n in algorithms.items() if n >= p.per_algorithm]
        full += [(F.col("day") == d) & F.col("algorithm").eqNullSafe(a) for (d, a), n in both.items() if n >= p.per_algorithm_day]
        full += [(F.col("day") == d) & F.col("place").eqNullSafe(place) for (d, place), n in places.items() if n >= p.per_place_day]
        left = known.where(~reduce(or_, full)) if full else known
        top = left.orderBy(F.desc("score"), "draft_id").limit(block).collect()
        for r in top:
            if len(out) >= p.max_total:
                break
            d, a, place = r["day"], r["algorithm"], r["place"]
            if days[d] >= p.per_day or algorithms[a] >= p.per_algorithm or both[d, a] >= p.per_algorithm_day or (place is not None and places[d, place] >= p.per_place_day):
                continue
            days[d] += 1
            algorithms[a] += 1
            both[d, a] += 1
            if place is not None:
                places[d, place] += 1
            out.append((r, len(out) + 1))
        if len(top) < block:
            break
    from pyspark.sql import types as T

    return spark.createDataFrame([(*r, rank) for r, rank in out], T.StructType([*known.schema.fields, T.StructField("rank", T.IntegerType())]))


def notifications(drafts: DataFrame, channels: dict[str, tuple[str, list[int]]], as_of: str) -> DataFrame:
    """(draft_id, channel, lead_days, send_at): each channel's send time, some days before the target day; past ones are left out. `channels` maps a name to its time and leads."""
    plan = [F.struct(F.lit(c).alias("channel"), F.lit(at).alias("at"), F.lit(lead).alias("lead_days")) for c, (at, leads) in channels.items() for lead in leads]
    rows = drafts.select("draft_id", "target", F.explode(F.array(*plan)).alias("p"))
    send = F.to_timestamp(F.concat_ws(" ", F.date_sub("target", F.col("p.lead_days")).cast("string"), F.col("p.at")))
    return rows.select("draft_id", "p.channel", "p.lead_days", send.alias("send_at")).where(F.col("send_at") >= F.lit(as_of).cast("timestamp"))
