"""Curation of members and the feed."""

from pyspark.sql import functions as F

from tidemark.catalog.base import ELIGIBLE, ITEMS, items, query
from tidemark.catalog.consolidation import AS_OF, _SCORES, _scored
from tidemark.functions.hashing import hex_bits
from tidemark.operators import curate, feed
from tidemark.operators.scans import eligible


def _candidates(spark, d):
    rows = eligible(items(spark, d))
    return rows.select(
        F.col("user_id").alias("draft_id"), "item_id", "t", F.col("day").cast("string").alias("day"), "lat", "lon", hex_bits(F.col("phash")).alias("hash"), F.col("quality").alias("score"), F.when(F.col("is_video"), "video").otherwise(F.col("device")).alias("scene"),
        (F.col("height") > F.col("width")).alias("upright"), "persons", "burst_uuid",
    )


@query()
def member_selection(spark, d):
    best = curate.collapse_bursts(_candidates(spark, d), ["draft_id"])
    return curate.curate(best, curate.policy("trip"))


@query(f"WITH {ELIGIBLE} SELECT user_id, item_id FROM eligible WHERE burst_uuid IS NULL OR item_id IN (SELECT item_id FROM eligible WHERE burst_uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, burst_uuid ORDER BY quality DESC, t, item_id) = 1)")
def burst_collapse(spark, d):
    return curate.collapse_bursts(_candidates(spark, d), ["draft_id"]).select(F.col("draft_id").alias("user_id"), "item_id")


@query(
    f"""WITH {ITEMS}, s AS (SELECT user_id AS draft_id, item_id, round(0.4 * coalesce(quality, 0) + 0.2 * least(1.0, width * height / 12000000.0::DOUBLE) + 0.15 * CASE WHEN width >= height THEN 1.0 ELSE 0.6 END + 0.15 + 0.1 * CASE WHEN lat IS NOT NULL THEN 1 ELSE 0 END - 0.1 * (count(*) OVER (PARTITION BY user_id, phash) - 1), 9) AS v FROM items)
    SELECT draft_id, item_id AS cover, round(v, 6) AS cover_score FROM s QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY v DESC, item_id) = 1"""
)
def cover_pick(spark, d):
    return curate.covers(items(spark, d).withColumn("draft_id", F.col("user_id"))).select("draft_id", "cover", F.round("cover_score", 6).alias("cover_score"))


@query(
    f"""WITH {ITEMS} SELECT a.item_id, abs(a.t - b.t) AS time_gap, round(1 - bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) / 64, 6) AS hash_likeness, round(len(list_intersect(a.persons, b.persons)) / len(list_distinct(list_concat(a.persons, b.persons))), 6) AS people, a.device = b.device AS same_device
    FROM items a JOIN items b ON b.item_id = a.item_id + 1"""
)
def pair_similarity(spark, d):
    rows = items(spark, d).withColumn("hash", hex_bits(F.col("phash")))
    pairs = rows.alias("a").join(rows.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    s = curate.similarity("a", "b")
    return pairs.select(F.col("a.item_id").alias("item_id"), s["time_gap"].alias("time_gap"), F.round(s["hash_likeness"], 6).alias("hash_likeness"), F.round(s["people"], 6).alias("people"), s["same_device"].alias("same_device"))


@query(f"WITH {ITEMS} SELECT item_id, CASE WHEN coalesce(is_panorama, FALSE) THEN 'panorama' WHEN len(persons) >= 3 THEN 'group' WHEN tag = 'tag2' THEN 'landmark' WHEN hour(ts) >= 21 OR hour(ts) < 5 THEN 'night' WHEN iso >= 1600 THEN 'indoor' ELSE 'outdoor' END AS scene FROM items")
def scene_buckets(spark, d):
    tags = F.array(F.when(F.col("tag") == "tag2", "Landmark").otherwise(F.col("tag")))
    return items(spark, d).select("item_id", curate.scene_bucket(F.col("is_panorama"), F.size("persons"), tags, F.hour("ts"), F.col("iso") >= 1600).alias("scene"))


def _feed(spark, d):
    made = _scored(spark, d).withColumns({"algorithm": F.col("device"), "place": F.when(F.dayofmonth("day") % 3 != 0, F.col("device")), "mentions": F.lit(0), "coverage": F.lit(0.0)})
    return made.withColumn("draft_id", F.concat_ws("|", "device", F.col("day").cast("string"))).withColumn("score", F.round("score", 6)).select("draft_id", "algorithm", "place", "day", "n", "t_to", "quality", "mentions", "coverage", "score")


@query(f"WITH {_SCORES}, f AS (SELECT device || '|' || day AS draft_id, round(score, 6) AS score, n, quality, floor(({AS_OF} - t_to) / 86400) AS age FROM scored) SELECT draft_id, score FROM f WHERE score + CASE WHEN age <= 30 THEN 0.03 WHEN age >= 365 THEN -0.05 ELSE 0 END >= 0.6 AND n >= 4 AND quality >= 0.05")
def feed_eligibility(spark, d):
    return feed.eligible(_feed(spark, d), AS_OF, feed.Profile(min_score=0.6, quality_floor=0.05)).select("draft_id", "score")


@query(f"WITH {_SCORES} SELECT device || '|' || day AS draft_id, round(round(score, 6) * CASE WHEN device = 'click' THEN 0.35 ELSE 1 END * CASE WHEN day(day) % 3 <> 0 AND device = 'signup' THEN 1.2 ELSE 1 END, 6) AS score FROM scored WHERE device <> 'error'")
def feed_preferences(spark, d):
    return feed.preferred(_feed(spark, d), ["signup"], ["error"], ["click"]).select("draft_id", F.round("score", 6).alias("score"))


@query()
def feed_build(spark, d):
    return feed.build(_feed(spark, d), feed.Profile(max_total=40, per_day=2, per_algorithm=10)).select("rank", "draft_id", "algorithm", "score")


@query(
    """SELECT o_orderkey AS draft_id, channel, lead_days, (CAST(o_orderdate AS DATE) - lead_days) + CAST(hm AS TIME) AS send_at FROM orders, (VALUES ('mail', '08:00:00', 7), ('mail', '08:00:00', 1), ('push', '18:30:00', 0)) c(channel, hm, lead_days)
    WHERE (CAST(o_orderdate AS DATE) - lead_days) + CAST(hm AS TIME) >= TIMESTAMP '2000-01-01'""",
    text="send_at",
)
def notification_plan(spark, d):
    from tidemark.sources.bindings import table

    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.to_date("o_orderdate").alias("target"))
    return feed.notifications(rows, {"mail": ("08:00:00", [7, 1]), "push": ("18:30:00", [0])}, "2000-01-01")
