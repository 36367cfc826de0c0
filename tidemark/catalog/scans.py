"""Scans, lookups, filters and paging."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.base import ELIGIBLE, ITEMS, items, query
from tidemark.operators import scans
from tidemark.sources.bindings import table


@query(f"WITH {ELIGIBLE} SELECT item_id, t, day FROM eligible WHERE lat IS NOT NULL", text="day")
def eligible_filter(spark, d):
    return scans.located(scans.timestamped(scans.eligible(items(spark, d)))).select("item_id", "t", "day")


@query(f"WITH {ITEMS} SELECT item_id, t FROM items WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, item_id LIMIT 500")
def ordered_scan(spark, d):
    return scans.ordered_scan(items(spark, d), "2024-01-05", "2024-01-20", 500).select("item_id", "t")


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE NOT no_show AND (burst_uuid IS NULL OR coalesce(burst_representative, FALSE)) AND is_video AND item_id IN (SELECT o_orderkey FROM orders)")
def point_lookup(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"))
    return scans.lookup(items(spark, d), ids, only_videos=True).select("item_id")


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE NOT no_show AND (item_id % 7 = 0 OR item_id % 3 < 2) ORDER BY item_id LIMIT 200")
def index_candidates(spark, d):
    known = items(spark, d).withColumns({"indexed_at": F.when(F.col("item_id") % 7 != 0, F.col("ts")), "feature_version": F.col("item_id") % 3})
    return scans.index_candidates(known, 2, 200).select("item_id")


@query(f"WITH {ELIGIBLE} SELECT item_id FROM eligible WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09' AND (burst_uuid IS NULL OR coalesce(burst_representative, FALSE)) ORDER BY ts, item_id LIMIT 300")
def good_candidates(spark, d):
    return scans.good_candidates(items(spark, d), "2024-01-03", "2024-01-09", 300).select("item_id")


@query(f"WITH {ITEMS} SELECT device AS algorithm, count(*) AS n FROM items WHERE device IN ('view', 'click') GROUP BY device")
def count_by_algorithm(spark, d):
    return items(spark, d).where(F.col("device").isin("view", "click")).groupBy(F.col("device").alias("algorithm")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT printf('%.4f,%.4f', floor(lat / 0.01) * 0.01, floor(lon / 0.01) * 0.01) AS cell, min(item_id) AS item_id FROM items WHERE lat IS NOT NULL GROUP BY 1")
def cell_index(spark, d):
    from tidemark.functions.geo import floor_cell

    return scans.located(items(spark, d)).groupBy(floor_cell(F.col("lat"), F.col("lon"), 0.01).alias("cell")).agg(F.min("item_id").alias("item_id"))


@query(f"WITH {ITEMS} SELECT user_id, device, item_id FROM items WHERE NOT no_show QUALIFY row_number() OVER (PARTITION BY user_id, device ORDER BY ts, item_id) <= 5")
def staypoint_candidates(spark, d):
    shown = items(spark, d).where(~F.col("no_show"))
    return scans.first_per_key(shown, ["user_id", "device"], ["ts", "item_id"], 5).select("user_id", "device", "item_id")


@query(f"WITH {ITEMS} SELECT item_id, user_id FROM items WHERE user_id IN (SELECT user_id FROM items GROUP BY user_id HAVING count(*) >= 70)")
def group_size_having(spark, d):
    return scans.having(items(spark, d), ["user_id"], 70).select("item_id", "user_id")


_FEED = """feed AS (SELECT o_custkey AS feed_id, list(o_orderkey ORDER BY o_orderkey) AS members, max(o_totalprice) AS score,
  CASE WHEN o_custkey % 5 <> 0 THEN CAST(min(floor(epoch(o_orderdate))) AS BIGINT) END AS t_from FROM orders GROUP BY o_custkey),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, feed_id) AS rank FROM feed)"""


def _feed(spark, d):
    from tidemark.functions.calendar import seconds

    # A page is cut from the feed, which is as long as the feed's limit: ranking it needs one task.
    made = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("feed_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("members"), F.max("o_totalprice").alias("score"), F.min(seconds(F.col("o_orderdate"))).alias("t_from"))
    made = made.withColumn("t_from", F.when(F.col("feed_id") % 5 != 0, F.col("t_from")))
    return made.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feed_id")))


@query(f"WITH {_FEED} SELECT feed_id, rank FROM ranked WHERE t_from IS NULL OR t_from < 850000000 ORDER BY rank LIMIT 24")
def feed_page_by_time(spark, d):
    return scans.page_after(_feed(spark, d), "time:850000000", 24).select("feed_id", "rank")


@query(f"WITH {_FEED} SELECT feed_id, rank FROM ranked WHERE rank > coalesce((SELECT min(rank) FROM ranked WHERE list_contains(members, 101)), 0) ORDER BY rank LIMIT 24")
def feed_page_by_member(spark, d):
    return scans.page_after(_feed(spark, d), "media:101", 24).select("feed_id", "rank")


@query(f"WITH {ELIGIBLE} SELECT item_id FROM eligible WHERE CASE WHEN is_panorama IS NOT NULL THEN is_panorama ELSE width / height >= 2.3 END")
def panorama_filter(spark, d):
    from tidemark.operators.strategies import is_panorama

    return scans.eligible(items(spark, d)).where(is_panorama()).select("item_id")


@query(f"WITH {ITEMS} SELECT item_id, day FROM items WHERE ts < TIMESTAMP '2024-01-11' AND ts + INTERVAL 6 HOUR >= TIMESTAMP '2024-01-10'", text="day")
def overlaps_day(spark, d):
    one = items(spark, d).withColumn("until", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return one.where((F.col("ts") < F.lit("2024-01-11").cast("timestamp")) & (F.col("until") >= F.lit("2024-01-10").cast("timestamp"))).select("item_id", "day")


@query(f"WITH {ITEMS} SELECT item_id, device FROM items WHERE NOT list_has_any(persons, ['u1', 'u2', 'u3']) AND day <> DATE '2024-01-06' AND NOT (tag = 'tag1')")
def feed_visibility(spark, d):
    from tidemark.operators.feed import visible

    return visible(items(spark, d), persons=["u1", "u2", "u3"], days=["2024-01-06"], tags=["tag1"]).select("item_id", "device")
