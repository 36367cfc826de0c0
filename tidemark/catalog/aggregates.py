"""Aggregates over groups of items, and window patterns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.base import DIGEST, ELIGIBLE, ITEMS, haversine, items, query
from tidemark.catalog.strategies import BOUGHT, bought
from tidemark.operators import aggregates as A
from tidemark.operators import trips
from tidemark.operators.scans import eligible

U = ["user_id"]


@query(f"WITH {ITEMS} SELECT user_id, device, min(t) AS t_from, max(t) AS t_to, count(*) >= 3 AND min(t) >= 631152000 AS reliable FROM items GROUP BY ALL")
def time_ranges(spark, d):
    return A.time_range(items(spark, d), ["user_id", "device"]).select("user_id", "device", "t_from", "t_to", "reliable")


@query(f"WITH {ITEMS}, c AS (SELECT *, avg(lat) OVER (PARTITION BY user_id) AS a, avg(lon) OVER (PARTITION BY user_id) AS b FROM items) SELECT user_id, round(any_value(a), 6) AS lat, round(any_value(b), 6) AS lon, round(max({haversine('lat', 'lon', 'a', 'b')}), 3) AS radius_m FROM c GROUP BY user_id")
def centroids(spark, d):
    return A.centroid(items(spark, d), U).select("user_id", F.round("lat_c", 6).alias("lat"), F.round("lon_c", 6).alias("lon"), F.round("radius_m", 3).alias("radius_m"))


@query(f"WITH {ITEMS}, g AS (SELECT user_id, tag, max(quality) AS score, count(*) AS n FROM items WHERE tag IS NOT NULL GROUP BY ALL) SELECT user_id, tag, score, n, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, n DESC, tag) AS rank FROM g QUALIFY rank <= 5")
def dominant_tags(spark, d):
    return A.top_labels(items(spark, d), U, "tag", "quality").select("user_id", "tag", "score", "n", "rank")


@query(f"WITH {ITEMS}, g AS (SELECT user_id, lower(device) AS word, count(*) AS n FROM items GROUP BY ALL) SELECT user_id, word, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, word) AS rank FROM g QUALIFY rank <= 3")
def keyword_ranks(spark, d):
    return A.keywords(items(spark, d), U, "device", 3)


@query(
    f"""WITH {ITEMS}, b AS (SELECT day, count(*) AS n, avg(CASE WHEN len(persons) > 0 THEN 1.0 ELSE 0.0 END) AS coverage, CAST(sum(len(persons)) AS BIGINT) AS mentions FROM items GROUP BY day), u AS (SELECT day, count(DISTINCT p) AS uniq FROM (SELECT day, unnest(persons) AS p FROM items) GROUP BY day)
    SELECT day, n, uniq AS "unique", mentions, round(0.4 * coverage + 0.35 * least(1.0, uniq / 4) + 0.25 * least(1.0, mentions / n), 6) AS people_score FROM b JOIN u USING (day)""",
    text="day",
)
def people_metrics(spark, d):
    return A.people(items(spark, d), ["day"]).select("day", "n", "unique", "mentions", F.round("people_score", 6).alias("people_score"))


@query(
    f"""WITH {ITEMS}, l AS (SELECT user_id, quantile_cont(CAST(quality AS DOUBLE), 0.1) AS a, quantile_cont(CAST(quality AS DOUBLE), 0.9) AS b FROM items GROUP BY user_id)
    SELECT user_id, round(avg(CASE WHEN b - a > 1e-9 THEN greatest(0.0, least(1.0, (quality - a) / (b - a))) ELSE quality END), 6) AS quality_avg FROM items JOIN l USING (user_id) GROUP BY user_id"""
)
def quality_aggregate(spark, d):
    return A.quality(items(spark, d), U, "quality").select("user_id", F.round("quality_avg", 6).alias("quality_avg"))


@query(f"WITH {ITEMS}, g AS (SELECT day, device, count(*) AS c, sum(count(*)) OVER (PARTITION BY day) AS total, count(*) OVER (PARTITION BY day) AS variants FROM items GROUP BY day, device) SELECT day, device AS main, round(c / total, 6) AS share, variants, CASE WHEN c / total >= 0.6 THEN device END AS stable FROM g QUALIFY row_number() OVER (PARTITION BY day ORDER BY c DESC, lower(device), device) = 1", text="day")
def device_summary(spark, d):
    return A.devices(items(spark, d), ["day"]).select("day", "main", F.round("share", 6).alias("share"), "variants", "stable")


@query(f"WITH {ITEMS}, g AS (SELECT user_id, device, count(*) AS n, min(t) AS f FROM items GROUP BY ALL) SELECT user_id, device, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, device) = 1")
def majority_device(spark, d):
    return A.majority(items(spark, d), U, "device", "t").select("user_id", "device", "n")


@query(f"WITH {ITEMS}, c AS (SELECT user_id, device, isodow(day) >= 6 AS w, CASE WHEN day = DATE '2024-01-01' THEN 'Neujahr' END AS h FROM items) SELECT user_id, device, CASE WHEN min(w) = max(w) THEN min(w) END AS weekend, CASE WHEN count(DISTINCT h) = 1 THEN max(h) END AS holiday FROM c GROUP BY ALL")
def calendar_summary(spark, d):
    from tidemark.functions.calendar import holiday, is_weekend

    known = items(spark, d).withColumns({"weekend": is_weekend(F.col("day")), "holiday": holiday(F.col("day"))})
    return A.calendar_summary(known, ["user_id", "device"])


@query(f"WITH {ITEMS} SELECT user_id, round(quantile_cont(CAST(value AS DOUBLE), 0.25), 6) AS q1, round(median(value), 6) AS med, round(quantile_cont(CAST(value AS DOUBLE), 0.75), 6) AS q3, quantile_disc(value, 0.95) AS p95 FROM items GROUP BY user_id")
def quantiles(spark, d):
    rows = items(spark, d)
    linear = rows.groupBy("user_id").agg(F.round(F.percentile("value", 0.25), 6).alias("q1"), F.round(F.median("value"), 6).alias("med"), F.round(F.percentile("value", 0.75), 6).alias("q3"))
    return linear.join(A.nearest_rank(rows, U, "value", 0.95).withColumnRenamed("value", "p95"), "user_id")


@query(f"WITH {ITEMS}, g AS (SELECT day, count(*) AS n FROM items GROUP BY day) SELECT day, n, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS z FROM g", text="day")
def density_z(spark, d):
    return A.zscores(items(spark, d).groupBy("day").agg(F.count("*").alias("n")), "n").select("day", "n", F.round("z", 6).alias("z"))


@query(f"WITH {ITEMS} SELECT user_id, count(DISTINCT day) AS days, count(DISTINCT device) AS devices, count(DISTINCT hour(ts)) AS hours FROM items GROUP BY user_id")
def distinct_counts(spark, d):
    return items(spark, d).groupBy("user_id").agg(F.count_distinct("day").alias("days"), F.count_distinct("device").alias("devices"), F.count_distinct(F.hour("ts")).alias("hours"))


@query(f"WITH {ITEMS}, f AS (SELECT 'device' AS kind, device AS value, count(*) AS c FROM items GROUP BY device UNION ALL SELECT 'hash', substr(phash, 1, 2), count(*) FROM items GROUP BY 2 UNION ALL SELECT 'day', CAST(dayofyear(day) AS VARCHAR), count(*) FROM items GROUP BY 2) SELECT kind, value, c, max(c) OVER (PARTITION BY kind) AS most FROM f")
def corpus_frequencies(spark, d):
    rows = items(spark, d)
    parts = {"device": F.col("device"), "hash": F.substring("phash", 1, 2), "day": F.dayofyear("day").cast("string")}
    made = [A.frequencies(rows, c).withColumn("kind", F.lit(k)) for k, c in parts.items()]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("kind", "value", "c", "most")


@query(f"WITH {BOUGHT} SELECT segment, nation, count(DISTINCT year(day)) AS years, count(DISTINCT year(day)) >= 2 AND max(year(day)) - min(year(day)) + 1 = count(DISTINCT year(day)) AS consecutive FROM bought GROUP BY ALL")
def series_highlights(spark, d):
    return A.series(bought(spark, d), ["segment", "nation"]).select("segment", "nation", "years", "consecutive")


@query(f"WITH {ITEMS}, g AS (SELECT day, device, count(*) AS n, min(t) AS first_seen, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM items GROUP BY ALL) SELECT day, device, n, first_seen, lat, lon, row_number() OVER (PARTITION BY day ORDER BY n DESC, first_seen, device) AS rank FROM g QUALIFY rank <= 3", text="day")
def travel_waypoints(spark, d):
    return A.waypoints(items(spark, d), ["day"], "device", 3).select("day", "device", "n", "first_seen", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "rank")


@query("SELECT l_orderkey AS draft_id, sha1(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS fingerprint FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def fingerprints(spark, d):
    from tidemark.functions.hashing import fingerprint
    from tidemark.sources.bindings import members_of_orders, table

    return members_of_orders(table(spark, d, "lineitem")).groupBy("draft_id").agg(fingerprint(F.collect_list("member")).alias("fingerprint"))


@query(
    f"""WITH {ITEMS}, n AS (SELECT *, printf('%.4f,%.4f', floor(lat / 0.01) * 0.01, floor(lon / 0.01) * 0.01) AS cell, CASE WHEN hour(ts + offset_min * INTERVAL 1 MINUTE) >= 22 OR hour(ts + offset_min * INTERVAL 1 MINUTE) < 6 THEN 1 ELSE 0 END AS night FROM items WHERE lat IS NOT NULL),
    g AS (SELECT user_id, cell, sum(night) AS nights, count(*) AS n, avg(lat) AS a, avg(lon) AS b FROM n GROUP BY ALL), top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY nights DESC, n DESC, cell) = 1)
    SELECT user_id, any_value(top.cell) AS cell, any_value(top.n) AS n, round(quantile_disc({haversine("lat", "lon", "a", "b")}, 0.95), 3) AS radius_m FROM n JOIN top USING (user_id, cell) GROUP BY user_id"""
)
def home_places(spark, d):
    return A.home_places(items(spark, d), U).select("user_id", "cell", "n", F.round("radius_m", 3).alias("radius_m"))


@query(f"WITH {ELIGIBLE} SELECT min(t) AS t_from, max(t) AS t_to, count(*) AS n, count(DISTINCT device) AS devices, count(DISTINCT user_id) AS people, {DIGEST} AS digest FROM eligible")
def scope_context(spark, d):
    from tidemark.functions.hashing import member_digest

    return eligible(items(spark, d)).agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.count("*").alias("n"), F.count_distinct("device").alias("devices"), F.count_distinct("user_id").alias("people"), member_digest(F.col("item_id")).alias("digest"))


# Window patterns ----------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT item_id, burst_uuid, row_number() OVER (PARTITION BY burst_uuid ORDER BY CASE WHEN burst_representative THEN 0 ELSE 1 END, burst_index, t, item_id) AS rank FROM items WHERE burst_uuid IS NOT NULL")
def burst_ranks(spark, d):
    w = Window.partitionBy("burst_uuid").orderBy(F.when(F.col("burst_representative"), 0).otherwise(1), "burst_index", "t", "item_id")
    return items(spark, d).where("burst_uuid is not null").select("item_id", "burst_uuid", F.row_number().over(w).alias("rank"))


@query(f"WITH {ITEMS} SELECT item_id, round(coalesce({haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0), 3) AS metres, t - lag(t) OVER w AS seconds FROM items WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY user_id, day ORDER BY t, item_id)")
def leg_metrics(spark, d):
    return trips.legs(items(spark, d).where("lat is not null"), ["user_id", "day"]).select("item_id", F.round(F.coalesce("metres", F.lit(0.0)), 3).alias("metres"), "seconds")


@query(f"WITH {ITEMS} SELECT item_id, row_number() OVER (PARTITION BY phash ORDER BY t, item_id) - 1 AS repeat FROM items")
def repeat_numbers(spark, d):
    return items(spark, d).select("item_id", (F.row_number().over(Window.partitionBy("phash").orderBy("t", "item_id")) - 1).alias("repeat"))


@query(f"WITH {ITEMS} SELECT user_id, day, arg_min(lat, struct_pack(t := t, i := item_id)) AS first_lat, arg_max(lat, struct_pack(t := t, i := item_id)) AS last_lat FROM items WHERE lat IS NOT NULL GROUP BY ALL", text="day")
def first_last_place(spark, d):
    order = F.struct("t", "item_id")
    return items(spark, d).where("lat is not null").groupBy("user_id", "day").agg(F.min_by("lat", order).alias("first_lat"), F.max_by("lat", order).alias("last_lat"))


@query(f"WITH {ITEMS} SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id, day ORDER BY t, item_id) AS rn, day FROM items) WHERE rn <= 3", text="day")
def round_robin_days(spark, d):
    from tidemark.operators.curate import interleave

    return interleave(items(spark, d).select("user_id", "item_id", "t", "day"), ["user_id", "day"], ["t", "item_id"], 3).select("user_id", "item_id", "rn", "day")
