"""Labels, tags, stored rows, routes and roll-ups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.base import ELIGIBLE, ITEMS, haversine, items, query
from tidemark.catalog.features import HOLIDAY_SQL, _EASTER
from tidemark.functions.hashing import hex_bits
from tidemark.operators import enrich, score
from tidemark.operators.scans import eligible
from tidemark.sources.bindings import table
from tidemark.sources.sinks import cluster_rows


@query("SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand || ' X' || p_size) ELSE lower(p_brand || ' ' || p_type) END, lower(CASE WHEN p_partkey % 2 = 0 THEN 'Ann' END)) AS device FROM part")
def device_keys(spark, d):
    p = F.col("p_partkey")
    model = F.when(p % 3 == 0, F.concat("p_brand", F.lit(" X"), F.col("p_size").cast("string"))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", enrich.device_key(F.col("p_brand"), model, F.when(p % 2 == 0, F.lit(" Ann "))).alias("device"))


@query(
    f"""WITH {ITEMS}, s AS (SELECT item_id, 'people' AS label, CASE WHEN len(persons) > 1 THEN 0.9 END AS score FROM items UNION ALL SELECT item_id, 'bright', CASE WHEN brightness > 0.7 THEN round(brightness, 6) END FROM items UNION ALL SELECT item_id, 'video', CASE WHEN is_video THEN 0.8 END FROM items UNION ALL SELECT item_id, 'outdoor', CASE WHEN lat IS NOT NULL THEN 0.5 END FROM items)
    SELECT item_id, coalesce(string_agg(label, ',' ORDER BY score DESC, label), '') AS tags FROM (SELECT * FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label) <= 3) GROUP BY item_id"""
)
def scene_tags(spark, d):
    parts = {"people": F.when(F.size("persons") > 1, 0.9), "bright": F.when(F.col("brightness") > 0.7, F.round("brightness", 6)), "video": F.when(F.col("is_video"), 0.8), "outdoor": F.when(F.col("lat").isNotNull(), 0.5)}
    tagged = items(spark, d).select("item_id", enrich.scene_tags(parts, 3).alias("s")).where(F.size("s") > 0)
    return tagged.select("item_id", F.array_join(F.transform("s", lambda x: x["label"]), ",").alias("tags"))


_RAMP = "greatest(0.0, least(1.0, ({x} - {a}) / ({b} - {a})))"


def _ramp(x: str, a: str, b: str) -> str:
    return _RAMP.format(x=x, a=f"{a}::DOUBLE", b=f"{b}::DOUBLE")


@query(
    f"""WITH {ITEMS}, r AS (SELECT item_id, sharpness / 200 AS s, clipping AS c, contrast / 4 AS k FROM items) SELECT item_id, round((coalesce(CASE WHEN s IS NOT NULL THEN {_ramp('s', '0.0004', '0.004')} * 0.35 END, 0) + coalesce(CASE WHEN c IS NOT NULL THEN (1 - {_ramp('c', '0.02', '0.18')}) * 0.2 END, 0) + {_ramp('k', '0.05', '0.25')} * 0.2)
    / (CASE WHEN s IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE), 9) AS quality FROM r"""
)
def still_quality(spark, d):
    none = F.lit(None).cast("double")
    return items(spark, d).select("item_id", F.round(enrich.still_quality(F.col("sharpness") / 200, F.col("clipping"), F.col("contrast") / 4, none, none), 9).alias("quality"))


@query(f"SELECT s_suppkey, round(greatest(250.0, {haversine('lat', 'lon', 'lat - 0.002', 'lon')}, {haversine('lat', 'lon', 'lat + s_nationkey / 10000', 'lon')}, {haversine('lat', 'lon', 'lat', 'lon - 0.001')}, {haversine('lat', 'lon', 'lat', 'lon + 0.003')}), 4) AS radius_m FROM (SELECT s_suppkey, s_nationkey, 48 + s_suppkey / 1000::DOUBLE AS lat, 11 + s_suppkey / 2000::DOUBLE AS lon FROM supplier)")
def poi_radius(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (48 + F.col("s_suppkey") / 1000).alias("lat"), (11 + F.col("s_suppkey") / 2000).alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    return s.select("s_suppkey", F.round(enrich.poi_radius(lat, lon, lat - 0.002, lon - 0.001, lat + F.col("s_nationkey") / 10000, lon + 0.003), 4).alias("radius_m"))


@query(f"WITH {ITEMS}, s AS (SELECT n_name AS name, ('0x' || substr(md5(n_name), 1, 16))::UBIGINT AS g FROM nation) SELECT item_id AS draft_id, arg_max(name, struct_pack(x := 64 - CAST(bit_count(xor(('0x' || phash)::UBIGINT, g)) AS INTEGER), n := name)) AS icon, round(max(1 - bit_count(xor(('0x' || phash)::UBIGINT, g)) / 64), 6) AS similarity FROM items, s GROUP BY item_id")
def iconic_signatures(spark, d):
    made = items(spark, d).select(F.col("item_id").alias("draft_id"), hex_bits(F.col("phash")).alias("h"))
    signs = table(spark, d, "nation").select(F.col("n_name").alias("name"), hex_bits(F.substring(F.md5("n_name"), 1, 16)).alias("h"))
    return score.iconic(made, signs).select("draft_id", "icon", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {ELIGIBLE}, v AS (SELECT user_id, device, count(*) AS c, min(t) AS f FROM eligible GROUP BY ALL), g AS (SELECT user_id, min(t) AS t_from, max(t) AS t_to, count_if(NOT is_video) AS photos, count_if(is_video) AS videos, min(lat) AS south, max(lon) AS east FROM eligible GROUP BY user_id)
    SELECT user_id, t_from, t_to, CAST(photos AS BIGINT) AS photos, CAST(videos AS BIGINT) AS videos, south, east, device AS dominant FROM g JOIN (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f, device) = 1) USING (user_id)"""
)
def stored_rows(spark, d):
    return cluster_rows(eligible(items(spark, d)), ["user_id"]).select("user_id", "t_from", "t_to", "photos", "videos", "south", "east", "dominant")


@query(
    f"""WITH {ITEMS}, p AS (SELECT user_id, t, item_id, printf('%.1f,%.1f', floor(lat * 2) / 2, floor(lon)) AS place FROM items WHERE lat IS NOT NULL), c AS (SELECT *, lag(place) OVER (PARTITION BY user_id ORDER BY t, item_id) AS prev FROM p)
    SELECT user_id, string_agg(place, ' → ' ORDER BY t, item_id) AS route FROM c WHERE prev IS NULL OR prev <> place GROUP BY user_id"""
)
def routes(spark, d):
    """The places of each user in order, without stays. A user's changes of place are as many as the label shows."""
    w = Window.partitionBy("user_id").orderBy("t", "item_id")
    rows = items(spark, d).where("lat is not null").withColumn("place", F.format_string("%.1f,%.1f", F.floor(F.col("lat") * 2) / 2, F.floor("lon").cast("double")))
    moved = rows.withColumn("prev", F.lag("place").over(w)).where("prev is null or prev != place")
    stops = moved.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "item_id", "place"))).alias("s"))
    return stops.select("user_id", F.array_join(F.transform("s", lambda x: x["place"]), " → ").alias("route"))


@query(f"WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS b FROM orders), x AS (SELECT o_orderkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r), y AS (SELECT *, CAST(year(day) AS BIGINT) AS y FROM x), m AS (SELECT *, day - {_EASTER} AS after, strftime(day, '%m-%d') AS md FROM y) SELECT o_orderkey, max(CASE WHEN ({HOLIDAY_SQL}) IS NOT NULL THEN 1.0 WHEN isodow(day) >= 6 THEN 0.5 ELSE 0.0 END) AS holiday FROM m GROUP BY o_orderkey")
def holiday_scores(spark, d):
    from tidemark.functions.calendar import seconds

    rows = table(spark, d, "orders").withColumn("a", seconds(F.date_trunc("day", "o_orderdate")))
    return rows.select("o_orderkey", score.holiday(F.col("a"), F.col("a") + 86400 * (F.col("o_orderkey") % 9)).alias("holiday"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate), o_orderpriority)")
def calendar_rollup(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return rows.rollup("year", "month", "priority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {ITEMS}, g AS (SELECT CAST(floor(t / 21600) AS BIGINT) AS slot, device, count(*) AS n FROM items GROUP BY ALL) SELECT slot, device, n, sum(n) OVER (PARTITION BY device ORDER BY slot ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM g")
def slot_counts(spark, d):
    g = items(spark, d).groupBy(F.floor(F.col("t") / 21600).alias("slot"), "device").agg(F.count("*").alias("n"))
    return g.withColumn("so_far", F.sum("n").over(Window.partitionBy("device").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"WITH {ITEMS} SELECT item_id, CASE WHEN is_panorama THEN 1 END AS flag, round(48 + (item_id % 60) / 60.0::DOUBLE + (item_id % 7) / 3600.0::DOUBLE, 9) AS degrees FROM items")
def parsed_coordinates(spark, d):
    from tidemark.functions.strings import dms

    i = F.col("item_id")
    text = lambda n: F.concat(n.cast("string"), F.lit("/1"))
    return items(spark, d).select("item_id", F.when(F.col("is_panorama"), 1).alias("flag"), F.round(dms(F.lit("96/2"), text(i % 60), text(i % 7), F.lit("N")), 9).alias("degrees"))
