"""Trip detection over days."""

from pyspark.sql import functions as F

from tidemark.catalog.base import ITEMS, haversine, items, query
from tidemark.operators import trips as T

#: All users live at one place, so that some are away.
_HOME = "47.9", "11.6"


def _home(spark, d):
    return items(spark, d).select("user_id").distinct().withColumns({"home_lat": F.lit(47.9), "home_lon": F.lit(11.6)})


_LEGS = f"l AS (SELECT *, {haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS m, t - lag(t) OVER w AS s FROM items WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY user_id, day ORDER BY t, item_id))"
_MOVES = f"""{_LEGS}, mv AS (SELECT user_id, day, coalesce(sum(m), 0) / 1000 AS travel_km, max(CASE WHEN s >= 300 AND m >= 10000 THEN m / s * 3.6 END) AS max_kmh FROM l GROUP BY ALL)"""
_DAYS = f"""{ITEMS}, {_MOVES}, k AS (SELECT *, {haversine("lat", "lon", *_HOME)} / 1000 AS km FROM items), g AS (SELECT user_id, day, count(*) AS n, max(km) AS max_km, avg(km) AS avg_km FROM k GROUP BY ALL),
 span AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM g GROUP BY user_id),
 d0 AS (SELECT span.user_id, span.day, coalesce(n, 0) AS n, max_km, avg_km, coalesce(travel_km, 0) AS travel_km, coalesce(max_kmh >= 100, FALSE) OR coalesce(travel_km, 0) > 150 AS fast, g.n IS NULL AS synthetic FROM span LEFT JOIN g USING (user_id, day) LEFT JOIN mv USING (user_id, day)),
 days AS (SELECT *, CASE WHEN stddev_pop(n) OVER u > 0 THEN (n - avg(n) OVER u) / stddev_pop(n) OVER u ELSE 0 END AS z FROM d0 WINDOW u AS (PARTITION BY user_id))"""


def _days(spark, d):
    return T.day_summaries(items(spark, d), ["user_id"], _home(spark, d))


@query(f"WITH {_DAYS} SELECT user_id, day, n, round(max_km, 4) AS max_km, round(avg_km, 4) AS avg_km, round(travel_km, 4) AS travel_km, fast, synthetic, round(z, 6) AS z FROM days", text="day")
def day_summaries(spark, d):
    return _days(spark, d).select("user_id", "day", "n", *[F.round(c, 4).alias(c) for c in ("max_km", "avg_km", "travel_km")], "fast", "synthetic", F.round("z", 6).alias("z"))


_AWAY = f"""{_DAYS}, f AS (SELECT *, coalesce(avg_km >= 60, FALSE) AS far FROM days), c AS (SELECT *, far OR (coalesce(lag(far) OVER w, FALSE) AND coalesce(lead(far) OVER w, FALSE)) AS closed FROM f WINDOW w AS (PARTITION BY user_id ORDER BY day)),
 a AS (SELECT *, CASE WHEN synthetic THEN closed OR coalesce(last_value(CASE WHEN NOT synthetic THEN closed END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) OR coalesce(lead(CASE WHEN NOT synthetic THEN closed END) OVER (PARTITION BY user_id ORDER BY day), FALSE) ELSE closed END AS away FROM c)"""


@query(f"WITH {_AWAY} SELECT user_id, day, away FROM a", text="day")
def away_days(spark, d):
    return T.away_days(_days(spark, d), ["user_id"], 60.0).select("user_id", "day", "away")


_RUNS = f"""{_AWAY}, n1 AS (SELECT *, away OR (fast AND (coalesce(lag(away) OVER w, FALSE) OR coalesce(lead(away) OVER w, FALSE))) AS inn FROM a WINDOW w AS (PARTITION BY user_id ORDER BY day)),
 n2 AS (SELECT *, CASE WHEN inn AND NOT coalesce(lag(inn) OVER (PARTITION BY user_id ORDER BY day), FALSE) THEN 1 ELSE 0 END AS new FROM n1), n3 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM n2),
 runs AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS days FROM n3 WHERE inn)"""


def _runs(spark, d):
    return T.runs(T.away_days(_days(spark, d), ["user_id"], 60.0), ["user_id"], 2)


@query(f"WITH {_RUNS} SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS days FROM runs WHERE days >= 2 GROUP BY user_id, run", text="first last")
def away_runs(spark, d):
    return _runs(spark, d).groupBy("user_id", "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).select("user_id", "first", "last", "days")


@query(
    f"""WITH {_RUNS}, sc0 AS (SELECT *, round(least(1.0, n / 20) + greatest(0.0, coalesce(z, 0)) * 0.2 - CASE WHEN fast THEN 0.3 ELSE 0 END, 9) AS sc FROM runs WHERE days >= 2)
    SELECT user_id, day, row_number() OVER (PARTITION BY user_id, run ORDER BY sc DESC, day) <= greatest(1, CAST(round(days * 0.65) AS INTEGER)) AS core FROM sc0""",
    text="day",
)
def core_days(spark, d):
    return T.core_days(_runs(spark, d), ["user_id"]).select("user_id", "day", "core")


@query(
    f"""WITH {_RUNS}, tg AS (SELECT user_id, run, min(day) AS first, max(day) AS last, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, max(max_km) AS max_km, avg(avg_km) AS avg_km, avg(CASE WHEN fast THEN 1.0 ELSE 0.0 END) AS transit, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS covered, max(z) AS z, avg(CASE WHEN isodow(day) >= 6 THEN 1.0 ELSE 0.0 END) AS weekend FROM runs WHERE days >= 2 GROUP BY user_id, run),
    s AS (SELECT *, greatest(0.0, 10 * (0.28 * least(1.0, days / 7) + 0.18 * coalesce(1 - exp(-max_km / 400), 0) + 0.16 * least(1.0, n / 60) + 0.14 * covered + 0.1 * greatest(0.0, least(1.0, z / 3)) + 0.08 * weekend + 0.06 * coalesce(greatest(0.0, least(1.0, avg_km / 200)), 0) - 0.1 * transit)) AS score,
     CASE WHEN days <= 1 THEN 'day_trip' WHEN last - first <= 2 AND days <= 3 THEN 'short_trip' ELSE 'vacation' END AS class FROM tg)
    SELECT user_id, first, last, n, round(score, 6) AS score, class, score >= CASE WHEN weekend = 1 THEN least(5.0, CASE class WHEN 'day_trip' THEN 4.0 WHEN 'short_trip' THEN 5.5 ELSE 7.0 END) ELSE CASE class WHEN 'day_trip' THEN 4.0 WHEN 'short_trip' THEN 5.5 ELSE 7.0 END END AS passes,
     'trip.' || class || CASE WHEN transit >= 0.45 THEN '.transit' ELSE '' END AS storyline FROM s""",
    text="first last",
)
def vacation(spark, d):
    return T.trips(_runs(spark, d), ["user_id"]).select("user_id", "first", "last", "n", F.round("score", 6).alias("score"), "class", "passes", "storyline")


@query(f"WITH {_AWAY}, lim AS (SELECT user_id, min(day) AS x, max(day) AS y FROM a WHERE away GROUP BY user_id) SELECT a.user_id, day, coalesce(day BETWEEN x AND y, FALSE) AS filled FROM a LEFT JOIN lim USING (user_id)", text="day")
def filled_between(spark, d):
    return T.filled_between(T.away_days(_days(spark, d), ["user_id"], 60.0), ["user_id"], "away").select("user_id", "day", "filled")


@query(f"WITH {ITEMS}, p AS (SELECT DISTINCT device, day, unnest(persons) AS p FROM items), s AS (SELECT device, day, count(*) AS c FROM p WHERE p IN ('u1', 'u5', 'u9', 'u20') GROUP BY ALL) SELECT x.device, x.day, coalesce(c, 0) / 4 AS presence FROM (SELECT DISTINCT device, day FROM items) x LEFT JOIN s USING (device, day)", text="day")
def cohort_presence(spark, d):
    return T.cohort_presence(items(spark, d), ["device"], ["u1", "u5", "u9", "u20"]).select("device", "day", "presence")


@query(f"WITH {ITEMS}, {_MOVES} SELECT user_id, day, round(travel_km, 4) AS travel_km, round(max_kmh, 4) AS max_kmh, coalesce(max_kmh >= 100, FALSE) OR travel_km > 150 AS fast FROM mv", text="day")
def transport_speed(spark, d):
    return T.transport(items(spark, d), ["user_id", "day"]).select("user_id", "day", F.round("travel_km", 4).alias("travel_km"), F.round("max_kmh", 4).alias("max_kmh"), "fast")


_CENTERS = "centers AS (SELECT DISTINCT user_id, c.id AS center_id, c.lat AS c_lat, c.lon AS c_lon, c.r AS radius_km, c.a AS va, c.b AS vb FROM items, (VALUES (1, 48.0::DOUBLE, 11.0::DOUBLE, 60.0::DOUBLE, NULL, 1705000000), (2, 50.5::DOUBLE, 13.0::DOUBLE, 80.0::DOUBLE, 1704500000, NULL)) c(id, lat, lon, r, a, b))"


@query(
    f"""WITH {ITEMS}, {_CENTERS}, j AS (SELECT user_id, item_id, center_id, radius_km, {haversine("lat", "lon", "c_lat", "c_lon")} / 1000 AS km FROM items JOIN centers USING (user_id) WHERE (va IS NULL OR t >= va) AND (vb IS NULL OR t <= vb) AND lat IS NOT NULL)
    SELECT user_id, item_id, center_id, round(km, 4) AS center_km, km > radius_km AS away FROM j QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY km, center_id) = 1"""
)
def home_centers(spark, d):
    made = spark.createDataFrame([(1, 48.0, 11.0, 60.0, None, 1705000000), (2, 50.5, 13.0, 80.0, 1704500000, None)], "center_id int, lat double, lon double, radius_km double, valid_from bigint, valid_until bigint")
    centers = items(spark, d).select("user_id").distinct().join(F.broadcast(made), F.lit(True))
    return T.nearest_center(items(spark, d).where("lat is not null"), centers, ["user_id"]).select("user_id", "item_id", "center_id", F.round("center_km", 4).alias("center_km"), "away")
