"""Grouping strategies. Yearly ones read orders, by customer; the others events, by user."""

from pyspark.sql import functions as F

from tidemark.catalog.base import DIGEST, ELIGIBLE, ITEMS, digest, haversine, items, query
from tidemark.catalog.features import _EASTER, HOLIDAY_SQL, SEASON_SQL
from tidemark.catalog.sessions import HEAD, SHOW, runs_sql
from tidemark.functions.calendar import seconds
from tidemark.operators import strategies as S
from tidemark.operators.scans import eligible
from tidemark.sources.bindings import table

OWNER = ["user_id"]
#: Orders as items of their customers' market segments.
BOUGHT = """bought AS (SELECT o_orderkey AS item_id, o_orderdate AS ts, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t, CAST(o_orderdate AS DATE) AS day, c_mktsegment AS segment, c_nationkey AS nation,
  48 + (o_orderkey % 7) * 0.5::DOUBLE AS lat, 11 + (o_orderkey % 5) * 0.7::DOUBLE AS lon, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 12 = 0 END AS is_panorama, CAST(o_orderkey % 4 * 1000 + 500 AS INTEGER) AS width, 1000 AS height
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def bought(spark, d):
    o = F.col("o_orderkey")
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        o.alias("item_id"), F.col("o_orderdate").alias("ts"), seconds(F.col("o_orderdate")).alias("t"), F.to_date("o_orderdate").alias("day"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        (48 + (o % 7) * 0.5).alias("lat"), (11 + (o % 5) * 0.7).alias("lon"), F.when(o % 6 == 0, o % 12 == 0).alias("is_panorama"), (o % 4 * 1000 + 500).cast("int").alias("width"), F.lit(1000).alias("height"),
    )


def homes(spark, d):
    u = F.col("user_id")
    return items(spark, d).select("user_id").distinct().select("user_id", (48 + (u % 7) * 0.5).alias("home_lat"), (11 + (u % 5) * 0.7).alias("home_lon"))


def close_sql(rows: str, key: str, metres: float, name: str = "close") -> str:
    """Rows of the groups that stay near their mean."""
    return f"""{name}_m AS (SELECT *, avg(lat) OVER (PARTITION BY {key}) AS mlat, avg(lon) OVER (PARTITION BY {key}) AS mlon FROM {rows}),
 {name}_f AS (SELECT *, max(CASE WHEN {haversine("lat", "lon", "mlat", "mlon")} > {metres} THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS far FROM {name}_m),
 {name} AS (SELECT * FROM {name}_f WHERE far = 0)"""


def rounded(df, *more):
    return df.select(*SHOW, *more)


@query(f"WITH {ELIGIBLE}, {runs_sql('eligible', 't - lag(t) OVER w > 43200')}, {close_sql('runs', 'user_id, run', 300)} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM close GROUP BY user_id, run HAVING count(*) >= 2")
def cross_dimension(spark, d):
    return rounded(S.cross_dimension(eligible(items(spark, d)), OWNER, 43200, 300, 2))


_NO_BURST = "(SELECT * FROM eligible WHERE burst_uuid IS NULL)"
_FAR = f"t - lag(t) OVER w > 7200 OR coalesce({haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} > 900, FALSE)"


@query(
    f"""WITH {ELIGIBLE}, {runs_sql(_NO_BURST, _FAR)}, grouped AS (SELECT user_id, 'b' AS kind, burst_uuid AS k, t, item_id FROM eligible WHERE burst_uuid IS NOT NULL UNION ALL SELECT user_id, 'r', CAST(run AS VARCHAR), t, item_id FROM runs)
    SELECT user_id, {HEAD}, {DIGEST} AS digest FROM grouped GROUP BY user_id, kind, k HAVING count(*) >= 2"""
)
def bursts(spark, d):
    return rounded(S.bursts(eligible(items(spark, d)), OWNER, 7200, 900, 2))


_LOCAL = "(SELECT *, hour(ts + offset_min * INTERVAL 1 MINUTE) AS h FROM eligible)"


@query(f"WITH {ELIGIBLE}, {runs_sql(f'(SELECT * FROM {_LOCAL} WHERE h IN (6, 7, 18, 19))', 't - lag(t) OVER w > 86400')} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM runs GROUP BY user_id, run HAVING count(*) >= 2")
def golden_hours(spark, d):
    return rounded(S.golden_hours(eligible(items(spark, d)), OWNER, gap=86400, least=2))


@query(f"WITH {ELIGIBLE}, {runs_sql(f'(SELECT * FROM {_LOCAL} WHERE h >= 20 OR h <= 4)', 't - lag(t) OVER w > 30000')}, {close_sql('runs', 'user_id, run', 400)} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM close GROUP BY user_id, run HAVING count(*) >= 2")
def nightlife(spark, d):
    return rounded(S.nightlife(eligible(items(spark, d)), OWNER, 30000, 400, 2))


_PANO = "(SELECT * FROM eligible WHERE coalesce(is_panorama, width / height >= 2.3))"


@query(f"WITH {ELIGIBLE}, {runs_sql(_PANO, 't - lag(t) OVER w > 172800')} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM runs GROUP BY user_id, run HAVING count(*) >= 2")
def panoramas(spark, d):
    return rounded(S.panoramas(eligible(items(spark, d)), OWNER, 172800, 2))


@query(f"WITH {ELIGIBLE}, {runs_sql('(SELECT * FROM eligible WHERE height / width >= 1.2 AND len(persons) > 0)', 't - lag(t) OVER w > 172800')} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM runs GROUP BY user_id, run HAVING count(*) >= 2")
def portraits(spark, d):
    return rounded(S.portraits(eligible(items(spark, d)), OWNER, 172800, 2))


@query(
    f"""WITH {ELIGIBLE}, l AS (SELECT *, CAST(ts + offset_min * INTERVAL 1 MINUTE AS DATE) AS lday, printf('%.4f,%.4f', floor(lat / 0.01) * 0.01, floor(lon / 0.01) * 0.01) AS cell FROM eligible)
    SELECT user_id, lday AS day, {HEAD}, {DIGEST} AS digest FROM l GROUP BY user_id, lday HAVING count(*) >= 3 AND (max(len(persons)) > 1 OR count(DISTINCT CASE WHEN lat IS NOT NULL THEN cell END) >= 2 OR avg(quality) >= 0.6)""",
    text="day",
)
def day_albums(spark, d):
    return S.day_albums(eligible(items(spark, d)), OWNER, 3).select("day", *SHOW)


@query(f"WITH {ELIGIBLE} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM eligible WHERE is_video GROUP BY user_id, day HAVING count(*) >= 2")
def video_stories(spark, d):
    return rounded(S.video_stories(eligible(items(spark, d)), OWNER))


@query(f"WITH {ITEMS} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM items GROUP BY user_id, device, day, CASE WHEN lat IS NULL THEN 'unknown' ELSE printf('%.4f,%.4f', floor(lat), floor(lon)) END HAVING count(*) >= 2")
def device_groups(spark, d):
    return rounded(S.device_groups(items(spark, d), OWNER, 2))


@query(f"WITH {ELIGIBLE} SELECT user_id, {HEAD}, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, {DIGEST} AS digest FROM eligible WHERE lat IS NOT NULL GROUP BY user_id, floor(lat / 0.002), floor(lon / 0.002) HAVING count(*) >= 4 AND count(DISTINCT day) >= 3")
def significant_places(spark, d):
    return S.significant_places(eligible(items(spark, d)), OWNER, 0.002, 4).select(*SHOW, F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    f"""WITH {ELIGIBLE}, c AS (SELECT *, floor(lat / 0.01) AS x, floor(lon / 0.01) AS y FROM eligible WHERE lat IS NOT NULL),
    g AS (SELECT user_id, x, y, day, count(*) AS c FROM c GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id, x, y ORDER BY day) AS INTEGER) AS run FROM g),
    s AS (SELECT user_id, x, y, run, min(day) AS first FROM r GROUP BY ALL HAVING max(day) - min(day) BETWEEN 0 AND 3 AND sum(c) >= 4), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, x, y ORDER BY first) = 1)
    SELECT c.user_id, {HEAD}, {DIGEST} AS digest FROM c JOIN r USING (user_id, x, y, day) JOIN b USING (user_id, x, y, run) GROUP BY c.user_id, x, y"""
)
def first_visits(spark, d):
    return rounded(S.first_visits(eligible(items(spark, d)), OWNER, per_day=2, least=4))


SEGMENT = "SELECT segment, {key} count(*) AS n, min(t) AS t_from, max(t) AS t_to, {digest} AS digest FROM {rows} GROUP BY segment{group} HAVING {having}"


def _yearly(rows: str, having: str, key: str = "", group: str = "") -> str:
    return f"WITH {BOUGHT} " + SEGMENT.format(rows=rows, having=having, key=key, group=group, digest=DIGEST)


YEARLY = ["segment", "n", "t_from", "t_to", "digest"]


@query(_yearly("bought", "count(*) >= 110 AND count(DISTINCT month(day)) >= 4", "CAST(year(day) AS INTEGER) AS year,", ", year(day)"))
def year_in_review(spark, d):
    return S.per_year(bought(spark, d), ["segment"], 110, 4).select("year", *YEARLY)


@query(_yearly("(SELECT * FROM bought WHERE month(day) = 6)", "count(DISTINCT year(day)) >= 3 AND count(*) >= 20 AND count(DISTINCT day) >= 6"))
def this_month_over_years(spark, d):
    return S.this_month(bought(spark, d), ["segment"], "2001-06-15").select(*YEARLY)


@query(_yearly("(SELECT * FROM bought WHERE abs(make_date(2001, CAST(month(day) AS INTEGER), 1) + CAST(day(day) AS INTEGER) - 1 - DATE '2001-06-15') <= 2)", "count(DISTINCT year(day)) >= 3 AND count(*) >= 10"))
def on_this_day(spark, d):
    return S.on_this_day(bought(spark, d), ["segment"], "2001-06-15", 2).select(*YEARLY)


@query(_yearly("(SELECT * FROM bought WHERE day BETWEEN DATE '2000-06-12' AND DATE '2000-06-18')", "count(*) >= 2"))
def one_year_ago(spark, d):
    return S.one_year_ago(bought(spark, d), ["segment"], "2001-06-15", 3, 2).select(*YEARLY)


@query(
    f"""WITH {BOUGHT}, p AS (SELECT segment, strftime(day, '%m-%d') AS month_day, year(day) AS y, count(*) AS c FROM bought GROUP BY ALL),
    g AS (SELECT segment, month_day, CAST(sum(c) AS BIGINT) AS n, count(*) AS years, max(c) AS best, max(y) - min(y) AS span FROM p GROUP BY ALL HAVING sum(c) >= 5 AND count(*) >= 3)
    SELECT segment, month_day, n, years, round(5 * n + 10 * years + 3 * n / years + 2 * span + best, 6) AS score FROM g ORDER BY 5 * n + 10 * years + 3 * n / years + 2 * span + best DESC, segment, month_day LIMIT 30"""
)
def anniversaries(spark, d):
    return S.anniversaries(bought(spark, d), ["segment"], years=3).select("segment", "month_day", "n", "years", F.round("score", 6).alias("score"))


@query(f"WITH {BOUGHT}, y AS (SELECT *, CAST(year(day) AS BIGINT) AS y FROM bought), m AS (SELECT *, day - {_EASTER} AS after, strftime(day, '%m-%d') AS md FROM y), h AS (SELECT *, {HOLIDAY_SQL} AS holiday FROM m) SELECT holiday, segment, {HEAD}, {DIGEST} AS digest FROM h WHERE holiday IS NOT NULL GROUP BY segment, day, holiday HAVING count(*) >= 2")
def holiday_events(spark, d):
    return S.holidays(bought(spark, d), ["segment"], 2).select("holiday", *YEARLY)


@query(_yearly("(SELECT * FROM bought WHERE (month(day) = 12 AND day(day) = 31 AND hour(ts) >= 20) OR (month(day) = 1 AND day(day) = 1 AND hour(ts) <= 2))", "count(*) >= 1", "CAST(year(ts + INTERVAL 6 HOUR) AS INTEGER) AS year,", ", year(ts + INTERVAL 6 HOUR)"))
def new_years_eve(spark, d):
    return S.new_years_eve(bought(spark, d), ["segment"], 1).select("year", *YEARLY)


_SEASONS = f"(SELECT *, {SEASON_SQL.format('day')} AS season, CAST(year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END AS INTEGER) AS season_year FROM bought)"


@query(_yearly(_SEASONS, "count(*) >= 18", "season, season_year,", ", season, season_year"))
def seasons(spark, d):
    return S.seasons(bought(spark, d), ["segment"]).select("season", "season_year", *YEARLY)


@query(_yearly(_SEASONS, "count(*) >= 26 AND count(DISTINCT year(day)) >= 3", "season,", ", season"))
def seasons_over_years(spark, d):
    return S.seasons_over_years(bought(spark, d), ["segment"]).select("season", *YEARLY)


@query(_yearly("(SELECT * FROM bought WHERE coalesce(is_panorama, width / height >= 2.3) QUALIFY count(*) OVER (PARTITION BY segment, year(day)) >= 2)", "count(DISTINCT year(day)) >= 3 AND count(*) >= 10"))
def panoramas_over_years(spark, d):
    return S.panoramas_over_years(bought(spark, d), ["segment"]).select(*YEARLY)


@query(
    f"""WITH {ELIGIBLE}, p AS (SELECT *, array_to_string(list_sort(list_distinct(persons)), ',') AS people FROM eligible WHERE len(list_distinct(persons)) >= 2), d AS (SELECT DISTINCT people, day FROM p),
    b AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY people ORDER BY day) > 4 THEN 1 ELSE 0 END AS brk FROM d), r AS (SELECT people, day, sum(brk) OVER (PARTITION BY people ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT people, {HEAD}, {DIGEST} AS digest FROM p JOIN r USING (people, day) GROUP BY people, run HAVING count(*) >= 4"""
)
def person_cohorts(spark, d):
    return S.cohorts(eligible(items(spark, d)), 4, 4).select("people", "n", "t_from", "t_to", "digest")


def _home_sql(days: str) -> str:
    return f"""WITH {ELIGIBLE}, h AS (SELECT *, coalesce({haversine("lat", "lon", "48 + (user_id % 7) * 0.5::DOUBLE", "11 + (user_id % 5) * 0.7::DOUBLE")} <= 500, FALSE) AS near FROM eligible WHERE isodow(day) IN ({days})),
    g AS (SELECT user_id, day FROM h GROUP BY ALL HAVING avg(CASE WHEN near THEN 1.0 ELSE 0.0 END) >= 0.5 AND count(*) >= 2), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM g)
    SELECT user_id, {HEAD}, {DIGEST} AS digest FROM h JOIN r USING (user_id, day) GROUP BY user_id, run HAVING count(*) >= 3"""


@query(_home_sql("6, 7"))
def at_home_weekends(spark, d):
    return rounded(S.at_home(eligible(items(spark, d)), OWNER, homes(spark, d), (6, 7), 0.5, 2, 3, algorithm="at_home_weekend"))


@query(_home_sql("1, 2, 3, 4, 5"))
def at_home_weekdays(spark, d):
    return rounded(S.at_home(eligible(items(spark, d)), OWNER, homes(spark, d), (1, 2, 3, 4, 5), 0.5, 2, 3, algorithm="at_home_weekday"))


_TRAVEL = "(SELECT item_id, t, day, segment, lat, lon FROM bought)"


@query(
    f"""WITH {BOUGHT}, l AS (SELECT *, {haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS m, t - lag(t) OVER w AS s FROM bought WINDOW w AS (PARTITION BY segment, day ORDER BY t, item_id))
    SELECT segment, {HEAD}, {DIGEST} AS digest, round(coalesce(sum(m), 0) / 1000, 3) AS km, coalesce(CAST(count_if(m / nullif(s, 0) * 3.6 >= 5) AS BIGINT), 0) AS fast FROM l GROUP BY segment, day HAVING count(*) >= 2 AND coalesce(sum(m), 0) / 1000 >= 50"""
)
def transit_days(spark, d):
    return S.transit_days(bought(spark, d), ["segment"], 2, 50.0, 5.0, fast_legs=0).select(*YEARLY, F.round("km", 3).alias("km"), "fast")


@query(
    f"""WITH {ELIGIBLE}, k AS (SELECT *, {haversine("lat", "lon", "47.5", "11.5")} / 1000 AS km FROM eligible WHERE lat IS NOT NULL),
    g AS (SELECT user_id, day, count(*) AS c FROM k GROUP BY ALL HAVING count(*) >= 2 AND median(km) BETWEEN 80 AND 400), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM g),
    s AS (SELECT user_id, run, min(day) AS first, sum(c) AS c FROM r GROUP BY ALL HAVING max(day) - min(day) BETWEEN 1 AND 3 AND max(CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END) = 1),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, year(first) ORDER BY c DESC, first) = 1)
    SELECT k.user_id, {HEAD}, {DIGEST} AS digest FROM k JOIN r USING (user_id, day) JOIN b USING (user_id, run) GROUP BY k.user_id HAVING count(*) >= 4"""
)
def weekend_getaways(spark, d):
    home = items(spark, d).select("user_id").distinct().withColumns({"home_lat": F.lit(47.5), "home_lon": F.lit(11.5)})
    return rounded(S.weekend_getaways(eligible(items(spark, d)), OWNER, home, (1, 3), 2, years=1, least=4))


@query(text="day")
def location_similarity(spark, d):
    return S.location_similarity(eligible(items(spark, d)), OWNER, least=2).select("user_id", "place", "day", "n", "digest")


@query(text="month day")
def monthly_highlights(spark, d):
    return S.monthly_highlights(eligible(items(spark, d)), OWNER).select("user_id", "month", "day", "n", "score", "digest")


@query(
    f"""WITH RECURSIVE {ELIGIBLE}, p AS (SELECT item_id, t, lat, lon, substr(phash, 1, 4) AS block, ('0x' || phash)::UBIGINT AS h FROM eligible),
    e AS (SELECT a.item_id AS a, b.item_id AS b FROM p a JOIN p b ON a.block = b.block AND a.item_id <> b.item_id AND bit_count(xor(a.h, b.h)) <= 5),
    c AS (SELECT a AS item_id, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.item_id), roots AS (SELECT item_id, min(root) AS root FROM c GROUP BY item_id)
    SELECT root AS component, {HEAD}, {DIGEST} AS digest FROM roots JOIN p USING (item_id) GROUP BY root"""
)
def phash_groups(spark, d):
    from tidemark.sources.scratch import Scratch

    return S.phash_groups(eligible(items(spark, d)), Scratch(spark, "phash")).select("component", "n", "t_from", "t_to", "digest")


@query(f"WITH {ELIGIBLE} SELECT 'video' AS algorithm, user_id, count(*) AS n, {DIGEST} AS digest FROM eligible WHERE is_video GROUP BY user_id, day HAVING count(*) >= 2 UNION ALL SELECT 'year', NULL, count(*), {DIGEST} FROM eligible GROUP BY year(day)")
def strategy_union(spark, d):
    base = eligible(items(spark, d))
    video = S.video_stories(base, OWNER).withColumn("algorithm", F.lit("video"))
    year = S.drafts(base.withColumn("year", F.year("day")), "year", ["year"])
    return S.union(video, year).select("algorithm", "user_id", "n", "digest")
