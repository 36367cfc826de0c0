"""Row-level features and scalar functions."""

from pyspark.sql import functions as F

from tidemark.catalog.base import ITEMS, haversine, items, query
from tidemark.functions import calendar as cal
from tidemark.functions import geo, hashing, scoring, strings
from tidemark.sources.bindings import table

_B32 = "0123456789bcdefghjkmnpqrstuvwxyz"
_HASH = """array_to_string(list_transform(range(0, {n}), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + CAST(list_sum(list_transform(range(0, 5), lambda k:
  CASE WHEN (5 * c + k) % 2 = 0 THEN ((CAST(floor((lon + 180) / 360 * {x}) AS BIGINT) >> CAST({xb} - 1 - (5 * c + k) // 2 AS BIGINT)) & 1) ELSE ((CAST(floor((lat + 90) / 180 * {y}) AS BIGINT) >> CAST({yb} - 1 - (5 * c + k) // 2 AS BIGINT)) & 1) END * (1 << (4 - k)))) AS INTEGER), 1)), '')"""


def _geohash_sql(n: int) -> str:
    xb, yb = (5 * n + 1) // 2, 5 * n // 2
    return _HASH.format(n=n, x=1 << xb, y=1 << yb, xb=xb, yb=yb)


@query(
    f"""WITH {ITEMS} SELECT item_id, printf('%.4f,%.4f', floor(lat / 0.01) * 0.01, floor(lon / 0.01) * 0.01) AS cell, round({haversine("lat", "lon", "49.0", "12.4")} / 1000, 4) AS home_km,
    {_geohash_sql(7)} AS geohash7, {_geohash_sql(5)} AS geohash5, CAST(floor((lat + 90) / 0.3) AS BIGINT) || ':' || CAST(floor((lon + 180) / 0.3) AS BIGINT) AS world_cell FROM items WHERE lat IS NOT NULL"""
)
def geo_features(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return items(spark, d).where("lat is not null").select(
        "item_id",
        geo.floor_cell(lat, lon, 0.01).alias("cell"),
        F.round(geo.haversine_m(lat, lon, 49.0, 12.4) / 1000, 4).alias("home_km"),
        geo.geohash(lat, lon, 7).alias("geohash7"),
        geo.geohash(lat, lon, 5).alias("geohash5"),
        geo.world_cell(lat, lon, 0.3).alias("world_cell"),
    )


@query(f"WITH {ITEMS} SELECT DISTINCT user_id, sha256(printf('%.8f|%.8f|%.8f|%s', 48 + (user_id % 7) * 0.5::DOUBLE, 11 + (user_id % 5) * 0.7::DOUBLE, 0.35::DOUBLE, 'v1')) AS home_hash FROM items")
def home_hash(spark, d):
    u = F.col("user_id")
    return items(spark, d).select("user_id").distinct().select("user_id", F.sha2(F.format_string("%.8f|%.8f|%.8f|%s", 48 + (u % 7) * 0.5, 11 + (u % 5) * 0.7, F.lit(0.35), F.lit("v1")), 256).alias("home_hash"))


_EASTER = """(make_date(y, 3, 22) + CAST((((19 * (y % 19) + (15 - (13 + 8 * (y // 100)) // 25 + y // 100 - y // 400) % 30) % 30)
  + (2 * (y % 4) + 4 * (y % 7) + 6 * ((19 * (y % 19) + (15 - (13 + 8 * (y // 100)) // 25 + y // 100 - y // 400) % 30) % 30) + (4 + y // 100 - y // 400) % 7) % 7) AS INTEGER))"""
_CALENDAR = f"""days AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders),
 marked AS (SELECT *, day - {_EASTER} AS after, strftime(day, '%m-%d') AS md FROM days)"""
HOLIDAY_SQL = """CASE WHEN md = '01-01' THEN 'Neujahr' WHEN md = '05-01' THEN 'Tag der Arbeit' WHEN md = '10-03' THEN 'Tag der Deutschen Einheit' WHEN md = '12-25' THEN '1. Weihnachtstag' WHEN md = '12-26' THEN '2. Weihnachtstag'
 WHEN after = -2 THEN 'Karfreitag' WHEN after = 1 THEN 'Ostermontag' WHEN after = 39 THEN 'Christi Himmelfahrt' WHEN after = 50 THEN 'Pfingstmontag' END"""
SEASON_SQL = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) <= 5 THEN 'spring' WHEN month({0}) <= 8 THEN 'summer' ELSE 'autumn' END"


@query(f"WITH {_CALENDAR} SELECT o_orderkey, CAST(isodow(day) AS INTEGER) AS weekday, isodow(day) >= 6 AS weekend, {SEASON_SQL.format('day')} AS season, {HOLIDAY_SQL} AS holiday, CAST(dayofyear(day) AS INTEGER) AS day_of_year FROM marked")
def calendar_features(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", cal.iso_weekday(day).alias("weekday"), cal.is_weekend(day).alias("weekend"), cal.season(day).alias("season"), cal.holiday(day).alias("holiday"), F.dayofyear(day).alias("day_of_year"))


@query(
    f"""WITH {ITEMS}, l AS (SELECT item_id, ts + offset_min * INTERVAL 1 MINUTE AS local FROM items)
    SELECT item_id, CASE WHEN hour(local) BETWEEN 6 AND 10 THEN 'morning' WHEN hour(local) BETWEEN 11 AND 16 THEN 'noon' WHEN hour(local) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS daypart, CAST(local AS DATE) AS local_day FROM l""",
    text="local_day",
)
def dayparts(spark, d):
    local = cal.local_time(F.col("ts"), F.col("offset_min"))
    return items(spark, d).select("item_id", cal.daypart(F.hour(local)).alias("daypart"), F.to_date(local).alias("local_day"))


_SUN = f"""{ITEMS}, a AS (SELECT *, (day - DATE '1970-01-01') + 2440588 - 2451545.0::DOUBLE + 0.0008::DOUBLE - lon / 360 AS j FROM items WHERE lat IS NOT NULL),
 b AS (SELECT *, fmod(357.5291::DOUBLE + 0.98560028::DOUBLE * j, 360) AS m FROM a),
 c AS (SELECT *, fmod(m + 102.9372::DOUBLE + (1.9148::DOUBLE * sin(radians(m)) + 0.02::DOUBLE * sin(2 * radians(m)) + 0.0003::DOUBLE * sin(3 * radians(m))) + 180, 360) AS e FROM b),
 d AS (SELECT *, 2451545.0::DOUBLE + j + 0.0053::DOUBLE * sin(radians(m)) - 0.0069::DOUBLE * sin(2 * radians(e)) AS noon, asin(sin(radians(e)) * sin(radians(23.44::DOUBLE))) AS tilt FROM c),
 f AS (SELECT *, degrees(acos((sin(radians(-0.83::DOUBLE)) - sin(radians(lat)) * sin(tilt)) / (cos(radians(lat)) * cos(tilt)))) / 360 AS half FROM d),
 sun AS (SELECT *, CAST(round((noon - half - 2440587.5::DOUBLE) * 86400) AS BIGINT) AS rise, CAST(round((noon + half - 2440587.5::DOUBLE) * 86400) AS BIGINT) AS down FROM f)"""


@query(f"WITH {_SUN} SELECT item_id, CAST(round(rise / 60.0) AS BIGINT) AS sunrise_min, CAST(round(down / 60.0) AS BIGINT) AS sunset_min, t BETWEEN rise AND rise + 3600 OR t BETWEEN down - 3600 AND down AS golden FROM sun")
def solar_features(spark, d):
    known = items(spark, d).where("lat is not null")
    sun = cal.sun(F.col("day"), F.col("lat"), F.col("lon"))
    known = known.withColumns({"rise": sun["sunrise"], "down": sun["sunset"]})
    return known.select("item_id", F.round(F.col("rise") / 60).cast("bigint").alias("sunrise_min"), F.round(F.col("down") / 60).cast("bigint").alias("sunset_min"), cal.golden_hour(F.col("t"), F.col("rise"), F.col("down")).alias("golden"))


_CAPTURE = f"""{ITEMS}, c AS (SELECT item_id, ts, offset_min, CASE WHEN item_id % 5 = 0 THEN ts + INTERVAL 2 HOUR END AS captured, CASE WHEN item_id % 5 = 0 THEN (item_id % 10) / 10::DOUBLE + 0.5::DOUBLE END AS confidence, CASE WHEN item_id % 3 = 0 THEN 'Europe/Berlin' END AS zone, item_id % 4 <> 3 AS has_offset FROM items)"""


@query(
    f"""WITH {_CAPTURE} SELECT item_id,
    CASE WHEN captured IS NOT NULL AND confidence >= 0.8 THEN captured WHEN zone IS NOT NULL THEN ts + INTERVAL 1 HOUR WHEN has_offset THEN ts + offset_min * INTERVAL 1 MINUTE ELSE ts END AS local,
    CASE WHEN captured IS NOT NULL AND confidence >= 0.8 THEN 'captured' WHEN zone IS NOT NULL THEN 'zone' WHEN has_offset THEN 'offset' ELSE 'raw' END AS source FROM c""",
    text="local",
)
def capture_time(spark, d):
    from tidemark.operators.enrich import capture_time as resolve

    e = F.col("item_id")
    known = items(spark, d).withColumns(
        {"captured": F.when(e % 5 == 0, F.col("ts") + F.expr("INTERVAL 2 HOURS")), "confidence": F.when(e % 5 == 0, (e % 10) / 10 + 0.5), "zone": F.when(e % 3 == 0, "Europe/Berlin"), "offset": F.when(e % 4 != 3, F.col("offset_min"))}
    )
    local, source = resolve(F.col("ts"), F.col("captured"), F.col("confidence"), F.col("zone"), F.col("offset"))
    return known.select("item_id", local.alias("local"), source.alias("source"))


_NAMES = "CASE o_orderkey % 4 WHEN 0 THEN 'dir/IMG_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_pano.jpg' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H.%M.%S') || ' Edited.png' WHEN 2 THEN 'a/b/VID' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '-slowmo.mov' ELSE 'scan' || o_orderkey || '.tif' END"


@query(f"WITH n AS (SELECT o_orderkey, {_NAMES} AS name, date_trunc('second', o_orderdate) AS ts FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN ts END AS taken, CASE o_orderkey % 4 WHEN 0 THEN 'panorama' WHEN 1 THEN 'edited' WHEN 2 THEN 'slowmotion' END AS hint FROM n", text="taken")
def filename_features(spark, d):
    o, ts = F.col("o_orderkey"), F.col("o_orderdate")
    name = (
        F.when(o % 4 == 0, F.concat(F.lit("dir/IMG_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_pano.jpg")))
        .when(o % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH.mm.ss"), F.lit(" Edited.png")))
        .when(o % 4 == 2, F.concat(F.lit("a/b/VID"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("-slowmo.mov")))
        .otherwise(F.concat(F.lit("scan"), o.cast("string"), F.lit(".tif")))
    )
    return table(spark, d, "orders").select("o_orderkey", cal.filename_time(name).alias("taken"), strings.name_hint(name).alias("hint"))


_WMEAN = "CASE WHEN {w} > 0 THEN least(1.0, greatest(0.0, ({s}) / {w})) END"


def _wmean(parts) -> str:
    w = "(" + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {v}::DOUBLE ELSE 0 END" for x, v in parts) + ")"
    return _WMEAN.format(w=w, s=" + ".join(f"coalesce({x} * {v}::DOUBLE, 0)" for x, v in parts))


QUALITY_SQL = f"""{ITEMS}, q0 AS (SELECT *, CASE WHEN iso > 0 THEN 1 - ln(greatest(50.0, least(6400.0, iso)) / 50.0) / ln(128.0) END AS noise,
  {_wmean([("(CASE WHEN brightness IS NOT NULL THEN greatest(0.0, 1 - abs(brightness - 0.55::DOUBLE) / 0.35::DOUBLE) END)", 0.6), ("contrast", 0.4)])} AS exposure, width * height / 1000000.0::DOUBLE AS mpx FROM items),
 q1 AS (SELECT *, {_wmean([("sharpness", 0.35), ("sharpness", 0.15), ("exposure", 0.3), ("noise", 0.2)])} AS raw FROM q0),
 q2 AS (SELECT *, CASE WHEN clipping > 0 THEN greatest(0.0, raw * (1 - least(1.0, 0.5::DOUBLE * clipping))) ELSE raw END AS score FROM q1)"""


@query(
    f"""WITH {QUALITY_SQL} SELECT item_id, round(score, 9) AS score, round(exposure, 9) AS exposure, round(noise, 9) AS noise,
    coalesce(score < 0.35, FALSE) OR coalesce(mpx < 2.0, FALSE) OR coalesce(sharpness < 0.2, FALSE) OR coalesce(exposure < 0.25, FALSE) OR coalesce(noise < greatest(0.1, 0.25 - (2025 - year(ts)) * 0.01), FALSE) OR coalesce(clipping > 0.15, FALSE) AS low FROM q2"""
)
def quality_scores(spark, d):
    from tidemark.operators.enrich import item_quality

    return item_quality(items(spark, d).drop("low_quality")).select("item_id", F.round("quality_score", 9).alias("score"), F.round("exposure_score", 9).alias("exposure"), F.round("noise_score", 9).alias("noise"), F.col("low_quality").alias("low"))


@query(f"WITH {ITEMS} SELECT item_id, CAST(('0x' || substr(sha256(lower(trim(persons[1]))), 1, 15)) AS BIGINT) AS person, array_to_string(persons, '|') AS key FROM items")
def person_ids(spark, d):
    return items(spark, d).select("item_id", hashing.person_id(F.col("persons")[0]).alias("person"), F.array_join("persons", "|").alias("key"))


@query("SELECT n_nationkey, n_name || '|' || r_name AS locality, CASE WHEN n_name = lower(n_name) THEN 'lower' ELSE n_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def locality_labels(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", strings.joined_key(F.lit(None).cast("string"), F.col("n_name"), F.lit(None).cast("string"), F.col("r_name")).alias("locality"), strings.title_if_lower(strings.first_label(F.lit(" "), F.col("n_name"))).alias("label"))


@query(f"WITH {ITEMS} SELECT item_id, list_filter([CASE WHEN lat IS NULL THEN 'place' END, CASE WHEN iso IS NULL THEN 'iso' END, CASE WHEN sharpness IS NULL THEN 'sharpness' END], lambda x: x IS NOT NULL) AS missing FROM items WHERE lat IS NULL OR iso IS NULL OR sharpness IS NULL")
def qa_inspection(spark, d):
    from tidemark.operators.enrich import missing_fields

    return missing_fields(items(spark, d), {"place": "lat", "iso": "iso", "sharpness": "sharpness"}).select("item_id", "missing")


@query(f"WITH {ITEMS}, v AS (SELECT user_id, offset_min, count(*) AS n, min(t) AS first FROM (SELECT user_id, t, ((item_id % 3) - 1) * 60 AS offset_min FROM items) GROUP BY 1, 2) SELECT user_id, CAST(offset_min AS INTEGER) AS offset_min, n FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, offset_min) = 1")
def timezone_votes(spark, d):
    from tidemark.operators.aggregates import majority

    known = items(spark, d).withColumn("vote", (((F.col("item_id") % 3) - 1) * 60).cast("int"))
    return majority(known, ["user_id"], "vote", "t").select("user_id", F.col("vote").alias("offset_min"), "n")


@query(
    f"""WITH {ITEMS}, g AS (SELECT user_id, device, count(*) AS n, max(t) - min(t) AS span FROM items GROUP BY 1, 2)
    SELECT user_id, device, n, round(greatest(least(1.0, n / 50.0), least(1.0, span / 86400.0)), 6) AS confidence FROM g WHERE n >= 5 AND span >= 1800"""
)
def staypoint_places(spark, d):
    from tidemark.operators.enrich import dense_places

    return dense_places(items(spark, d), ["user_id", "device"], 5, 1800, 50, 86400).select("user_id", "device", "n", F.round("confidence", 6).alias("confidence"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(bit_count(xor(('0x' || substr(md5(CAST(a.s_suppkey AS VARCHAR)), 1, 16))::UBIGINT, ('0x' || substr(md5(CAST(b.s_suppkey AS VARCHAR)), 1, 16))::UBIGINT)) AS INTEGER) AS bits FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def hamming_neighbours(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 16).alias("h"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("b.s_suppkey") == F.col("a.s_suppkey") + 1).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), hashing.hamming_bytes(F.col("a.h"), F.col("b.h")).alias("bits"))


@query(f"WITH {ITEMS} SELECT item_id, round(CASE WHEN iso > 0 THEN 1 - ln(greatest(50.0, least(6400.0, iso)) / 50.0) / ln(128.0) END, 6) AS iso_score, round(CASE WHEN brightness IS NOT NULL THEN greatest(0.0, 1 - abs(brightness - 0.55::DOUBLE) / 0.35::DOUBLE) END, 6) AS balanced, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid, round(1 - exp(-value / 400), 6) AS saturation FROM items")
def score_functions(spark, d):
    return items(spark, d).select(
        "item_id", F.round(scoring.iso_score(F.col("iso")), 6).alias("iso_score"), F.round(scoring.balanced(F.col("brightness"), 0.55, 0.35), 6).alias("balanced"), F.round(scoring.sigmoid(F.col("value") / 100), 6).alias("sigmoid"), F.round(geo.distance_saturation(F.col("value")), 6).alias("saturation")
    )


@query("SELECT o_orderkey, CAST(abs(make_date(2001, CAST(month(o_orderdate) AS INTEGER), 1) + CAST(day(o_orderdate) AS INTEGER) - 1 - DATE '2001-06-15') AS INTEGER) AS days FROM orders")
def month_day_distances(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.month_day_distance(F.to_date("o_orderdate"), 6, 15).alias("days"))


@query("SELECT vec_id, list_reduce(list_prepend('', list_transform(embedding, lambda x: CASE WHEN x > list_avg(embedding) THEN '1' ELSE '0' END)), lambda a, b: a || b) AS bits FROM embeddings")
def average_hash(spark, d):
    from tidemark.functions.vision import average_bits

    return table(spark, d, "embeddings").select("vec_id", average_bits(F.col("embedding")).alias("bits"))
