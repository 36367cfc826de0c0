"""The registry, and the SQL forms of the bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bindings import items as _items
from tidemark.sources.bindings import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The items binding for other engines.
ITEMS = """items AS (
  SELECT event_id AS item_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(ts AS DATE) AS day, user_id, event_type AS device, value,
    CASE WHEN event_id % 9 <> 0 THEN 48 + (user_id % 7) * 0.5::DOUBLE + (event_id % 11) * 0.0005::DOUBLE END AS lat,
    CASE WHEN event_id % 9 <> 0 THEN 11 + (user_id % 5) * 0.7::DOUBLE + (event_id % 13) * 0.0005::DOUBLE END AS lon,
    event_id % 10 = 0 AS is_video,
    CASE event_id % 8 WHEN 0 THEN 4000 WHEN 1 THEN 1080 WHEN 2 THEN 3000 ELSE 1600 END AS width,
    CASE event_id % 8 WHEN 0 THEN 1500 WHEN 1 THEN 2160 WHEN 2 THEN 4000 ELSE 1200 END AS height,
    CASE WHEN event_id % 6 = 0 THEN event_id % 12 = 0 END AS is_panorama,
    substr(md5(CAST(event_id // 3 AS VARCHAR)), 1, 16) AS phash,
    CASE WHEN event_id % 3 = 0 THEN ['u' || user_id, 'u' || ((user_id + 1) % 150)] ELSE ['u' || user_id] END AS persons,
    round(value / 500, 6) AS quality,
    CASE WHEN event_id % 50 < 5 THEN 'b' || (event_id // 50) END AS burst_uuid,
    CAST(event_id % 50 AS INTEGER) AS burst_index,
    CASE WHEN event_id % 50 < 5 THEN event_id % 50 = 0 END AS burst_representative,
    event_id % 97 = 0 AS no_show, event_id % 53 = 0 AS low_quality,
    CAST(((user_id % 3) - 1) * 60 AS INTEGER) AS offset_min,
    'tag' || json_extract_string(props, '$.k') AS tag,
    CASE WHEN event_id % 4 <> 3 THEN CAST(100 * pow(2, event_id % 7) AS INTEGER) END AS iso,
    CASE WHEN event_id % 5 <> 4 THEN (event_id % 23) / 22::DOUBLE END AS sharpness,
    CASE WHEN event_id % 7 <> 6 THEN (event_id % 19) / 18::DOUBLE END AS brightness,
    (event_id % 17) / 16::DOUBLE AS contrast,
    CASE WHEN event_id % 3 <> 2 THEN (event_id % 13) / 60::DOUBLE END AS clipping
  FROM events
)"""
#: Items that every strategy starts from.
ELIGIBLE = f"""{ITEMS}, eligible AS (SELECT * FROM items WHERE NOT no_show AND NOT low_quality)"""
#: The digest of a set of item_ids, as an aggregate.
DIGEST = "bit_xor(CAST('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 15) AS BIGINT))"


def digest(key: str) -> str:
    return DIGEST.replace("item_id", key)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6371008.8") -> str:
    return f"(CASE WHEN ({lat1}) + ({lon1}) + ({lat2}) + ({lon2}) IS NOT NULL THEN 2 * {radius} * asin(least(1.0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))) END)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(table(spark, sf_dir, "events"))


def query(sql: str | None = None, text: str = ""):
    """Registers a query under its function's name, with the SQL that checks it. Days and times are given as text: `text` names their columns."""
    names = text.split()

    def add(f):
        QUERIES[f.__name__] = f if not names else lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in names})
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if not names else f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in names)}) FROM ({sql})"
        return f

    return add
