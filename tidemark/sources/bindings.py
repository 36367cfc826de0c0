"""Views of stored tables as item relations: one row per item with a time and optional place, hash, people and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import seconds


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table. Times without a zone are read as UTC instants, so filters on them still reach the scan."""
    setting = "spark.sql.parquet.inferTimestampNTZ.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    finally:
        spark.conf.set(setting, before)


def items(events: DataFrame) -> DataFrame:
    """Events as items. All columns are arithmetic on the event, so any engine can derive the same."""
    e, u = F.col("event_id"), F.col("user_id")
    located = e % 9 != 0
    frame = e % 8
    return events.select(
        e.alias("item_id"),
        "ts",
        seconds(F.col("ts")).alias("t"),
        F.to_date("ts").alias("day"),
        u.alias("user_id"),
        F.col("event_type").alias("device"),
        "value",
        F.when(located, 48 + (u % 7) * 0.5 + (e % 11) * 0.0005).alias("lat"),
        F.when(located, 11 + (u % 5) * 0.7 + (e % 13) * 0.0005).alias("lon"),
        (e % 10 == 0).alias("is_video"),
        F.when(frame == 0, 4000).when(frame == 1, 1080).when(frame == 2, 3000).otherwise(1600).alias("width"),
        F.when(frame == 0, 1500).when(frame == 1, 2160).when(frame == 2, 4000).otherwise(1200).alias("height"),
        F.when(e % 6 == 0, e % 12 == 0).alias("is_panorama"),
        F.substring(F.md5(F.floor(e / 3).cast("string")), 1, 16).alias("phash"),
        F.when(e % 3 == 0, F.array(F.concat(F.lit("u"), u.cast("string")), F.concat(F.lit("u"), ((u + 1) % 150).cast("string")))).otherwise(F.array(F.concat(F.lit("u"), u.cast("string")))).alias("persons"),
        F.round(F.col("value") / 500, 6).alias("quality"),
        F.when(e % 50 < 5, F.concat(F.lit("b"), F.floor(e / 50).cast("string"))).alias("burst_uuid"),
        (e % 50).cast("int").alias("burst_index"),
        F.when(e % 50 < 5, e % 50 == 0).alias("burst_representative"),
        (e % 97 == 0).alias("no_show"),
        (e % 53 == 0).alias("low_quality"),
        (((u % 3) - 1) * 60).cast("int").alias("offset_min"),
        F.concat(F.lit("tag"), F.get_json_object("props", "$.k")).alias("tag"),
        F.when(e % 4 != 3, 100 * F.pow(F.lit(2.0), e % 7)).cast("int").alias("iso"),
        F.when(e % 5 != 4, (e % 23) / 22).alias("sharpness"),
        F.when(e % 7 != 6, (e % 19) / 18).alias("brightness"),
        ((e % 17) / 16).alias("contrast"),
        F.when(e % 3 != 2, (e % 13) / 60).alias("clipping"),
    )


def members_of_orders(lineitem: DataFrame) -> DataFrame:
    """Orders as drafts: (draft_id, member) for each part of an order."""
    return lineitem.select(F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("member")).distinct()
