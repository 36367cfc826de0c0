"""Scans, lookups and base filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(items: DataFrame) -> DataFrame:
    """Items that are shown and not of low quality; nulls count as no."""
    return items.where(~F.coalesce("no_show", F.lit(False)) & ~F.coalesce("low_quality", F.lit(False)))


def timestamped(items: DataFrame, extra: Column | None = None) -> DataFrame:
    out = items.where(F.col("ts").isNotNull())
    return out if extra is None else out.where(extra)


def located(items: DataFrame, extra: Column | None = None) -> DataFrame:
    out = items.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return out if extra is None else out.where(extra)


def ordered_scan(items: DataFrame, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Items of a time range in the order (ts, item_id). Without a limit the order is global: a range-partitioned sort."""
    if since is not None:
        items = items.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        items = items.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    items = items.orderBy("ts", "item_id")
    return items if limit is None else items.limit(limit)


def lookup(items: DataFrame, ids: DataFrame, only_videos: bool = False) -> DataFrame:
    """Items of the given ids (item_id) that are shown and represent their burst, if they are in one."""
    out = items.where(~F.coalesce("no_show", F.lit(False)) & (F.col("burst_uuid").isNull() | F.coalesce("burst_representative", F.lit(False))))
    if only_videos:
        out = out.where("is_video")
    return out.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def index_candidates(items: DataFrame, version: int, limit: int) -> DataFrame:
    """Shown items that were never indexed, or by an older version, by id."""
    stale = F.col("indexed_at").isNull() | (F.col("feature_version") < version)
    return items.where(~F.coalesce("no_show", F.lit(False)) & stale).orderBy("item_id").limit(limit)


def good_candidates(items: DataFrame, since: str, until: str, limit: int) -> DataFrame:
    """Shown representatives of good quality in a closed time range."""
    fits = F.col("ts").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
    return eligible(items).where(fits & (F.col("burst_uuid").isNull() | F.coalesce("burst_representative", F.lit(False)))).orderBy("ts", "item_id").limit(limit)


def first_per_key(rows: DataFrame, key: str | list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in an order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def having(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """Rows of the keys that have at least n rows."""
    return rows.join(rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") >= n).drop("__n"), key, "left_semi")


def page_after(rows: DataFrame, cursor: str | None, size: int, id_column: str = "item_id") -> DataFrame:
    """A page of feed rows ranked by (rank): after a time ("time:<epoch>") or behind the row that holds a member ("media:<id>"); other cursors change nothing."""
    kind, _, value = (cursor or "").partition(":")
    if kind == "time" and value.lstrip("-").isdigit():
        rows = rows.where(F.col("t_from").isNull() | (F.col("t_from") < int(value)))
    elif kind == "media" and value.isdigit():
        anchor = rows.where(F.array_contains("members", F.lit(int(value)))).agg(F.min("rank").alias("__a"))
        rows = rows.join(anchor, F.lit(True)).where(F.col("__a").isNull() | (F.col("rank") > F.col("__a"))).drop("__a")
    return rows.orderBy("rank").limit(size)
