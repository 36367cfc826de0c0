"""Groups by closeness: bursts found by hash and time, and buckets of a day by place and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.density import components, dbscan
from tidemark.operators.islands import anchored_windows
from tidemark.operators.joins import hamming_nearest
from tidemark.sources.scratch import Scratch


def discover_bursts(items: DataFrame, scratch: Scratch, bits: int = 8, nearest: int = 16, seconds: int = 3, prefix: int = 4) -> DataFrame:
    """(item_id, burst_id, burst_index, burst_representative) of items without a burst that are among the nearest by hash of another one taken at most `seconds` apart, directly or by others.

    burst_id is a hash of the smallest item; members are numbered by time and id; the sharpest represents, then the first.
    """
    free = items.where("burst_uuid is null and phash is not null and t is not null").select("item_id", "phash", "t", "sharpness")
    near = hamming_nearest(free, free, "item_id", bits, nearest, prefix)
    at = free.select(F.col("item_id").alias("other"), F.col("t").alias("t_other"))
    close = near.join(free.select("item_id", "t"), "item_id").join(at, "other").where(F.abs(F.col("t") - F.col("t_other")) <= seconds)
    roots = components(close.select(F.col("item_id").alias("a"), F.col("other").alias("b")), scratch, "bursts")
    rows = free.join(roots.withColumnRenamed("node", "item_id"), "item_id")
    w = Window.partitionBy("root")
    first = F.row_number().over(w.orderBy(F.desc_nulls_last("sharpness"), "t", "item_id")) == 1
    return rows.select("item_id", F.sha1(F.col("root").cast("string")).alias("burst_id"), (F.row_number().over(w.orderBy("t", "item_id")) - 1).alias("burst_index"), first.alias("burst_representative"))


def attach_by_time(items: DataFrame, buckets: DataFrame, key: list[str]) -> DataFrame:
    """Unlocated items with the first bucket (key, bucket, start, end; the smallest number first) whose time holds them. Buckets of a key are few."""
    spans = buckets.select(*key, "bucket", "start", "end")
    return items.join(spans, key).where(F.col("t").between(F.col("start"), F.col("end"))).groupBy(*key, "item_id").agg(F.min("bucket").alias("bucket"))


def geo_time_buckets(items: DataFrame, owner: list[str], scratch: Scratch, metres: float = 250.0, seconds: int = 10800, least: int = 9) -> DataFrame:
    """(owner, day, item_id, bucket): per day, windows fixed to their first item within density clusters; of what is left of the located items, such windows that also stay within `metres`; each of `least` items.

    Buckets are numbered in that order, by cluster and start. Items without a place go to the first bucket whose time holds them; others that fit nowhere are left out.
    """
    key = [*owner, "day"]
    rows = items.where("t is not null").select(*key, "item_id", "t", "lat", "lon")
    located = rows.where("lat is not null and lon is not null")
    dense = dbscan(located, metres, least, scratch, key).where("cluster is not null").select("item_id", "cluster")
    inner = anchored_windows(located.join(dense, "item_id"), [*key, "cluster"], seconds)
    sized = lambda df, by: df.join(df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n"), by, "left_semi")
    inner = scratch.table(sized(inner, [*key, "cluster", "window"]).select(*key, "item_id", "t", F.lit(0).alias("kind"), "cluster", "window"), "inner")
    rest = located.join(inner.select("item_id"), "item_id", "left_anti").select(*key, "item_id", "t", "lat", "lon")
    outer = sized(anchored_windows(rest, key, seconds, metres), [*key, "window"]).select(*key, "item_id", "t", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("cluster"), "window")
    placed = scratch.table(inner.unionByName(outer), "placed")
    groups = placed.groupBy(*key, "kind", "cluster", "window").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    groups = groups.withColumn("bucket", F.row_number().over(Window.partitionBy(*key).orderBy("kind", "cluster", "window")))
    of = ["kind", "cluster", "window", *key]
    numbered = placed.alias("p").join(groups.alias("g"), [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in of]).select(*[F.col(f"p.{c}").alias(c) for c in (*key, "item_id")], F.col("g.bucket").alias("bucket"))
    loose = rows.where("lat is null or lon is null")
    return numbered.unionByName(attach_by_time(loose, groups, key).select(*key, "item_id", "bucket"))
