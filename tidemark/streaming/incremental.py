"""Streams of items: seen-before filters, windows, sessions and late siblings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(items: DataFrame, key: str = "checksum", late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(items: DataFrame, owner: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions by gap: owner, first and last second, n. Times are cut to seconds; a gap of exactly the length still joins."""
    at = items.withColumn("ts", F.date_trunc("second", "ts")).withWatermark("ts", late)
    g = at.groupBy(owner, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.select(owner, "first", "last", "n")


def buckets(items: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding window and device; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return items.withWatermark("ts", late).groupBy(w.alias("w"), "device").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "device", "n")


def anchored(items: DataFrame, owner: str, seconds: int) -> DataFrame:
    """Windows fixed to their first item, kept as state per owner: each row with the number and start of its window. Rows of a batch are taken in time order; what comes late joins the open window or opens one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        number, anchor = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values(["t", "item_id"])
        out = []
        for t, item in zip(rows["t"].tolist(), rows["item_id"].tolist(), strict=True):
            if anchor is None or abs(t - anchor) > seconds:
                number, anchor = number + 1, t
            out.append((key[0], item, t, number, anchor))
        state.update((number, anchor))
        yield pd.DataFrame(out, columns=[owner, "item_id", "t", "window", "start"])

    return items.groupBy(owner).applyInPandasWithState(step, f"{owner} bigint, item_id bigint, t bigint, window int, start bigint", "number int, anchor bigint", "append", GroupStateTimeout.NoTimeout)


def into_store(items: DataFrame, folder: str, late_key: str, checkpoint: str, table: str = "items"):
    """Starts a query that appends each batch to a table and writes to `<table>_siblings` the stored rows that share a late row's key, to be grouped again."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        path = f"{folder}/{table}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            known = spark.read.parquet(path)
            again = known.join(df.select(late_key).where(F.col(late_key).isNotNull()).distinct(), late_key, "left_semi")
            # A batch that is replayed after a failure overwrites its own part, and doesn't meet its own rows.
            again.where(F.col("batch") != number).drop("batch").write.mode("overwrite").parquet(f"{folder}/{table}_siblings/batch={number}")
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        df.unpersist()

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
