"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset (as in tests) a new folder, which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables of one call; writing one cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
        self.used: Counter[str] = Counter()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.used[name] += 1
        path = f"{self.folder}/{name}" + (f"-{self.used[name]}" if self.used[name] > 1 else "")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
