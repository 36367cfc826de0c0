"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWNER: ContextVar[list[Scratch] | None] = ContextVar("scratch owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (local runs, tests) an own one. On a cluster it must be set, as a folder of the driver's machine is none that executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def narrowed(df: DataFrame, source: DataFrame, per_task: int = 4 << 20) -> DataFrame:
    """`df`, made from `source` by a shuffle, in no more tasks than give each `per_task` bytes of the source as Catalyst estimates it (for files: as they are stored)."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(1, min(-(-size // per_task), 1 << 20)))


@contextmanager
def collecting(owner: list[Scratch]) -> Iterator[None]:
    """The calls made inside add their tables to `owner`, who drops them when what they returned has been read."""
    before = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(before)


class Scratch:
    """Tables of one operator call. A table written here cuts the lineage and survives lost executors. They stay until their owner drops them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
        if (owner := _OWNER.get()) is not None:
            owner.append(self)

    def table(self, df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None, per_file: int = 50_000, dealt: bool = False) -> DataFrame:
        """Written by as many tasks as df has, unless `rows`, about how many df has at most, is given: then by one task for `per_file` of them.

        Only for rows of a fixed width, so that rows stand for bytes. dealt: df is made from texts, whose tasks
        stay as they are; their small rows are dealt out to the tasks that write.
        """
        path = f"{self.root}/{name}"
        if rows is not None:
            files = max(1, -(-rows // per_file))
            df = df.repartition(files) if dealt else df.coalesce(files)
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
