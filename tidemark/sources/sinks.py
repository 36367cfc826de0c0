"""Stored drafts and their members, exports and run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import config_hash
from tidemark.operators.consolidate import insert_new
from tidemark.sources.scratch import Scratch


class DraftStore:
    """A folder with `drafts` (by algorithm and fingerprint) and `members` tables; every write appends files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, like: DataFrame | None = None) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None if like is None else like.limit(0)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drafts(self) -> DataFrame | None:
        return self._read("drafts")

    def insert(self, drafts: DataFrame) -> None:
        """Appends drafts that aren't stored; stored ones stay as they are."""
        insert_new(drafts, self._read("drafts", drafts)).write.mode("append").partitionBy("algorithm").parquet(f"{self.folder}/drafts")

    def insert_members(self, members: DataFrame) -> None:
        """Appends (draft_id, item_id, position, role)."""
        members.write.mode("append").parquet(f"{self.folder}/members")

    def delete(self, algorithms: list[str] | None = None) -> None:
        """Removes all drafts, or those of some algorithms: their partitions are deleted, others aren't touched."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for target in [f"{self.folder}/drafts"] if algorithms is None else [f"{self.folder}/drafts/algorithm={a}" for a in algorithms]:
            path = fs_path(target)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def insert_stream(self, drafts: DataFrame, checkpoint: str):
        """Starts a query that inserts a stream of drafts batch by batch; each batch sees what those before it have stored, so a replayed one adds nothing."""

        def batch(df: DataFrame, _: int) -> None:
            self.insert(df)

        return drafts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def refresh(self, rows: DataFrame, columns: list[str]) -> None:
        """Sets columns of stored drafts to those of `rows` (algorithm, fingerprint, the columns): the partitions of their algorithms are written anew, others aren't touched. Rows that aren't stored are ignored."""
        key = ["algorithm", "fingerprint"]
        news = rows.select(*key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns]).dropDuplicates(key)
        names = [r["algorithm"] for r in rows.select("algorithm").distinct().collect()]
        stored = self.drafts().where(F.col("algorithm").isin(names))
        out = stored.join(news, key, "left")
        out = out.withColumns({c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*stored.columns)
        # What is read can't be overwritten: the new partitions are written beside and then take the old ones' place.
        Scratch(self.spark, "refresh").table(out, "drafts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("algorithm").parquet(f"{self.folder}/drafts")

    def latest(self, n: int) -> DataFrame:
        return self.drafts().orderBy(F.desc("t_from"), F.desc("t_to"), "draft_id").limit(n)


def cluster_rows(members: DataFrame, key: list[str], settings: dict[str, str] | None = None) -> DataFrame:
    """What is stored of a draft: time bounds, photo and video counts, bounding box, dominant place, hash of the settings."""
    from tidemark.operators.aggregates import majority

    g = members.groupBy(*key).agg(
        F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.count_if(~F.col("is_video")).alias("photos"), F.count_if("is_video").alias("videos"), F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")
    )
    g = g.join(majority(members, key, "device", "t").select(*key, F.col("device").alias("dominant")), key, "left")
    return g.withColumn("config_hash", config_hash(*[F.lit(v).alias(k) for k, v in sorted((settings or {}).items())])) if settings else g


def duplicate_edges(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller id first, with its last distance (by `seen`)."""
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return pairs.select(a, b, "distance", "seen").groupBy("a", "b").agg(F.max_by("distance", "seen").alias("distance"))


def export_json(rows: DataFrame, path: str, version: int = 1) -> None:
    """One JSON document per row with a schema version."""
    rows.select(F.to_json(F.struct(F.lit(version).alias("schema"), *rows.columns)).alias("value")).write.text(path)


def export_html(feed: DataFrame, most: int = 200) -> str:
    """A page of the feed; the feed is as short as its limit."""
    from html import escape

    cards = "".join(f"<li><h2>{escape(str(r['title']))}</h2><p>{escape(str(r['subtitle']))}</p></li>" for r in feed.orderBy("rank").limit(most).collect())
    return f"<!DOCTYPE html><html><body><ol>{cards}</ol></body></html>"


def emit_event(spark: SparkSession, path: str, job: str, status: str, **context: str) -> None:
    """Appends one run event as a JSON line."""
    spark.createDataFrame([(job, status, {k: str(v) for k, v in context.items()})], "job string, status string, context map<string,string>").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


class Preferences:
    """A table of (profile, kind, value): favourites, hidden things and opt-outs of users. Every change is a new version of the profile; the last one counts."""

    SCHEMA = "profile string, version bigint, kind string, value string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def read(self) -> DataFrame:
        """(profile, kind, value) as they stand."""
        rows = self._all()
        last = rows.groupBy("profile").agg(F.max("version").alias("version"))
        return rows.join(last, ["profile", "version"]).where("kind is not null").select("profile", "kind", "value").distinct()

    def of(self, profile: str) -> dict[str, list[str]]:
        """The values of one profile by kind, sorted; a user's list is short."""
        out: dict[str, list[str]] = {}
        for r in self.read().where(F.col("profile") == profile).orderBy("kind", "value").collect():
            out.setdefault(r["kind"], []).append(r["value"])
        return out

    def write(self, profile: str, values: dict[str, list[str]]) -> None:
        """Replaces what is stored of a profile."""
        version = (self._all().where(F.col("profile") == profile).agg(F.max("version")).first()[0] or 0) + 1
        rows = [(profile, version, kind, v) for kind, given in values.items() for v in given] or [(profile, version, None, None)]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
