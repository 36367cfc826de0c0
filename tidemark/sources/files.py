"""Files as items: recursive scans, metadata from names and bytes, and stored JSON documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import filename_time
from tidemark.functions.strings import name_hint, path_tokens

#: Extensions that are images and videos.
IMAGES = "jpg jpeg png gif webp heic heif tif tiff bmp dng cr2 cr3 nef arw orf rw2 raf srw pef".split()
VIDEOS = "mp4 mov m4v avi mkv webm 3gp mts".split()
#: First bytes (hex) of formats.
MAGIC = {"ffd8ff": "image/jpeg", "89504e47": "image/png", "47494638": "image/gif", "49492a00": "image/tiff", "4d4d002a": "image/tiff", "424d": "image/bmp", "1a45dfa3": "video/x-matroska"}


def locate(spark: SparkSession, folder: str, most: int | None = None, videos: bool = True, content: bool = False) -> DataFrame:
    """Media files under a folder: path, size, modified, extension; content on request. The extension is filtered before any bytes are read."""
    kinds = IMAGES + (VIDEOS if videos else [])
    pattern = "*.{" + ",".join(x for k in kinds for x in (k, k.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("extension"), *(["content"] if content else []))
    return out if most is None else out.orderBy("path").limit(most)


def sniffed(files: DataFrame, strict: bool = False) -> DataFrame:
    """Adds mime from the first bytes, else from the extension; strict drops files whose bytes and extension disagree about image or video."""
    head = F.lower(F.hex(F.substring("content", 1, 12)))
    by_bytes = F.when(F.substring(head, 9, 8) == "66747970", F.when(F.substring(head, 17, 8).isin("68656963", "68656978", "6d696631"), "image/heic").otherwise("video/mp4"))
    for start, mime in MAGIC.items():
        by_bytes = F.when(head.startswith(start), mime).otherwise(by_bytes)
    by_name = F.when(F.col("extension").isin(*VIDEOS), F.concat(F.lit("video/"), "extension")).when(F.col("extension").isin(*IMAGES), F.concat(F.lit("image/"), "extension"))
    out = files.withColumns({"mime": F.coalesce(by_bytes, by_name), "is_raw": F.col("extension").isin("dng", "cr2", "cr3", "nef", "arw", "orf", "rw2", "raf", "srw", "pef")})
    if strict:
        out = out.where(F.split("mime", "/")[0] == F.split(by_name, "/")[0])
    return out


def named(files: DataFrame) -> DataFrame:
    """Adds what a file's name tells: a time, hints, words, and the number of a burst frame."""
    p = F.col("path")
    return files.withColumns({"named_at": filename_time(p), "hint": name_hint(p), "words": path_tokens(F.regexp_extract(p, r"([^/]*)$", 1)), "burst_index": F.nullif(F.regexp_extract(p, r"(?i)(?:burst|_b)(\d{1,4})(?=\D|$)", 1), F.lit("")).cast("int")})


def xmp_people_and_words(files: DataFrame, column: str = "xmp") -> DataFrame:
    """Adds keywords and persons from XMP packets."""
    words = F.expr(f"xpath({column}, '//*[local-name()=\"subject\"]//*[local-name()=\"li\"]/text()')")
    persons = F.expr(f"xpath({column}, '//*[local-name()=\"PersonInImage\"]//*[local-name()=\"li\"]/text()')")
    tidy = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))
    return files.withColumns({"keywords": tidy(words), "persons": tidy(persons)})


PROBE = T.StructType(
    [
        T.StructField("streams", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("codec_type", T.StringType()), ("codec_name", T.StringType()), ("avg_frame_rate", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("tags", T.MapType(T.StringType(), T.StringType())))]))),
        T.StructField("format", T.StructType([T.StructField("duration", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])),
    ]
)


def probed(files: DataFrame, column: str = "probe") -> DataFrame:
    """Adds duration, codec, frame rate and rotation from stored probe output (JSON)."""
    from tidemark.functions.strings import rational

    p = F.from_json(column, PROBE)
    video = F.filter(p["streams"], lambda s: s["codec_type"] == "video")[0]
    return files.withColumns({"duration_s": p["format"]["duration"].try_cast("double"), "codec": video["codec_name"], "fps": rational(video["avg_frame_rate"]), "rotation": video["tags"]["rotate"].try_cast("int"), "is_slow_mo": rational(video["avg_frame_rate"]) >= 100})


COLLECTION = (
    "dataset string, title string, themes array<string>, clusters array<struct<id:string,title:string,summary:string,expected_days:array<string>,"
    "items:array<struct<filename:string,taken_at:string,quality:double,tags:array<string>,people:array<string>,location:struct<city:string,country:string>,roles:array<string>>>>>"
)


def collection_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Labelled collections from JSON files, summed up per cluster: members, hours, days, days that are missing, key item."""
    one = spark.read.schema(COLLECTION).json(path, multiLine=True).select("dataset", F.explode("clusters").alias("c"))
    items = one.select("dataset", F.col("c.id").alias("id"), F.col("c.expected_days").alias("expected"), F.explode("c.items").alias("i")).withColumn("at", F.to_timestamp("i.taken_at"))
    key = F.struct(F.array_contains("i.roles", "key").cast("int").alias("k"), F.col("i.quality").alias("q"))
    g = items.groupBy("dataset", "id").agg(
        F.count("*").alias("n"), F.round((F.max("at").cast("double") - F.min("at").cast("double")) / 3600, 2).alias("hours"), F.array_sort(F.collect_set(F.substring("i.taken_at", 1, 10))).alias("days"), F.first("expected").alias("expected"),
        F.max_by("i.filename", key).alias("key_item"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i.tags")))).alias("tags"),
    )
    return g.withColumn("missing", F.array_sort(F.array_except("expected", "days"))).drop("expected")


@F.pandas_udf(T.StringType())
def xxh64(data: pd.Series) -> pd.Series:
    """xxHash64 with seed 0, as 16 hex digits (Spark's own xxhash64 has another seed)."""
    import xxhash

    return data.map(lambda b: None if b is None else xxhash.xxh64(bytes(b)).hexdigest())


def checksums(files: DataFrame) -> DataFrame:
    """Adds the SHA-256 and the fast checksum of the content."""
    return files.withColumns({"checksum": F.sha2("content", 256), "fast_checksum": xxh64("content")})


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose checksum isn't known, each content once (the first path)."""
    once = files.groupBy("checksum").agg(F.min("path").alias("path"))
    return files.join(once, ["checksum", "path"], "left_semi").join(known.select("checksum").distinct(), "checksum", "left_anti")
