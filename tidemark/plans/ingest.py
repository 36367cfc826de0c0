"""From files to items: located, read by the extractors that are asked for, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.enrich import link_places, normalised_time
from tidemark.sources import files
from tidemark.sources.exif import with_exif

#: An extractor adds columns to files. It mustn't drop rows, and what it can't read it leaves null.
Extractor = Callable[[DataFrame], DataFrame]


def _exif(df: DataFrame) -> DataFrame:
    found = with_exif(df)
    return df.join(found.withColumnsRenamed({c: f"exif_{c}" for c in found.columns if c != "path"}), "path", "left")


def _times(df: DataFrame) -> DataFrame:
    """The time from EXIF, else from the name, else the file's own."""
    taken = F.try_to_timestamp(F.col("exif_taken"), F.lit("yyyy:MM:dd HH:mm:ss")) if "exif_taken" in df.columns else F.lit(None).cast("timestamp")
    rows = df.withColumns({"taken_at": taken, "time_source": F.when(taken.isNotNull(), "exif"), "mtime": F.col("modified")})
    return normalised_time(rows).drop("taken_at", "time_source", "mtime")


#: Extractors by name, in the order in which they run.
EXTRACTORS: dict[str, Extractor] = {"mime": files.sniffed, "name": files.named, "checksum": files.checksums, "exif": _exif, "time": _times}


def register_extractor(name: str, extractor: Extractor) -> None:
    """Adds an extractor of the caller's own behind the others."""
    EXTRACTORS[name] = extractor


def ingest(spark: SparkSession, folder: str, known: DataFrame | None = None, without: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Media files under a folder with what all extractors, but those switched off, tell of them. Files whose content is known (checksum) are left out, each new content comes once."""
    found = files.locate(spark, folder, most, content=True)
    for name, extractor in EXTRACTORS.items():
        if name in without:
            continue
        found = extractor(found)
        if name == "checksum":
            found = files.new_files(found, known if known is not None else spark.createDataFrame([], "checksum string"))
    return found.drop("content")


def link_locations(items: DataFrame, places: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Items with the nearest stored place; stands in for asking a geocoder."""
    return link_places(items, places, metres)
