"""Row-level enrichment of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.calendar import local_time
from tidemark.functions.geo import haversine_m

#: Limits below (or above) which an item is of low quality.
LOW = {"score": 0.35, "megapixels": 2.0, "sharpness": 0.2, "exposure": 0.25, "noise": 0.25, "clipping": 0.15}
NOISE_YEAR, NOISE_DECAY, NOISE_FLOOR, CLIPPING_WEIGHT = 2025, 0.01, 0.1, 0.5


def capture_time(ts: Column, captured: Column, confidence: Column, zone: Column, offset: Column) -> tuple[Column, Column]:
    """Local capture time and where it comes from: a captured time that is trusted, the zone, the offset, else as it is."""
    trusted = captured.isNotNull() & (confidence >= 0.8)
    local = F.when(trusted, captured).when(zone.isNotNull(), F.from_utc_timestamp(ts, F.coalesce(zone, F.lit("UTC")))).when(offset.isNotNull(), local_time(ts, offset)).otherwise(ts)
    source = F.when(trusted, "captured").when(zone.isNotNull(), "zone").when(offset.isNotNull(), "offset").otherwise("raw")
    return local, source


def item_quality(items: DataFrame) -> DataFrame:
    """Adds quality_score, exposure_score, noise_score and low_quality from sharpness, brightness, contrast, iso, clipping and the size."""
    c = F.col
    sharp, clip = scoring.clamp01(c("sharpness")), scoring.clamp01(c("clipping"))
    exposure = scoring.weighted_mean([(scoring.balanced(scoring.clamp01(c("brightness")), 0.55, 0.35), 0.6), (scoring.clamp01(c("contrast")), 0.4)])
    out = items.withColumns({"exposure_score": exposure, "noise_score": scoring.iso_score(c("iso"))})
    raw = scoring.weighted_mean([(sharp, 0.35), (sharp, 0.15), (c("exposure_score"), 0.3), (c("noise_score"), 0.2)])
    out = out.withColumn("quality_score", F.when(raw.isNotNull() & (clip > 0), F.greatest(F.lit(0.0), raw * (1 - F.least(F.lit(1.0), CLIPPING_WEIGHT * clip)))).otherwise(raw))
    noise_limit = F.greatest(F.lit(NOISE_FLOOR), LOW["noise"] - F.greatest(F.lit(0), NOISE_YEAR - F.year("ts")) * NOISE_DECAY)
    rules = [c("quality_score") < LOW["score"], c("width") * c("height") / 1e6 < LOW["megapixels"], sharp < LOW["sharpness"], c("exposure_score") < LOW["exposure"], c("noise_score") < noise_limit, clip > LOW["clipping"]]
    low = F.lit(False)
    for r in rules:
        low = low | F.coalesce(r, F.lit(False))
    return out.withColumn("low_quality", low)


def missing_fields(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows that lack a field, with the names of what they lack."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), n) for n, c in fields.items()]))
    return items.withColumn("missing", names).where(F.size("missing") > 0)


def dense_places(items: DataFrame, key: list[str], least: int, span: int, full: int, full_span: int) -> DataFrame:
    """Keys with enough items over enough time, and the larger of two ramps as confidence."""
    g = items.groupBy(*key).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    return g.where((F.col("n") >= least) & (F.col("span") >= span)).withColumn("confidence", F.greatest(F.least(F.lit(1.0), F.col("n") / full), F.least(F.lit(1.0), F.col("span") / full_span)))


def content_kind(tokens: Column, sharpness: Column, colour: Column, contrast: Column, brightness: Column, ratio: Column, is_video: Column, fps: Column) -> Column:
    """(kind, confidence) of screenshots, documents, maps and screen recordings by added-up evidence; null below a half."""
    any_of = lambda *words: F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(False))
    add = lambda *parts: sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    scores = {
        "screen_recording": F.when(is_video, add((any_of("screenrec", "recording", "capture"), 0.6), (fps >= 45, 0.25))),
        "screenshot": add((any_of("screenshot", "screen", "bildschirmfoto"), 0.6), (ratio.between(1.55, 2.4), 0.15), (sharpness <= 0.35, 0.1), (colour <= 0.45, 0.15)),
        "map": add((any_of("map", "navigation", "atlas"), 0.55), (colour >= 0.45, 0.2)),
        "document": add((any_of("document", "scan", "receipt", "invoice"), 0.5), (colour <= 0.2, 0.2), (contrast >= 0.55, 0.15), ((brightness <= 0.18) | (brightness >= 0.82), 0.15)),
    }
    rows = F.array(*[F.struct(F.least(F.lit(1.0), F.coalesce(s, F.lit(0.0))).alias("confidence"), F.lit(-k).alias("order"), F.lit(name).alias("kind")) for k, (name, s) in enumerate(scores.items())])
    best = F.array_max(rows)
    return F.when(best["confidence"] >= 0.5, F.struct(best["kind"].alias("kind"), best["confidence"].alias("confidence")))


def scene_tags(parts: dict[str, Column], most: int = 6) -> Column:
    """The highest scored labels, as (label, score), ties by label; null scores are left out."""
    rows = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct((-s).alias("minus"), F.lit(label).alias("label"))) for label, s in parts.items()]))
    return F.transform(F.slice(F.array_sort(rows), 1, most), lambda x: F.struct(x["label"].alias("label"), (-x["minus"]).alias("score")))


def still_quality(sharpness: Column, clipping: Column, contrast: Column, noise: Column, blocks: Column) -> Column:
    """Quality of a still from raw measures by fixed ranges."""
    return scoring.weighted_mean(
        [(scoring.ramp(sharpness, 0.0004, 0.004), 0.35), (1 - scoring.ramp(clipping, 0.02, 0.18), 0.2), (scoring.ramp(contrast, 0.05, 0.25), 0.2), (1 - scoring.ramp(noise, 0.005, 0.05), 0.15), (1 - scoring.ramp(blocks, 0.01, 0.08), 0.1)]
    )


#: Weights of a point of interest's tags, of its category, of single tag values, and of what else is known of it.
POI_TAGS = {"tourism": 600, "historic": 450, "man_made": 220, "leisure": 140, "natural": 140, "place": 130, "sport": 60, "landuse": 25}
POI_CATEGORIES = {"tourism": 220, "historic": 180, "man_made": 150, "leisure": 90, "natural": 90, "place": 80, "sport": 50}
POI_VALUES = {("man_made", "tower"): 260}
POI_NAME, POI_CATEGORY_VALUE, POI_WIKIDATA, POI_METRES = 100, 30, 120, 25


def poi_score(category: Column, name: Column, wikidata: Column, distance_m: Column, value: Column | None = None, tags: Column | None = None) -> Column:
    """Weight of a point of interest: its category (key and value), its tags (a map; without one the category is the only tag), a name, an encyclopaedia entry, less a point for each 25 m."""
    points = lambda known, key: F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[key], F.lit(0))
    flag = lambda c, w: F.when(c.isNotNull(), w).otherwise(0)
    value = value if value is not None else F.lit(None).cast("string")
    if tags is None:
        tags = F.when(category.isNotNull(), F.create_map(category, F.coalesce(value, F.lit(""))))
    total = points(POI_CATEGORIES, category) + flag(name, POI_NAME) + flag(value, POI_CATEGORY_VALUE)
    total = total + flag(F.coalesce(wikidata, F.try_element_at(tags, F.lit("wikidata"))), POI_WIKIDATA)
    for key, weight in POI_TAGS.items():
        total = total + flag(F.try_element_at(tags, F.lit(key)), weight)
    for (key, wanted), weight in POI_VALUES.items():
        total = total + F.when(F.try_element_at(tags, F.lit(key)) == wanted, weight).otherwise(0)
    return total - F.when(distance_m > 0, F.floor(distance_m / POI_METRES)).otherwise(0)


def primary_poi(pois: Column) -> Column:
    """The best scored of an array of points of interest (id, category, name, wikidata, distance_m); ties by id."""
    rows = F.transform(pois, lambda p: F.struct(poi_score(p["category"], p["name"], p["wikidata"], p["distance_m"]).alias("score"), (-p["id"]).alias("order"), p.alias("poi")))
    return F.array_max(rows)["poi"]


def clean_pois(elements: DataFrame, lat: float, lon: float, radius_m: float, limit: int) -> DataFrame:
    """Named elements with a known category within a radius, each id once (the nearest), the nearest first."""
    d = elements.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), lat, lon))
    d = d.where(F.col("category").isNotNull() & F.col("name").isNotNull() & (F.col("distance_m") <= radius_m))
    return d.groupBy("id").agg(F.min_by(F.struct("category", "name", "distance_m"), "distance_m").alias("p")).select("id", "p.*").orderBy("distance_m", "id").limit(limit)


def poi_radius(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column, least: float = 250.0) -> Column:
    """Search radius of a place: its farthest edge, `least` at least."""
    edges = [haversine_m(lat, lon, a, b) for a, b in ((south, lon), (north, lon), (lat, west), (lat, east))]
    return F.greatest(F.lit(least), *edges)


def device_key(maker: Column, model: Column, owner: Column) -> Column:
    """Maker, model and owner as a key; the maker is left out where the model begins with it."""
    maker, model = F.trim(maker), F.trim(model)
    named = F.when(F.lower(model).startswith(F.lower(maker)), model).otherwise(F.concat_ws(" ", maker, model))
    return F.concat_ws("|", F.nullif(F.lower(named), F.lit("")), F.lower(F.trim(owner)))


def normalised_time(items: DataFrame, order: tuple[str, ...] = ("filename", "mtime"), plausible_minutes: int = 720) -> DataFrame:
    """Adds taken, taken_source and minutes_off to items (taken_at, time_source, path, mtime).

    A time from the item itself (exif, or any source but mtime) stays. Else the sources in `order` are tried: the time stamp in the file name,
    read as UTC, and the file's own. minutes_off tells by how much the file's time is away, if by more than `plausible_minutes`.
    """
    from tidemark.functions.calendar import filename_time

    own = (F.col("time_source") == "exif") | (F.col("taken_at").isNotNull() & F.col("time_source").isNotNull() & (F.col("time_source") != "mtime"))
    own = F.coalesce(own, F.lit(False))
    found = {"filename": filename_time(F.col("path")), "mtime": F.col("mtime")}
    tried = F.coalesce(*[F.when(found[name].isNotNull(), F.struct(found[name].alias("at"), F.lit(name).alias("source"))) for name in order], F.struct(F.col("taken_at").alias("at"), F.col("time_source").alias("source")))
    best = F.when(own, F.struct(F.col("taken_at").alias("at"), F.col("time_source").alias("source"))).otherwise(tried)
    out = items.withColumn("__t", best).withColumns({"taken": F.col("__t.at"), "taken_source": F.col("__t.source")}).drop("__t")
    off = F.floor(F.abs(F.unix_timestamp("taken") - F.unix_timestamp("mtime")) / 60)
    return out.withColumn("minutes_off", F.when(off > plausible_minutes, off))


def reliable_range(drafts: DataFrame, members: DataFrame, key: list[str], samples: int = 3, coverage: float = 0.6, year: int = 1990) -> DataFrame:
    """Drafts with t_from and t_to: as they stand if they are a range from `year` on, else from the members (key, t), if at least `samples` of them and that share of all have a time from then on; else null."""
    least = F.unix_timestamp(F.to_timestamp(F.lit(f"{year:04d}-01-01")))
    good = (F.col("t_from") > 0) & (F.col("t_to") >= F.col("t_from")) & (F.col("t_from") >= least)
    timed = F.when(F.col("t") >= least, F.col("t"))
    found = members.groupBy(*key).agg(F.count("*").alias("__all"), F.count(timed).alias("__timed"), F.min(timed).alias("__a"), F.max(timed).alias("__b"))
    enough = (F.col("__timed") >= samples) & (F.col("__timed") >= coverage * F.col("__all"))
    out = drafts.join(found, key, "left").withColumn("__good", F.coalesce(good, F.lit(False)))
    both = {c: F.when(F.col("__good"), F.col(c)).when(enough, F.col(x)) for c, x in (("t_from", "__a"), ("t_to", "__b"))}
    return out.withColumns(both).drop("__all", "__timed", "__a", "__b", "__good")


def link_places(items: DataFrame, places: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Items with the nearest stored place (place_id, lat, lon) within a distance, and how far it is; ties by place_id. Items without one have nulls.

    Takes the part of geocoding. Items are grouped by their coordinates rounded to five digits first, so a spot is looked up once; places are looked up in cells as wide as the distance.
    """
    from tidemark.functions.geo import haversine_m

    rows = items.withColumns({"__y": F.round("lat", 5), "__x": F.round("lon", 5)})
    spots = rows.where("__y is not null and __x is not null").select("__y", "__x").distinct()
    step = metres / 111_000.0
    # The width of a cell in degrees of longitude is that of its band's side nearer to the pole.
    band = lambda y: F.floor(y / step)
    width = lambda b: step / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(b * step), F.abs((b + 1) * step)), F.lit(89.0)))), F.lit(0.01))
    near = lambda k: F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])).alias(k)
    look = spots.select("*", near("__dy")).withColumn("__b", band(F.col("__y")) + F.col("__dy")).select("*", near("__dx"))
    look = look.withColumn("__c", F.floor(F.col("__x") / width(F.col("__b"))) + F.col("__dx"))
    known = places.where("lat is not null and lon is not null").select("place_id", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), band(F.col("lat")).alias("__b"))
    known = known.withColumn("__c", F.floor(F.col("__lon") / width(F.col("__b"))))
    pairs = look.join(known, ["__b", "__c"]).withColumn("__m", haversine_m(F.col("__y"), F.col("__x"), F.col("__lat"), F.col("__lon"))).where(F.col("__m") <= metres)
    best = pairs.groupBy("__y", "__x").agg(F.min(F.struct("__m", "place_id")).alias("__best"))
    out = rows.join(best, ["__y", "__x"], "left")
    return out.withColumns({"place_id": F.col("__best.place_id"), "place_metres": F.col("__best.__m")}).drop("__y", "__x", "__best")
