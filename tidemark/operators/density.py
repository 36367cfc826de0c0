"""Density clusters and graph components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_m
from tidemark.functions.hashing import hex_bits
from tidemark.operators.joins import hash_pairs
from tidemark.sources.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes of undirected edges (a, b); root is the smallest node. In each round every node takes the least label among its neighbours, then the label of its label."""
    both = edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.table(both, f"{name}_edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}_0")
    for k in range(1, rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = scratch.table(labels.join(seen, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new")), f"{name}_{k}s")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = scratch.table(step.join(jump, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")), f"{name}_{k}")
        labels = after.select("node", "root")
        if not after.where("old != root").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels


def near_pairs(points: DataFrame, metres: float, key: list[str] | None = None, id_column: str = "item_id") -> DataFrame:
    """(a, b) of the points at most `metres` apart, a before b, by a grid of cells as wide as the distance: each point is looked up in its own and the eight cells around."""
    key = key or []
    lat_step = metres / 111_000.0
    # A cell's width in degrees of longitude holds for its band's side nearer to the pole.
    band = F.floor(F.col("lat") / lat_step)
    edge = F.greatest(F.abs(band * lat_step), F.abs((band + 1) * lat_step))
    p = points.where("lat is not null and lon is not null").select(*key, id_column, "lat", "lon", band.cast("bigint").alias("y"), edge.alias("edge"))
    width = lambda e: lat_step / F.greatest(F.cos(F.radians(F.least(e, F.lit(89.0)))), F.lit(0.01))
    own = p.withColumn("x", F.floor(F.col("lon") / width(F.col("edge"))).cast("bigint"))
    around = p.withColumn("dy", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    around = around.withColumn("y", F.col("y") + F.col("dy")).withColumn("edge", F.greatest(F.abs(F.col("y") * lat_step), F.abs((F.col("y") + 1) * lat_step)))
    around = around.withColumn("x", F.floor(F.col("lon") / width(F.col("edge"))).cast("bigint")).withColumn("dx", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    around = around.select(*key, (F.col("x") + F.col("dx")).alias("x"), "y", F.col(id_column).alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = own.withColumnRenamed(id_column, "a").join(around, [*key, "x", "y"]).where("a < b")
    return pairs.where(haversine_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) <= metres).select(*key, "a", "b")


def dbscan(points: DataFrame, metres: float, least: int, scratch: Scratch, key: list[str] | None = None, id_column: str = "item_id") -> DataFrame:
    """(key, item_id, cluster): cluster is the smallest core item of a density cluster, null for noise. A point counts itself among its neighbours; border points go to the cluster with the lowest id."""
    key = key or []
    pairs = scratch.table(near_pairs(points, metres, key, id_column), "pairs")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias(id_column)).agg((F.count("*") + 1).alias("degree"))
    placed = points.where("lat is not null and lon is not null").select(*key, id_column)
    core = scratch.table(placed.join(degree, id_column, "left").where(F.coalesce("degree", F.lit(1)) >= least).select(id_column), "core")
    ids = core.select(F.col(id_column).alias("a"))
    inner = pairs.join(ids, "a", "left_semi").join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    roots = components(inner, scratch, "dbscan")
    cores = scratch.table(core.join(roots.withColumnRenamed("node", id_column), id_column, "left").select(id_column, F.coalesce("root", id_column).alias("cluster")), "cores")
    reach = both.join(cores.withColumnRenamed(id_column, "b"), "b").groupBy(F.col("a").alias(id_column)).agg(F.min("cluster").alias("near"))
    out = placed.join(cores, id_column, "left").join(reach, id_column, "left")
    return out.select(*key, id_column, F.coalesce("cluster", "near").alias("cluster"))


def drop_outliers(points: DataFrame, metres: float, least: int, scratch: Scratch, key: list[str]) -> DataFrame:
    """Located points that aren't noise; all of a key's points if all are noise."""
    found = dbscan(points, metres, least, scratch, key)
    good = found.groupBy(*key).agg(F.count("cluster").alias("__good"))
    return points.join(found.join(good, key).where("cluster is not null or __good = 0").select("item_id"), "item_id", "left_semi")


def similar_hash_pairs(items: DataFrame, prefix: int = 4, bits: int = 5, hash_column: str = "phash", id_column: str = "item_id") -> DataFrame:
    """(a, b, distance), a before b, of items whose hash begins alike and differs in few bits. Equal hashes are joined once as a class: the pairs are those between classes, and each class's items with its first."""
    rows = items.where(F.col(hash_column).isNotNull()).select(id_column, hash_column)
    rows = rows.withColumn("h", hex_bits(F.col(hash_column))).where("h is not null")
    classes = rows.groupBy("h").agg(F.min(id_column).alias("first"))
    other = classes.select(F.col("h").alias("g"), F.col("first").alias("first_b"))
    between = hash_pairs(classes, other, prefix, bits).where("first < first_b")
    same = rows.join(classes, "h").where(F.col(id_column) > F.col("first")).select(F.col("first").alias("a"), F.col(id_column).alias("b"), F.lit(0).alias("distance"))
    return between.select(F.col("first").alias("a"), F.col("first_b").alias("b"), "distance").unionByName(same)


def similar_hash_groups(items: DataFrame, scratch: Scratch, prefix: int = 4, bits: int = 5) -> DataFrame:
    """Items with the component (smallest item) of the similarity graph that they are in."""
    roots = components(similar_hash_pairs(items, prefix, bits).select("a", "b"), scratch, "hashes")
    return items.join(roots.select(F.col("node").alias("item_id"), F.col("root").alias("component")), "item_id")
