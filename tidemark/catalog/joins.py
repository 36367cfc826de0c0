"""Joins by similarity, interval, nearness and set overlap."""

from pyspark.sql import functions as F

from tidemark.catalog.base import ITEMS, haversine, items, query
from tidemark.operators import density, joins
from tidemark.sources.bindings import members_of_orders, table

_HASHED = """h AS (SELECT item_id, substr(phash, 1, 2) AS block, ('0x' || phash)::UBIGINT AS h FROM items)"""


@query(f"WITH {ITEMS}, {_HASHED} SELECT a.item_id, b.item_id AS other, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, row_number() OVER (PARTITION BY a.item_id ORDER BY bit_count(xor(a.h, b.h)), b.item_id) AS rank FROM h a JOIN h b ON a.block = b.block AND a.item_id <> b.item_id AND bit_count(xor(a.h, b.h)) <= 24 QUALIFY rank <= 4")
def hamming_nearest(spark, d):
    return joins.hamming_nearest(items(spark, d), items(spark, d), "item_id", 24, 4, 2)


@query(f"WITH {ITEMS}, p AS (SELECT phash, min(item_id) AS first, substr(phash, 1, 2) AS block, ('0x' || phash)::UBIGINT AS h FROM items GROUP BY phash) SELECT a.first AS a, b.first AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM p a JOIN p b ON a.block = b.block AND a.first < b.first AND bit_count(xor(a.h, b.h)) <= 18 UNION ALL SELECT first, item_id, 0 FROM items JOIN p USING (phash) WHERE item_id > first")
def near_duplicate_edges(spark, d):
    return density.similar_hash_pairs(items(spark, d), 2, 18)


_STAYS = "stays AS (SELECT user_id, t AS s, t + 20000 AS e, item_id AS stay FROM items WHERE device = 'purchase')"


def _stays(spark, d):
    return items(spark, d).where("device = 'purchase'").select("user_id", F.col("t").alias("s"), (F.col("t") + 20000).alias("e"), F.col("item_id").alias("stay"))


@query(f"WITH {ITEMS}, {_STAYS} SELECT item_id, stay FROM items JOIN stays USING (user_id) WHERE t BETWEEN s AND e QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY s, e, stay) = 1")
def staypoint_interval_join(spark, d):
    return joins.first_interval(items(spark, d), _stays(spark, d), ["user_id"], "item_id", "t", "s", "e", 20000).select("item_id", "stay")


@query(f"WITH {ITEMS}, q AS (SELECT user_id, t, item_id FROM items WHERE device = 'purchase'), v AS (SELECT user_id, t, item_id AS view_id, value FROM items WHERE device = 'view') SELECT q.item_id, v.view_id AS view_id_asof, v.value AS value_asof FROM q LEFT JOIN v ON v.user_id = q.user_id AND v.t <= q.t QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY v.t DESC, v.view_id DESC) = 1")
def asof_join(spark, d):
    rows = items(spark, d)
    left = rows.where("device = 'purchase'").select("user_id", "t", "item_id")
    right = rows.where("device = 'view'").select("user_id", "t", F.col("item_id").alias("view_id"), "value")
    return joins.asof_join(left, right, ["user_id"], "t", ["view_id", "value"], "view_id").select("item_id", "view_id_asof", "value_asof")


@query(
    f"""WITH {ITEMS} SELECT a.item_id, b.item_id AS other, abs(a.t - b.t) AS gap FROM items a JOIN items b ON a.user_id = b.user_id AND a.item_id <> b.item_id AND a.is_video AND NOT b.is_video AND abs(a.t - b.t) <= 40000
    QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY abs(a.t - b.t) * 100 + bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)), b.item_id) = 1"""
)
def live_pairs(spark, d):
    from tidemark.functions.hashing import hamming_bits, hex_bits

    rows = items(spark, d).select("user_id", "t", "item_id", "is_video", hex_bits(F.col("phash")).alias("h"))
    cost = F.col("gap") * 100 + hamming_bits(F.col("h"), F.col("h_r"))
    return joins.nearest_in_time(rows.where("is_video"), rows.where("not is_video"), ["user_id"], "t", 40000, "item_id", "item_id", cost)


_SETS = "m AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS p FROM lineitem), z AS (SELECT d, count(*) AS n FROM m GROUP BY d)"


def _baskets(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("member")).distinct()


@query(f"WITH {_SETS}, i AS (SELECT a.d AS a, b.d AS b, count(*) AS shared FROM m a JOIN m b ON a.p = b.p AND a.d < b.d GROUP BY ALL) SELECT a, b, CAST(shared AS INTEGER) AS shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM i JOIN z x ON x.d = a JOIN z y ON y.d = b WHERE shared / (x.n + y.n - shared) >= 0.5 - 1e-12")
def member_overlaps(spark, d):
    return joins.set_overlaps(_baskets(spark, d), 0.5).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {_SETS}, i AS (SELECT a.d AS a, b.d AS b, count(*) AS shared FROM m a JOIN m b ON a.p = b.p AND a.d <> b.d GROUP BY ALL) SELECT a AS child, b AS parent FROM i JOIN z x ON x.d = a JOIN z y ON y.d = b WHERE shared = x.n AND (y.n > x.n OR (y.n = x.n AND b < a))")
def draft_subsets(spark, d):
    return joins.subsets(_baskets(spark, d))


_POINTS = "p AS (SELECT n_nationkey * 100 + s_suppkey % 100 AS item_id, 48 + (s_suppkey * 7919 % 1000) / 20000.0::DOUBLE AS lat, 11 + (s_suppkey * 104729 % 1000) / 20000.0::DOUBLE AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _points(spark, d):
    s = F.col("s_suppkey")
    made = table(spark, d, "supplier")
    return made.select(s.alias("item_id"), (48 + (s * 7919 % 1000) / 20000).alias("lat"), (11 + (s * 104729 % 1000) / 20000).alias("lon"))


_SUPPLIED = "p AS (SELECT s_suppkey AS item_id, 48 + (s_suppkey * 7919 % 1000) / 20000.0::DOUBLE AS lat, 11 + (s_suppkey * 104729 % 1000) / 20000.0::DOUBLE AS lon FROM supplier)"


@query(f"WITH {_SUPPLIED} SELECT a.item_id AS a, b.item_id AS b FROM p a JOIN p b ON a.item_id < b.item_id AND {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 600")
def near_pairs(spark, d):
    return density.near_pairs(_points(spark, d), 600)


@query(
    f"""WITH RECURSIVE {_SUPPLIED}, e AS (SELECT a.item_id AS a, b.item_id AS b FROM p a JOIN p b ON a.item_id <> b.item_id AND {haversine("a.lat", "a.lon", "b.lat", "b.lon")} <= 600),
    core AS (SELECT item_id FROM p LEFT JOIN e ON a = item_id GROUP BY item_id HAVING count(b) + 1 >= 3), ce AS (SELECT a, b FROM e WHERE a IN (SELECT item_id FROM core) AND b IN (SELECT item_id FROM core)),
    reach AS (SELECT item_id, item_id AS root FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.item_id), cores AS (SELECT item_id, min(root) AS cluster FROM reach GROUP BY item_id),
    border AS (SELECT e.a AS item_id, min(cluster) AS near FROM e JOIN cores ON cores.item_id = e.b GROUP BY e.a)
    SELECT p.item_id, coalesce(cluster, near) AS cluster FROM p LEFT JOIN cores USING (item_id) LEFT JOIN border USING (item_id)"""
)
def dbscan(spark, d):
    from tidemark.sources.scratch import Scratch

    return density.dbscan(_points(spark, d), 600, 3, Scratch(spark, "dbscan"))


@query(f"WITH {ITEMS} SELECT item_id, min(c) AS centers FROM (SELECT item_id, count(*) OVER (PARTITION BY substr(phash, 1, 3)) AS c FROM items) GROUP BY item_id")
def hash_prefix_lookup(spark, d):
    rows = items(spark, d).select("item_id", F.substring("phash", 1, 3).alias("p"))
    return rows.join(rows.groupBy("p").agg(F.count("*").alias("centers")), "p").select("item_id", "centers")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_join(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_anti_join(spark, d):
    orders = table(spark, d, "orders")
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(poor, "o_custkey", "left_semi").join(big, "o_orderkey", "left_anti").select("o_orderkey")


@query("WITH s AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS m FROM lineitem) SELECT a.d, len(list_distinct(list_concat(list(a.m), list(a.m + 1)))) AS union_size, CAST(count(*) AS INTEGER) AS members FROM s a GROUP BY a.d")
def member_set_algebra(spark, d):
    sets = members_of_orders(table(spark, d, "lineitem")).groupBy(F.col("draft_id").alias("d")).agg(F.array_sort(F.collect_list("member")).alias("m"))
    return sets.select("d", F.size(F.array_union("m", F.transform("m", lambda x: x + 1))).alias("union_size"), F.size("m").alias("members"))
