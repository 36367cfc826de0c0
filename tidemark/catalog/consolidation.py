"""Scores and consolidation of drafts. Drafts are customers' orders: members are their parts."""

from pyspark.sql import functions as F

from tidemark.catalog.base import ELIGIBLE, haversine, items, query
from tidemark.operators import consolidate as C
from tidemark.operators import joins, score
from tidemark.operators.scans import eligible
from tidemark.sources.bindings import table
from tidemark.sources.scratch import Scratch

#: Drafts: one per order.
_DRAFTS = """m AS (SELECT DISTINCT l_orderkey AS draft_id, l_partkey AS member FROM lineitem),
 drafts AS (SELECT o_orderkey AS draft_id, CASE o_orderkey % 4 WHEN 0 THEN 'burst' WHEN 1 THEN 'trip' WHEN 2 THEN 'session' ELSE 'day' END AS algorithm, o_orderkey % 3 AS priority, round(o_totalprice / 500000, 9) * CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS score,
  (SELECT 1) AS one, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t_from, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 86400 * (o_orderkey % 5) AS t_to, count(member) AS n, list_sort(list(member)) AS members
  FROM orders JOIN m ON m.draft_id = o_orderkey GROUP BY ALL)"""


def members(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("member")).distinct()


def drafts(spark, d, rows=None):
    from tidemark.functions.calendar import seconds

    o = F.col("o_orderkey")
    sets = (members(spark, d) if rows is None else rows).groupBy("draft_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("member")).alias("members"))
    head = table(spark, d, "orders").select(
        o.alias("draft_id"), F.when(o % 4 == 0, "burst").when(o % 4 == 1, "trip").when(o % 4 == 2, "session").otherwise("day").alias("algorithm"), (o % 3).alias("priority"),
        (F.round(F.col("o_totalprice") / 500000, 9) * F.when(o % 9 == 0, 0).otherwise(1)).alias("score"), seconds(F.col("o_orderdate")).alias("t_from"), (seconds(F.col("o_orderdate")) + 86400 * (o % 5)).alias("t_to"),
    )
    return head.join(sets, "draft_id")


_EFFECTIVE = "CASE WHEN score > 0 THEN score ELSE n END"


@query(f"WITH {_DRAFTS} SELECT draft_id, round({_EFFECTIVE}, 9) AS effective FROM drafts WHERE n >= 2 AND {_EFFECTIVE} >= 0.25")
def draft_filter(spark, d):
    return C.filter_drafts(drafts(spark, d)).select("draft_id", F.round("effective", 9).alias("effective"))


@query(f"WITH {_DRAFTS} SELECT draft_id FROM drafts QUALIFY row_number() OVER (PARTITION BY algorithm, members ORDER BY score DESC, n DESC, draft_id DESC) = 1")
def duplicate_collapse(spark, d):
    return C.collapse_duplicates(drafts(spark, d), ["algorithm", "members"], [F.desc("score"), F.desc("n")]).select("draft_id")


@query(f"WITH {_DRAFTS}, f AS (SELECT draft_id, algorithm, sha1(array_to_string(members, ',')) AS fingerprint FROM drafts) SELECT algorithm, fingerprint, min(draft_id) AS draft_id FROM f GROUP BY ALL HAVING (algorithm, fingerprint) NOT IN (SELECT (algorithm, fingerprint) FROM f WHERE algorithm = 'burst')")
def insert_if_absent(spark, d):
    from tidemark.functions.hashing import fingerprint

    made = drafts(spark, d).select("draft_id", "algorithm", fingerprint(F.col("members")).alias("fingerprint"))
    return C.insert_new(made, made.where("algorithm = 'burst'")).select("algorithm", "fingerprint", "draft_id")


_SHARED = "i AS (SELECT a.draft_id AS a, b.draft_id AS b, count(*) AS shared FROM m a JOIN m b ON a.member = b.member AND a.draft_id < b.draft_id GROUP BY ALL)"


@query(
    f"""WITH {_DRAFTS}, i AS (SELECT a.draft_id AS child, b.draft_id AS parent, count(*) AS shared FROM m a JOIN m b ON a.member = b.member AND a.draft_id <> b.draft_id GROUP BY ALL),
    pairs AS (SELECT child, parent FROM i JOIN drafts x ON x.draft_id = child JOIN drafts y ON y.draft_id = parent WHERE shared = x.n AND (y.n > x.n OR (y.n = x.n AND parent < child))),
    k AS (SELECT draft_id, row_number() OVER (ORDER BY priority DESC, {_EFFECTIVE} DESC, n DESC, draft_id) AS r FROM drafts),
    o AS (SELECT CASE WHEN c.r < p.r THEN parent ELSE child END AS other_id, CASE WHEN c.r < p.r THEN child ELSE parent END AS preferred_id, least(c.r, p.r) AS best FROM pairs JOIN k c ON c.draft_id = child JOIN k p ON p.draft_id = parent)
    SELECT other_id, arg_min(preferred_id, best) AS preferred_id FROM o GROUP BY other_id"""
)
def nesting(spark, d):
    return C.nest(joins.subsets(members(spark, d)), drafts(spark, d))


@query()
def dominance(spark, d):
    """Greedy over all drafts, best first; tests hold it against the plain pass."""
    made = C.effective_score(drafts(spark, d)).withColumn("order", F.struct((-F.col("effective")).alias("s"), (-F.col("n")).alias("n"), "draft_id"))
    return C.dominant(made, joins.set_overlaps(members(spark, d), 0.5), "order", Scratch(spark, "dominance")).select("draft_id", "algorithm")


@query(
    f"""WITH {_DRAFTS}, {_SHARED}, j AS (SELECT a, b, shared / (x.n + y.n - shared) AS jac, x.algorithm AS aa, y.algorithm AS ab, x.priority AS pa, y.priority AS pb, CASE WHEN x.score > 0 THEN x.score ELSE x.n END AS ea, CASE WHEN y.score > 0 THEN y.score ELSE y.n END AS eb, x.n AS na, y.n AS nb, x.t_from AS fa, x.t_to AS ta, y.t_from AS fb, y.t_to AS tb
     FROM i JOIN drafts x ON x.draft_id = a JOIN drafts y ON y.draft_id = b WHERE shared / (x.n + y.n - shared) >= 0.5 - 1e-12), h AS (SELECT *, pa > pb OR (pa = pb AND (ea > eb OR (ea = eb AND (na > nb OR (na = nb AND a < b))))) AS lw FROM j WHERE jac >= 0.85 OR (aa = ab AND jac >= 0.5))
    SELECT CASE WHEN lw THEN a ELSE b END AS winner, CASE WHEN lw THEN b ELSE a END AS loser, CASE WHEN CASE WHEN greatest(ta, tb) - least(fa, fb) > 0 THEN greatest(0, least(ta, tb) - greatest(fa, fb)) / (greatest(ta, tb) - least(fa, fb)) WHEN fa = fb AND ta = tb THEN 1.0 ELSE 0 END >= 0.01 THEN 'merge' ELSE 'drop' END AS action FROM h"""
)
def overlap_actions(spark, d):
    made = drafts(spark, d).withColumn("sub_story", F.lit(False))
    return C.overlap_actions(joins.set_overlaps(members(spark, d), 0.5), made, 0.5, 0.85, 0.01)


@query()
def annotation_pruning(spark, d):
    return C.prune_annotations(drafts(spark, d), {"burst": 0.35, "session": 0.2}, Scratch(spark, "annotations"))


@query()
def per_member_caps(spark, d):
    made = drafts(spark, d).select("draft_id", F.col("algorithm").alias("grouping"), "score", "priority", F.transform("members", lambda m: m % 40 + 40 * (F.col("draft_id") % 200)).alias("members"))
    return C.per_member_cap(made.withColumn("cover", F.col("members")[0]), Scratch(spark, "caps"))


@query(
    f"""WITH {ELIGIBLE}, r AS (SELECT user_id AS draft_id, item_id, quality, sharpness, row_number() OVER (PARTITION BY user_id, phash ORDER BY t * 100000 + item_id) - 1 AS repeat, t * 100000 + item_id AS position FROM eligible),
    s AS (SELECT *, round(greatest(0.0, 0.7 * quality + 0.3 * coalesce(sharpness, quality) - CASE WHEN repeat > 0 THEN least(1.0, 0.35 * (1 + 0.5 * (repeat - 1))) ELSE 0 END), 9) AS score FROM r)
    SELECT draft_id, item_id, repeat, round(score, 6) AS score, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, position) AS rank FROM s"""
)
def member_ranking(spark, d):
    rows = eligible(items(spark, d)).select(F.col("user_id").alias("draft_id"), "item_id", "quality", F.col("sharpness").alias("aesthetics"), "phash", (F.col("t") * 100000 + F.col("item_id")).alias("position"))
    return C.member_ranks(rows).select("draft_id", "item_id", "repeat", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_DRAFTS} SELECT draft_id, CASE WHEN strftime(to_timestamp(t_from) AT TIME ZONE 'UTC', '%d.%m.%Y') = strftime(to_timestamp(t_to) AT TIME ZONE 'UTC', '%d.%m.%Y') THEN 'P' || priority || ', ' || strftime(to_timestamp(t_from) AT TIME ZONE 'UTC', '%d.%m.%Y') ELSE 'P' || priority || ', ' || strftime(to_timestamp(t_from) AT TIME ZONE 'UTC', '%d.%m.%Y') || ' – ' || strftime(to_timestamp(t_to) AT TIME ZONE 'UTC', '%d.%m.%Y') END AS title, n || ' items' AS subtitle FROM drafts")
def titles(spark, d):
    made = drafts(spark, d).withColumn("place", F.concat(F.lit("P"), F.col("priority").cast("string")))
    return C.titled(made).select("draft_id", "title", "subtitle")


AS_OF = 1706745600
_SPAN = "CASE WHEN h < 0.5 THEN h / 0.5 WHEN h <= 48 THEN 1 - 0.4 * (h - 0.5) / 47.5 ELSE greatest(0.0, 0.6 * (1 - (h - 48) / 192)) END"
_SCORES = f"""{ELIGIBLE}, c AS (SELECT *, avg(lat) OVER w AS a, avg(lon) OVER w AS b FROM eligible WINDOW w AS (PARTITION BY device, day)),
 g AS (SELECT device, day, count(*) AS n, min(t) AS t_from, max(t) AS t_to, avg(quality) AS quality, count(lat) AS placed, count(tag) AS tags, count(DISTINCT tag) AS utags, avg(CASE WHEN is_video THEN 1.0 ELSE 0.0 END) AS video, sum(len(persons)) AS mentions, max({haversine("lat", "lon", "a", "b")}) AS radius FROM c GROUP BY ALL),
 u AS (SELECT device, day, count(DISTINCT p) AS uniq FROM (SELECT device, day, unnest(persons) AS p FROM eligible) GROUP BY ALL),
 s AS (SELECT *, (t_to - t_from) / 3600.0::DOUBLE AS h, 0.4 + 0.35 * least(1.0, uniq / 4) + 0.25 * least(1.0, mentions / n) AS people, 0.4 * tags / n + 0.35 * least(1.0, utags / 8) + 0.25 * least(1.0, tags / n) AS content, least(1.0, n / greatest(60.0, (t_to - t_from) / 60.0)) AS density,
  CASE WHEN day = DATE '2024-01-01' THEN 1.0 WHEN isodow(day) >= 6 THEN 0.5 ELSE 0.0 END AS holiday, 1 - least(1.0, greatest(0.0, ({AS_OF} - t_to) / 86400.0) / 365) AS recency, 0.7 * placed / n + 0.3 * greatest(0.0, least(1.0, 1 - coalesce(radius / 1000, 10.0) / 10)) AS location,
  (least(1.0, video / 0.3) * 0.45 + 0 + least(1.0, video / 0.4) * 0.3) AS liveliness FROM g JOIN u USING (device, day)),
 scored AS (SELECT *, 0.22 * quality + 0.08 * quality + 0.16 * people + 0.09 * content + 0.10 * density + 0.07 * holiday + 0.12 * recency + 0.05 * location + 0.10 * (0.55 + 0.45 * ({_SPAN})) + 0.08 * liveliness AS score FROM s)"""


def _scored(spark, d):
    return score.composite(score.draft_parts(eligible(items(spark, d)), ["device", "day"], AS_OF))


@query(f"WITH {_SCORES} SELECT device, day, n, round(people, 9) AS people, round(content, 9) AS content, round(density, 9) AS density, holiday, round(recency, 9) AS recency, round(location, 9) AS location, round(liveliness, 9) AS liveliness, round(score, 9) AS score FROM scored", text="day")
def composite_score(spark, d):
    return _scored(spark, d).select("device", "day", "n", *[F.round(c, 9).alias(c) for c in ("people", "content", "density", "holiday", "recency", "location", "liveliness", "score")])


@query(
    f"""WITH {_SCORES}, q AS (SELECT device, min(score) AS lo, quantile_cont(CAST(score AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(score AS DOUBLE), 0.75) AS q3, max(score) AS hi FROM scored GROUP BY device)
    SELECT device, day, round(CASE WHEN hi - lo <= 1e-9 THEN 0.5 WHEN score <= lo THEN 0.1 WHEN score >= hi THEN 0.9 WHEN score <= q1 THEN 0.1 + 0.2 * (score - lo) / (q1 - lo) WHEN score <= q3 THEN 0.3 + 0.4 * (score - q1) / (q3 - q1) ELSE 0.7 + 0.2 * (score - q3) / (hi - q3) END, 6) AS normalised FROM scored JOIN q USING (device)""",
    text="day",
)
def normalised_score(spark, d):
    return score.normalise(_scored(spark, d), "device").select("device", "day", F.round("normalised", 6).alias("normalised"))
