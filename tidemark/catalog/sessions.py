"""Sessions, runs and sequential scans."""

from pyspark.sql import functions as F

from tidemark.catalog.base import DIGEST, ELIGIBLE, ITEMS, haversine, items, query
from tidemark.operators import islands, strategies
from tidemark.operators.scans import eligible

HEAD = "count(*) AS n, min(t) AS t_from, max(t) AS t_to"
SHOW = ["user_id", "n", "t_from", "t_to", "digest"]


def runs_sql(source: str, breaks: str, key: str = "user_id", name: str = "runs", columns: str = "*") -> str:
    """Islands over (t, item_id)."""
    return f"""{name}_b AS (SELECT {columns}, {breaks} AS brk FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY t, item_id)),
 {name} AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY t, item_id ROWS UNBOUNDED PRECEDING) AS run FROM {name}_b)"""


@query(f"WITH {ELIGIBLE}, {runs_sql('eligible', 't - lag(t) OVER w > 21600')} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM runs GROUP BY user_id, run HAVING count(*) >= 3")
def gap_sessions(spark, d):
    return strategies.gap_sessions(eligible(items(spark, d)), ["user_id"], 21600, 3).select(*SHOW)


_FAR = f"t - lag(t) OVER w > 43200 OR coalesce({haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} > 600, FALSE)"


@query(f"WITH {ELIGIBLE}, {runs_sql('eligible', _FAR)} SELECT user_id, {HEAD}, {DIGEST} AS digest FROM runs GROUP BY user_id, run HAVING count(*) >= 2")
def gap_distance_sessions(spark, d):
    rows = islands.gap_distance_runs(eligible(items(spark, d)), ["user_id"], 43200, 600)
    return strategies.drafts(rows, "session", ["user_id", "run"], 2).select(*SHOW)


@query(f"WITH {ITEMS}, d AS (SELECT DISTINCT user_id, day FROM items), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d) SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS days FROM r GROUP BY user_id, island HAVING count(*) >= 2", text="first last")
def consecutive_day_runs(spark, d):
    days = islands.day_runs(items(spark, d).select("user_id", "day").distinct(), ["user_id"])
    return days.groupBy("user_id", "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).where("days >= 2").select("user_id", "first", "last", "days")


@query(
    f"""WITH RECURSIVE {ITEMS}, s AS (SELECT user_id, t, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t, item_id) AS k FROM items),
 w AS (SELECT user_id, t, item_id, k, t AS anchor, 0 AS win FROM s WHERE k = 1
  UNION ALL SELECT s.user_id, s.t, s.item_id, s.k, CASE WHEN s.t - w.anchor <= 86400 THEN w.anchor ELSE s.t END, CASE WHEN s.t - w.anchor <= 86400 THEN w.win ELSE w.win + 1 END FROM w JOIN s ON s.user_id = w.user_id AND s.k = w.k + 1)
 SELECT user_id, win AS "window", count(*) AS n, min(t) AS t_from, {DIGEST} AS digest FROM w GROUP BY 1, 2"""
)
def anchored_windows(spark, d):
    rows = islands.anchored_windows(items(spark, d).select("user_id", "t", "item_id", "lat", "lon"), ["user_id"], 86400)
    return strategies.drafts(rows, "window", ["user_id", "window"]).select("user_id", "window", "n", "t_from", "digest")


@query(text="day")
def anchored_near_windows(spark, d):
    return strategies.time_similarity(eligible(items(spark, d)), ["user_id"], 10800, 250.0, 1).select("user_id", "day", "window", "n", "digest")


@query()
def staypoints(spark, d):
    return islands.staypoints(items(spark, d), ["user_id"], 400.0, 3600)
