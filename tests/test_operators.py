import random
import time
from collections import Counter
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, consolidate, curate, density, enrich, feed, islands, joins, scans, score, strategies, trips
from tidemark.operators.islands import _metres
from tidemark.sources.scratch import Scratch

ITEM = "user_id bigint, item_id bigint, t bigint, lat double, lon double"


def pairs(rows):
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("gap,runs", [(9, 2), (10, 1)])
def test_gap_is_inclusive(spark, gap, runs):
    rows = spark.createDataFrame([(1, 1, 0, None, None), (1, 2, 10, None, None)], ITEM)
    assert islands.gap_runs(rows, ["user_id"], gap).select("run").distinct().count() == runs


def test_unknown_places_do_not_break_runs(spark):
    rows = spark.createDataFrame([(1, 1, 0, 48.0, 11.0), (1, 2, 1, None, None), (1, 3, 2, 48.0, 11.0), (1, 4, 3, 49.0, 11.0)], ITEM)
    assert pairs(islands.gap_distance_runs(rows, ["user_id"], 10, 100).select("item_id", "run")) == [(1, 0), (2, 0), (3, 0), (4, 1)]


def test_least_size(spark):
    rows = spark.createDataFrame([(1, k, k, None, None) for k in range(3)] + [(2, k, k, None, None) for k in range(2)], ITEM)
    assert strategies.gap_sessions(rows, ["user_id"], 10, 3).count() == 1
    assert strategies.gap_sessions(rows, ["user_id"], 10, 4).count() == 0


def test_digest_ignores_order_and_tells_sets_apart(spark):
    make = lambda ids: strategies.drafts(spark.createDataFrame([(1, i, 0, None, None) for i in ids], ITEM), "x", ["user_id"]).first().digest
    assert make([1, 2, 3]) == make([3, 1, 2]) != make([1, 2, 4])


def windows_brute(rows, seconds, metres):
    out, anchor, n = [], None, -1
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        now = {"lat": r[3], "lon": r[4]}
        fits = anchor is not None and r[2] - anchor[0] <= seconds
        if fits and None not in (*now.values(), *anchor[1].values()):
            fits = _metres(anchor[1], now) <= metres
        if not fits:
            anchor, n = (r[2], now), n + 1
        out.append((r[0], r[1], n))
    return out


def walk(seed, n, users=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(users), k, rnd.randrange(40_000), *((48 + rnd.random() / 200, 11 + rnd.random() / 200) if rnd.random() < 0.8 else (None, None))) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_anchored_windows_against_plain_pass(spark, seed):
    rows = walk(seed, 200)
    got = islands.anchored_windows(spark.createDataFrame(rows, ITEM).repartition(3), ["user_id"], 4000, 250.0)
    want = [x for u in range(3) for x in windows_brute([r for r in rows if r[0] == u], 4000, 250.0)]
    assert pairs(got.select("user_id", "item_id", "window")) == sorted(want)


def stays_brute(rows, metres, dwell):
    rows = [{"lat": r[3], "lon": r[4], "t": r[2]} for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[3] is not None]
    out, i = [], 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and _metres(rows[i], rows[j]) <= metres:
            j += 1
        if rows[j - 1]["t"] - rows[i]["t"] >= dwell:
            out.append((rows[i]["t"], rows[j - 1]["t"], j - i))
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_staypoints_against_plain_pass(spark, seed):
    rows = walk(seed + 10, 150)
    got = islands.staypoints(spark.createDataFrame(rows, ITEM).repartition(3), ["user_id"], 400.0, 300)
    want = [(u, *s) for u in range(3) for s in stays_brute([r for r in rows if r[0] == u], 400.0, 300)]
    assert pairs(got.select("user_id", "start", "end", "n")) == sorted(want) and want


def dbscan_brute(points, metres, least):
    ids = [p[0] for p in points]
    near = {a[0]: [b[0] for b in points if _metres({"lat": a[1], "lon": a[2]}, {"lat": b[1], "lon": b[2]}) <= metres] for a in points}
    core = {i for i in ids if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo, label[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = i
                        todo.append(j)
    return {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in ids}


@pytest.mark.parametrize("lat", [0.0, 48.0, 89.5, -70.0])
def test_dbscan_against_plain_pass(spark, lat):
    rnd = random.Random(int(lat))
    points = [(k, lat + rnd.random() / 100, 179.9 - rnd.random() / 100) for k in range(120)]
    got = density.dbscan(spark.createDataFrame([*points, (999, None, None)], "item_id bigint, lat double, lon double"), 120, 3, Scratch(spark, "t"))
    assert dict(got.collect()) == dbscan_brute(points, 120, 3)


def test_outliers_are_kept_if_all_are(spark):
    rows = spark.createDataFrame([(1, 1, 0, 48.0, 11.0), (1, 2, 0, 48.0, 11.0), (1, 3, 0, 49.0, 11.0), (2, 4, 0, 40.0, 1.0), (2, 5, 0, 41.0, 1.0)], ITEM)
    assert pairs(density.drop_outliers(rows, 100, 2, Scratch(spark, "t"), ["user_id"]).select("item_id")) == [(1,), (2,), (4,), (5,)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = dict(density.components(edges, Scratch(spark, "t")).collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_interval_join(spark):
    points = spark.createDataFrame([(1, k, k) for k in range(0, 50)], "u bigint, p bigint, t bigint")
    spans = spark.createDataFrame([(1, 10, 10), (1, 5, 31), (1, 31, 40)], "u bigint, s bigint, e bigint")
    got = joins.interval_join(points, spans, ["u"], "t", "s", "e", 7)
    assert pairs(got.select("t", "s")) == sorted((t, s) for t in range(50) for s, e in ((10, 10), (5, 31), (31, 40)) if s <= t <= e)
    assert dict(joins.first_interval(points, spans, ["u"], "p", "t", "s", "e", 7).select("t", "s").collect())[31] == 5


def test_asof_join_takes_the_last_that_is_not_later(spark):
    left = spark.createDataFrame([(1, 5, 1), (1, 0, 2), (2, 9, 3)], "u bigint, t bigint, id bigint")
    right = spark.createDataFrame([(1, 5, 10, "a"), (1, 5, 11, "b"), (1, 6, 12, "c"), (3, 1, 13, "d")], "u bigint, t bigint, r bigint, v string")
    assert sorted(joins.asof_join(left, right, ["u"], "t", ["v"], "r").select("id", "v_asof").collect()) == [(1, "b"), (2, None), (3, None)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_set_overlaps_against_all_pairs(spark, threshold):
    rnd = random.Random(7)
    sets = {k: set(rnd.sample(range(25), rnd.randint(1, 9))) for k in range(60)}
    rows = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s], "draft_id bigint, member bigint")
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-12)
    assert pairs(joins.set_overlaps(rows, threshold).select("a", "b")) == want
    inside = sorted((a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b] and (len(sets[b]) > len(sets[a]) or b < a))
    assert pairs(joins.subsets(rows)) == inside


@pytest.mark.parametrize("carried", [0, 3, 64])
def test_set_overlaps_of_kinds_against_all_pairs(spark, carried):
    """Sets that go along with their members, sets that don't, and one member of all; pairs that share more than one member come once."""
    rnd = random.Random(11)
    sets = {f"d{k}": {f"m{x}" for x in rnd.sample(range(30), rnd.randint(1, 9))} | {"all"} for k in range(70)}
    kind = {k: int(k[1:]) % 3 for k in sets}
    rows = spark.createDataFrame([(k, m) for k, s in sets.items() for m in [*s, *s]] + [("d1", None)], "draft_id string, member string").repartition(3)
    want = []
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            jaccard = shared / len(sets[a] | sets[b])
            if a < b and jaccard >= (0.2 if kind[a] == kind[b] else 0.6) - 1e-12:
                want.append((a, b, shared, round(jaccard, 9)))
    by_rows = spark.createDataFrame(list(kind.items()), "draft_id string, kind int")
    for kinds in (by_rows, F.substring("draft_id", 2, 9).cast("int") % 3):
        got = joins.set_overlaps(rows, 0.2, kinds, 0.6, carried=carried)
        assert pairs(got.withColumn("jaccard", F.round("jaccard", 9))) == sorted(want)


def test_overlap_decisions_carry_few_columns(spark):
    """Pairs that differ in time are settled before places, names and hashes are joined."""
    drafts = spark.range(4).selectExpr("id draft_id", "'x' algorithm", "1 priority", "0.5D score", "3L n", "id % 2 * 1000 t_from", "id % 2 * 1000 + 100 t_to", "48.0D lat", "11.0D lon", "array('a') core", "1.0D hash_median")
    found = spark.createDataFrame([(a, b, 0.9) for a in range(4) for b in range(a + 1, 4)], "a bigint, b bigint, jaccard double")
    got = consolidate.overlap_decisions(found, drafts)
    assert pairs(got) == sorted((a, b, "merge" if (b - a) % 2 == 0 else "drop") for a in range(4) for b in range(a + 1, 4))
    exchanged = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert len(exchanged) >= 4


def test_merges_compare_the_winners_members_only(spark):
    members = spark.createDataFrame([(d, d + k, k + 1) for d in range(6) for k in range(3)], "draft_id bigint, item_id bigint, position bigint")
    decided = spark.createDataFrame([(0, 2, "merge"), (0, 1, "merge"), (3, 5, "drop"), (3, 4, "merge")], "winner bigint, loser bigint, action string")
    got = consolidate.merged_members(decided, members)
    assert pairs(got) == sorted([*map(tuple, members.collect()), (0, 3, 4), (0, 4, 5), (3, 6, 4)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_member_quality_beyond_one_and_rounded_once(spark, tmp_path):
    """Items of more than full quality, and scores that two roundings would take up, as the SQL has them."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"copy (select * replace (value * 3 as value) from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = {r[:2]: tuple(map(float, r[2:])) for r in con.execute(f"select draft_id, item_id, quality_part, aesthetics_part, penalty, score from ({entry.oracle_sql()['member_quality']})").fetchall()}
    got = {(r.draft_id, r.item_id): (r.quality_part, r.aesthetics_part, r.penalty, r.score) for r in entry.queries()["member_quality"](spark, str(tmp_path)).collect()}
    assert got == want and max(v[0] for v in got.values()) > 1
    columns = "draft_id bigint, item_id bigint, position bigint, quality double, width int, height int, sharpness double, noise double, iso int, exposure double, brightness double, contrast double, entropy double, colorfulness double, phash string, dhash string, burst_uuid string, avg_quality double, avg_aesthetics double, avg_resolution double, avg_sharpness double, avg_iso double"
    blank = [None] * 5 + [0.0] + [None] * 4 + [None] * 8
    rows = spark.createDataFrame([(1, 1, 1, 1.2, *blank), (1, 2, 2, 0.1234499999, *blank), (1, 3, 3, -0.5, *blank)], columns)
    free, held = ([tuple(r) for r in consolidate.member_quality(rows, limited=x).orderBy("item_id").select("quality_part", "score", "rank").collect()] for x in (False, True))
    assert [(round(q, 12), r) for q, _, r in free] == [(1.2, 1), (0.1234499999, 2), (-0.5, 3)] and [q for q, _, _ in held] == [1.0, 0.1234499999, 0.0]
    assert free[1][1] == 0.7 * 0.1234499999


def test_hash_pairs_reach_all_similar_items(spark):
    rows = spark.createDataFrame([(1, "00000000000000ff"), (2, "00000000000000ff"), (3, "00000000000000fe"), (4, "1000000000000000"), (5, None)], "item_id bigint, phash string")
    assert pairs(density.similar_hash_groups(rows, Scratch(spark, "t")).select("item_id", "component")) == [(1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("prefix, bits", [(2, 5), (4, 8), (1, 20)])
def test_nearest_hashes_against_all_pairs(spark, prefix, bits):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(6)]
    # One hash that many rows have, near ones in all bits, and others.
    hashes = [base[0]] * 25 + [b ^ sum(1 << rnd.randrange(62) for _ in range(rnd.randint(0, 6))) & (1 << 64) - 1 for b in base for _ in range(12)]
    rows = [(k, f"{h:016x}") for k, h in enumerate(hashes)] + [(999, None)]
    df = spark.createDataFrame(rows, "item_id bigint, phash string").repartition(3)
    want = []
    for i, h in enumerate(hashes):
        near = sorted((bin(h ^ g).count("1"), j) for j, g in enumerate(hashes) if i != j and f"{h:016x}"[:prefix] == f"{g:016x}"[:prefix])
        want += [(i, j, d, r + 1) for r, (d, j) in enumerate([x for x in near if x[0] <= bits][:4])]
    assert pairs(joins.hamming_nearest(df, df, "item_id", bits, 4, prefix)) == sorted(want)
    first = {h: hashes.index(h) for h in hashes}
    classes = {(min(a, b), max(a, b)) for h, a in first.items() for g, b in first.items() if a != b and f"{h:016x}"[:prefix] == f"{g:016x}"[:prefix] and bin(h ^ g).count("1") <= bits}
    same = {(first[h], k) for k, h in enumerate(hashes) if first[h] != k}
    assert pairs(density.similar_hash_pairs(df, prefix, bits).select("a", "b")) == sorted(classes | same)


@pytest.mark.parametrize("tile", [7, 40])
def test_nearest_hashes_of_a_prefix_in_tiles(spark, tile):
    """Pairs of one prefix are compared in memory, a tile at a time, and never become rows."""
    rnd = random.Random(5)
    hashes = [0x5A << 56 | rnd.getrandbits(56) for _ in range(90)] + [0xA5 << 56 | rnd.getrandbits(20) for _ in range(30)]
    hashes += hashes[:25] + hashes[:1] * 30
    rows = [(f"n{k}", f"{h:016x}") for k, h in enumerate(hashes)]
    left, right = (spark.createDataFrame(r, "item_id string, phash string").repartition(3) for r in (rows[::2], rows))
    want = []
    for i, x in rows[::2]:
        near = sorted((bin(int(x, 16) ^ int(y, 16)).count("1"), j) for j, y in rows if i != j and x[:2] == y[:2])
        want += [(i, j, d, r + 1) for r, (d, j) in enumerate([p for p in near if p[0] <= 24][:4])]
    got = joins.hamming_nearest(left, right, "item_id", 24, 4, 2, tile=tile)
    assert pairs(got) == sorted(want)
    assert "bit_count" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_staypoints_of_a_crowded_spot_take_linear_time(spark):
    rows = [(1, k, k // 100, 48.0 + (k % 7) * 1e-5, 11.0 + (k % 5) * 1e-5) for k in range(100_000)] + [(1, 100_001, 2000, 49.0, 12.0)]
    df = spark.createDataFrame(rows, ITEM)
    began = time.perf_counter()
    assert islands.staypoints(df, ["user_id"], 400.0, 1200).collect() == []
    assert [r["n"] for r in islands.staypoints(df, ["user_id"], 400.0, 500).collect()] == [100_000]
    assert time.perf_counter() - began < 30


def test_dominance_on_a_long_path(spark):
    n = 1000
    drafts = spark.createDataFrame([(k, k) for k in range(n)], "draft_id bigint, r bigint")
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "a bigint, b bigint")
    got = consolidate.dominant(drafts, edges, "r", Scratch(spark, "t"), rounds=3)
    assert pairs(got.select("draft_id")) == [(k,) for k in range(0, n, 2)]


def test_signatures_beyond_the_bound_are_an_error(spark):
    drafts = spark.createDataFrame([(1, 5), (2, None)], "draft_id bigint, h bigint")
    signs = spark.createDataFrame([("a", 5), ("b", 4), ("c", 5)], "name string, h bigint")
    assert [tuple(r) for r in score.iconic(drafts, signs).collect()] == [(1, "c", 1.0)]
    assert score.iconic(drafts, signs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        score.iconic(drafts, spark.range(score.SIGNATURES + 1).selectExpr("string(id) name", "id h"))


def test_dominance_equals_the_pass_in_order(spark):
    rnd = random.Random(5)
    n = 80
    conflicts = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(150)}
    rank = list(range(n))
    rnd.shuffle(rank)
    kept = []
    for d in sorted(range(n), key=lambda k: rank[k]):
        if not any((min(d, k), max(d, k)) in conflicts for k in kept):
            kept.append(d)
    drafts = spark.createDataFrame([(d, rank[d]) for d in range(n)], "draft_id bigint, r bigint")
    edges = spark.createDataFrame(list(conflicts), "a bigint, b bigint")
    assert pairs(consolidate.dominant(drafts, edges, "r", Scratch(spark, "t")).select("draft_id")) == sorted((k,) for k in kept)


def test_annotations_need_unused_members(spark):
    drafts = spark.createDataFrame([(1, "burst", [1, 2]), (2, "trip", [1]), (3, "burst", [2, 3]), (4, "burst", []), (5, "burst", [1, 2, 9])], "draft_id bigint, algorithm string, members array<bigint>")
    assert pairs(consolidate.prune_annotations(drafts, {"burst": 0.5}, Scratch(spark, "t"))) == [(1,), (2,), (3,)]
    assert pairs(consolidate.prune_annotations(drafts, {"burst": 0.51}, Scratch(spark, "t"))) == [(2,), (3,)]


def test_member_caps_and_covers(spark):
    schema = "draft_id bigint, grouping string, score double, priority int, members array<bigint>, cover bigint"
    drafts = spark.createDataFrame([(1, "g", 0.9, 0, [1, 2], 2), (2, "g", 0.8, 0, [1, 3], 3), (3, "g", 0.7, 0, [1, 4], 4), (4, "g", 0.6, 0, [1, 5], 1), (5, "h", 0.1, 0, [1], 1)], schema)
    # 3 finds item 1 used up; 4 has it as its cover and evicts draft 1.
    assert pairs(consolidate.per_member_cap(drafts, Scratch(spark, "t"), 2)) == [(2,), (4,), (5,)]


@pytest.mark.parametrize("seed", range(2))
def test_components_decide_like_one_pass(spark, seed):
    rnd = random.Random(seed)
    drafts = [(k, rnd.choice(("burst", "trip", "device")), sorted(rnd.sample(range(120), rnd.randint(1, 5)))) for k in range(60)]
    least, used, kept = {"burst": 0.5, "device": 0.7}, set(), []
    for d, a, m in sorted(drafts, key=lambda x: (x[1] in least, x[0])):
        if a not in least or sum(x not in used for x in m) / len(m) >= least[a]:
            kept.append((d,))
            used.update(m)
    rows = spark.createDataFrame(drafts, "draft_id bigint, algorithm string, members array<bigint>")
    assert pairs(consolidate.prune_annotations(rows, least, Scratch(spark, "t"))) == sorted(kept)
    count, kept = {}, []
    for d, a, m in sorted(drafts, key=lambda x: (-(x[0] % 7), -len(x[2]), x[0])):
        if all(count.get((a, x), 0) < 2 for x in m):
            kept.append((d,))
            for x in m:
                count[a, x] = count.get((a, x), 0) + 1
    capped = rows.select("draft_id", F.col("algorithm").alias("grouping"), (F.col("draft_id") % 7).cast("double").alias("score"), F.lit(0).alias("priority"), "members", F.lit(-1).cast("bigint").alias("cover"))
    assert pairs(consolidate.per_member_cap(capped, Scratch(spark, "t"), 2)) == sorted(kept)


def test_nesting_prefers_priority(spark):
    drafts = spark.createDataFrame([(1, 0, 0.5, 9), (2, 5, 0.1, 2)], "draft_id bigint, priority int, score double, n bigint")
    assert pairs(consolidate.nest(spark.createDataFrame([(2, 1)], "child bigint, parent bigint"), drafts)) == [(1, 2)]


def test_unscored_drafts_count_their_members(spark):
    drafts = spark.createDataFrame([(1, 0.0, 5, 0, 1), (2, 0.1, 5, 0, 1), (3, None, 1, 0, 1)], "draft_id bigint, score double, n bigint, t_from bigint, t_to bigint")
    assert pairs(consolidate.filter_drafts(drafts, 2, 0.25).select("draft_id")) == [(1,)]


def test_days_are_filled_and_closed(spark):
    flags = {1: True, 2: False, 3: True, 5: False, 6: True}
    days = spark.createDataFrame([(1, f"2024-01-0{d}", 100.0 if f else 0.0) for d, f in flags.items()], "u bigint, day string, avg_km double").withColumn("day", F.col("day").cast("date"))
    out = trips.away_days(trips.gap_filled(days, ["u"]), ["u"], 50.0).orderBy("day").collect()
    assert [(r.day.day, r.synthetic, r.away) for r in out] == [(1, False, True), (2, False, True), (3, False, True), (4, True, True), (5, False, False), (6, False, True)]


def test_synthetic_days_follow_their_neighbours(spark):
    rows = [("2024-01-01", 0.0), ("2024-01-05", 100.0), ("2024-01-06", 100.0), ("2024-01-09", 0.0)]
    days = spark.createDataFrame([(1, *r) for r in rows], "u bigint, day string, avg_km double").withColumn("day", F.col("day").cast("date"))
    out = {r.day.day: r.away for r in trips.away_days(trips.gap_filled(days, ["u"]), ["u"], 50.0).collect()}
    assert out == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: False}


def candidates(spark, rows):
    schema = "draft_id bigint, item_id bigint, t bigint, day string, lat double, lon double, hash bigint, score double, scene string, upright boolean, persons array<string>"
    return spark.createDataFrame(rows, schema)


def test_curation_keeps_its_limits(spark):
    rnd = random.Random(1)
    rows = [(1, k, k * 300, f"d{k // 20}", 48.0, 11.0 + k / 1000, rnd.getrandbits(63), rnd.random(), rnd.choice("abc"), rnd.random() < 0.5, [f"p{rnd.randrange(9)}"]) for k in range(100)]
    p = curate.Policy(target=10, least=4)
    chosen = [r.item_id for r in curate.curate(candidates(spark, rows), p).orderBy("position").collect()]
    by = {r[1]: r for r in rows}
    assert p.least <= len(chosen) <= 10 and chosen == sorted(chosen)
    assert max(sum(by[c][3] == d for c in chosen) for d in {r[3] for r in rows}) <= p.per_day


def test_curation_relaxes_until_there_are_enough(spark):
    rows = [(1, k, 0, "d", 48.0, 11.0, 0, 1 - k / 100, "a", True, ["p"]) for k in range(9)]
    assert curate.curate(candidates(spark, rows), curate.Policy(target=6, least=5)).count() == 6
    assert curate.curate(candidates(spark, rows[:2]), curate.Policy()).count() == 2


def test_curation_looks_behind_the_best(spark):
    p = curate.Policy(target=10, least=4, pool=20)
    # The best 200 share their day, slot and place; the 40 behind them are free of each other.
    rows = [(1, k, k, "d", 48.0, 11.0, k * 0x123456789ABCDE % (1 << 63), 1 - k / 1000, "ab"[k % 2], k % 2 == 0, None) for k in range(200)]
    rows += [(1, 200 + k, (k + 1) * 86400, f"e{k}", 40.0 + k, 11.0, random.Random(k).getrandbits(63), 0.5 - k / 1000, "abc"[k % 3], k % 2 == 0, None) for k in range(40)]
    chosen = [r.item_id for r in curate.curate(candidates(spark, rows), p).collect()]
    by = {r[1]: r for r in rows}
    assert len(chosen) == 10 and sum(by[c][3] == "d" for c in chosen) <= 1
    # A scene that fills the best places doesn't keep the others out either.
    rows = [(1, k, k * 86400, f"d{k}", 48.0 + k / 10, 11.0, random.Random(k).getrandbits(63), 1 - k / 1000, "a" if k < 60 else "bc"[k % 2], k % 2 == 0, None) for k in range(90)]
    chosen = [r.item_id for r in curate.curate(candidates(spark, rows), replace(p, least=10)).collect()]
    assert len(chosen) == 10 and sum(c < 60 for c in chosen) <= 6


@pytest.mark.parametrize("look", [1, 2, 5])
def test_feed_goes_on_until_it_is_full(spark, look):
    rnd = random.Random(5)
    rows = [(f"x{k:03}", "one" if k < 150 else rnd.choice(["a", "b", None]), rnd.choice(["p", "q", None]), f"2024-01-{1 + rnd.randrange(28):02}", 1 - k // 2 / 1000) for k in range(400)]
    rows += [(f"z{k}", "c", None, "2024-02-01", None) for k in range(5)]
    drafts = spark.createDataFrame(rows, "draft_id string, algorithm string, place string, day string, score double")
    p = feed.Profile(max_total=14, per_day=2, per_algorithm=4, per_place_day=1, per_algorithm_day=1)
    days, algorithms, places, both, want = Counter(), Counter(), Counter(), Counter(), []
    for i, a, place, d, _ in rows:
        if len(want) < 14 and days[d] < 2 and algorithms[a] < 4 and both[d, a] < 1 and (place is None or places[d, place] < 1):
            want.append(i)
            days[d] += 1
            algorithms[a] += 1
            both[d, a] += 1
            places[d, place] += 1
    got = feed.build(drafts, p, look).orderBy("rank").collect()
    assert [r.draft_id for r in got] == want and len(want) > 12


def test_feed_caps_act_together(spark):
    rows = [(f"x{k:03}", "abc"[k % 3], "p" if k % 2 else None, f"2024-01-{1 + k % 4:02}", 1 - k / 1000) for k in range(200)]
    drafts = spark.createDataFrame(rows, "draft_id string, algorithm string, place string, day string, score double")
    p = feed.Profile(max_total=12, per_day=4, per_algorithm=5, per_place_day=1, per_algorithm_day=2)
    got = feed.build(drafts, p, look=50).orderBy("rank").collect()
    count = lambda f: max([0, *__import__("collections").Counter(f(r) for r in got).values()])
    assert 0 < len(got) <= 12 and [r.rank for r in got] == list(range(1, len(got) + 1))
    assert count(lambda r: r.day) <= 4 and count(lambda r: r.algorithm) <= 5 and count(lambda r: (r.day, r.algorithm)) <= 2
    assert count(lambda r: (r.day, r.place) if r.place else r.draft_id) <= 1


def test_paging(spark):
    rows = spark.createDataFrame([(1, 100, [7]), (2, None, [8]), (3, 50, [9]), (4, 10, [7])], "rank int, t_from bigint, members array<bigint>")
    page = lambda c: [r.rank for r in scans.page_after(rows, c, 10).collect()]
    assert (page("time:60"), page("media:8"), page("media:5"), page("nonsense"), page(None)) == ([2, 3, 4], [3, 4], [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4])


def test_majority_breaks_ties_by_first(spark):
    rows = spark.createDataFrame([(1, "b", 5), (1, "a", 9), (1, None, 1), (1, "a", 6), (1, "b", 7)], "k bigint, v string, t bigint")
    assert aggregates.majority(rows, ["k"], "v", "t").first().v == "b"


def test_normalised_scores(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(5)] + [("b", 1.0), ("b", 1.0)], "algorithm string, score double")
    got = pairs(score.normalise(rows).select("algorithm", "normalised"))
    assert [round(x, 6) for a, x in got if a == "a"] == [0.1, 0.3, 0.5, 0.7, 0.9] and {x for a, x in got if a == "b"} == {0.5}


def test_quality_of_unknown_measures(spark):
    schema = "ts timestamp, sharpness double, brightness double, contrast double, iso int, clipping double, width int, height int"
    rows = spark.createDataFrame([(None,) * 8, (datetime(2024, 1, 1), 0.9, 0.55, 1.0, 50, 0.0, 4000, 3000), (datetime(2024, 1, 1), 0.9, 0.55, 1.0, 50, 0.3, 4000, 3000)], schema)
    a, b, c = enrich.item_quality(rows).collect()
    assert (a.quality_score, a.low_quality) == (None, False)
    assert b.quality_score == pytest.approx(0.95) and not b.low_quality
    assert c.quality_score == pytest.approx(0.95 * 0.85) and c.low_quality


def test_content_kinds(spark):
    f = lambda *w, sharp=0.9, colour=0.9, contrast=0.1, bright=0.5, ratio=1.0, video=False, fps=30.0: enrich.content_kind(F.array(*map(F.lit, w)), *map(F.lit, (sharp, colour, contrast, bright, ratio, video, fps)))
    r = spark.range(1).select(f("screenshot", sharp=0.1, colour=0.1, ratio=2.0).alias("a"), f("x").alias("b"), f("scan", "receipt", colour=0.1, bright=0.9).alias("c"), f("recording", video=True, fps=60.0).alias("d")).first()
    assert (r.a.kind, r.a.confidence) == ("screenshot", pytest.approx(1.0)) and r.b is None and r.c.kind == "document" and r.d.kind == "screen_recording"


def test_points_of_interest(spark):
    rows = spark.createDataFrame([(1, "tourism", "a", 48.0, 11.0), (1, "tourism", "a", 48.001, 11.0), (2, None, "b", 48.0, 11.0), (3, "shop", None, 48.0, 11.0), (4, "shop", "d", 48.0005, 11.0), (5, "shop", "e", 49.0, 11.0)], "id bigint, category string, name string, lat double, lon double")
    assert [(r.id, round(r.distance_m)) for r in enrich.clean_pois(rows, 48.0, 11.0, 250, 9).collect()] == [(1, 0), (4, 56)]
    poi = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("category"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("wikidata"), F.lit(d).alias("distance_m")) for i, c, d in ((1, "shop", 0.0), (2, "tourism", 100.0))])
    assert spark.range(1).select(enrich.primary_poi(poi)["id"]).first()[0] == 2


def test_notifications_leave_the_past_out(spark):
    rows = spark.createDataFrame([(1, "2024-05-10")], "draft_id bigint, target string").withColumn("target", F.col("target").cast("date"))
    got = feed.notifications(rows, {"mail": ("08:00:00", [7, 1])}, "2024-05-05").collect()
    assert [(r.channel, r.lead_days, str(r.send_at)) for r in got] == [("mail", 1, "2024-05-09 08:00:00")]
