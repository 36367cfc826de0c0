"""Stages, jobs, and operators that SQL can't express, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.base import items
from tidemark.operators import consolidate, curate, enrich, feed, grouping, strategies
from tidemark.operators.islands import _metres
from tidemark.plans import ingest, jobs
from tidemark.plans.trips import trip_days, trip_scores
from tidemark.sources.scratch import Scratch
from tidemark.sources.sinks import DraftStore, Preferences

from .test_operators import dbscan_brute, pairs

FOLDER = "/root/testdata/sf0.001"
AS_OF = 1706745600


def windows(rows, seconds, metres=None):
    out = []
    for r in sorted(rows, key=lambda r: (r["t"], r["item_id"])):
        first = out[-1][0] if out else None
        if first and r["t"] - first["t"] <= seconds and (metres is None or _metres(first, r) <= metres):
            out[-1].append(r)
        else:
            out.append([r])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_geo_time_buckets_against_plain_pass(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(260):
        spot = rnd.choice([(48.0, 11.0), (48.01, 11.0), (48.5, 11.5)])
        place = (spot[0] + rnd.random() * 2e-3, spot[1] + rnd.random() * 2e-3) if k % 5 else (None, None)
        rows.append({"user_id": k % 2, "day": f"2024-01-0{1 + k % 3}", "item_id": k, "t": rnd.randrange(40_000), "lat": place[0], "lon": place[1]})
    df = spark.createDataFrame(rows, "user_id bigint, day string, item_id bigint, t bigint, lat double, lon double").repartition(3)
    got = {r["item_id"]: (r["user_id"], r["day"], r["bucket"]) for r in grouping.geo_time_buckets(df, ["user_id"], Scratch(spark, "t"), 150.0, 9000, 3).collect()}
    want = {}
    for key in {(r["user_id"], r["day"]) for r in rows}:
        mine = [r for r in rows if (r["user_id"], r["day"]) == key]
        located = [r for r in mine if r["lat"] is not None]
        label = dbscan_brute([(r["item_id"], r["lat"], r["lon"]) for r in located], 150.0, 3)
        label = dict(label) if not isinstance(label, dict) else label
        made = []
        for c in sorted({label.get(r["item_id"]) for r in located} - {None}):
            made += [w for w in windows([r for r in located if label.get(r["item_id"]) == c], 9000) if len(w) >= 3]
        used = {r["item_id"] for w in made for r in w}
        made += [w for w in windows([r for r in located if r["item_id"] not in used], 9000, 150.0) if len(w) >= 3]
        for n, w in enumerate(made, 1):
            want |= {r["item_id"]: (*key, n) for r in w}
        for r in mine:
            if r["lat"] is None and (hit := next((n for n, w in enumerate(made, 1) if w[0]["t"] <= r["t"] <= w[-1]["t"]), None)):
                want[r["item_id"]] = (*key, hit)
    assert got == want and want


def test_stays_of_members_are_assigned_in_order(spark):
    rnd = random.Random(1)
    rows = [(k % 3, k, 100 - k, 48 + rnd.random() * 0.01 if k % 4 else None, 11 + rnd.random() * 0.01) for k in range(90)]
    got = {r["item_id"]: r["stay"] for r in curate.assign_stays(spark.createDataFrame(rows, "draft_id bigint, item_id bigint, position bigint, lat double, lon double").repartition(3), 300.0).collect()}
    for d in range(3):
        centers = []
        for _, k, _, lat, lon in sorted((r for r in rows if r[0] == d), key=lambda r: r[2]):
            if lat is None:
                assert got[k] is None
                continue
            hit = next((n for n, c in enumerate(centers, 1) if _metres(c, {"lat": lat, "lon": lon}) <= 300.0), None)
            if hit is None:
                centers.append({"lat": lat, "lon": lon})
            assert got[k] == (hit or len(centers))


def test_day_quotas_stay_within_the_target():
    rnd = random.Random(3)
    for _ in range(300):
        days = {f"d{k:02d}": (rnd.choice(["core", "peripheral"]), round(rnd.random(), 2)) for k in range(rnd.randint(1, 12))}
        target = rnd.randint(1, 40)
        quota = curate.day_quotas(days, target)
        core = [d for d, (kind, _) in days.items() if kind == "core"]
        assert set(quota) == set(days) and all(q >= 0 for q in quota.values()) and all(quota[d] >= 1 for d in core)
        assert sum(quota.values()) <= max(target, len(core))
        assert all(quota[d] <= 2 for d in days if d not in core)
    assert curate.day_quotas({"a": ("core", 1.0), "b": ("core", 0.5), "c": ("peripheral", 0.2)}, 6) == {"a": 3, "b": 3, "c": 0}
    assert curate.day_quotas({}, 5) == {}


def overlaps_plain(drafts, sets):
    """Rounds of undefeated winners over all pairs, with merges of like times."""
    drafts, sets = {k: dict(v) for k, v in drafts.items()}, {k: list(v) for k, v in sets.items()}
    while True:
        rank = lambda k: (drafts[k]["priority"], drafts[k]["score"], len(sets[k]), -k)
        beats = []
        for a in drafts:
            for b in drafts:
                j = len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
                if a != b and rank(a) > rank(b) and j >= 0.45 and (j >= 0.85 or drafts[a]["algorithm"] == drafts[b]["algorithm"]):
                    beats.append((a, b))
        if not beats:
            return {k: sorted(v) for k, v in sets.items()}
        lost = {b for _, b in beats}
        best = {}
        for a, b in beats:
            if a not in lost and (b not in best or rank(a) > rank(best[b])):
                best[b] = a
        for b, a in sorted(best.items()):
            x, y = drafts[a], drafts[b]
            lo, hi = max(x["t_from"], y["t_from"]), min(x["t_to"], y["t_to"])
            iou = max(0, hi - lo) / (max(x["t_to"], y["t_to"]) - min(x["t_from"], y["t_from"]))
            y["merge"] = iou >= 0.55 and abs(x["score"] - y["score"]) <= max(1, x["score"]) * 0.35
        for b, a in sorted(best.items()):
            if drafts[b]["merge"]:
                sets[a] += [m for m in sets[b] if m not in sets[a]]
                x, y = drafts[a], drafts[b]
                x |= {"t_from": min(x["t_from"], y["t_from"]), "t_to": max(x["t_to"], y["t_to"]), "score": max(x["score"], y["score"])}
        for b in best:
            del drafts[b], sets[b]


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_are_settled_in_rounds(spark, seed):
    rnd = random.Random(seed)
    drafts, sets = {}, {}
    for k in range(40):
        base = [100 * (k % 8) + m for m in range(10)]
        sets[k] = sorted(rnd.sample(base, rnd.randint(6, 10)))
        f = rnd.randrange(100)
        drafts[k] = {"algorithm": rnd.choice("ab"), "priority": rnd.randint(0, 2), "score": round(rnd.random() + 0.01, 3), "t_from": f, "t_to": f + 300}
    df = spark.createDataFrame([(k, v["algorithm"], v["priority"], v["score"], len(sets[k]), v["t_from"], v["t_to"]) for k, v in drafts.items()], "draft_id bigint, algorithm string, priority int, score double, n bigint, t_from bigint, t_to bigint")
    df = df.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "core": F.lit(None).cast("array<string>"), "hash_median": F.lit(None).cast("double")})
    members = spark.createDataFrame([(k, m, p) for k, s in sets.items() for p, m in enumerate(s)], "draft_id bigint, item_id bigint, position bigint")
    out, inside = consolidate.resolve_overlaps(df, members, Scratch(spark, "t"))
    got = {}
    for r in inside.collect():
        got.setdefault(r["draft_id"], []).append(r["item_id"])
    assert {k: sorted(v) for k, v in got.items()} == overlaps_plain(drafts, sets)
    assert {r["draft_id"]: r["n"] for r in out.collect()} == {k: len(v) for k, v in got.items()}


@pytest.fixture(scope="module")
def state(spark):
    rows = items(spark, FOLDER).withColumn("user_id", F.col("user_id") % 4)
    types = ("day_album", "video_stories", "burst", "holiday_event", "season", "time_similarity", "monthly_highlights", "anniversary", "vacation")
    return jobs.cluster(rows, jobs.Options(as_of=AS_OF, types=types), Scratch(spark, "jobs"))


def test_members_of_strategies_are_those_of_their_drafts(state):
    sizes = state.members.groupBy("draft_id").agg(F.count("*").alias("m"), F.max("position").alias("p"))
    rows = state.drafts.join(sizes, "draft_id", "left").collect()
    assert rows and all(r["n"] == r["m"] == r["p"] for r in rows)
    assert {r["algorithm"] for r in rows} >= {"day_album", "video_stories", "season", "vacation", "monthly_highlights"}
    assert all(0 <= r["score"] <= 1 and r["novelty"] is not None for r in rows)


def test_every_strategy_is_registered():
    assert len(jobs.STRATEGIES) == 31 and jobs.PRIORITY["vacation"] == 31


def test_unknown_strategies_are_an_error(spark):
    with pytest.raises(ValueError):
        jobs.strategy_drafts(items(spark, FOLDER), jobs.Options(types=("nothing",)), Scratch(spark, "t"))


def test_stages_run_in_order(state):
    seen = []
    out = jobs.consolidated(state, {"least": 3, "annotate": {"season": 0.2}, "cap": 2, "most": 30}, watch=lambda name, n: seen.append((name, n)))
    assert [n for n, _ in seen] == ["filter", "rank_members", "curate", "collapse", "nest", "dominate", "overlaps", "annotations", "caps", "titles"]
    counts = [n for _, n in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    rows = {r["draft_id"]: r for r in out.drafts.collect()}
    inside = {}
    for r in out.members.collect():
        inside.setdefault(r["draft_id"], set()).add(r["item_id"])
    assert set(inside) == set(rows) and all(len(v) <= 30 for v in inside.values())
    # No member in more than two stories of an algorithm that aren't parts of others, and parts have a holder.
    uses = {}
    for k, r in rows.items():
        assert r["sub_story"] == (r["holder"] is not None) and r["title"]
        if not r["sub_story"]:
            for m in inside[k]:
                uses[r["algorithm"], m] = uses.get((r["algorithm"], m), 0) + 1
    assert max(uses.values()) <= 2


def test_own_stages_can_be_put_in(state):
    half = lambda s: consolidate.State(s.drafts.where("draft_id % 2 = 0"), s.members, s.scratch)
    out = consolidate.run_stages(state, {"half": half})
    assert out.drafts.count() == state.drafts.where("draft_id % 2 = 0").count()


def test_stored_drafts_are_refreshed(spark, tmp_path):
    store = DraftStore(spark, str(tmp_path / "store"))
    made = spark.createDataFrame([(1, "a", "f1", 0.5), (2, "a", "f2", 0.6), (3, "b", "f1", 0.7)], "draft_id bigint, algorithm string, fingerprint string, score double")
    store.insert(made)
    store.refresh(spark.createDataFrame([("a", "f1", 0.9), ("a", "zz", 0.1)], "algorithm string, fingerprint string, score double"), ["score"])
    assert pairs(store.drafts().select("draft_id", "algorithm", "score")) == [(1, "a", 0.9), (2, "a", 0.6), (3, "b", 0.7)]


def test_streamed_drafts_are_stored_once(spark, tmp_path):
    rows = [(1, "a", "f1", 0.5), (2, "a", "f1", 0.6), (3, "b", "f1", 0.7)]
    schema = "draft_id bigint, algorithm string, fingerprint string, score double"
    store = DraftStore(spark, str(tmp_path / "store"))
    for k in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store.insert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / f"check{k}")).awaitTermination(60)
    assert pairs(store.drafts().select("draft_id", "algorithm")) == [(1, "a"), (3, "b")]


def test_preferences_are_replaced_as_a_whole(spark, tmp_path):
    store = Preferences(spark, str(tmp_path / "prefs"))
    assert store.of("me") == {}
    store.write("me", {"favourite": ["b", "a"], "hidden_person": ["x"]})
    store.write("you", {"favourite": ["z"]})
    store.write("me", {"favourite": ["c"]})
    assert store.of("me") == {"favourite": ["c"]} and store.of("you") == {"favourite": ["z"]}
    store.write("me", {})
    assert store.of("me") == {} and pairs(store.read()) == [("you", "favourite", "z")]


def test_trip_days_and_runs(spark):
    """A week at home, four days far away with an evening stay each, and home again."""
    rows, k = [], 0
    for day in range(14):
        lat = 50.0 if 5 <= day <= 8 else 48.0
        for hour in (9, 10, 12, 18, 19, 20, 21, 22):
            at = dt.datetime(2024, 5, 1 + day, hour, tzinfo=dt.UTC)
            rows.append((1, k, int(at.timestamp()), at.date(), lat + (0.001 if hour < 18 else 0.0), 11.0))
            k += 1
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, t bigint, day date, lat double, lon double")
    home = spark.createDataFrame([(1, 48.0, 11.0)], "user_id bigint, home_lat double, home_lon double")
    days = trip_days(df, ["user_id"], home, Scratch(spark, "t"))
    got = {r["day"].day: r for r in days.collect()}
    assert [d for d in sorted(got) if got[d]["candidate"]] == [6, 7, 8, 9]
    assert got[6]["away"] and got[6]["outside"] and got[6]["dwell"] and not got[3]["away"] and got[3]["outside"] is False
    (trip,) = trip_scores(days, ["user_id"]).collect()
    assert (trip["first"].day, trip["last"].day, trip["days"], trip["n"], trip["class"]) == (6, 9, 4, 32, "vacation")


def test_curation_as_a_stage(spark, state):
    rows = items(spark, FOLDER).withColumn("user_id", F.col("user_id") % 4)
    stages = {"curate": jobs.curated(rows, {"season": curate.policy("trip"), "day_album": curate.policy("session")})}
    out = consolidate.run_stages(state, stages)
    sizes = {r["draft_id"]: r for r in out.drafts.collect()}
    before = {r["draft_id"]: r["n"] for r in state.drafts.collect()}
    for k, r in sizes.items():
        assert r["n"] <= {"season": 25, "day_album": 8}.get(r["algorithm"], before[k])
    inside = out.members.groupBy("draft_id").agg(F.count("*").alias("m")).collect()
    assert {r["draft_id"]: r["m"] for r in inside} == {k: r["n"] for k, r in sizes.items()}


def test_ingest_reads_each_content_once(spark, tmp_path):
    from .test_media import DETAIL, GPS, jpeg, tiff

    image = jpeg((0xE1, b"Exif\0\0" + tiff("<", [(0x0110, 2, "M1")], DETAIL, GPS)))
    (tmp_path / "sub").mkdir()
    for name, data in (("a.jpg", image), ("sub/b.jpg", image), ("IMG_20230405_060708.jpg", b"\xff\xd8\xff broken"), ("known.png", b"\x89PNG known"), ("note.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    known = ingest.ingest(spark, str(tmp_path)).where("path like '%known.png'").select("checksum")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in ingest.ingest(spark, str(tmp_path), known).collect()}
    assert set(got) == {"a.jpg", "IMG_20230405_060708.jpg"}
    a, b = got["a.jpg"], got["IMG_20230405_060708.jpg"]
    assert (a["exif_model"], a["taken_source"], str(a["taken"])) == ("M1", "exif", "2024-01-02 03:04:05")
    assert (b["exif_model"], b["taken_source"], str(b["taken"])) == (None, "filename", "2023-04-05 06:07:08")
    assert "exif_model" not in ingest.ingest(spark, str(tmp_path), without=("exif",)).columns


def test_location_similarity_against_plain_pass(spark):
    rnd = random.Random(4)
    rows = [{"user_id": k % 2, "item_id": k, "t": rnd.randrange(80_000), "day": f"2024-01-0{1 + k % 2}", "lat": 48 + rnd.random() * 0.03 if k % 6 else None, "lon": 11 + rnd.random() * 0.01 if k % 6 else None} for k in range(300)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, t bigint, day string, lat double, lon double").repartition(3)
    got = strategies.location_similarity(df, ["user_id"], 9000, 600.0, 3).collect()
    want = []
    for r in rows:
        r["place"] = None if r["lat"] is None else (int(r["lat"] / 0.01 + 1e-12), int(r["lon"] / 0.01 + 1e-12))
    for key in {(r["user_id"], r["place"], r["day"]) for r in rows if r["place"]}:
        want += [(key[0], key[2], len(w), w[0]["t"], w[-1]["t"]) for w in windows([r for r in rows if (r["user_id"], r["place"], r["day"]) == key], 9000, 600.0) if len(w) >= 3]
    assert sorted((r["user_id"], r["day"], r["n"], r["t_from"], r["t_to"]) for r in got) == sorted(want) and want


def test_monthly_highlights_against_plain_pass(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(900):
        at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=rnd.randrange(86400 * 58))
        rows.append((k % 3, k, int(at.timestamp()), at.date(), round(rnd.random(), 3), [f"p{x}" for x in range(rnd.randint(0, 3))], rnd.random() < 0.2))
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, t bigint, day date, quality double, persons array<string>, is_video boolean").repartition(3)
    got = strategies.monthly_highlights(df, ["user_id"], least=140, days=7).collect()
    want = []
    for u in range(3):
        for month in (1, 2):
            mine = [r for r in rows if r[0] == u and r[3].month == month]
            days = sorted({r[3] for r in mine})
            if len(mine) < 140 or len(days) < 7:
                continue
            scored = []
            for d in days:
                g = [r for r in mine if r[3] == d]
                mean = lambda f: sum(map(f, g)) / len(g)  # noqa: B023, E731
                scored.append((-round(0.3 * min(1, len(g) / 20) + 0.35 * mean(lambda r: r[4]) + 0.2 * min(1, mean(lambda r: len(r[5])) / 2) + 0.15 * mean(lambda r: r[6]), 9), d, min(r[2] for r in g)))
            taken = []
            for _, d, t in sorted(scored):
                if len(taken) < 5 and all(abs(t - x) >= 36 * 3600 for _, x in taken):
                    taken.append((d, t))
            want += [(u, d) for d, _ in taken]
    assert sorted((r["user_id"], r["day"]) for r in got) == sorted(want) and want


def feed_plain(drafts, p):
    """The best drafts in order, as long as nothing that they belong to is full."""
    out, used = [], {}
    for r in sorted(drafts, key=lambda r: (-r["score"], r["draft_id"])):
        caps = [(("day", r["day"]), p.per_day), (("algorithm", r["algorithm"]), p.per_algorithm), (("both", r["day"], r["algorithm"]), p.per_algorithm_day)]
        caps += [(("place", r["day"], r["place"]), p.per_place_day)] if r["place"] is not None else []
        if len(out) < p.max_total and all(used.get(k, 0) < c for k, c in caps):
            out.append(r["draft_id"])
            for k, _ in caps:
                used[k] = used.get(k, 0) + 1
    return out


@pytest.mark.parametrize("look", [1, 5])
def test_feed_against_plain_pass(spark, look):
    rnd = random.Random(look)
    rows = [{"draft_id": k, "algorithm": rnd.choice("aaaab"), "day": dt.date(2024, 1, 1 + min(rnd.randrange(40), 20)), "place": rnd.choice([None, "x", "y"]), "score": round(rnd.random(), 2)} for k in range(400)]
    p = feed.Profile(max_total=25, per_day=3, per_algorithm=14)
    got = feed.build(spark.createDataFrame(rows, "draft_id bigint, algorithm string, day date, place string, score double"), p, look).orderBy("rank").collect()
    assert [r["draft_id"] for r in got] == feed_plain(rows, p) and len(got) > 10


@pytest.mark.parametrize("seed", range(3))
def test_annotations_against_plain_pass(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["trip", "note", "tag", "note"]), sorted(rnd.sample(range(60), rnd.randint(1, 8)))) for k in range(70)] + [(99, "note", [])]
    need = {"note": 0.5, "tag": 0.25}
    used = {m for _, a, ms in rows if a not in need for m in ms}
    want = {k for k, a, _ in rows if a not in need}
    for k, a, ms in sorted(rows):
        if a in need and ms and sum(m not in used for m in ms) / len(ms) >= need[a]:
            want.add(k)
            used |= set(ms)
    df = spark.createDataFrame(rows, "draft_id bigint, algorithm string, members array<bigint>").repartition(3)
    for rounds in (0, 1, 12):
        assert pairs(consolidate.prune_annotations(df, need, Scratch(spark, "t"), rounds)) == sorted((k,) for k in want)


def test_hidden_places_and_pets(spark):
    rows = spark.createDataFrame([(1, "Rome", ["rex"]), (2, "paris", None), (3, None, ["tom"])], "id bigint, place string, pets array<string>")
    assert pairs(feed.visible(rows, places=["rome"], pets=["tom"]).select("id")) == [(2,)]


def test_points_of_interest_by_their_fixed_weights(spark):
    f = lambda category, value, name, tags, metres: enrich.poi_score(F.lit(category), F.lit(name), F.lit(None).cast("string"), F.lit(metres), F.lit(value), tags)
    tags = F.create_map(F.lit("man_made"), F.lit("tower"), F.lit("wikidata"), F.lit("Q1"))
    r = spark.range(1).select(f("man_made", "tower", "T", tags, 130.0).alias("a"), f("sport", None, None, None, None).alias("b")).first()
    assert (r.a, r.b) == (150 + 100 + 30 + 120 + 220 + 260 - 5, 50 + 60)
