import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.islands import gap_runs
from tidemark.sources import files, sinks
from tidemark.streaming import incremental


@pytest.fixture
def media(tmp_path):
    folder = tmp_path / "media" / "deep"
    folder.mkdir(parents=True)
    (folder / "IMG_20240102_030405_pano.JPG").write_bytes(b"\xff\xd8\xff\xe0rest")
    (folder / "clip_b012.mov").write_bytes(b"\x00\x00\x00\x18ftypqt  moov")
    (folder / "wrong.mp4").write_bytes(b"\x89PNG\r\n\x1a\n")
    (folder / "copy.jpg").write_bytes(b"\xff\xd8\xff\xe0rest")
    (folder / "notes.txt").write_text("x")
    return str(tmp_path / "media")


def test_files(spark, media):
    found = files.locate(spark, media, content=True)
    assert found.count() == 4 and files.locate(spark, media, videos=False).count() == 2 and files.locate(spark, media, most=1).count() == 1
    seen = {r.path.rsplit("/", 1)[1]: r for r in files.named(files.sniffed(found)).collect()}
    assert {k: r.mime for k, r in seen.items()} == {"IMG_20240102_030405_pano.JPG": "image/jpeg", "clip_b012.mov": "video/mp4", "wrong.mp4": "image/png", "copy.jpg": "image/jpeg"}
    first = seen["IMG_20240102_030405_pano.JPG"]
    assert (str(first.named_at), first.hint, seen["clip_b012.mov"].burst_index) == ("2024-01-02 03:04:05", "panorama", 12)
    assert files.sniffed(found, strict=True).count() == 3


def test_checksums_find_known_files(spark, media):
    import xxhash

    found = files.checksums(files.locate(spark, media, content=True))
    assert {r.fast_checksum for r in found.where("path like '%copy%'").collect()} == {xxhash.xxh64(b"\xff\xd8\xff\xe0rest").hexdigest()}
    fresh = files.new_files(found, found.where("path like '%wrong%'"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in fresh.collect()) == ["IMG_20240102_030405_pano.JPG", "clip_b012.mov"]


def test_xmp_and_probe(spark):
    xmp = "<x xmlns:dc='d' xmlns:rdf='r' xmlns:p='p'><dc:subject><rdf:Bag><rdf:li> sea </rdf:li><rdf:li>sea</rdf:li></rdf:Bag></dc:subject><p:PersonInImage><rdf:Bag><rdf:li>Ann</rdf:li></rdf:Bag></p:PersonInImage></x>"
    probe = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "hevc", "avg_frame_rate": "240000/1001", "tags": {"rotate": "90"}}], "format": {"duration": "2.5"}})
    r = files.probed(files.xmp_people_and_words(spark.createDataFrame([(xmp, probe)], "xmp string, probe string"))).first()
    assert (r.keywords, r.persons, r.duration_s, r.codec, round(r.fps, 2), r.rotation, r.is_slow_mo) == (["sea"], ["Ann"], 2.5, "hevc", 239.76, 90, True)


def test_collection_clusters(spark, tmp_path):
    item = lambda f, at, q, roles: {"filename": f, "taken_at": at, "quality": q, "tags": ["b", "a"], "people": [], "roles": roles}
    doc = {"dataset": "d", "clusters": [{"id": "c", "expected_days": ["2024-01-01", "2024-01-02", "2024-01-03"], "items": [item("x", "2024-01-01T10:00:00+00:00", 0.9, []), item("y", "2024-01-03T11:30:00+00:00", 0.5, ["key"])]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    r = files.collection_clusters(spark, str(tmp_path / "m.json")).first()
    assert (r.n, r.hours, r.missing, r.key_item, r.tags) == (2, 49.5, ["2024-01-02"], "y", ["a", "b"])


def test_store_never_changes_what_it_has(spark, tmp_path):
    store = sinks.DraftStore(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "draft_id bigint, algorithm string, fingerprint string, score double, t_from bigint, t_to bigint")
    store.insert(rows((1, "a", "f", 0.1, 0, 1), (2, "a", "f", 0.2, 0, 1), (3, "b", "f", 0.3, 5, 6)))
    store.insert(rows((4, "a", "f", 0.9, 0, 1), (5, "a", "g", 0.4, 9, 9)))
    assert sorted((r.draft_id, r.score) for r in store.drafts().collect()) == [(1, 0.1), (3, 0.3), (5, 0.4)]
    assert [r.draft_id for r in store.latest(2).collect()] == [5, 3]
    store.delete(["a"])
    assert [r.draft_id for r in store.drafts().collect()] == [3]


def test_exports(spark, tmp_path):
    feed = spark.createDataFrame([(2, "<b>", "2 items"), (1, "A", "1 items")], "rank int, title string, subtitle string")
    assert sinks.export_html(feed).index("A") < sinks.export_html(feed).index("&lt;b&gt;")
    sinks.export_json(feed, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["schema"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 1]
    sinks.emit_event(spark, str(tmp_path / "events"), "job", "done", n=3)
    assert spark.read.json(str(tmp_path / "events")).first().context.n == "3"


def test_duplicate_edges_are_oriented(spark):
    pairs = spark.createDataFrame([(2, 1, 5, 1), (1, 2, 3, 2)], "a bigint, b bigint, distance int, seen bigint")
    assert [tuple(r) for r in sinks.duplicate_edges(pairs).collect()] == [(1, 2, 3)]


START = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, files_=1):
    for k in range(files_):
        part = rows[k::files_]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


SCHEMA = "item_id bigint, user_id bigint, ts timestamp, t bigint, device string, checksum string"


def events(n=40):
    return [(k, k % 2, START + timedelta(seconds=97 * k * (1 + k % 3)), int((97 * k * (1 + k % 3))), "ab"[k % 2], f"c{k % 7}") for k in range(n)]


def test_first_seen(spark, tmp_path):
    got = run(spark, incremental.first_seen(stream(spark, tmp_path, events(), SCHEMA)), "seen")
    assert sorted({r.checksum for r in got}) == [f"c{k}" for k in range(7)] and len(got) == 7


def test_stream_sessions_equal_batch_runs(spark, tmp_path):
    rows = events()
    got = run(spark, incremental.sessions(stream(spark, tmp_path, rows, SCHEMA), "user_id", "400 seconds"), "sess", "complete")
    batch = gap_runs(spark.createDataFrame(rows, SCHEMA).withColumn("t", F.unix_timestamp("ts")), ["user_id"], 400).groupBy("user_id", "run").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    assert sorted((r.user_id, r.first, r.n) for r in got) == sorted((r.user_id, r.first, r.n) for r in batch.collect())


def test_stream_buckets(spark, tmp_path):
    got = run(spark, incremental.buckets(stream(spark, tmp_path, events(), SCHEMA), "1 hour"), "bucket", "complete")
    assert sum(r.n for r in got) == 40 and {r.start.minute for r in got} == {0}


def test_stream_anchored_windows_keep_state(spark, tmp_path):
    rows = [(k, 1, START, 10 * k, "a", "c") for k in range(20)]
    df = incremental.anchored(stream(spark, tmp_path, rows, SCHEMA), "user_id", 45)
    got = run(spark, df, "anchored")
    assert {r.item_id: r.window for r in got} == {k: k // 5 for k in range(20)}


def test_late_siblings_are_found_again(spark, tmp_path):
    first = [(1, 1, START, 0, "a", "x"), (2, 1, START, 0, "a", "y")]
    df = stream(spark, tmp_path, first, SCHEMA)
    for rows in (None, [(3, 1, START, 0, "a", "x")]):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.into_store(df, str(tmp_path / "store"), "checksum", str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "store/items")).count() == 3
    assert [r.item_id for r in spark.read.parquet(str(tmp_path / "store/items_siblings")).collect()] == [1]
