import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import Items, build_index, contamination, search, summary
from tidemark.llm.queries import QUERIES
from tidemark.llm.storage import Scratch

from .conftest import DOCS, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    found = {}
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), set()).add(str(key))
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if got := found.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= got
        out.append((doc_id, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def run(docs, items, **more):
    out = contamination(docs, items, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], len({k for s in r["spans"] for k in range(s["a"], s["b"])}), sorted(set(map(str, r["items"])))) for r in out), key=str), out


@pytest.mark.parametrize("query_words", [1 << 20, 40])
def test_against_brute_force(spark, query_words):
    rnd = random.Random(4)
    make = lambda n: " ".join(rnd.choice(["a", "B", "c", "é", "D1"]) for _ in range(n))
    docs = [(k, make(rnd.randint(0, 70))) for k in range(150)] + [(200, None), (201, "")]
    items = [(k, make(rnd.choice((0, 1, 2, 4, 11, 14)))) for k in range(9)] + [(9, None), (3, make(5))]
    frame = spark.createDataFrame([(k, t, None, None, 0) for k, t in docs], DOCS).repartition(3)
    got, _ = run(frame, spark.createDataFrame(items, "item_id bigint, text string"), query_words=query_words, segment_words=300)
    if query_words == 40:
        assert sum(len(words(t)) for _, t in items) > 40
    assert [g[:3] for g in got] == [b[:3] for b in brute(docs, items)] and [g[3] for g in got] == [b[3] for b in brute(docs, items)]


def test_awkward_documents(spark, stored):
    items = spark.createDataFrame([(1, prose(1, 60)), (2, "One, two THREE!"), (3, None), (None, "word"), (4, "")], "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in stored.collect()]
    got, _ = run(stored, items)
    assert got == brute(rows, [(1, prose(1, 60)), (2, "one two three"), (None, "word")])
    flat = summary(contamination(stored, items)).collect()
    assert {r["contaminated"] for r in flat} == {True, False} and all(r["contaminated"] == (r["n_hit"] > 0) == (r["n_items"] > 0) for r in flat)


def test_proximity_allows_words_between(spark):
    item = [f"w{k}" for k in range(10)]
    near = item[:4] + ["x", "y"] + item[4:7] + ["z"] + item[7:]
    far = item[:5] + ["x"] * 9 + item[5:]
    docs = spark.createDataFrame([(1, " ".join(near), None, None, 0), (2, " ".join(far), None, None, 0), (3, " ".join(reversed(item)), None, None, 0), (4, " ".join(item), None, None, 0)], DOCS)
    _, out = run(docs, spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string"))
    got = {r["doc_id"]: [(n["item"], n["a"], n["b"]) for n in r["near"]] for r in out}
    assert got == {1: [("5", 0, 13)], 2: [], 3: [], 4: []}


def test_proximity_finds_every_window(spark):
    item = [f"w{k}" for k in range(30)]
    texts = [[*item[k : k + 4], "x", *item[k + 4 : k + 10]] for k in range(21)]
    docs = spark.createDataFrame([(k, " ".join(t), None, None, 0) for k, t in enumerate(texts)], DOCS)
    _, out = run(docs, spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string"))
    assert {r["doc_id"]: [(n["item"], n["a"], n["b"]) for n in r["near"]] for r in out} == {k: [("5", 0, 11)] for k in range(21)}


def test_near_matches_are_returned(spark, tmp_path):
    item = [f"w{k}" for k in range(20)]
    spark.createDataFrame([(1, " ".join([*item[5:9], "x", *item[9:15]]), None, None, 0), (2, "other", None, None, 0)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = QUERIES["near_contamination"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_near"], [tuple(n) for n in r["near"]]) for r in found} == {1: (1, [("5", 0, 11)]), 2: (0, [])}


def test_items_without_an_id_count_as_one_without_a_name(spark):
    docs = spark.createDataFrame([(1, "some word here", None, None, 0), (2, "nothing", None, None, 0)], DOCS)
    items = spark.createDataFrame([(None, "word"), (None, "here"), (3, "some word")], "item_id bigint, text string")
    flat = {r["doc_id"]: r for r in summary(contamination(docs, items)).collect()}
    assert (flat[1]["n_hit"], flat[1]["n_items"], flat[1]["items_sha256"]) == (3, 2, hashlib.sha256(b"3").hexdigest()) and flat[2]["n_items"] == 0


def test_the_stored_index_answers_other_items(spark):
    docs = spark.createDataFrame([(k, prose(k, 40), None, None, 0) for k in range(30)], DOCS).repartition(2)
    index = build_index(docs, Scratch(spark, "test"), segment_words=500)
    for k in (3, 17):
        found = search(index, Items([("q", " ".join(prose(k, 40).split()[5:15]))])).where("size(spans) > 0").collect()
        assert [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in found] == [(k, [(5, 15)])]


def test_words_with_the_hash_of_another_are_no_match(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "hash_words", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    rows = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["alpha be c"])], names=["u", "d", "t"])]
    (batch,) = list(decontaminate._index(1000)(iter(rows)))
    seg = decontaminate.Segment(batch.to_pylist()[0], Items([("q", "gamma be")]))
    assert seg.df.tolist() == [0, 1, 0]


def test_empty_tables(spark, none, stored):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(none, empty).collect() == []
    assert not any(r["contaminated"] for r in summary(contamination(stored, empty)).collect())
