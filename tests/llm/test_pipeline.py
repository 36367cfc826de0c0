"""Stages of the pipeline, each against a plain version."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm import language as language_model
from tidemark.llm.decontaminate import contamination, words_of
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.storage import Scratch
from tidemark.llm.text import utf8

from .conftest import DOCS, prose
from .test_dedup import near_brute


@pytest.fixture
def shifting(spark, tmp_path, monkeypatch):
    """A table that is split in another way after each table that is written, as with other numbers of cores."""
    texts = [prose(k, 40 + k) for k in range(30)]
    texts += [f"{t} end" for t in texts[:15]] + texts[20:24]
    for k in range(3):
        rows = [(i, t, None, None, 0) for i, t in enumerate(texts) if i % 3 == k]
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, texts[29]), (2, texts[25])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, table, n = "spark.sql.files.minPartitionNum", Scratch.table, [0]

    def write(self, *args, **more):
        out = table(self, *args, **more)
        n[0] += 1
        spark.conf.set(name, "1" if n[0] % 2 else "64")
        return out

    monkeypatch.setattr(Scratch, "table", write)
    spark.conf.set(name, "64")
    yield spark.read.parquet(str(tmp_path / "d")), str(tmp_path), list(enumerate(texts))
    spark.conf.unset(name)


def test_near_duplicates_read_the_same_rows_in_all_scans(shifting):
    docs, _, rows = shifting
    got = near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == near_brute(rows)


def test_benchmark_blocks_read_the_same_rows(spark, shifting):
    docs, folder, _ = shifting
    got = contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), query_words=200).collect()
    assert len(got) == 49 and {r["doc_id"] for r in got if r["spans"]} == {25, 29}


def test_stages_drop_the_rows_that_were_found(spark, shifting):
    docs, folder, rows = shifting
    classes = near_brute(rows)
    kept = corpus_pipeline.near(spark, docs, folder).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c, _ in classes})
    clean = corpus_pipeline.decontaminated(spark, docs, folder).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in clean) == [i for i, _ in rows if i not in (25, 29)]
    want = {r["doc_id"] for r in mixture(docs, corpus_pipeline.MIX_KEEP).collect() if r["sampled"]}
    assert {r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, folder).collect()} == want


def test_weights_of_the_mix_reach_the_last_stage(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, prose(k, int(rng.integers(20, 60))), "en", "hot" if k % 3 == 0 else f"s{k % 7}", 0) for k in range(3000)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    words = {k: len(t.split()) for k, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    corpus_pipeline.mixed(spark, docs, None).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    got = {r["doc_id"]: r["sample_weight"] for r in corpus_pipeline.tokens(spark, mixed, None).collect()}

    def shares(weight):
        mass = dict.fromkeys(sorted(set(source.values())), 0.0)
        for k, w in weight.items():
            mass[source[k]] += w * words[k]
        return np.array(list(mass.values())) / sum(mass.values())

    full = shares(dict.fromkeys(words, 1.0))
    target = full**0.5 / (full**0.5).sum()
    assert np.abs(shares(dict.fromkeys(got, 1.0)) - target).max() > 0.02
    assert np.abs(shares(got) - target).max() < 0.01


def test_language_against_one_text_at_a_time(spark, stored):
    model = language_model.learn(stored, language_model.F.lit(True))
    want = []
    for r in stored.collect():
        if any(map(str.isalpha, r["text"] or "")):
            (_, (score,)) = model.predict(*utf8(pa.array([r["text"]])))
            if score >= corpus_pipeline.LANGUAGE_LEAST:
                want.append(tuple(r))
    got = corpus_pipeline.language(spark, stored, None)
    assert got.columns == stored.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def near_quote(words, item, window=10, slop=4):
    """Whether a window of the item stands in the words, in order and with `slop` others between at most."""
    for i in range(max(1, len(item) - window + 1) if item else 0):
        want = item[i : i + window]
        for start in (k for k, w in enumerate(words) if w == want[0]):
            at = start
            for w in want[1:]:
                at = next((k for k in range(at + 1, min(len(words), start + len(want) + slop)) if words[k] == w), None)
                if at is None:
                    break
            if at is not None:
                return True
    return False


def test_decontamination_against_every_window(spark, tmp_path, stored):
    item = prose(77, 40)
    quote = item.split()[8:22]
    quote[5:5] = ["or", "so"]
    texts = [prose(5, 30) + " " + item, " ".join(quote), " ".join(item.split()[:9]), " ".join(reversed(item.split())), None, "", "one two three"]
    spark.createDataFrame([(1, item), (2, "two three"), (3, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    items = [words_of(item), words_of("two three")]
    kept = [k for k, t in enumerate(texts) if not any(near_quote(words_of(t), i) for i in items)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()) == kept == [2, 3, 4, 5]
    # Rows with nulls, repeated ones and columns of any name.
    got = corpus_pipeline.decontaminated(spark, stored, str(tmp_path))
    want = [tuple(r) for r in stored.collect() if not any(near_quote(words_of(r["text"]), i) for i in items)]
    assert got.columns == stored.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_near_keeps_one_row_of_each_class(spark, stored):
    got = corpus_pipeline.near(spark, stored, None)
    assert got.columns == stored.columns
    classes = near_brute([(r["doc_id"], r["text"]) for r in stored.collect()])
    rows = got.collect()
    # Rows without words and with a null doc_id are classes of their own; the others are one by class.
    assert sorted(str(r["doc_id"]) for r in rows if r["doc_id"] is not None) == sorted({str(c) for _, c, _ in classes if c is not None})


def test_tokens_of_any_rows(spark, stored):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.tokens(spark, stored.withColumn("sample_weight", language_model.F.lit(1.5)), None).collect()
    want = [(str(r["doc_id"]), zlib.crc32(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4"))) for r in stored.collect()]
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted(want) and {r["sample_weight"] for r in got} == {1.5}


def test_whole_pipeline(spark, tmp_path, stored):
    stored.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(2, 30_000)[:400])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = stored
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert number == 4 or [c for c in docs.columns if c != "sample_weight"] == stored.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    apart = sorted(map(str, map(tuple, docs.collect())))
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))) == apart and apart
    # No near copies, no texts without letters, no benchmark.
    texts = {r["doc_id"]: r["text"] for r in stored.collect()}
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept <= set(texts) and not kept & {k for k, t in texts.items() if not any(map(str.isalpha, t or ""))} and 13 not in kept


def test_empty_table(spark, tmp_path, none):
    spark.createDataFrame([(1, "one two")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, none, str(tmp_path))
        assert got.collect() == [] and [c for c in got.columns if c != "sample_weight"] == none.columns
    assert corpus_pipeline.tokens(spark, none.withColumn("sample_weight", language_model.F.lit(1.0)), None).collect() == []


def test_results_of_other_calls_stay(spark, stored):
    """A frame that an operator has returned is still read after a pipeline has run its stages."""
    found = near_duplicates(stored)
    docs = corpus_pipeline.language(spark, stored, None).cache()
    assert corpus_pipeline.near(spark, docs, None).count() and found.count() == stored.count()
