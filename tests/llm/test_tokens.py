import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_index as module
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.storage import Scratch
from tidemark.llm.token_index import Encoder, WaveletMatrix, token_index, write_shards


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path(), keep=60)


@pytest.fixture(scope="module")
def library():
    """The library as it is, with nothing set."""
    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_library(encoder, library):
    rnd = random.Random(2)
    texts = ["", "  a", " a b", "a b  c   d", "a\n  b\n\n c", "x ", "a \nb\n ", "it's <|endoftext|> ok", "a<|endoftext|>b. c", "<|endoftext|>", "a <|endoftext|", "x <|endoftext|> <|endoftext|>", "é ü  ñ", "a\u0085 b", "a  b", "你好 \U0001f600x"]
    texts += ["".join(rnd.choice(["a", "b", " ", " ", "\n", "\t", "'s", "1", "é", "!", ",", ".", ", ", ".\n", "\r", "\u00a0", "\x01", "ab", "word"]) for _ in range(rnd.randint(0, 16))) for _ in range(1500)]
    assert encoder.byte_level
    for k in range(0, len(texts), 100):
        ids, counts = encoder.encode(texts[k : k + 100])
        ends = np.cumsum(counts)
        for text, a, b in zip(texts[k : k + 100], ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    assert 50256 in encoder.encode(["a <|endoftext|> b"])[0]


def test_other_tokenizers_are_not_split():
    words = Encoder(tokenizer_path("word_bpe_49k.json"))
    ids, _ = words.encode(["Two words", "a  b"])
    assert ids.tolist() == sum((words.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Two words", "a  b")), [])


@pytest.mark.parametrize("n,size", [(0, 1), (1, 1), (5, 1), (700, 3), (3000, 50), (2500, 60_000)])
def test_wavelet_matrix(n, size, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 1024)
    ids = np.random.default_rng(n).integers(0, size, n).astype(np.uint32)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    assert w.decode().tolist() == ids.tolist()
    for i in range(0, n, max(1, n // 40)):
        token = int(ids[i])
        assert w.access(i) == token
        assert w.rank(token, i) == int((ids[:i] == token).sum())
        assert w.count(token) == int((ids == token).sum())
    if n:
        assert w.occurrences(int(ids[n // 2])) == np.flatnonzero(ids == ids[n // 2]).tolist()
    assert w.count(size + 7) == 0 and w.occurrences(size + 7) == []


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_round_trip(stored, shard, library):
    got = token_index(stored, tokenizer_path(), shard_tokens=shard).collect()
    rows = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in stored.collect()])
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    want, start = {}, 0
    for known, doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want.setdefault(doc_id if known else None, []).append((len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert {k: sorted((r["n_tokens"], r["ids_crc32"]) for r in v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n_tokens"] for r in order])[:-1].tolist()
    assert order[-1]["start"] + order[-1]["n_tokens"] == start
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert keys == sorted(keys)


def test_select_and_rank_over_many_blocks(monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 1024)
    rng = np.random.default_rng(6)
    # A frequent, a rare and an absent bit by turns.
    bits = np.concatenate([rng.random(3000) < 0.5, np.zeros(5000, bool), np.ones(4000, bool), rng.random(2500) < 0.01])
    plane = module.Plane.build(bits, module.zstandard.ZstdCompressor().compress)
    for bit in (0, 1):
        places = np.flatnonzero(bits == bit)
        assert [plane.select(bit, k) for k in range(len(places))] == places.tolist()
    ones = np.concatenate([[0], np.cumsum(bits)])
    assert [plane.rank1(i) for i in range(len(bits) + 1)] == ones.tolist() and plane.zeros == len(bits) - ones[-1]


def test_access_inflates_the_blocks_on_its_way_only(monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 1024)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(np.random.default_rng(1).integers(0, 200, 50_000).astype(np.uint32)).to_bytes())
    w.access(777)
    assert all(len(p.held) <= 2 < len(p.blocks) for p in w.planes)


def test_a_file_alone_gives_documents_and_ids(stored, spark, library):
    shards = write_shards(stored, Scratch(spark, "test"), tokenizer_path(), shard_tokens=400).select("file").collect()
    assert shards
    got = sorted((str(d), ids.tolist()) for r in shards for d, ids in WaveletMatrix.from_bytes(bytes(r["file"])).documents())
    assert got == sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in stored.collect())
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(bytes(shards[0]["file"])[:-3])


def test_empty_table(none):
    assert token_index(none, tokenizer_path()).collect() == []
