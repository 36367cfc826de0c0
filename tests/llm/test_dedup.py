import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import near_dup
from tidemark.llm.exact_dedup import exact_duplicates, identities
from tidemark.llm.near_dup import connected_components, forest, least_agreement, near_duplicates, prefix_length, shortening
from tidemark.llm.storage import Scratch

from .conftest import DOCS, prose

BLANK = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        norm = BLANK.sub("", text or "")
        best = min(groups[norm])
        out.append((doc_id, None if best[1] else best[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_exact_against_brute_force(stored, block):
    got = exact_duplicates(stored, block).collect()
    rows = [(r["doc_id"], r["text"]) for r in stored.collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == exact_brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_exact_names_do_not_depend_on_the_split(spark):
    texts = [prose(k % 23, 3 + k % 9) for k in range(120)]
    names = []
    for parts in (1, 6):
        docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS).repartition(parts)
        names.append({r["doc_id"]: (r["round"], r["name"]) for r in identities(docs, Scratch(spark, "test"), 16).collect()})
    assert names[0] == names[1]
    assert len(set(names[0].values())) == len(set(map(lambda t: BLANK.sub("", t), texts)))


def test_exact_empty_table(none):
    assert exact_duplicates(none).collect() == []


def test_exact_blocks_that_repeat_inside_texts(spark):
    texts = ["ab" * n for n in range(1, 40)] * 2 + ["ba" * 7, "aabb" * 8]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    got = exact_duplicates(docs, 2).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == exact_brute(list(enumerate(texts)))


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(rows, similarity=0.8):
    """Row number -> (smallest doc_id of the class, links)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        names[find(i)].append((doc_id is None, doc_id))
    return sorted(((rows[i][0], min(names[find(i)], key=lambda x: (x[0], x[1] or 0))[1], links[i]) for i in range(len(rows))), key=str)


def test_near_against_brute_force(stored):
    got = near_duplicates(stored).collect()
    rows = [(r["doc_id"], r["text"]) for r in stored.collect()]
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == near_brute(rows)


def test_near_chains_groups_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 4)
    monkeypatch.setattr(near_dup, "NODE_TILE", 4)
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):
        words = prose(100 + g, 120).split()
        for _ in range(int(rng.integers(1, 14))):
            texts.append(" ".join(words))
            words[int(rng.integers(0, 120))] = f"w{rng.integers(1000)}"
    passage = prose(999, 55)
    texts += [passage + " " + prose(2000 + k, 80) for k in range(30)] + texts[:6]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS).repartition(3).cache()
    docs.count()
    got = near_duplicates(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == near_brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r["class_id"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_near_empty_table(none):
    assert near_duplicates(none).collect() == []


def test_prefix_reaches_the_recall():
    k = prefix_length()
    assert 1 - (1 - 0.8**k) ** near_dup.TREES >= near_dup.RECALL
    assert k == near_dup.DEPTH or 1 - (1 - 0.8 ** (k + 1)) ** near_dup.TREES < near_dup.RECALL
    assert 0 < least_agreement() < 0.8 * near_dup.TREES * near_dup.DEPTH


def test_shortening_is_the_least_that_reaches_the_recall():
    for similarity, recall in ((0.8, 0.9999), (0.8, 0.999), (0.9, 0.9999), (0.5, 0.9), (0.99, 0.9)):
        k, j = shortening(similarity, recall)
        reached = lambda j: 1 - (1 - similarity**k) ** j * (1 - similarity ** (k + 1)) ** (near_dup.TREES - j)  # noqa: B023, E731
        assert reached(j) >= recall and (j == 0 or reached(j - 1) < recall)
    assert shortening() == (3, 13)


def test_forest_against_plain_tries(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_NODE", 5)
    rng = np.random.default_rng(8)
    # Few values, so that there are many nodes, and large ones.
    sigs = rng.choice([7, 7, 7, 9, 11, 13, 1 << 31], (70, near_dup.TREES, near_dup.DEPTH)).astype(np.uint32)
    reps = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sigs)], "uid bigint, sig binary").repartition(4)
    got = forest(reps, Scratch(spark, "test"), 70, 0.8, 0.9999)
    length, needed = shortening(0.8, 0.9999)
    name = lambda k, t, n: (t, *sigs[k, t, :n].tolist())
    nodes = defaultdict(set)
    for k in range(70):
        for t in range(near_dup.TREES):
            for n in (length, length + 1):
                nodes[name(k, t, n)].add(k)
    short = set()
    for k in range(70):
        size = [len(nodes[name(k, t, length)]) for t in range(near_dup.TREES)]
        for t in sorted(range(near_dup.TREES), key=lambda t: (size[t] > 5, size[t] if size[t] > 5 else t, t))[:needed]:
            short.add(name(k, t, length))
    want = {x: frozenset(m) for x, m in nodes.items() if len(m) > 1 and (x in short if len(x) == length + 1 else x[:-1] not in short)}
    found = defaultdict(set)
    for r in got.collect():
        found[r["tree"], r["node"]].add((r["uid"], r["size"]))
    assert sorted((t, sorted(u for u, _ in m), {s for _, s in m}) for (t, _), m in found.items()) == sorted((x[0], sorted(m), {len(m)}) for x, m in want.items())


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_pairs_just_above_the_threshold(spark, similarity):
    """Pairs of texts whose sets have a similarity of that or a little more: all are found."""
    rng, texts = np.random.default_rng(int(similarity * 100)), []
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = list(words)
        # Other words at the last j places leave 296 - j of 296 + j shingles.
        j = int(296 * (1 - similarity) / (1 + similarity))
        other[300 - j :] = [f"v{x}" for x in rng.integers(0, 10**6, j)]
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS).repartition(4)
    got = near_duplicates(docs).where("n_links = 1").count()
    assert got >= 0.995 * 800


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (12, 11), (7, 7)] + [(100 + k, 101 + k) for k in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(connected_components(df, Scratch(spark, "test"), "c").collect())
    assert got == {**{k: 1 for k in range(1, 6)}, 10: 10, 11: 10, 12: 10, **{100 + k: 100 for k in range(41)}}


def test_components_random(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test"), "r").collect())
    assert got == {k: find(k) for k in root}
