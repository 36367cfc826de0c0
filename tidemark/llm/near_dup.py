"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. Sketch. Every whole text becomes its set of hashed shingles of five words (words as in `text.segment`, lower-cased;
   a text of one to four words is one shingle) and a MinHash signature. Documents with the same set form one
   class of copies, of which one representative goes on.
2. Forest. A signature is cut into `trees` strings of `depth` values. In each tree the strings are sorted, which lays the
   prefix trie out: a node is a run of strings with the same prefix, and the lengths of the prefixes that neighbours share
   tell the nodes and their sizes. From the deepest level on, matched prefixes are shortened until a pair at the similarity
   sought meets in some tree with the target recall. Down to the level above the last, all have to be. On the last one
   a document shortens its prefix in as many trees as it still needs (`shortening`), in the first ones in which that leads to a
   node of SMALL_NODE members at most, and only then in larger ones, the smaller first. A node that a member shortens to is
   matched by all of its members. So frequent prefixes stay long wherever rarer ones make up for it.
   (The choice doesn't look at sizes below SMALL_NODE: a document would else avoid the very trees in which it has company.)
   Representatives that meet in a node are compared by
   their whole signatures; those that agree in too few places to be similar are dropped (`least_agreement`).
   What is left joins representatives into candidate groups.
3. Verification. Within a candidate group all pairs are verified exactly, from the sets. A group is cut into
   tiles of TILE members (fewer, if their sets are large) and each pair of tiles is one unit of work, so no task holds a large group and no
   pairs are written: a unit returns each member's number of links and a spanning forest of its links.
4. Classes are the connected components of the verified links.

Null and empty texts, and texts without words, have no shingles: each is a class of its own with no links.
Repeated rows are rows of their own and link to each other. class_id is the smallest doc_id of the class; where all
are null it is null. An empty table gives no row. Very long texts are read whole; their sets are held by one task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .text import PLACE, hash_words, mix, numbered, pieces, rows, segment, utf8

#: Contract of near duplicates: words of a shingle and least similarity.
SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH = 16, 4
#: Members of a node that is shortened to without a look at its size.
SMALL_NODE = 64
#: Least share of pairs at the threshold itself that meet in some tree; more similar ones are found more surely.
RECALL = 0.99998
#: Members of a tile of a trie node and of a candidate group, and shingles of the latter, by its largest set.
NODE_TILE, TILE, TILE_SHINGLES = 1024, 512, 1_000_000

_RANDOM = np.random.default_rng(20240229)
_XOR = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shortens the prefix from `depth` until 1 - (1 - s**k)**trees reaches the recall."""
    k = depth
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


def shortening(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> tuple[int, int]:
    """(k, j): with prefixes of k values in j trees and of k + 1 in the others the recall is reached, with fewer than j trees not. j is `trees` where even k = 1 in all of them is too long."""
    k = prefix_length(similarity, recall, trees, depth)
    if k == depth:
        return k - 1, 0
    j = 0
    while j < trees and 1 - (1 - similarity**k) ** j * (1 - similarity ** (k + 1)) ** (trees - j) < recall:
        j += 1
    return k, j


def least_agreement(similarity: float = SIMILARITY, size: int = TREES * DEPTH) -> int:
    """Equal places that a signature pair of that similarity has at least, but for five standard deviations."""
    return max(1, int(similarity * size - 5 * (size * similarity * (1 - similarity)) ** 0.5))


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    mapped, starts, ends, word_at = segment(data, at)
    words = hash_words(mapped, starts, ends)
    many = max(0, len(words) - n + 1)
    runs = np.zeros(many, np.uint64)
    for k in range(n):
        runs += words[k : k + many] * _ORDER[k]
    runs = mix(runs)
    out = []
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], chunk: int = 1 << 15) -> np.ndarray:
    """MinHash signatures (uint32) of non-empty sets."""
    out = np.empty((len(sets), len(_XOR)), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= chunk):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        first = np.cumsum([0] + [len(x) for x in sets[i : j - 1]])
        for k in range(len(_XOR)):
            out[i:j, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], first) >> np.uint64(32)
        i = j
    return out


_SKETCH = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in pieces(batch.column(2)):
            sets = shingle_sets(data, at)
            full = [k for k, s in enumerate(sets) if len(s)]
            sigs = signatures([sets[k] for k in full])
            sig: list[bytes | None] = [None] * len(sets)
            for k, row in zip(full, sigs, strict=True):
                sig[k] = row.tobytes()
            prints = np.array([(s.sum(dtype=np.uint64), mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(sig, pa.binary())], schema=_SKETCH)


_STRING = "uid bigint, tree int, " + ", ".join(f"v{k} bigint" for k in range(DEPTH))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tree: its number and the signature's string in it."""
    names = ["uid", "tree", *(f"v{k}" for k in range(DEPTH))]
    for batch in batches:
        if batch.num_rows:
            sig = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]).reshape(-1, DEPTH).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sig) // TREES)), *[pa.array(np.ascontiguousarray(sig[:, k])) for k in range(DEPTH)]], names=names)


def _named(length: int):
    """Rows of sorted strings as (uid, tree, short, long, edge): the names of the nodes at that length and one more; edge marks rows whose neighbour may be elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, short = np.zeros(batch.num_rows, np.uint64), None
            for k in range(min(DEPTH, length + 1)):
                key = mix(key * np.uint64(0x100000001B3) + batch.column(2 + k).to_numpy().astype(np.uint64) + np.uint64(k + 1))
                short = key if k + 1 == length else short
            edge = np.zeros(batch.num_rows, bool)
            edge[[0, -1] if len(edge) else []] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(short.view(np.int64)), pa.array(key.view(np.int64)), pa.array(edge)], names=["uid", "tree", "short", "long", "edge"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, node, size) of the runs of sorted (tree, short, long, edge), at both lengths. A run that reaches over an edge comes in parts."""
    for batch in batches:
        tree, edge = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).copy()
        if not len(tree):
            continue
        edge[[0, -1]] = True
        for column in (1, 2):
            node = batch.column(column).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (tree[1:] != tree[:-1])]))
            size = np.diff(first, append=len(node))
            # A run of one is a node of one, unless it lies at an edge.
            some = (size > 1) | np.logical_or.reduceat(edge, first)
            first, size = first[some], size[some]
            yield pa.RecordBatch.from_arrays([pa.array(tree[first]), pa.array(node[first]), pa.array(size)], names=["tree", "node", "size"])


def forest(reps: DataFrame, scratch: Scratch, many: int, similarity: float, recall: float) -> DataFrame:
    """Where representatives (uid, sig) meet: uid, tree, node, size (more than 1)."""
    length, needed = shortening(similarity, recall)
    strings = reps.select("uid", "sig").mapInArrow(_strings, _STRING)
    order = ["tree", *(f"v{k}" for k in range(DEPTH))]
    trie = strings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_named(length), "uid bigint, tree int, short bigint, long bigint, edge boolean")
    trie = scratch.table(trie, "trie", rows=TREES * many, per_file=500_000)
    # The names of both lengths are hashes, so they tell nodes of one length from those of the other.
    nodes = trie.select("tree", "short", "long", "edge").mapInArrow(_runs, "tree int, node bigint, size bigint").groupBy("tree", "node").agg(F.sum("size").alias("size")).where("size > 1")
    nodes = scratch.table(nodes, "nodes", rows=2 * TREES * many, per_file=1_000_000)
    met = trie.drop("edge").join(nodes.withColumnsRenamed({"node": "short", "size": "n_short"}), ["tree", "short"])
    met = scratch.table(met.join(nodes.withColumnsRenamed({"node": "long", "size": "n_long"}), ["tree", "long"], "left"), "met", rows=TREES * many, per_file=500_000)
    crowded = met.where(F.col("n_short") > SMALL_NODE).groupBy("uid").agg(F.collect_list(F.struct(F.col("n_short").alias("n"), "tree")).alias("large"))
    large = F.coalesce("large", F.array().cast("array<struct<n:bigint,tree:int>>"))
    own = F.struct(F.col("n_short").alias("n"), "tree")
    place = F.when(F.col("n_short") <= SMALL_NODE, F.col("tree") - F.size(F.filter(large, lambda x: x["tree"] < F.col("tree")))).otherwise(TREES - F.size(large) + F.size(F.filter(large, lambda x: x < own)))
    short = met.join(crowded, "uid", "left").groupBy("tree", "short").agg(F.max(place < needed).alias("shortened"))
    found = met.join(short, ["tree", "short"]).select(
        "uid", "tree", F.when(F.col("shortened"), F.col("short")).otherwise(F.col("long")).alias("node"), F.when(F.col("shortened"), F.col("n_short")).otherwise(F.col("n_long")).alias("size")
    )
    return scratch.table(found.where("size > 1"), "shared", rows=TREES * many, per_file=1_000_000)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with the same first `keys` columns; they come sorted."""
    flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, members in groupby(flat, key=lambda r: r[:keys]):
        yield key, [m[keys:] for m in members]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    free, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if free[root]:
            free[root] = False
            todo = [root]
            while todo:
                at = todo.pop()
                reached = np.flatnonzero(linked[at] & free)
                free[reached] = False
                todo += reached.tolist()
                out += [(at, x) for x in reached.tolist()]
    return out


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batches(found) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in found:
        a.append(max(x, y))
        b.append(min(x, y))
        if len(a) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)


def _compare(least: int):
    """Members (uid, tile, sig) of a trie node, or of two tiles of it: edges between those whose signatures agree enough."""

    def edges(batches):
        for (_, _, i, j), members in _groups(batches, 4):
            if len(members) < 2:
                continue
            uids = [m[0] for m in members]
            sig = np.frombuffer(b"".join(m[2] for m in members), np.uint32).reshape(len(members), -1)
            if len(members) == 2:
                if int((sig[0] == sig[1]).sum()) >= least:
                    yield uids[0], uids[1]
                continue
            linked = np.zeros((len(sig), len(sig)), bool)
            step = max(1, (1 << 24) // sig.size)
            for k in range(0, len(sig), step):
                linked[k : k + step] = (sig[k : k + step, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.uint16) >= least
            if i != j:
                tile = np.array([m[1] for m in members])
                linked &= tile[:, None] != tile[None, :]
            for x, y in _forest(linked):
                yield uids[x], uids[y]

    return lambda batches: _edge_batches(edges(batches))


def tiled(df: DataFrame, tiles: str, key: str = "uid") -> DataFrame:
    """Adds tile (of the row), i and j: a row for each pair of tiles that its own tile is in. `tiles` is the number of its group's tiles."""
    n = F.col(tiles)
    df = df.withColumn("tile", F.pmod(F.xxhash64(key), n).cast("int"))
    return df.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1))).select("*", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).drop("other", tiles)


def connected_components(edges: DataFrame, scratch: Scratch, name: str, most: int | None = None) -> DataFrame:
    """(node, root) of all nodes that have edges (a, b), `most` edges at most; root is the smallest node of the component. Alternates the large-star and small-star steps until nothing changes."""

    def step(pairs: DataFrame, table: str) -> tuple[DataFrame, tuple]:
        out = scratch.table(pairs.where("a != b").distinct(), table, rows=most, per_file=200_000)
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.col("b") % 1_000_003)).first())

    now, state = step(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{name}0")
    k, most = 0, 2 * state[0]
    while state[0]:
        k += 1
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = scratch.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}{k}m", rows=most, per_file=200_000)
        large, _ = step(both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))), f"{name}{k}l")
        lowest = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}{k}n", rows=most, per_file=200_000)
        small = large.join(lowest, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        after, new_state = step(small, f"{name}{k}")
        done, now, state = new_state == state, after, new_state
        if done:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, ...) with the text as its set of shingles."""
    for batch in batches:
        data, at = utf8(batch.column(1))
        sets = pa.array([s.tobytes() for s in shingle_sets(data, at)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sets, *batch.columns[2:]], names=batch.schema.names)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _verify(similarity: float):
    """Members (uid, tile, weight, set) of one or two tiles of a candidate group: links of each member, counted by weight, and edges."""

    def found(batches):
        for (_, i, j), members in _groups(batches, 3):
            if len(members) < 2:
                continue
            sets = [np.frombuffer(m[3], np.uint64) for m in members]
            size = np.array([len(s) for s in sets], np.int64)
            weight = np.array([m[2] for m in members], np.int64)
            tile = np.array([m[1] for m in members])
            distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.cumsum(size) - size
            mark = np.zeros(len(distinct), np.int32)
            linked = np.zeros((len(sets), len(sets)), bool)
            for k in range(len(sets)):
                if i != j and tile[k] != i:
                    continue
                own = code[first[k] : first[k] + size[k]]
                mark[own] = 1
                shared = np.add.reduceat(mark[code], first)
                mark[own] = 0
                linked[k] = shared >= similarity * (size[k] + size - shared) - 1e-9
                if i != j:
                    linked[k] &= tile != i
            if i != j:
                linked |= linked.T
            np.fill_diagonal(linked, False)
            for k in np.flatnonzero(linked.any(axis=1)).tolist():
                yield members[k][0], None, int(weight[linked[k]].sum())
            for x, y in _forest(linked):
                yield members[x][0], members[y][0], 0

    def run(batches):
        held = []
        for row in found(batches):
            held.append(row)
            if len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=_LINK)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=_LINK)

    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Per row of `docs`: uid, doc_id, class_id, n_links (other rows that are similar to it), kept (one of each class: the smallest doc_id, then the first row)."""
    scratch = Scratch(docs.sparkSession, "near")
    if PLACE not in docs.columns:
        docs = docs.select("doc_id", "text")
    texts = rows(numbered(docs, scratch), "text")
    sketch = scratch.table(texts.mapInArrow(_sketch, "uid bigint, doc_id bigint, n bigint, f1 bigint, f2 bigint, sig binary"), "sketch", rows=texts.count(), dealt=True)

    many = sketch.count()
    # One representative for each set; its weight is the number of rows that have the set.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    sets = scratch.table(sketch.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("uid").alias("rep"), F.count("*").alias("weight"), first.alias("first")), "sets", rows=many)
    reps = sketch.where("n > 0").select("uid", "n", "sig").join(sets.select(F.col("rep").alias("uid"), "weight"), "uid")
    reps = scratch.table(reps, "reps", rows=many)

    shared = forest(reps, scratch, many, similarity, recall).withColumnRenamed("node", "prefix")
    many_shared = shared.count()
    shared = shared.withColumn("tiles", F.ceil(F.col("size") / NODE_TILE).cast("int"))
    under = tiled(shared.join(reps.select("uid", "sig"), "uid"), "tiles").select("tree", "prefix", "i", "j", "uid", "tile", "sig")
    under = under.repartition("tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j", "uid")
    candidates = connected_components(under.mapInArrow(_compare(least_agreement(similarity)), "a bigint, b bigint"), scratch, "candidates", many_shared)

    candidates = scratch.table(candidates, "candidates", rows=many)
    grouped_rows = candidates.count()
    candidates = candidates.withColumnRenamed("node", "uid").join(reps.select("uid", "n", "weight"), "uid")
    fit = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_SHINGLES) / F.max("n"))))
    sizes = scratch.table(candidates.groupBy("root").agg(F.ceil(F.count("*") / fit).cast("int").alias("tiles")), "candidate_sizes", rows=grouped_rows)
    grouped = candidates.join(sizes, "root").select("uid", "root", "tiles", "weight")
    sized = texts.select("uid", "text").join(grouped, "uid").select("uid", "text", "root", "tiles", "weight")
    sized = sized.mapInArrow(_sets, "uid bigint, text binary, root bigint, tiles int, weight bigint").withColumnRenamed("text", "shingles")
    work = tiled(sized, "tiles").select("root", "i", "j", "uid", "tile", "weight", "shingles")
    work = work.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "uid")
    verified = scratch.table(work.mapInArrow(_verify(similarity), "a bigint, b bigint, links bigint"), "verified", rows=8 * grouped_rows, per_file=200_000, dealt=True)

    links = verified.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = scratch.table(connected_components(verified.where("b is not null").select("a", "b"), scratch, "classes", verified.count()), "classes", rows=grouped_rows)
    of_rep = scratch.table(
        sets.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .select("n", "f1", "f2", "first", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
        "of_rep",
        rows=many,
    )
    heads = scratch.table(of_rep.groupBy("root").agg(F.min("first").alias("head")), "heads", rows=many)
    of_set = scratch.table(of_rep.join(heads, "root").select("n", "f1", "f2", "head", "n_links"), "of_set", rows=many)
    found = sketch.where("n > 0").select("uid", "doc_id", "n", "f1", "f2").join(of_set, ["n", "f1", "f2"])
    found = found.select("uid", "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("uid") == F.col("head.uid")).alias("kept"))
    alone = sketch.where("n = 0").select("uid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    return found.unionByName(alone)
