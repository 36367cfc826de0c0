"""Benchmark decontamination by a distributed positional inverted index.

The training documents are indexed once, in segments: for each of a segment's words the sorted positions there, stored
as tables in the shared folder with the segment's dictionary. A test item's windows are then looked up in every segment: beginning with the
postings of the window's rarest term there, the lists of the other terms, each moved by the term's offset, are
intersected one after the other, the rarer first. What is left are exact phrase matches. Proximity matches keep
the order of the terms and allow some other words between them. The index holds all words, so further test items are looked up in it
without reading the documents again. No postings move between tasks.

Terms are the words of A-Z lower-cased text: runs of digits, ASCII letters and non-ASCII characters. Within a segment words are told
apart by a hash of 64 bits; a term's spelling is compared with the dictionary's.

Null and empty texts have no words: n_words 0, nothing hit. An item without words matches nothing. Items with the same item_id
count as one item, so do all with a null one, which has no name. Repeated documents are answered one by one. An empty benchmark
hits nothing. Very long documents make a segment of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .text import WORD_TABLE, hash_words, pieces, rows, segment

#: Consecutive words of an item that make a window.
WINDOW = 10
#: Words between the terms of a proximity match, at most, all together.
SLOP = 4
#: Positions between two documents of a segment, more than a window and its slop.
GAP = 64
#: Words of a segment, and words of test items that are looked up at a time (more are looked up in blocks).
SEGMENT_WORDS = 1 << 19
QUERY_WORDS = 1 << 20
#: Candidates that are intersected at a time.
CHUNK = 1 << 20


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(WORD_TABLE).split()


class Items:
    """Windows of test items as rows of term numbers; -1 behind a shorter one."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = sorted({k for k, _ in items}, key=lambda k: (k is None, k))
        self.terms: dict[bytes, int] = {}
        number = {k: n for n, k in enumerate(self.ids)}
        found: dict[tuple[int, tuple[int, ...]], None] = {}
        for key, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            for i in range(max(0, len(ids) - window) + 1 if ids else 0):
                found[number[key], tuple(ids[i : i + window])] = None
        self.item = np.array([k[0] for k in found], np.int64)
        self.size = np.array([len(k[1]) for k in found], np.int64)
        self.windows = np.full((len(found), window), -1, np.int64)
        for n, (_, ids) in enumerate(found):
            self.windows[n, : len(ids)] = ids
        self.spelling = b"".join(self.terms)
        self.length = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        ends = np.cumsum(self.length)
        self.hashes = hash_words(np.frombuffer(self.spelling, np.uint8), ends - self.length, ends)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _slices(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[0], first[0] + 1, ... of all slices, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _index(segment_words: int):
    kind = pa.schema([("segment", pa.int64()), ("uids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("hashes", "spelling", "length", "df", "postings")]])

    def one(parts: list[tuple], number: int) -> pa.RecordBatch:
        """parts: (uids, doc_ids, words of each document, word hashes, bytes, starts and ends of words)."""
        counts = np.concatenate([p[2] for p in parts])
        hashes = np.concatenate([p[3] for p in parts])
        base = np.cumsum(counts + GAP) - counts - GAP
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        positions = (np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(len(hashes)))[order].astype(np.int32)
        # The spelling of each word where it comes first.
        before = np.cumsum([0] + [len(p[3]) for p in parts])
        at = order[first]
        of = np.searchsorted(before, at, "right") - 1
        length, texts = np.zeros(len(at), np.int32), [b""] * len(at)
        for k, p in enumerate(parts):
            mine = np.flatnonzero(of == k)
            a, e = p[5][at[mine] - before[k]], p[6][at[mine] - before[k]]
            length[mine] = e - a
            spelled = p[4][_slices(a, e - a)].tobytes()
            ends = np.cumsum(e - a).tolist()
            for n, i, j in zip(mine.tolist(), [0, *ends], ends, strict=False):
                texts[n] = spelled[i:j]
        packed = (hashes[first], np.frombuffer(b"".join(texts), np.uint8), length, np.diff(first, append=len(hashes)).astype(np.int32), np.diff(positions, prepend=np.int32(0)))
        return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([sum((p[k] for p in parts), [])], pa.list_(pa.int64())) for k in (0, 1)], pa.array([counts.tolist()], pa.list_(pa.int64())), *[pa.array([_pack(x)], pa.binary()) for x in packed]], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = number = 0
        for batch in batches:
            for i, j, data, at in pieces(batch.column(2)):
                mapped, starts, ends, word_at = segment(data, at)
                part = batch.slice(i, j - i)
                held.append((part.column(0).to_pylist(), part.column(1).to_pylist(), np.diff(word_at), hash_words(mapped, starts, ends), mapped, starts, ends))
                size += len(starts) + (j - i) * GAP
                if size >= segment_words:
                    yield one(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield one(held, number)

    return run


INDEX = "segment bigint, uids array<bigint>, doc_ids array<bigint>, n_words array<bigint>, hashes binary, spelling binary, length binary, df binary, postings binary"


class Segment:
    """Postings of the items' terms in one segment: positions, sorted by term and position."""

    def __init__(self, row: dict, items: Items):
        hashes, length, df = _unpack(row["hashes"], "u8"), _unpack(row["length"], "i4").astype(np.int64), _unpack(row["df"], "i4").astype(np.int64)
        n = len(items.hashes)
        self.df = np.zeros(n + 1, np.int64)
        at = np.minimum(np.searchsorted(hashes, items.hashes), max(len(hashes) - 1, 0))
        held = np.flatnonzero((hashes[at] == items.hashes) & (length[at] == items.length)) if len(hashes) else np.zeros(0, np.int64)
        spelling = np.frombuffer(items.spelling, np.uint8)
        mine = spelling[_slices((np.cumsum(items.length) - items.length)[held], items.length[held])]
        theirs = _unpack(row["spelling"], "u1")[_slices((np.cumsum(length) - length)[at[held]], length[at[held]])]
        other = np.unique(np.repeat(held, items.length[held])[mine != theirs])
        held = held[~np.isin(held, other)]
        self.df[held] = df[at[held]]
        self.first = np.cumsum(self.df) - self.df
        positions = np.cumsum(_unpack(row["postings"], "i4"), dtype=np.int32)
        self.positions = positions[_slices((np.cumsum(df) - df)[at[held]], df[at[held]])].astype(np.int64)
        self.keys = np.repeat(np.arange(n + 1, dtype=np.int64), self.df) << 32 | self.positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term << 32 | position
        at = np.searchsorted(self.keys, want)
        return (position >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)

    def neighbour(self, term: np.ndarray, position: np.ndarray, ahead: bool) -> np.ndarray:
        """The nearest position of the term after (or before) another one; -1 without."""
        at = np.searchsorted(self.keys, term << 32 | position, "right" if ahead else "left") - (0 if ahead else 1)
        ok = (at >= self.first[term]) & (at < self.first[term] + self.df[term])
        return np.where(ok, self.positions[np.clip(at, 0, len(self.keys) - 1)], -1)


def _candidates(seg: Segment, items: Items, which: np.ndarray):
    """For runs of windows all of whose terms occur: (window of each candidate, position of its rarest term, order of offsets by frequency)."""
    windows = items.windows[which]
    df = np.where(windows >= 0, seg.df[windows], np.iinfo(np.int64).max)
    which = which[(df > 0).all(axis=1)]
    windows = items.windows[which]
    df = np.where(windows >= 0, seg.df[windows], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    rarest = windows[np.arange(len(which)), order[:, 0]] if len(which) else np.zeros(0, np.int64)
    n = seg.df[rarest]
    ends = np.cumsum(n)
    i = 0
    while i < len(which):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + CHUNK, "right")))
        row = np.repeat(np.arange(i, j), n[i:j])
        at = np.repeat(seg.first[rarest[i:j]] - (ends[i:j] - n[i:j] - (ends[i] - n[i])), n[i:j]) + np.arange(len(row))
        yield which[row], seg.positions[at], order[row]
        i = j


def phrase_matches(seg: Segment, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its first word) of all exact occurrences."""
    out = []
    for window, position, order in _candidates(seg, items, np.arange(len(items.windows))):
        start = position - order[:, 0]
        for k in range(1, items.windows.shape[1]):
            offset = order[:, k]
            term = items.windows[window, offset]
            ok = (term < 0) | seg.has(np.maximum(term, 0), start + offset)
            window, start, order = window[ok], start[ok], order[ok]
        ok = start >= 0
        out.append((window[ok], start[ok]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def proximity_matches(seg: Segment, items: Items, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position, last position) of the windows whose terms occur in order with 1 to `slop` other words between; the tightest about each place of the rarest term."""
    out = []
    for window, position, order in _candidates(seg, items, np.flatnonzero(items.size > 1)):
        centre, size = order[:, 0], items.size[window]
        low, high, ok = position.copy(), position.copy(), np.ones(len(position), bool)
        for step in range(1, items.windows.shape[1]):
            for ahead in (True, False):
                offset = centre + step if ahead else centre - step
                live = ok & (offset < size if ahead else offset >= 0)
                if live.any():
                    k = np.flatnonzero(live)
                    edge = high if ahead else low
                    edge[k] = seg.neighbour(items.windows[window[k], offset[k]], edge[k], ahead)
                    ok[k] = edge[k] >= 0
            ok &= high - low < size + slop
            if not ok.all():
                window, centre, size, low, high, ok = (x[ok] for x in (window, centre, size, low, high, ok))
        near = high - low >= size
        out.append(np.unique(np.stack([window[near], low[near], high[near]]), axis=1))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


MATCHES = "uid bigint, doc_id bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>, near array<struct<item:string,a:bigint,b:bigint>>"


def _query(given, slop: int):
    kind = pa.schema(
        [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.struct([("item", pa.string()), ("a", pa.int64()), ("b", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = given.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                counts = np.array(row["n_words"], np.int64)
                base = np.cumsum(counts + GAP) - counts - GAP
                seg = Segment(row, items)
                spans: list[list] = [[] for _ in counts]
                names: list[list] = [[] for _ in counts]
                near: list[list] = [[] for _ in counts]
                if len(seg.keys) and len(items.windows):
                    window, start = phrase_matches(seg, items)
                    order = np.argsort(start, kind="stable")
                    window, start = window[order], start[order]
                    end = start + items.size[window]
                    doc = np.searchsorted(base, start, "right") - 1
                    for d, i in np.unique(np.stack([doc, items.item[window]]), axis=1).T.tolist():
                        names[d].append(items.ids[i])
                    reach = np.maximum.accumulate(end) if len(end) else end
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(end) else np.zeros(0, np.int64)
                    for n, e in zip(new.tolist(), reach[np.append(new[1:], len(end)) - 1].tolist() if len(new) else [], strict=True):
                        spans[doc[n]].append({"a": int(start[n] - base[doc[n]]), "b": int(e - base[doc[n]])})
                    for w, a, b in zip(*(x.tolist() for x in proximity_matches(seg, items, slop)), strict=True) if slop else ():
                        d = int(np.searchsorted(base, a, "right")) - 1
                        near[d].append({"item": items.ids[items.item[w]], "a": a - int(base[d]), "b": b + 1 - int(base[d])})
                yield pa.RecordBatch.from_pydict({"uid": row["uids"], "doc_id": row["doc_ids"], "n_words": row["n_words"], "spans": spans, "items": names, "near": near}, kind)

    return run


def build_index(docs: DataFrame, scratch: Scratch, name: str = "index", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Stores the postings of all words of `docs`, segment by segment."""
    return scratch.table(rows(docs, "text").mapInArrow(_index(segment_words), INDEX), name, compression="none")


def search(index: DataFrame, items: Items, slop: int = SLOP) -> DataFrame:
    """Looks the items' windows up in every segment; a row per document, also without a match: spans of hit words, items with exact matches, proximity matches."""
    return index.mapInArrow(_query(index.sparkSession.sparkContext.broadcast(items), slop), MATCHES)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, query_words: int = QUERY_WORDS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """uid, doc_id, n_words, spans, items and near of every document.

    The documents are read once. The benchmark's words are counted; up to `query_words` of them are sent to the executors at a time. A
    larger benchmark is looked up in the index in blocks of items and the blocks' matches are put together by document.
    """
    index = build_index(docs, Scratch(docs.sparkSession, "decontaminate"), segment_words=segment_words)
    items = benchmark.select(F.col("item_id").cast("string").alias("k"), F.col("text").alias("t")).where("t is not null")
    total = items.select(F.sum(F.ceil(F.octet_length("t") / 2))).first()[0] or 0
    blocks = int(-(-total // query_words)) or 1
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        one = search(index, Items([(r[0], r[1]) for r in part.toLocalIterator()], window), slop)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")])
    return found


def summary(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit (words in any match), n_items, items_sha256, contaminated, n_near."""
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n")),
        lambda x, s: F.struct(F.greatest(x["to"], s["b"]).alias("to"), (x["n"] + F.greatest(s["b"] - F.greatest(x["to"], s["a"]), F.lit(0))).alias("n")),
    )["n"]
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
    )
