"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed size. The distinct blocks are sorted, by a hash and then by their bytes, and each gets its
rank as its name; then the names of adjacent blocks are paired, the distinct pairs sorted and named, and so on until each text
has one name. Equal names in the same round mean equal texts: contents are compared, never hashes alone. Ranks don't depend on
how rows are split over tasks, so the same texts get the same names on any cluster.

Texts are read and cut once, into a stored table. Only one copy of a block leaves each map task: within a task, every row refers to the first row that has the same
content there (its leader). The content of the leaders is shuffled to be named, then rows fetch the names of their
leaders, of which each has the rows of its task at most. So no key gathers the rows of a large group.

Normalisation deletes the white space [\\x20\\x09-\\x0D]. A null or empty text counts as empty, all of these as equal.
Repeated rows, also with the same doc_id, are rows of their own; null doc_ids sort last. Of a group, the row with
the most code points in the original text stays, then the one with the smallest doc_id, then the first row.
An empty table gives no row. Very long texts are read whole, their blocks are named one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .text import rows

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of a block.
BLOCK = 4096
#: Bytes of content that a task remembers at a time to find leaders.
REMEMBER = 64 << 20


class _Leaders:
    """Gives each content the (uid, pos) of the first row that had it lately."""

    def __init__(self):
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.size = 0

    def of(self, content: bytes, uid: int, pos: int) -> tuple[int, int]:
        found = self.seen.get(content)
        if found is None:
            if self.size > REMEMBER:
                self.seen, self.size = {}, 0
            self.seen[content] = found = (uid, pos)
            self.size += len(content) + 200
        return found


def _texts(batches: Iterator[pa.RecordBatch]):
    """(uid, doc_id, original text, normalised text in UTF-8)."""
    for batch in batches:
        raw = batch.column(2).cast(pa.binary()).to_pylist()
        for uid, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw, strict=True):
            yield uid, doc_id, data or b"", (data or b"").translate(None, BLANKS)


def _code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


def _batches(found, schema: pa.Schema, rows_most: int = 4096, bytes_most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= rows_most or size >= bytes_most:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_PLACE = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("leader", pa.int64()), ("leader_pos", pa.int64()), ("n_cp", pa.int64()), ("sha", pa.binary()), ("content", pa.binary())])
_NAME = pa.schema([("leader", pa.int64()), ("leader_pos", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])
PLACED = "uid bigint, doc_id bigint, pos bigint, leader bigint, leader_pos bigint, n_cp bigint, sha binary, content binary"


def _blocks(block: int):
    """Each block's leader, with its content if it leads; a text's length and hash with its first block."""

    def found(batches):
        leaders = _Leaders()
        for uid, doc_id, data, norm in _texts(batches):
            for pos in range(max(1, -(-len(norm) // block))):
                content = norm[pos * block : (pos + 1) * block]
                leader = leaders.of(content, uid, pos)
                yield (uid, doc_id, pos, *leader, None if pos else _code_points(data), None if pos else hashlib.sha256(norm).digest(), content if leader == (uid, pos) else None)

    return lambda batches: _batches(found(batches), _PLACE)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for rows (uid, names): the pairs of adjacent names; a last one alone is paired with 0, which names nothing."""

    def found():
        leaders = _Leaders()
        for batch in batches:
            for uid, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(names) % 2:
                    names.append(0)
                for pos in range(len(names) // 2):
                    content = names[2 * pos].to_bytes(8, "big") + names[2 * pos + 1].to_bytes(8, "big")
                    leader = leaders.of(content, uid, pos)
                    yield (uid, None, pos, *leader, None, None, content if leader == (uid, pos) else None)

    return _batches(found(), _PLACE)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the distinct contents of a task's sorted rows, from 1."""

    def named():
        place, last = 0, None
        for batch in batches:
            for part, uid, pos, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if content != last:
                    place, last = place + 1, content
                yield uid, pos, part, place

    return _batches(named(), _NAME)


def _named(placed: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """Each place with the name of its content, its rank among all of the round."""
    led = placed.where("content is not null").select("uid", "pos", "content").withColumn("h", F.xxhash64("content"))
    # By ranges of the hash, which are even whatever the contents are, and whose bounds are small.
    ordered = led.repartitionByRange("h").sortWithinPartitions("h", "content").select(F.spark_partition_id().alias("part"), "uid", "pos", "content")
    names = scratch.table(ordered.mapInArrow(_number, "leader bigint, leader_pos bigint, part int, place bigint"), f"{table}_names", rows=placed.count(), per_file=400_000, dealt=True)
    counts = names.groupBy("part").agg(F.max("place").alias("n"))
    # One row for each range partition.
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    names = names.join(F.broadcast(before), "part").select("leader", "leader_pos", (F.col("before") + F.col("place")).alias("name"))
    return placed.drop("content").join(names, ["leader", "leader_pos"], "left")


def identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """uid, doc_id, n_cp, sha and the identity (round, name) of every row."""
    placed = scratch.table(rows(docs, "text").mapInArrow(_blocks(block), PLACED), "blocks")
    many = docs.count()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")
    whole = _named(placed, scratch, "round0").groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_cp").alias("n_cp"), F.max(F.hex("sha")).alias("sha"), listed)
    whole = scratch.table(whole, "round0", rows=many)
    done = whole.where(F.size("names") == 1).select("uid", "doc_id", "n_cp", "sha", F.lit(0).alias("round"), F.col("names")[0].alias("name"))
    k, left = 0, whole.where(F.size("names") > 1)
    rest = left
    while (most := rest.agg(F.max(F.size("names"))).first()[0] or 1) > 1:
        k += 1
        pairs = scratch.table(rest.select("uid", "names").mapInArrow(_pairs, PLACED), f"pairs{k}")
        again = _named(pairs, scratch, f"round{k}").groupBy("uid").agg(listed)
        rest = scratch.table(again, f"round{k}", rows=many)
        found = rest.where(F.size("names") == 1).select("uid", F.lit(k).alias("round"), F.col("names")[0].alias("name"))
        done = done.unionByName(left.join(found, "uid").select("uid", "doc_id", "n_cp", "sha", "round", "name"))
        rest = rest.where(F.size("names") > 1)
        if most <= 2:
            break
    return done


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 (of the normalised text), uid."""
    scratch = Scratch(docs.sparkSession, "exact")
    found = scratch.table(identities(docs, scratch, block), "identities", rows=(many := docs.count()))
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    groups = scratch.table(found.groupBy("round", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups", rows=many)
    return found.join(groups, ["round", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.lower("sha").alias("text_sha256"), "uid"
    )
