"""Token ids in shards, each one compressed file with a wavelet matrix.

A shard's file holds the shard's token sequence as bit planes (the wavelet matrix of Claude, Navarro and
Ordóñez), its alphabet and its documents (their ids and lengths, and what is carried along). Planes are cut into blocks of
BLOCK bits that are compressed apart; the header has the ones before each block and samples for select. So single tokens, counts
and the places of an id are read by inflating the blocks on their way alone; decode() returns the whole sequence.
A file answers by itself: `WaveletMatrix.from_bytes` needs nothing else.

Ids are those of the tokenizers library at its defaults, without added special tokens. Documents are sorted by doc_id (nulls
first, repeated doc_ids in the order of the rows). Null texts are empty; an empty document has its end id alone. A very long document has
a shard of its own. An empty table gives no shard and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, narrowed
from .text import pieces, rows, utf8

MAGIC = b"WVM2"
#: Bits of a block of a plane, and bits between two entries of the rank directory of an inflated block.
BLOCK, STEP = 1 << 18, 512
#: Marks a cut inside a word while it is encoded; texts with this character are encoded as they are.
CUT = "\x01"
#: Words whose ids an encoder keeps.
KEEP = 800_000
#: Tokens of a shard; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20


class Plane:
    """Bits with rank and select. Blocks are inflated when they are first asked for."""

    def __init__(self, n: int, blocks: list[bytes], before: np.ndarray):
        """blocks: compressed; before: ones before each block, and all."""
        self.n, self.blocks, self.before = n, blocks, before
        self.zeros = n - int(before[-1])
        starts = np.minimum(np.arange(len(before), dtype=np.int64) * BLOCK, n)
        self.counts = (starts - before, before)
        # For each bit, the block of every BLOCK-th such bit, so select looks at a few blocks only.
        self.samples = tuple(np.searchsorted(c, np.arange(0, int(c[-1]) + BLOCK, BLOCK), "right") - 1 for c in self.counts)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, bit: np.ndarray, pack) -> Plane:
        packed = np.packbits(bit, bitorder="little")
        parts = [packed[k : k + BLOCK // 8] for k in range(0, len(packed), BLOCK // 8)]
        before = np.cumsum([0] + [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in parts])
        return cls(len(bit), [pack(x.tobytes()) for x in parts], before)

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ones before every STEP bits of the block)."""
        if k not in self.held:
            data = np.zeros(BLOCK // 8, np.uint8)
            raw = zstandard.ZstdDecompressor().decompress(self.blocks[k])
            data[: len(raw)] = np.frombuffer(raw, np.uint8)
            self.held[k] = data, np.concatenate([[0], np.cumsum(np.bitwise_count(data).reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64))])
        return self.held[k]

    def bits(self) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        return np.unpackbits(np.frombuffer(b"".join(map(unpack, self.blocks)), np.uint8), bitorder="little", count=self.n).view(bool)

    def get(self, i: int) -> int:
        return int(self._block(i // BLOCK)[0][i % BLOCK >> 3] >> (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones before place i."""
        k, rest = divmod(i, BLOCK)
        if not rest:
            return int(self.before[k])
        data, ranks = self._block(k)
        step = rest // STEP
        part = np.unpackbits(data[step * STEP // 8 : (rest + 7) // 8], bitorder="little")[: rest - step * STEP]
        return int(self.before[k] + ranks[step] + part.sum())

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        counts, sample = self.counts[bit], self.samples[bit]
        low, high = int(sample[k // BLOCK]), int(sample[k // BLOCK + 1])
        block = low + int(np.searchsorted(counts[low : high + 1], k, "right")) - 1
        data, ranks = self._block(block)
        k -= int(counts[block])
        if not bit:
            ranks = np.arange(len(ranks), dtype=np.int64) * STEP - ranks
        step = int(np.searchsorted(ranks, k, "right")) - 1
        part = np.unpackbits(data[step * STEP // 8 : (step + 1) * STEP // 8], bitorder="little")
        return block * BLOCK + step * STEP + int(np.flatnonzero(part == bit)[k - ranks[step]])


class WaveletMatrix:
    """Bit planes of a sequence over a sorted alphabet, the highest bit first, and the documents that it consists of. Behind each plane, zeros come before ones."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[Plane], doc_ids: list[int | None], counts: np.ndarray, carried: np.ndarray | None = None):
        self.n, self.alphabet, self.planes, self.doc_ids, self.counts, self.carried = n, alphabet, planes, doc_ids, counts, carried

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: list[int | None] | None = None, counts: np.ndarray | None = None, carried: list[float | None] | None = None) -> WaveletMatrix:
        pack = zstandard.ZstdCompressor(level=1).compress
        alphabet = np.flatnonzero(np.bincount(ids)).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
        code = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        values, width = code[ids], max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        planes = []
        for k in range(width - 1, -1, -1):
            bit = (values & values.dtype.type(1 << k)) != 0
            planes.append(Plane.build(bit, pack))
            values = np.concatenate([values.take(np.flatnonzero(~bit)), values.take(np.flatnonzero(bit))])
        return cls(len(ids), alphabet, planes, doc_ids or [], np.array([] if counts is None else counts, np.int64), None if carried is None else np.array([np.nan if x is None else x for x in carried], float))

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit, ones = plane.get(i), plane.rank1(i)
            value = value << 1 | bit
            i = plane.zeros + ones if bit else i - ones
        return int(self.alphabet[value])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        value = int(np.searchsorted(self.alphabet, token))
        if value >= len(self.alphabet) or self.alphabet[value] != token:
            return 0, 0
        low, high, width = 0, i, len(self.planes)
        for level, plane in enumerate(self.planes):
            a, b = plane.rank1(low), plane.rank1(high)
            low, high = (plane.zeros + a, plane.zeros + b) if value >> (width - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs before place i."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def occurrences(self, token: int) -> list[int]:
        """All places of the token, ascending."""
        low, high = self._range(token, self.n)
        value, width, out = int(np.searchsorted(self.alphabet, token)), len(self.planes), []
        for at in range(low, high):
            for level in range(width - 1, -1, -1):
                bit = value >> (width - 1 - level) & 1
                at = self.planes[level].select(bit, at - self.planes[level].zeros if bit else at)
            out.append(at)
        return out

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        values = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            bit = plane.bits()
            before = np.empty_like(values)
            before[np.flatnonzero(~bit)] = values[: plane.zeros]
            before[np.flatnonzero(bit)] = values[plane.zeros :] | values.dtype.type(1 << k)
            values = before
        return self.alphabet[values]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document."""
        ids, ends = self.decode(), np.cumsum(self.counts)
        for doc_id, a, e in zip(self.doc_ids, (ends - self.counts).tolist(), ends.tolist(), strict=True):
            yield doc_id, ids[a:e]

    def to_bytes(self) -> bytes:
        """Header; alphabet, documents' null flags, ids, lengths and carried values; then of each plane its ones before the blocks and its blocks. Each part behind its length."""
        pack = zstandard.ZstdCompressor(level=1).compress
        flags = np.array([d is None for d in self.doc_ids], bool)
        parts = [self.alphabet.astype("<u4"), np.packbits(flags), np.array([d or 0 for d in self.doc_ids], "<i8"), self.counts.astype("<i8"), np.array([] if self.carried is None else self.carried, "<f8")]
        out = [pack(x.tobytes()) for x in parts]
        for plane in self.planes:
            out += [pack(plane.before.astype("<i8").tobytes()), *plane.blocks]
        header = struct.pack("<4sQQBB", MAGIC, self.n, len(self.doc_ids), len(self.planes), self.carried is not None)
        return header + b"".join(struct.pack("<I", len(x)) + x for x in out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, docs, width, carries = struct.unpack_from("<4sQQBB", data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at, unpack = struct.calcsize("<4sQQBB"), zstandard.ZstdDecompressor().decompress

        def part() -> bytes:
            nonlocal at
            (length,) = struct.unpack_from("<I", data, at)
            at += 4 + length
            if at > len(data):
                raise ValueError("damaged shard file")
            return data[at - length : at]

        alphabet, flags, doc_ids, counts, carried = (np.frombuffer(unpack(part()), k) for k in ("<u4", "u1", "<i8", "<i8", "<f8"))
        none = np.unpackbits(flags, count=docs).view(bool).tolist()
        planes = []
        for _ in range(width):
            before = np.frombuffer(unpack(part()), "<i8")
            planes.append(Plane(n, [part() for _ in range(len(before) - 1)], before))
        return cls(n, alphabet, planes, [None if x else d for d, x in zip(doc_ids.tolist(), none, strict=True)], counts, carried if carries else None)


class Encoder:
    """Encodes with the tokenizers library; keeps the ids of words that it has met.

    A byte-level BPE splits text before a single space, so a text's ids are those of its words, each with the
    space before it. It also splits between a letter and a mark that ends the word, and before a lone line end;
    there, too, words are cut, which keeps them few. Texts in which a space follows a space or ends the text, and those that hold an added
    token, are encoded as they are.
    Beyond `keep` words, those met once are forgotten.
    """

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        self.keep = keep
        #: What makes a text one that is encoded as it is.
        self.marks = ["  ", CUT, *sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.byte_level = self._is_byte_level()
        self._forget()

    def _is_byte_level(self) -> bool:
        probe = "ab cd\n ef \n gh's  12 é  x\n"
        return all(self._ids(a + b) == self._ids(a) + self._ids(b) for a, b in (("ab", " cd"), ("ab\n", " ef"), (" é ", " x\n"))) and int(self.bytes_of[self._ids(probe)].sum()) == len(probe.encode()) and self._ids(" a") != self._ids("a")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _tidy(self) -> None:
        """Keeps the words met more than once, or of these the more frequent half if they are too many."""
        words, code = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        stay = code[self.met[code] > 1]
        if len(stay) > self.keep // 2:
            stay = stay[self.met[stay] > np.median(self.met[stay])]
        names, size, met = [words[k] for k in stay.tolist()], self.size[stay], self.met[stay]
        ids = self.pool[np.repeat(self.first[stay] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self._forget()
        self._keep(names, ids, size)
        self.met[: len(names)] = met

    def _learn(self, words: list[str]) -> None:
        """words: a middle word without the space before it; a text's first word with a space behind it; what follows a cut without a space, behind the mark of the cut."""
        middle = [w for w in words if w[-1:] != " " and w[:1] != CUT]
        for i in range(0, len(middle), 20_000):
            part = [f" {w}" for w in middle[i : i + 20_000]]
            # Some hundred words at a time: the library takes longer over long texts.
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(["".join(part[k : k + 250]) for k in range(0, len(part), 250)], add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)))) + 1
            self._keep(middle[i : i + 20_000], ids, np.diff(ends, prepend=0))
        first = [w for w in words if w[-1:] == " " or w[:1] == CUT]
        if first:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([w[1:] if w[0] == CUT else w[:-1] for w in first], add_special_tokens=False)]
            self._keep(first, np.fromiter((k for x in got for k in x), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def _keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + m > len(self.first):
            self.first, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.met))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[n : n + m] = self.used + np.cumsum(size) - size
        self.size[n : n + m] = size
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m), strict=True))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Nulls are empty."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if len(self.known) > self.keep:
            self._tidy()
        odd = pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")).to_numpy(zero_copy_only=False) | (not self.byte_level)
        # Looked for in all texts at once first: most have neither. A find may span two texts, so each is asked then.
        together = utf8(column)[0].tobytes()
        for mark in self.marks:
            if mark.encode() in together:
                odd |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        full = pc.binary_length(column).to_numpy() > 0
        plain = full & ~odd
        counts, ids = np.zeros(len(column), np.int64), np.zeros(0, np.uint32)
        if plain.any():
            cut = pc.replace_substring_regex(column.filter(pa.array(plain)), r"(\pL)([.,])([ \n]|$)", rf"\1 {CUT}\2\3")
            cut = pc.replace_substring_regex(cut, r"([\pL\pN.,;:!?])\n([\pL\pN])", f"\\1 {CUT}\n\\2")
            split = pc.split_pattern(cut, " ")
            at = split.offsets.to_numpy().astype(np.int64)
            words = split.flatten().dictionary_encode()
            place, names = words.indices.to_numpy(), words.dictionary.to_pylist()
            codes = self._codes(names)[place]
            # A text's first word has no space before it; its key ends in one, which no other key does.
            first = at[:-1] - at[0]
            codes[first] = self._codes([names[k] + " " for k in place[first].tolist()])
            seen = np.bincount(codes)
            self.met[: len(seen)] += seen
            size = self.size[codes]
            ends = np.cumsum(size)
            where = np.repeat((self.first[codes] - (ends - size)).astype(np.int32), size)
            where += np.arange(len(where), dtype=np.int32)
            ids = self.pool.take(where)
            counts[plain] = np.diff(np.concatenate([[0], ends])[at - at[0]])
        rest = np.flatnonzero(full & odd).tolist()
        if rest:
            got = {k: np.array(e.ids, np.uint32) for k, e in zip(rest, self.tokenizer.encode_batch([column[k].as_py() for k in rest], add_special_tokens=False), strict=True)}
            at = np.concatenate([[0], np.cumsum(counts)])
            ids = np.concatenate([got[k] if k in got else ids[at[k] : at[k + 1]] for k in range(len(column))])
            for k, x in got.items():
                counts[k] = len(x)
        return ids, counts

    def _codes(self, words: list[str]) -> np.ndarray:
        """The number of each word; new ones are learned."""
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(codes < 0)):
            new = list(map(words.__getitem__, missing.tolist()))
            self._learn(list(dict.fromkeys(new)))
            codes[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return codes


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """One for each Python worker, the last that was asked for."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, keep] = Encoder(path, keep)
    return _ENCODERS[path, keep]


def _write(path: str, end_id: int, shard_tokens: int, keep: int = KEEP, carry: bool = False):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])

    def shard(part: int, block: int, before: int, ids: np.ndarray, doc_ids: list, counts: np.ndarray, carried: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "before": [before], "n_tokens": [len(ids)], "file": [WaveletMatrix.build(ids, doc_ids, counts, carried if carry else None).to_bytes()]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = -1, encoder(path, keep)
        held: list[tuple[np.ndarray, list, np.ndarray, list]] = []
        block = before = waiting = 0

        def flush():
            nonlocal block, before, waiting, held
            ids = np.concatenate([x[0] for x in held])
            out = shard(part, block, before, ids, [d for x in held for d in x[1]], np.concatenate([x[2] for x in held]), [c for x in held for c in x[3]])
            block, before, waiting, held = block + 1, before + len(ids), 0, []
            return out

        for batch in batches:
            if part < 0 and batch.num_rows:
                part = batch.column(2)[0].as_py()
            for i, j, _, _ in pieces(batch.column(1), 1 << 22):
                ids, counts = enc.encode(batch.column(1)[i:j])
                places = np.ones(len(ids) + len(counts), bool)
                counts = counts + 1
                places[np.cumsum(counts) - 1] = False
                with_end = np.full(len(places), end_id, np.uint32)
                with_end[places] = ids
                held.append((with_end, batch.column(0)[i:j].to_pylist(), counts, batch.column(3)[i:j].to_pylist() if carry else []))
                waiting += len(with_end)
                if waiting >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, keep: int = KEEP, carry: str | None = None) -> DataFrame:
    """Encodes the texts, sorted by doc_id, and writes the shards: part, block, before (ids of the part before the shard), n_tokens and the file, which holds the documents' values of the column `carry`, too, if one is named."""
    more = [carry] if carry else []
    ordered = rows(docs, "text", *more).repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid").select("doc_id", "text", F.spark_partition_id().alias("part"), *more)
    shards = ordered.mapInArrow(_write(tokenizer, end_id, shard_tokens, keep, bool(carry)), "part int, block int, before bigint, n_tokens bigint, file binary")
    return scratch.table(narrowed(shards, docs.select("text")), "shards", compression="none")


def _read(carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = WaveletMatrix.from_bytes(file)
                ids, counts = shard.decode().astype("<u4"), shard.counts
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(counts), pa.int32()),
                        "doc_id": pa.array(shard.doc_ids, pa.int64()),
                        "at": pa.array(before + ends - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array([zlib.crc32(ids[e - c : e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                        **({"carried": pa.array(shard.carried, from_pandas=True)} if carry else {}),
                    }
                )

    return run


def read_documents(shards: DataFrame, carry: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 of each document, and what is carried."""
    more = ["carried"] if carry else []
    read = shards.select("part", "before", "file").mapInArrow(_read(carry), "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", carried double" * len(more))
    # One row for each range partition, so what is broadcast grows with their number alone.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return read.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *more)


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, keep: int = KEEP, carry: str | None = None) -> DataFrame:
    """keep: words that each worker remembers, which takes about 250 bytes a word and saves encoding them again; carry: a column of numbers that goes along. Writes the shards of `docs` and returns what their files hold of each document."""
    found = read_documents(write_shards(docs, Scratch(docs.sparkSession, "tokens"), tokenizer, end_id, shard_tokens, keep, carry), bool(carry))
    return found.withColumnRenamed("carried", carry) if carry else found
