"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A conversation's messages are read as lines. The hidden state of a line is a role and whether the line begins a turn.
What is seen of a line is its speaker marker (`User:`, `### Assistant`, `<|system|>` and the like), whether it begins a
message, its length, its ending and its shape. Distributions are counted on labelled messages of a bounded
sample of conversations, with prior counts for what markers mean; the most likely states come from Viterbi's algorithm.
Markers are cut off and consecutive lines of one turn are rendered as `<|role|>`, the text, `<|end|>`.

A conversation can be longer than a task can hold: messages are sorted over all tasks, each task reduces its stretch
of a conversation to the best scores from any state before it to any state at its end, the stretches of a
conversation are chained by these, and each is decoded between its two known states. The result is the same as
Viterbi's over the whole conversation.

Messages are ordered by turn, nulls first, then by a hash of the text, so repeated rows are interchangeable. A message always begins a
turn, a line within it where the states say so. Rows with a null
conv_id are one conversation. A null or empty text is one empty line; a very long one is read whole. The role column is read only to learn, and
null roles are not learned from. With nothing to learn from, the prior counts decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, narrowed

#: Conversations that are learned from, about, and messages of them at most.
SAMPLE = 4000
SAMPLE_MESSAGES = 40_000
ROLES_MOST = 32
#: Speaker names and the roles they mean.
SPEAKERS = {"system": "system sys instruction instructions context developer", "user": "user human you customer q question prompter client me", "assistant": "assistant ai bot model agent a answer gpt chatbot response", "tool": "tool function observation"}
_ROLE = {n: r for r, names in SPEAKERS.items() for n in names.split()}
_NAMES = "|".join(sorted(_ROLE, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?\s*({_NAMES})(?:\|>)?|[#*>\[(]*\s*({_NAMES})\s*[\])*]*\s*[:>]\**|#+\s*({_NAMES})\s*$|\[({_NAMES})\])\s*", re.IGNORECASE)
_END = re.compile(r"\s*<\|(?:im_end|end|eot_id)\|>\s*$", re.IGNORECASE)
#: Values of each feature: marker, begins a message, length, ending, shape.
SIZES = (len(SPEAKERS) + 1, 2, 8, 5, 5)
_MARKS = {r: k + 1 for k, r in enumerate(SPEAKERS)}


def features(line: str, begins: bool) -> tuple[tuple[int, ...], str]:
    """(values of the features, the line without its marker)."""
    m = MARKER.match(line)
    role = _ROLE[next(g for g in m.groups() if g).lower()] if m else None
    rest = _END.sub("", line[m.end() :] if m else line)
    body = rest.strip()
    length = min(7, len(body).bit_length() - 2) if len(body) > 3 else 0
    ending = {"?": 1, "!": 2, ":": 3, ".": 4}.get(body[-1:], 0)
    shape = 0 if not body else 1 if re.match(r"[-*•]|\d+[.)]", body) else 2 if line[:4] == "    " or body[:3] == "```" else 3 if body[:1].isupper() else 4
    return (_MARKS.get(role, 0), int(begins), max(0, length), ending, shape), rest


class Model:
    """States are role * 2 + (0 for a turn's first line, 1 for a later one). All scores are logarithms."""

    def __init__(self, roles: list[str], start: np.ndarray, move: np.ndarray, seen: list[np.ndarray]):
        self.roles, self.start, self.move, self.seen = roles, start, move, seen

    def emissions(self, values: list[tuple[int, ...]]) -> np.ndarray:
        x = np.array(values)
        return sum(self.seen[k][:, x[:, k]].T for k in range(len(SIZES)))

    def stretch(self, values: list[tuple[int, ...]], first: bool) -> np.ndarray:
        """Best score from each state before the lines (from the beginning, if `first`: all rows alike) to each state at the end."""
        e = self.emissions(values)
        now = np.tile(self.start + e[0], (len(self.start), 1)) if first else self.move + e[0]
        for row in e[1:]:
            now = (now[:, :, None] + self.move[None]).max(axis=1) + row
        return now

    def decode(self, values: list[tuple[int, ...]], entry: int | None, leave: int | None) -> list[int]:
        """Best states of the lines between a state before them (None: the beginning) and one at the end (None: any)."""
        e = self.emissions(values)
        now = (self.start if entry is None else self.move[entry]) + e[0]
        back = []
        for row in e[1:]:
            scores = now[:, None] + self.move
            back.append(scores.argmax(axis=0))
            now = scores.max(axis=0) + row
        out = [int(now.argmax()) if leave is None else leave]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def fit(messages: list[tuple[object, str, str]]) -> Model:
    """Counts (conversation, role, text), in order, on top of the prior counts."""
    roles = sorted(set(SPEAKERS) | {r for _, r, _ in messages})
    n = 2 * len(roles)
    number = {r: k for k, r in enumerate(roles)}
    start, move, seen = np.full(n, 0.1), np.full((n, n), 0.05), [np.full((n, s), 0.5) for s in SIZES]
    start[1::2] = 1e-3
    move[:, 1::2] = 1e-3  # a later line follows a line of its own turn
    for r, k in number.items():
        move[2 * k : 2 * k + 2, 2 * k + 1] += 2.0
        # Turns change sides more often than not.
        for other in ("user", "assistant"):
            if r != other:
                move[2 * k : 2 * k + 2, 2 * number[other]] += 1.0
        # A marker names its role; later lines have none. A turn begins with a message or a marker.
        seen[0][2 * k, _MARKS.get(r, 0)] += 20.0
        seen[0][2 * k, 0] += 5.0
        seen[0][2 * k + 1] = 0.01
        seen[0][2 * k + 1, 0] += 25.0
        seen[1][2 * k] += (4.0, 16.0)
        seen[1][2 * k + 1] = (25.0, 0.01)
    prior = [s.copy() for s in seen]
    for _, group in groupby(messages, key=lambda x: x[0]):
        last = None
        for _, role, text in group:
            for k, line in enumerate(text.split("\n")):
                state = 2 * number[role] + (k > 0)
                values, _ = features(line, k == 0)
                if last is None:
                    start[state] += 1
                else:
                    move[last, state] += 1
                for f, v in enumerate(values):
                    seen[f][state, v] += 1
                last = state
    # What data without markers counts must not say that markers never occur.
    rows = np.maximum(1.0, (seen[0].sum(axis=1) - prior[0].sum(axis=1)) / 100)[:, None]
    seen[0] += prior[0] * rows
    return Model(roles, np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), [np.log(s / s.sum(axis=1, keepdims=True)) for s in seen])


def learn(conversations: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Fits on the messages of about `sample` conversations, chosen by a hash, for which `train` is true."""
    known = conversations.where(train & F.col("role").isNotNull())
    n = known.select(F.approx_count_distinct("conv_id")).first()[0] or 1
    place = F.pmod(F.xxhash64(F.lit(23), "conv_id"), F.lit(1 << 30)) / (1 << 30)
    picked = known.where(place < min(1.0, sample / n)).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).orderBy(place, "conv_id", "turn", F.xxhash64("text"), "role").limit(SAMPLE_MESSAGES)
    messages = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].lower(), r[3]) for r in picked.toLocalIterator()))
    if len({m[4] for m in messages}) > ROLES_MOST:
        raise ValueError(f"more than {ROLES_MOST} roles")
    return fit([(m[:2], m[4], m[5]) for m in messages])


def turns(states: list[int], lines: list[str], roles: list[str], begins: list[bool]) -> list[tuple[int, str, str]]:
    """(number of its message, role, text) of the turns that the states make. A message always begins a turn."""
    out: list[list] = []
    message, last = -1, -1
    for state, line, new in zip(states, lines, begins, strict=True):
        message += new
        if new or state % 2 == 0 or state // 2 != last:
            out.append([message, roles[state // 2], [line]])
        else:
            out[-1][2].append(line)
        last = state // 2
    return [(m, r, "\n".join(x).strip()) for m, r, x in out]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def parse_transcript(text: str | None, model: Model) -> list[tuple[str, str]]:
    """(role, text) of the turns of one raw transcript."""
    values, lines = zip(*(features(line, k == 0) for k, line in enumerate((text or "").split("\n"))), strict=True)
    found = turns(model.decode(list(values), None, None), list(lines), model.roles, [k == 0 for k in range(len(lines))])
    return [(role, body) for _, role, body in found]


def _lines(texts: list[str | None]) -> tuple[list[tuple[int, ...]], list[str], list[bool]]:
    values, lines, begins = [], [], []
    for text in texts:
        for k, line in enumerate((text or "").split("\n")):
            v, rest = features(line, k == 0)
            values.append(v)
            lines.append(rest)
            begins.append(k == 0)
    return values, lines, begins


def _stretches(batches: Iterator[pa.RecordBatch], names: list[str]):
    """(part, conv_id, rows) of the sorted rows."""
    flat = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
    for key, rows in groupby(flat, key=lambda r: r[:2]):
        yield *key, list(rows)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(k, k + n), pa.int64()), *b.columns[1:]], names=["part", "k", *b.schema.names[1:]])
        k += n


def format_conversations(conversations: DataFrame, model: Model) -> DataFrame:
    """A row per recovered turn: conv_id, turn, piece (number of the turn in its message), role, text, rendered."""
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession, "chat")
    shared = spark.sparkContext.broadcast(model)
    columns = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid")]
    order = ["conv_id", "turn", F.xxhash64("text"), "uid"]
    ordered = conversations.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "turn", "text")
    table = scratch.table(narrowed(ordered.mapInArrow(_number, "part int, k bigint, conv_id bigint, turn bigint, text string"), conversations.select("conv_id", "turn", "text")), "ordered")

    def reduce(batches):
        kind = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("first", pa.list_(pa.float64())), ("later", pa.list_(pa.float64()))])
        for part, conv_id, rows in _stretches(batches, ["part", "conv_id", "k", "text"]):
            values = _lines([r[3] for r in rows])[0]
            yield pa.RecordBatch.from_pydict({"part": [part], "conv_id": [conv_id], "first": [shared.value.stretch(values, True)[0].tolist()], "later": [shared.value.stretch(values, False).ravel().tolist()]}, kind)

    def chain(batches):
        kind = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())])
        flat = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "first", "later")), strict=True))
        for conv_id, rows in groupby(flat, key=lambda r: r[0]):
            rows = list(rows)
            now, back = np.array(rows[0][2]), []
            for r in rows[1:]:
                scores = now[:, None] + np.array(r[3]).reshape(len(now), -1)
                back.append(scores.argmax(axis=0))
                now = scores.max(axis=0)
            ends = [int(now.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            yield pa.RecordBatch.from_pydict({"part": [r[1] for r in rows], "conv_id": [conv_id] * len(rows), "entry": [None, *ends[:-1]], "leave": ends}, kind)

    def decode(batches):
        kind = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string())])
        for _, conv_id, rows in _stretches(batches, ["part", "conv_id", "k", "turn", "text", "entry", "leave"]):
            values, lines, begins = _lines([r[4] for r in rows])
            states = shared.value.decode(values, rows[0][5], rows[0][6])
            found, piece, last = [], 0, None
            for message, role, text in turns(states, lines, shared.value.roles, begins):
                piece = piece + 1 if message == last else 0
                last = message
                found.append((conv_id, rows[message][3], piece, role, text, render(role, text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kind.types, strict=True)], schema=kind)

    by_part = table.repartition("part").sortWithinPartitions("part", "k")
    reduced = scratch.table(by_part.mapInArrow(reduce, "part int, conv_id bigint, first array<double>, later array<double>"), "reduced", rows=(many := table.count()), dealt=True)
    states = reduced.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(chain, "part int, conv_id bigint, entry int, leave int")
    states = scratch.table(states, "states", rows=many).select("part", F.col("conv_id").alias("id"), "entry", "leave")
    joined = table.join(states, (table["part"] == states["part"]) & table["conv_id"].eqNullSafe(states["id"])).select(table["part"], "conv_id", "k", "turn", "text", "entry", "leave")
    return joined.repartition("part").sortWithinPartitions("part", "k").mapInArrow(decode, "conv_id bigint, turn bigint, piece int, role string, text string, rendered string")
