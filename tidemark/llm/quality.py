"""Quality classification by a regularised quadratic discriminant.

A text is described by statistics of its characters, words and lines, each transformed towards a bell shape. Each
class is a Gaussian whose covariance is shrunk towards the pooled one and its diagonal; a text's
score is the logistic of the difference of log-densities (Mahalanobis distances by cached Cholesky factors) with
the class shares as priors, divided by a factor, as texts' statistics aren't quite Gaussian.

Learning needs each class's count, mean and covariance alone. They are summed over all labelled rows in the
tasks, for two halves apart, and added up, so nothing is sampled and some kilobytes reach the driver. The shares of shrinkage and
the factor are those of CHOICES and SOFTENINGS whose models, each fitted on one half, give the labels of the other half the highest likelihood.

Null and empty texts have the statistics of an empty text and are scored like others. Labels that are null or not 0
or 1 are ignored; a doc_id with several labels takes the lowest. If a class has no rows, every score is the share of
label 1 (0.5 without labels). Repeated rows score alike, and fall in the same half. Of equal likelihoods the first choice is taken. Very
long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import hash_words, mix, pieces, segment, sums

#: Shares of the pooled covariance and of the diagonal in a class's covariance, and what log-odds are divided by: what is tried.
CHOICES = tuple((pool, diagonal) for pool in (0.01, 0.05, 0.2) for diagonal in (0.005, 0.05, 0.2))
SOFTENINGS = (1.0, 2.0, 4.0, 8.0)

NAMES = (
    "bytes words word_length capitals digits marks symbols pipes exclamations blanks non_ascii distinct_words top_word repeated_neighbours "
    "repeated_trigrams lines line_length repeated_lines entropy mark_words capital_words distinct_capitals long_words sentence_ends"
).split()

_CLASS = np.zeros((9, 256), bool)
_CLASS[0, ord("A") : ord("Z") + 1] = True
_CLASS[1, ord("0") : ord("9") + 1] = True
_CLASS[2, [ord(c) for c in ".,;:'\"-()"]] = True
_CLASS[3, [ord(c) for c in "#$%&*@^~=+<>[]{}\\/_`"]] = True
_CLASS[4, ord("|")] = True
_CLASS[5, ord("!")] = True
_CLASS[6, [9, 10, 11, 12, 13, 32]] = True
_CLASS[7, 128:] = True
_CLASS[8, [ord(c) for c in ".?"]] = True
_GROUP = np.zeros(256, np.int64)
for _k, _b in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
    _GROUP[_b] = _GROUP[_b - 32] = _k + 1
_GROUP[48:58] = 27
_GROUP[[9, 10, 11, 12, 13, 32]] = 28
_GROUP[33:48] = 29
_GROUP[128:] = 30
_NOT_BLANK = np.where(_CLASS[6], 0, np.arange(256)).astype(np.uint8)
_NOT_BLANK[0] = 1
_LINE = np.arange(256, dtype=np.uint8)
_LINE[0], _LINE[10] = 1, 0


def _repeats(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of each slice, how often its most frequent value occurs)."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, r[first], np.diff(first, append=len(v)))
    return sums(new, at), top


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text."""
    size = np.diff(at)
    some = np.maximum(size, 1)
    share = [sums(_CLASS[k][data], at) / some for k in range(len(_CLASS))]
    mapped, starts, ends, word_at = segment(data, at, _NOT_BLANK)
    words = np.diff(word_at)
    any_word = np.maximum(words, 1)
    length = ends - starts
    hashed = hash_words(mapped, starts, ends)
    distinct, top = _repeats(hashed, word_at)
    doc = np.repeat(np.arange(len(size)), words)
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    many = max(0, len(hashed) - 2)
    triple = mix(hashed[:many] + hashed[1 : 1 + many] * np.uint64(3) + hashed[2 : 2 + many] * np.uint64(5))
    triples_at = np.minimum(np.cumsum(np.concatenate([[0], np.maximum(words - 2, 0)])), many)
    inside = doc[:many] == doc[2 : 2 + many]
    triples, _ = _repeats(triple[inside], triples_at)
    last = data[ends - 1] if len(ends) else data[:0]
    first = data[starts] if len(starts) else data[:0]
    capitals = np.concatenate([[0], np.cumsum(_CLASS[0][data])])
    letters = np.concatenate([[0], np.cumsum((_GROUP[data] > 0) & (_GROUP[data] < 27))])
    shout = (capitals[ends] - capitals[starts] == letters[ends] - letters[starts]) & (letters[ends] - letters[starts] > 1)
    line_bytes, line_starts, line_ends, line_at = segment(data, at, _LINE)
    lines = np.diff(line_at)
    any_line = np.maximum(lines, 1)
    distinct_lines, _ = _repeats(hash_words(line_bytes, line_starts, line_ends), line_at)
    groups = np.bincount(np.repeat(np.arange(len(size)), size) * 31 + _GROUP[data], minlength=31 * len(size)).reshape(-1, 31)
    p = groups / some[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1)
    root = np.sqrt
    out = np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(size / any_word), root(share[0]), root(share[1]), root(share[2]), root(share[3]), root(share[4]), root(share[5]),
            root(share[6]), root(share[7]), np.log1p(distinct) - np.log1p(words), root(top / any_word), root(sums(same, word_at) / any_word),
            np.log1p(triples) - np.log1p(np.maximum(words - 2, 0)), np.log1p(lines), np.log1p(size / any_line), root(1 - distinct_lines / any_line), entropy,
            root(sums(_CLASS[3][last] | _CLASS[5][last], word_at) / any_word), root(sums(shout, word_at) / any_word), root(sums(_CLASS[0][first], word_at) / any_word),
            root(sums(length > 20, word_at) / any_word), root(share[8]),
        ],
        axis=1,
    )
    return out.astype(np.float64)


class Model:
    """Two shrunk Gaussians; chol are the Cholesky factors of their covariances."""

    def __init__(self, count: np.ndarray, total: np.ndarray, product: np.ndarray, pool: float = CHOICES[0][0], diagonal: float = CHOICES[0][1], soften: float = SOFTENINGS[0]):
        self.pool, self.diagonal, self.soften = pool, diagonal, soften
        self.share = float(count[1] / count.sum()) if count.sum() else 0.5
        self.mean = self.chol = None
        if (count < 2).any():
            return
        n = count[:, None]
        self.mean = total / n
        scatter = product - np.einsum("ci,cj->cij", total, self.mean)
        within = scatter.sum(axis=0) / count.sum()
        floor = np.maximum(np.diag(within), 1e-6) * 1e-3 + 1e-7
        own = scatter / count[:, None, None]
        mixed = (1 - pool - diagonal) * own + pool * within + diagonal * np.stack([np.diag(np.diag(x)) for x in own])
        self.chol = np.linalg.cholesky(mixed + np.diag(floor))
        self.log_det = 2 * np.log(np.diagonal(self.chol, axis1=1, axis2=2)).sum(axis=1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 as the densities have them."""
        if self.chol is None:
            share = min(max(self.share, 1e-12), 1 - 1e-12)
            return np.full(len(x), np.log(share / (1 - share)))
        density = np.stack([-0.5 * ((np.linalg.solve(self.chol[c], (x - self.mean[c]).T) ** 2).sum(axis=0) + self.log_det[c]) for c in (0, 1)])
        return density[1] - density[0] + np.log(self.share / (1 - self.share))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        if self.chol is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.soften, -40, 40)))


def describe(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the statistics of text, as x."""
    kept = docs.select(*keep, F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(len(keep))):
                x = statistics(data, at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[: len(keep)], flat], names=[*keep, "x"])

    return kept.mapInArrow(run, T.StructType([*kept.drop("text").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _x(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _losses(models, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed negative log-likelihoods of the labels by the models that were fitted on the other half."""
    loss = np.zeros((len(CHOICES), len(SOFTENINGS)))
    for batch in batches:
        label, half = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x = _x(batch.column(2))
        for h in (0, 1):
            mine, sign = x[half == h], 1 - 2 * label[half == h]
            for c, model in enumerate(models[1 - h]):
                odds = model.odds(mine) * sign
                for k, soften in enumerate(SOFTENINGS):
                    loss[c, k] += np.logaddexp(0, np.clip(odds / soften, -40, 40)).sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(loss.size, dtype=np.int32)), pa.array(loss.ravel())], names=["k", "v"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(NAMES)
    count, total, product = np.zeros((2, 2)), np.zeros((2, 2, width)), np.zeros((2, 2, width, width))
    for batch in batches:
        label, half = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x = _x(batch.column(2))
        for h in (0, 1):
            for c in (0, 1):
                mine = x[(label == c) & (half == h)]
                count[h, c] += len(mine)
                total[h, c] += mine.sum(axis=0)
                product[h, c] += mine.T @ mine
    flat = np.concatenate([count.ravel(), total.ravel(), product.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "v"])


def learn(described: DataFrame) -> Model:
    """Fits the model on rows (label, x), all of them; they are read twice, so they had better be stored."""
    width = len(NAMES)
    known = described.where("label in (0, 1)").select(F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("x"), F.lit(2)).cast("int").alias("half"), "x")

    def summed(parts: DataFrame, size: int) -> np.ndarray:
        flat = np.zeros(size)
        for row in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():
            flat[row["k"]] = row["v"]
        return flat

    flat = summed(known.mapInArrow(_moments, "k int, v double"), 4 * (1 + width + width * width))
    count, total, product = flat[:4].reshape(2, 2), flat[4 : 4 + 4 * width].reshape(2, 2, width), flat[4 + 4 * width :].reshape(2, 2, width, width)
    halves = [[Model(count[h], total[h], product[h], *c) for c in CHOICES] for h in (0, 1)]
    loss = summed(known.mapInArrow(lambda batches: _losses(halves, batches), "k int, v double"), len(CHOICES) * len(SOFTENINGS))
    choice, soften = divmod(int(loss.argmin()), len(SOFTENINGS))
    return Model(count.sum(axis=0), total.sum(axis=0), product.sum(axis=0), *CHOICES[choice], SOFTENINGS[soften])


def score(described: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` and the score of every row."""
    shared = described.sparkSession.sparkContext.broadcast(model)
    kept = described.select(*keep, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _x(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(shared.value.score(x))], names=[*keep, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.drop("x").schema.fields, T.StructField("score", T.DoubleType())]))
