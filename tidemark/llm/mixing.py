"""Mixing sources to target weights by iterative proportional fitting.

The tokens of all documents are counted by cell, a combination of the margins' values (source, language, topic). The
cells' token mass is raked: scaled to each margin's target shares in turn until all margins agree. A
document's weight is its cell's raked mass over its own mass; its probability is the weight times a factor, at most
1, with the factor set so that the expected tokens are the share to keep. A document is sampled if a hash of its doc_id
falls below its probability, so equal inputs give equal samples on any number of machines.

Up to CELLS cells are raked on the driver and sent to the executors; more are raked by joins of tables, by the same steps and the same
stopping rule. Margins that contradict each other have no common solution: after ROUNDS rounds the last state is taken, with a warning
that says how far off the margins are. Tokens are counted as words here. Very long texts are read whole, in one task each.
A null margin value is a value of its own. Targets are tempered shares: mass ** alpha, normalised (alpha 1 keeps a
margin, 0 makes its values equal). Values without mass stay without. Documents in cells without tokens have weight and
probability 0. Repeated rows with one doc_id are sampled together. An empty table gives no row.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .text import hash_words, pieces, rows, segment

MARGINS = {"source": 0.5, "lang": 0.7, "topic": 0.0}
TOPICS = 8
#: Cells that the driver rakes, and that are broadcast, at most.
CELLS = 100_000
#: Largest relative error of a margin, and rounds at most.
ERROR, ROUNDS = 1e-9, 500


def topics(data: np.ndarray, at: np.ndarray, n: int = TOPICS) -> tuple[np.ndarray, np.ndarray]:
    """(topic, number of words) of each text. The topic is the part of the hashed vocabulary that most of its words of six or more bytes fall in; the lowest of equals, 0 without such words."""
    mapped, starts, ends, word_at = segment(data, at)
    words = np.diff(word_at)
    long = ends - starts >= 6
    row = np.repeat(np.arange(len(words)), words)[long]
    part = (hash_words(mapped, starts[long], ends[long]) >> np.uint64(40)).astype(np.int64) % n
    return np.bincount(row * n + part, minlength=n * len(words)).reshape(-1, n).argmax(axis=1), words


def described(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, lang, topic and n_tokens (words) of every row."""
    kept = rows(docs, "source", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(4)):
                topic, words = topics(data, at)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:4], pa.array([f"t{k}" for k in topic.tolist()], pa.string()), pa.array(words, pa.int64())], names=["uid", "doc_id", "source", "lang", "topic", "n_tokens"])

    return kept.mapInArrow(run, "uid bigint, doc_id bigint, source string, lang string, topic string, n_tokens bigint")


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Scales the cells' mass to the targets, given as mass of each value of each margin."""
    out = mass.astype(float)
    worst = 0.0
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, out, len(target))
            factor = np.where(now > 0, target / np.maximum(now, 1e-300), 0)
            worst = max(worst, float(np.abs(factor[target > 0] - 1).max(initial=0)))
            out = out * factor[code]
        if worst < ERROR:
            return out
    _unsettled(worst)
    return out


def _unsettled(worst: float) -> None:
    warnings.warn(f"the margins don't agree after {ROUNDS} rounds; the largest relative error is {worst:.3g}", stacklevel=3)


def temper(mass: np.ndarray, alpha: float) -> np.ndarray:
    """Mass of each value at the exponent alpha, with the same total."""
    out = np.where(mass > 0, np.maximum(mass, 1e-300) ** alpha, 0)
    return out * (mass.sum() / out.sum()) if out.sum() else out


def calibrate(weight: np.ndarray, mass: np.ndarray, keep: float) -> float:
    """The factor for which sum(mass * min(1, factor * weight)) is `keep` of the mass, or as much as can be."""
    order = np.argsort(-weight, kind="stable")
    w, m = weight[order], mass[order].astype(float)
    goal, full, rest = keep * m.sum(), 0.0, float((w * m).sum())
    for k in range(len(w)):
        if rest <= 0:
            break
        factor = (goal - full) / rest
        if factor * w[k] <= 1:
            return max(factor, 0.0)
        full += m[k]
        rest -= w[k] * m[k]
    return float(1 / w[w > 0].min()) if (w > 0).any() else 0.0


def _rake_tables(cells: DataFrame, margins: dict[str, float], scratch: Scratch) -> DataFrame:
    """The same by joins, for any number of cells: adds `raked`."""
    targets = {}
    for name, alpha in margins.items():
        sums = cells.groupBy(name).agg(F.sum("mass").cast("double").alias("m"))
        tempered = sums.withColumn("t", F.when(F.col("m") > 0, F.pow("m", F.lit(alpha))).otherwise(0.0))
        total = tempered.agg(F.sum("m"), F.sum("t")).first()
        ratio = total[0] / total[1] if total[1] else 0.0
        targets[name] = scratch.table(tempered.select(F.col(name).alias("value"), (F.col("t") * ratio).alias("target")), f"target_{name}")
    now = scratch.table(cells.withColumn("raked", F.col("mass").cast("double")), "raked0")
    worst = 0.0
    for k in range(1, ROUNDS + 1):
        after, worst = now, 0.0
        for name in margins:
            sums = after.groupBy(F.col(name).alias("value")).agg(F.sum("raked").alias("m"))
            factor = sums.join(targets[name], sums["value"].eqNullSafe(targets[name]["value"])).select(sums["value"], "target", F.when(F.col("m") > 0, F.col("target") / F.col("m")).otherwise(0.0).alias("factor"))
            factor = scratch.table(factor, f"factor{k}_{name}")
            worst = max(worst, factor.where("target > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            after = after.join(factor, after[name].eqNullSafe(factor["value"])).withColumn("raked", F.col("raked") * F.col("factor")).drop("value", "factor", "target")
        after = scratch.table(after, f"raked{k}")
        scratch.drop(f"raked{k - 1}")
        now = after
        if worst < ERROR:
            return now
    _unsettled(worst)
    return now


def mixture(docs: DataFrame, keep: float = 0.5, margins: dict[str, float] | None = None, seed: int = 1, cells_most: int = CELLS) -> DataFrame:
    """Per row: uid, doc_id, the margins' values, n_tokens, weight, prob, sampled, sample_weight (what a sampled document counts for to meet the targets)."""
    margins = margins or MARGINS
    scratch = Scratch(docs.sparkSession, "mixing")
    known = scratch.table(described(docs), "described", rows=docs.count(), per_file=200_000, dealt=True)
    cells = scratch.table(known.groupBy(*margins).agg(F.sum("n_tokens").alias("mass")), "cells")
    if cells.count() <= cells_most:
        got = cells.toPandas()
        mass = got["mass"].to_numpy(float)
        codes = [got[c].astype(object).where(got[c].notna(), None).map(lambda v: (v is None, v or "")).factorize(sort=True)[0] for c in margins]
        targets = [temper(np.bincount(c, mass), a) for c, a in zip(codes, margins.values(), strict=True)] if len(got) else []
        raked = rake(mass, codes, targets) if len(got) else mass
        weight = np.where(mass > 0, raked / np.maximum(mass, 1), 0)
        factor = calibrate(weight, mass, keep) if len(got) else 0.0
        schema = cells.drop("mass").schema.add("weight", "double")
        table = docs.sparkSession.createDataFrame([(*(None if v is None or v != v else v for v in r), float(w)) for r, w in zip(got[list(margins)].itertuples(index=False, name=None), weight, strict=True)], schema)
        table = F.broadcast(table)
    else:
        table = _rake_tables(cells, margins, scratch).withColumn("weight", F.when(F.col("mass") > 0, F.col("raked") / F.col("mass")).otherwise(0.0))
        # The factor by bisection on sums over the cells.
        total = table.agg(F.sum("mass"), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
        low, high = 0.0, 1 / total[1] if total[1] else 0.0
        for _ in range(60):
            factor = (low + high) / 2
            kept = table.agg(F.sum(F.col("mass") * F.least(F.lit(1.0), F.col("weight") * factor))).first()[0]
            low, high = (factor, high) if kept < keep * total[0] else (low, factor)
        factor, table = high, table.drop("mass", "raked")
    table = table.select(*[F.col(c).alias(f"_{c}") for c in margins], "weight")
    prob = F.least(F.lit(1.0), F.col("weight") * factor)
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    joined = known.join(table, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in margins])
    return joined.select(
        "uid", "doc_id", *margins, "n_tokens", "weight", prob.alias("prob"), (place < prob).alias("sampled"), F.when(place < prob, F.col("weight") * factor / prob).alias("sample_weight")
    )
