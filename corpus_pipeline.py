"""From raw documents to token ids: language, near duplicates, decontamination, mixing, token shards.

Every stage reads all rows that the one before it has kept. Stages that filter keep the columns of documents, and further ones
that the input has. Rows are told apart by stored numbers, so null and repeated doc_ids do no harm: repeated rows are rows of their
own. A null or empty text and one without letters have no language and go with the first stage, as do all rows of an
empty table, of which no stage makes any. Very long texts are read whole. Only column names that begin with __tidemark_, and
sample_weight, are reserved; others don't clash.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contamination
from tidemark.llm.language import identify, learn
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.storage import Scratch, collecting
from tidemark.llm.text import PLACE, numbered
from tidemark.llm.token_index import token_index

#: A document is rejected if no language reaches this mean marginal, or if it has no letters.
LANGUAGE_LEAST = 0.3
#: Words that the last stage's workers remember; they have served the other stages before and hold their memory, too.
TOKEN_WORDS = 200_000
#: Share of the tokens that mixing keeps.
MIX_KEEP = 0.8
#: What a sampled document counts for, from mixing on.
WEIGHT = "sample_weight"

#: Tables of the stages that this thread has called and whose results may still be read.
_CALLS = threading.local()


def _stage(number: int):
    """Makes a stage of a function: its tables stay until the next stage is called, in the same thread, with what it has returned and its caller has written."""

    def made(f):
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            held = _CALLS.__dict__.setdefault("held", {})
            for scratch in held.pop(number - 1, ()):
                scratch.drop()
            held[number] = []
            with collecting(held[number]):
                return f(spark, docs, sf_dir)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return made


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with their numbers, stored once; what an operator finds of them is joined by these."""
    return numbered(docs, Scratch(docs.sparkSession, "stage"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The numbered rows of `docs` that aren't among the uids of `dropped`."""
    return docs.join(dropped.select(F.col("uid").alias(PLACE)), PLACE, "left_anti").drop(PLACE)


@_stage(0)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    model = learn(docs, F.lit(True))
    found = identify(docs, model, "text", "__tidemark_lang", "__tidemark_score")
    return found.where((F.col("__tidemark_lang") != "und") & (F.col("__tidemark_score") >= LANGUAGE_LEAST)).drop("__tidemark_lang", "__tidemark_score")


@_stage(1)
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    docs = _numbered(docs)
    return _without(docs, near_duplicates(docs).where(~F.col("kept")))


@_stage(2)
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, as it is or with some words put in."""
    docs = _numbered(docs)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where((F.size("spans") > 0) | (F.size("near") > 0)))


@_stage(3)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their calibrated probabilities. Where these are clipped at 1 a sample alone misses the targets, so sample_weight goes along: tokens counted by it meet them."""
    docs = _numbered(docs)
    drawn = mixture(docs, MIX_KEEP).where("sampled").select(F.col("uid").alias(PLACE), WEIGHT)
    return docs.drop(WEIGHT).join(drawn, PLACE).drop(PLACE)


@_stage(4)
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet shards; one row per document as read back from them, with its weight in the mix."""
    return token_index(docs, tokenizer_path(), keep=TOKEN_WORDS, carry=WEIGHT)


STAGES = [("language", language), ("near_duplicates", near), ("decontamination", decontaminated), ("mixing", mixed), ("token_index", tokens)]
#: The stages learn models and draw by hashes, which SQL can't express; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = out.table(stage(spark, docs, sf_dir), name)
        if last:
            out.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
