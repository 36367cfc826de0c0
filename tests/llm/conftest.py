"""Awkward documents: nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EXTRA = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in ("uid", "name", "score", "kept", "part", "x", "weight", "class_id", "tile")]])


def prose(seed: int, words: int, start: str = "") -> str:
    rnd = random.Random(seed)
    return start + " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 8))) for _ in range(words))


def awkward() -> list[tuple]:
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    texts = [None, "", "   \t\n ", base, base, base + " ", base.upper(), " ".join(near), "one two three", "one two three", "!!! ??? ...", "12345 67", "über straße 你好", prose(2, 30_000), "word", "a\u0000b c"]
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(3, base, None, None, None), (None, base, "en", "s0", 1), (None, None, None, None, None), (3, base, "en", "s1", 2)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, *(["clash"] * 9)) for r in awkward()]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def stored(docs, tmp_path_factory):
    """The same as a stored table, as a query reads it."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EXTRA)
