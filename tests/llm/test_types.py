"""Keys stored as plain integers."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contamination, summary
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.html_extract import extract_pages
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.queries import QUERIES, tokenizer_path
from tidemark.llm.secrets_scan import secret_scan
from tidemark.llm.token_index import token_index


def test_integer_keys(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s"), (2, None, None, None)], "doc_id int, text string, lang string, source string")
    items = spark.createDataFrame([(1, "c d e")], "item_id int, text string")
    for made in (exact_duplicates(docs), near_duplicates(docs), mixture(docs), token_index(docs, tokenizer_path()), summary(contamination(docs, items)), secret_scan(docs)):
        assert sorted(r.doc_id for r in made.collect()) == [1, 2]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    assert extract_pages(pages).count() == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_answer_every_row(spark, name):
    folder = "/root/testdata/sf0.001"
    table = {"op1": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")
    got = QUERIES[name](spark, folder)
    assert got.count() >= spark.read.parquet(f"{folder}/{table}.parquet").count()
