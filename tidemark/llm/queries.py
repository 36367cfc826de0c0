"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_index import token_index

    return token_index(_table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, summary

    return summary(contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))).drop("n_near")


@query
def near_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of op6_decontaminate, whose columns are those of its SQL twin."""
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("near").cast("bigint").alias("n_near"), "near")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op6_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
  FROM b WHERE len(w) > 0
),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT doc_id, p.n, i, id FROM places p JOIN windows v ON v.n = p.n AND v.win = array_to_string(p.w[i:i + p.n - 1], ' ')),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("uid")


ORACLE_SQL["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER g = 1 AS kept,
       sha256(n) AS text_sha256
FROM d
WINDOW g AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("uid")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn
    from .text import crc_mod

    docs = _table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 5)
    model = learn(docs, rest != 0)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import describe, learn, score
    from .storage import Scratch
    from .text import crc_mod

    scratch = Scratch(spark, "quality")
    docs = _table(spark, sf_dir, "documents")
    described = scratch.table(describe(docs, "doc_id"), "described", rows=docs.count(), dealt=True)
    rest = crc_mod(F.col("doc_id"), 3)
    labels = _table(spark, sf_dir, "labels").where(rest != 1).groupBy("doc_id").agg(F.min("quality").alias("label"))
    model = learn(scratch.table(described.join(labels, "doc_id").select("label", "x"), "labelled", rows=described.count(), per_file=200_000))
    found = score(described, model, "doc_id")
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_scan import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


@query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_table(spark, sf_dir, "documents")).drop("uid")


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, learn
    from .text import crc_mod

    conversations = _table(spark, sf_dir, "conversations")
    return format_conversations(conversations, learn(conversations, crc_mod(F.col("conv_id"), 5) != 0))


#: All pairs by shared shingles, and components by following links: right, but only for small tables.
ORACLE_SQL["op7_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d
),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT c.doc_id, class_id, coalesce(n_links, 0) AS n_links, c.doc_id = class_id AS kept FROM c LEFT JOIN l USING (doc_id)
"""
