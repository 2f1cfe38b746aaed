"""Derived views over the given tables, on which the registered queries run.

``RESPONSES_SQL`` is plain SQL that Spark and DuckDB both read, so that the two sides of a check
start from the same rows. Everything else here has its own SQL in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import code_description, parse_annotations, split_codes
from ..operators.responses import parse_responses, usable_rows

# (order, code, name, parent_code, parent_name)
CODEBOOK = [
    (0, "A1", "English", "A", "Language"),
    (1, "A2", "French", "A", "Language"),
    (2, "A3", "German", "A", "Language"),
    (3, "A4", "Spanish", "A", "Language"),
    (4, "B1", "Good", "B", "Quality"),
    (5, "B2", "Poor", "B", "Quality"),
    (6, "B3", "Mixed", "B", "Quality"),
    (7, "B4", "Unclear", "B", "Quality"),
    (8, "C1", "Toxic", "C", "Tone"),
    (9, "C2", "Polite", "C", "Tone"),
]
CODES = [row[1] for row in CODEBOOK]

# Documents as survey answers with untidy code and sentiment cells: separators, look-alike and
# lower-case letters, repeated codes, mixed sentiment spellings, conflicts and miscounts.
RESPONSES_SQL = """
SELECT row_id, answer, context, lang,
  CASE WHEN row_id % 4 = 1 THEN translate(doubled, 'ABC', 'АВС') WHEN row_id % 4 = 2 THEN lower(doubled) ELSE doubled END AS raw_codes,
  CASE WHEN row_id % 13 = 0 AND b IS NOT NULL THEN sents || sep || '1'
       WHEN row_id % 17 = 0 AND b IS NOT NULL THEN 'maybe' || sep || sents
       WHEN row_id % 7 = 0 THEN sents || sep || again ELSE sents END AS raw_sentiments,
  a || ':' || CAST(s1 AS STRING) || ', ' || a || '=' || CAST(s2 AS STRING) || coalesce('; ' || b || '|' || CAST(s3 AS STRING), '') AS inline_labels
FROM (
  SELECT *,
    CASE WHEN row_id % 7 = 0 THEN codes || sep || codes ELSE codes END AS doubled,
    CASE WHEN b IS NULL AND row_id % 5 = 0 THEN '' WHEN b IS NULL THEN w1 ELSE w1 || sep || w2 || sep || w3 END AS sents,
    CASE WHEN b IS NULL AND row_id % 5 = 0 THEN '' WHEN b IS NULL THEN v1 ELSE v1 || sep || w2 || sep || w3 END AS again
  FROM (
    SELECT *,
      CASE WHEN b IS NULL AND row_id % 5 = 0 THEN 'UNKNOWN' WHEN b IS NULL THEN a ELSE a || sep || b || sep || c END AS codes,
      CASE WHEN row_id % 2 = 0 THEN CAST(s1 AS STRING) WHEN s1 = 0 THEN 'neutral' WHEN s1 = 1 THEN 'Positive' ELSE 'негативная' END AS w1,
      CASE WHEN row_id % 2 = 1 THEN CAST(s2 AS STRING) WHEN s2 = 0 THEN '0.0' WHEN s2 = 1 THEN 'позитивно' ELSE 'NEGATIVE' END AS w2,
      CAST(s3 AS STRING) AS w3,
      CASE WHEN row_id % 11 = 0 THEN CAST((s1 + 1) % 3 AS STRING) ELSE CAST(s1 AS STRING) END AS v1
    FROM (
      SELECT d.doc_id AS row_id, d.source AS context, d.lang AS lang,
        CASE WHEN l.toxic = 1 AND l.quality = 0 THEN ' ' ELSE d.text END AS answer,
        CASE d.lang WHEN 'en' THEN 'A1' WHEN 'fr' THEN 'A2' WHEN 'de' THEN 'A3' ELSE 'A4' END AS a,
        CASE WHEN l.quality = 1 THEN 'B1' WHEN l.quality = 0 THEN 'B2' END AS b,
        CASE WHEN l.toxic = 1 THEN 'C1' WHEN l.toxic = 0 THEN 'C2' END AS c,
        CASE d.doc_id % 3 WHEN 0 THEN ', ' WHEN 1 THEN '; ' ELSE chr(10) END AS sep,
        (d.doc_id + d.n_chars) % 3 AS s1, (d.doc_id + 2 * d.n_chars + 1) % 3 AS s2, (d.doc_id + 1) % 3 AS s3
      FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
    ) AS base
  ) AS worded
) AS joined
"""

# Conversation turns as replies of a chat model, well-formed and not.
REPLIES_SQL = """
SELECT row_id, text, gold,
  CASE kind
    WHEN 0 THEN '{{"labels":[' || one || ']}}'
    WHEN 1 THEN '```json' || chr(10) || '{{"labels":[' || one || ',' || two || ']}}' || chr(10) || '```'
    WHEN 2 THEN 'Reply: {{"labels": [' || two || ']}} end'
    WHEN 3 THEN '{{"labels":[' || one || ',{{"code":"ZZ9","sentiment":1}},"loose"]}}'
    WHEN 4 THEN '{{"labels":[{{"code":"A2","sentiment":4}},{{"code":"A2","sentiment":true}},{{"code":"A2","sentiment":1.0}},' || two || ']}}'
    WHEN 5 THEN '{{"labels":[' || one || ',' || one || ',' || two || ']}}'
    WHEN 6 THEN '{{"labels":[{{"code":"A1","sentiment":0}},{{"code":"A2","sentiment":1}},{{"code":"A3","sentiment":2}},{{"code":"b1","sentiment":"1"}},' || one || ']}}'
    WHEN 7 THEN text
    WHEN 8 THEN '{{"labels":[]}}'
    WHEN 9 THEN '[' || one || ']'
    WHEN 10 THEN '{{"codes":[]}}'
    WHEN 12 THEN '{{"labels":"[' || replace(one, '"', chr(92) || '"') || ']"}}'
    WHEN 13 THEN '{{"labels":["' || replace(one, '"', chr(92) || '"') || '",' || two || ']}}'
    WHEN 14 THEN '{{"labels":[{{"code":"A2","sentiment":"' || chr(92) || 't1"}},' || two || ']}}'
    ELSE '{{"labels":"none"}}' END AS raw_response,
  CASE WHEN kind = 11 THEN 'TimeoutError: no reply' ELSE '' END AS llm_error,
  CAST((length(text) % 97) + kind AS DOUBLE) / 16 AS latency_seconds,
  CAST(length(text) AS BIGINT) AS prompt_tokens,
  CAST(kind * 3 AS BIGINT) AS completion_tokens
FROM (
  SELECT conv_id * 1000 + turn AS row_id, text, (conv_id * 7 + turn * 5 + length(text)) % 15 AS kind,
    '{{"code":"' || substr('A1A2A3A4B1B2B3B4C1C2', CAST(1 + 2 * (length(text) % 10) AS INT), 2) || '","sentiment":' || CAST(turn % 3 AS STRING) || '}}' AS one,
    '{{"code":"' || substr('A1A2A3A4B1B2B3B4C1C2', CAST(1 + 2 * ((length(text) + turn) % 10) AS INT), 2) || '","sentiment":"' || CAST((turn + 1) % 3 AS STRING) || '"}}' AS two,
    substr('A1A2A3A4B1B2B3B4C1C2', CAST(1 + 2 * (length(text) % 10) AS INT), 2) || ':' || CAST(turn % 3 AS STRING)
      || CASE WHEN role = 'user' THEN ', C2:1' ELSE '' END AS gold
  FROM {conversations}
) AS turns
"""

# Embeddings as labelled vectors.
VECTORS_SQL = """
SELECT vec_id AS row_id, 'vector ' || CAST(vec_id AS STRING) AS text, embedding,
  substr('A1A2A3A4B1B2B3B4C1C2', CAST(1 + 2 * label AS INT), 2) AS code,
  substr('AAAABBBBCC', CAST(1 + label AS INT), 1) AS parent_code
FROM {embeddings}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codebook(spark: SparkSession) -> DataFrame:
    rows = [(*r, False) for r in CODEBOOK]
    schema = "order bigint, code string, name string, parent_code string, parent_name string, is_parent boolean"
    return spark.createDataFrame(rows, schema).withColumn(
        "description", code_description(F.col("code"), F.col("parent_name"), F.col("name"))
    )


def classes(spark: SparkSession) -> DataFrame:
    return codebook(spark).select("code")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESPONSES_SQL, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable responses in wide form: row_id, text, answer, context, codes."""
    return usable_rows(parse_responses(responses(spark, sf_dir), "answer", "raw_codes", "context"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with parsed annotations; rows with faults other than conflicts keep none."""
    raw = responses(spark, sf_dir)
    parsed = parse_annotations(F.col("raw_codes"), F.col("raw_sentiments"))
    return raw.select(
        "row_id", F.col("answer").alias("text"), F.trim("answer").alias("answer"), "context", parsed.alias("p")
    ).select("row_id", "text", "answer", "context", "p.annotations", "p.status")


def gold_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir).select("row_id", split_codes(F.col("raw_codes")).alias("codes"))
    return rows.select("row_id", F.filter("codes", lambda c: c != "UNKNOWN").alias("gold"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document and code, with many ties and scores right at thresholds."""
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(i).alias("i")) for i, c in enumerate(CODES)])
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(codes).alias("c"))
    score = ((F.col("doc_id") * 31 + F.col("n_chars") * 7 + F.col("c.i") * 17) % 101).cast("double") / 100
    return docs.select(F.col("doc_id").alias("row_id"), "c.code", score.alias("score"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four class probabilities for every document and code: the score, shared 2 : 3 : 5 in turning order."""
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(i).alias("i")) for i, c in enumerate(CODES)])
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(codes).alias("c"))
    score = ((F.col("doc_id") * 31 + F.col("n_chars") * 7 + F.col("c.i") * 17) % 101).cast("double") / 100
    turn = (F.col("doc_id") + F.col("c.i")) % 3
    part = lambda k: F.col("s") * F.when((turn + k) % 3 == 0, 0.2).when((turn + k) % 3 == 1, 0.3).otherwise(0.5)
    probs = F.array(1.0 - F.col("s"), part(0), part(1), part(2))
    return docs.withColumn("s", score).select(F.col("doc_id").alias("row_id"), "c.code", probs.alias("probs"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VECTORS_SQL, embeddings=table(spark, sf_dir, "embeddings"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors in the long form an index is built from."""
    dims = codebook(spark).select("code", F.col("name").alias("code_name"), "parent_name")
    return vectors(spark, sf_dir).join(F.broadcast(dims), "code")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPLIES_SQL, conversations=table(spark, sf_dir, "conversations"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
