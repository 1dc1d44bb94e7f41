"""The driver's tables in the shapes that the operators read.

Ratings, replies and rewards are made from ids and sizes by fixed formulas, here and in
the SQL alike: they carry values through the operators and claim nothing about quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, prompt, completion: user turns that an assistant turn follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return rows.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("next_text").alias("completion"))


PAIRS_SQL = """
    SELECT conv_id, turn, text AS prompt, next_text AS completion FROM (
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ) WHERE role = 'user' AND next_role = 'assistant'
"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, task, raw (1..10), text, n_chars."""
    raw = (F.lit(1) + (F.col("doc_id") * 7 + F.col("n_chars")) % 10).cast("int")
    tasks = F.array(*map(F.lit, ("qa", "mcq", "para", "tfq", "cs")))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(tasks, (F.col("doc_id") % 5 + 1).cast("int")).alias("task"), raw.alias("raw"), "text", "n_chars")


RATED_SQL = """
    SELECT doc_id, ['qa', 'mcq', 'para', 'tfq', 'cs'][doc_id % 5 + 1] AS task, (1 + (doc_id * 7 + n_chars) % 10)::INT AS raw, text, n_chars FROM documents
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


VECTORS_SQL = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
# Ranks of other rows (``others``) and of all rows (``everyone``) by cosine distance.
KNN_SQL = f"""
    e AS ({VECTORS_SQL}),
    d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS la, b.label AS lb, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM e a JOIN e b ON true),
    others AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d WHERE id != neighbour),
    everyone AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN id = neighbour THEN -1 ELSE distance END, neighbour) AS rank FROM d)
"""
