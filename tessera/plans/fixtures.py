"""The engine's relations derived from the test tables, in Spark and in SQL.

``embeddings`` gives chunks with vectors, four to a document; ``documents`` gives
chunks with text.  Where an operator needs both, they are paired by number.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.text import Index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(n):
    kind = F.element_at(F.array(F.lit("Person"), F.lit("Place"), F.lit("Thing")), (n % 3 + 1).cast("int"))
    return kind, F.concat(F.lit("data:///"), kind, F.lit("/"), n.cast("string"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = F.floor(F.col("vec_id") / 4)
    kind, doc = _named(n)
    at = (F.col("vec_id") % 4).cast("int")
    return e.select(
        doc.alias("doc_id"),
        kind.alias("doc_type"),
        at.alias("chunk_index"),
        F.lit(4).alias("chunk_count"),
        (at * 100).cast("int").alias("chunk_token_start"),
        F.lit(400).alias("doc_token_len"),
        "embedding",
        F.col("embedding").alias("clustering_embedding"),
        F.col("vec_id"),
    )


CH = """ch AS (
  SELECT vec_id, vec_id // 4 AS n, CASE (vec_id // 4) % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Place' ELSE 'Thing' END AS doc_type,
         concat('data:///', CASE (vec_id // 4) % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Place' ELSE 'Thing' END, '/', vec_id // 4) AS doc_id,
         CAST(vec_id % 4 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS e, embedding FROM embeddings)"""


def dist(a: str, b: str) -> str:
    """SQL of the distance on the [0, 1] scale."""
    size = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"round(least(greatest((1 - list_dot_product({a}, {b}) / {size}) / 2, 0), 1), 9)"


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one each; the type is the language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("data:///"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("lang").alias("doc_type"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


TX = "tx AS (SELECT concat('data:///', lang, '/', doc_id) AS doc_id, lang AS doc_type, 0 AS chunk_index, text AS content FROM documents)"


def paired_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector chunks with the text of the document of the same number."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return vector_chunks(spark, sf_dir).join(d, "vec_id")


PX = f"{CH}, px AS (SELECT ch.*, d.text AS content FROM ch JOIN documents d ON d.doc_id = ch.vec_id)"


def probe(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder; a local one only on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"tessera-{name}-")


_INDEXES: dict[tuple, str] = {}


def text_index(spark: SparkSession, sf_dir: str, chunks=text_chunks) -> Index:
    """The stored inverted index of a chunk relation, built once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, chunks.__name__)
    if key not in _INDEXES:
        path = shared_dir(spark, "index")
        Index.build(chunks(spark, sf_dir), path, buckets=16)
        _INDEXES[key] = path
    return Index(spark, _INDEXES[key])


def bm25_sql(source: str, query: str, among: str = "true") -> str:
    """CTEs ending in ``scored`` (source's columns and score)."""
    return f"""
  tok AS (SELECT *, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
  q AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{query}'), '[\\p{{L}}\\p{{N}}]+')) AS term),
  st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
  df AS (SELECT term, (SELECT count(*) FROM tok WHERE list_contains(t, term)) AS df FROM q),
  hit AS (SELECT doc_id, chunk_index, doc_type, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, q WHERE list_contains(t, term) AND {among}),
  scored AS (SELECT doc_id, chunk_index, any_value(doc_type) AS doc_type,
      round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM hit JOIN df USING (term), st GROUP BY doc_id, chunk_index)"""


# ---- a history of three commits that all documents take part in


def commit_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, tombstones) of the log.

    Version 1 inserts every document.  Version 2 changes those with an even id
    (a word more) and deletes those whose id is 1 more than a multiple of 4.
    Version 3 is on branch ``side``, forked at 1, and changes them all (reversed).
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.col("doc_id").alias("k"))
    row = lambda df, text, branch, v: df.select("doc_id", F.lit(0).alias("chunk_index"), text.alias("content"), F.lit(branch).alias("branch"), F.lit(v).cast("long").alias("version"))
    even, gone = F.col("k") % 2 == 0, F.col("k") % 4 == 1
    chunks = row(d, F.col("content"), "main", 1).unionByName(row(d.where(even), F.concat("content", F.lit(" again")), "main", 2)).unionByName(row(d, F.reverse("content"), "side", 3))
    hide = lambda df, branch, v: df.select("doc_id", F.lit(branch).alias("branch"), F.lit(v).cast("long").alias("version"))
    return chunks, hide(d.where(even | gone), "main", 2).unionByName(hide(d, "side", 3))


COMMITS = [("c1", "main", 1, "2024-01-01"), ("c1b", "main", 1, "2024-01-02"), ("c2", "main", 2, "2024-01-03"), ("c3", "side", 3, "2024-01-04")]
BRANCHES = [("main", None, None), ("side", "main", 1)]


def commits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMITS, "commit string, branch string, version long, day string").select("commit", "branch", "version", F.to_timestamp("day").alias("created_at"))


COMMITS_SQL = "commits(commit, branch, version) AS (VALUES " + ", ".join(f"('{c}', '{b}', {v})" for c, b, v, _ in COMMITS) + ")"
STATES_SQL = """s1 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents),
  s2 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(text, ' again') ELSE text END AS content FROM documents WHERE doc_id % 4 != 1),
  s3 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, reverse(text) AS content FROM documents)"""
