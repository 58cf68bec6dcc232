"""The chunk table and its scans.

Columns: doc_id, doc_type, chunk_index, chunk_count, chunk_token_start,
doc_token_len, embedding, clustering_embedding, content.  No key is enforced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer id lists become a semi join instead of an IN list.
IN_LIST = 200

LOCATOR = ("chunk_index", "chunk_count", "chunk_token_start", "doc_token_len")


def population(chunks: DataFrame, types: list[str] | None = None, ids: list[str] | DataFrame | None = None) -> DataFrame:
    """doc_type in types AND doc_id in ids; an empty list (or None) does not filter.

    Values enter as literals or as a local table, never as SQL text.
    """
    if types:
        chunks = chunks.where(F.col("doc_type").isin(*types))
    if isinstance(ids, DataFrame):
        return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if not ids:
        return chunks
    if len(ids) <= IN_LIST:
        return chunks.where(F.col("doc_id").isin(*ids))
    wanted = chunks.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "doc_id string")
    return chunks.join(wanted, "doc_id", "left_semi")


def doc_chunks(chunks: DataFrame, doc_id: str) -> DataFrame:
    """All chunks of one document."""
    return chunks.where(F.col("doc_id") == F.lit(doc_id))


def first_chunk(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per document: the columns of its lowest chunk (of equal indexes the least values)."""
    best = F.min_by(F.struct(*columns), F.struct("chunk_index", *columns))
    return chunks.groupBy("doc_id").agg(best.alias("b")).select("doc_id", *[F.col(f"b.{c}") for c in columns])


def doc_content(chunks: DataFrame) -> DataFrame:
    """(doc_id, content): chunk texts in order of index, joined by one blank."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["content"]), " ").alias("content"))


def locator(start: Column | str = "chunk_token_start", size: Column | str = "doc_token_len") -> Column:
    """Where in its document a chunk starts, 0 to 1; 0 for an empty document."""
    start, size = (F.col(x) if isinstance(x, str) else x for x in (start, size))
    return F.when(size == 0, F.lit(0.0)).otherwise(start / size)


def checked(chunks: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """The same rows; a vector that is null or not of ``dim`` elements is an error when read."""
    bad = F.raise_error(F.concat(F.lit("wrong vector in "), F.coalesce("doc_id", F.lit("null"))))
    good = F.col(vector).isNotNull() & (F.size(vector) == dim)
    return chunks.withColumn(vector, F.when(good, F.col(vector)).otherwise(bad))


def counts(chunks: DataFrame, *by: str) -> DataFrame:
    """Live chunks and distinct documents: one row, or one for each value of ``by``."""
    own = chunks.groupBy(*by) if by else chunks
    return own.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))
