"""Full text: postings, corpus statistics and BM25.

The analyzer lower-cases and takes runs of letters and digits; a query matches a
chunk that has any of its tokens.  k1 = 1.2, b = 0.75.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.strings import tokens

K1, B = 1.2, 0.75
#: Decimals of scores, so that ln of different libraries agree.
DECIMALS = 6


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """(doc_id, chunk_index, token, tf, len): the inverted index."""
    return _postings(chunks, text, "doc_id", "chunk_index")


def _postings(chunks: DataFrame, text: str, *keys: str) -> DataFrame:
    """Counted inside each row's array, so nothing is shuffled and each text is split once.

    Rows that repeat a key (none is enforced) have postings of their own.
    """
    spelt = F.sort_array(tokens(F.col(text)))
    # explode_outer: an inner explode would split the text once more to filter empty arrays
    split = chunks.select(*keys, F.explode_outer(F.array(spelt)).alias("t"))
    split = split.select(*keys, "t", F.size("t").alias("len"), F.transform("t", lambda x, i: F.when((i == 0) | (F.get("t", i - 1) != x), i)).alias("_at"))
    # a column of its own: inside the next lambda it would be made again for every token
    split = split.select(*keys, "t", "len", F.filter("_at", lambda i: i.isNotNull()).alias("_first"))
    nth = F.transform("_first", lambda i, n: F.struct(F.get("t", i).alias("token"), (F.coalesce(F.get("_first", n + 1), F.col("len")) - i).cast("long").alias("tf")))
    rows = split.select(*keys, "len", F.explode_outer(nth).alias("p")).where("p is not null")
    return rows.select(*keys, F.col("p.token").alias("token"), F.col("p.tf").alias("tf"), "len")


def corpus_statistics(chunks: DataFrame, text: str = "content") -> DataFrame:
    """One row: number of chunks and their average length in tokens."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def document_frequency(chunks: DataFrame, text: str = "content") -> DataFrame:
    """(token, df) over all chunks."""
    split = chunks.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    return split.groupBy("token").agg(F.count("*").alias("df"))


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25(chunks: DataFrame, query: str, among: DataFrame | None = None, text: str = "content") -> DataFrame:
    """Chunks of ``among`` (default all) with a positive score, and ``score``.

    Statistics are of all chunks, also when only some are ranked.  This reads
    all texts, once for the statistics and once for the scores; ``Index`` doesn't.
    """
    spark = chunks.sparkSession
    terms = query_terms(spark, query)
    among = chunks if among is None else among
    if not terms:
        return among.where(F.lit(False)).withColumn("score", F.lit(0.0))
    listed = F.array(*map(F.lit, terms))
    held = [F.sum(F.when(F.array_contains("t", t), 1).otherwise(0)).alias(f"df{i}") for i, t in enumerate(terms)]
    stats = chunks.select(tokens(F.col(text)).alias("t")).agg(F.count("*").alias("_n"), F.avg(F.size("t")).alias("_avg"), *held)
    # one row of statistics beside every chunk that has a term
    rows = among.withColumn("_t", tokens(F.col(text))).where(F.arrays_overlap("_t", listed)).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = F.size(F.filter("_t", _is(t))).cast("double")
        idf = F.log(1 + (F.col("_n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("_t") / F.col("_avg")))
    return rows.withColumn("score", F.round(score, DECIMALS)).where(F.col("score") > 0).select(*among.columns, "score")


def query_terms(spark, query: str) -> list[str]:
    """The query's distinct tokens, by the same analyzer as the texts."""
    return [r.t for r in spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("t")).collect()]


class Index:
    """A stored inverted index: postings in partitions by the token's hash, sorted by token.

    A query reads only its tokens' partitions, and in them (sorted files have
    telling row-group statistics) little more than its tokens' rows.  New chunks
    are added with ``append``; ``chunks`` statistics of all parts are summed.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path
        self.buckets = int(spark.read.parquet(f"{path}/statistics").agg(F.max("buckets")).first()[0])

    @classmethod
    def build(cls, chunks: DataFrame, path: str, text: str = "content", buckets: int = 64) -> Index:
        spark = chunks.sparkSession
        cls._write(chunks, path, text, buckets, "overwrite")
        return cls(spark, path)

    def append(self, chunks: DataFrame, text: str = "content") -> None:
        self._write(chunks, self.path, text, self.buckets, "append")

    @staticmethod
    def _write(chunks: DataFrame, path: str, text: str, buckets: int, mode: str) -> None:
        keys = ["doc_id", "doc_type", "chunk_index"]
        rows = _postings(chunks, text, *keys).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        # each task sorts the postings of its own chunks, so none is shuffled and no token is a task's alone
        rows.sortWithinPartitions("bucket", "token").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
        length = chunks.select(F.explode_outer(F.array(F.size(tokens(F.col(text))))).alias("len"))
        one = length.agg(F.count("*").alias("n"), F.count("len").alias("texts"), F.sum("len").alias("tokens")).withColumn("buckets", F.lit(buckets))
        one.coalesce(1).write.mode(mode).parquet(f"{path}/statistics")

    def postings(self, terms: list[str]) -> DataFrame:
        at = self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int").alias("b")).collect()
        rows = self.spark.read.parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin(*{r.b for r in at}) & F.col("token").isin(*terms))

    def bm25(self, query: str, types=None, ids=None) -> DataFrame:
        """(doc_id, doc_type, chunk_index, score) of chunks with a positive score."""
        from tessera.operators.chunks import population

        terms = query_terms(self.spark, query)
        if not terms:
            return self.spark.createDataFrame([], "doc_id string, doc_type string, chunk_index int, score double")
        rows = self.postings(terms)
        # one row of corpus statistics, one of document frequency for each of the query's tokens
        df = rows.groupBy("token").agg(F.count("*").alias("df"))
        stats = self.spark.read.parquet(f"{self.path}/statistics").agg(F.sum("n").alias("_n"), (F.sum("tokens") / F.sum("texts")).alias("_avg"))
        scored = population(rows, types, ids).join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))
        tf = F.col("tf").cast("double")
        idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
        out = scored.groupBy("doc_id", "doc_type", "chunk_index").agg(F.round(F.sum(part), DECIMALS).alias("score"))
        return out.where(F.col("score") > 0)
