"""Retrieval: vector, full-text and hybrid search, similar documents, typeahead.

Every order is total: ties go by doc_id, then chunk_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.strings import cache_key, task_prefix
from tessera.operators import chunks as C
from tessera.operators import text as T
from tessera.operators.embed import Provider, embed, isolated, vectors

RRF_K = 60
OVERFETCH = 3
MODES = ("vector", "fts", "hybrid")
DELIMITERS = r"\s.,;:"


class InvalidQuery(ValueError):
    pass


def validate(mode: str = "hybrid", start: int = 0, count: int = 10) -> None:
    if mode not in MODES:
        raise InvalidQuery(f"mode must be one of {', '.join(MODES)}")
    if not 0 <= start <= 1_000_000:
        raise InvalidQuery("start must be from 0 to 1000000")
    if not 1 <= count <= 1000:
        raise InvalidQuery("count must be from 1 to 1000")


#: What a hit carries; texts and vectors stay in the table.
HIT = ("doc_id", "doc_type", *C.LOCATOR)


def scored(chunks: DataFrame, probe: list[float]) -> DataFrame:
    """Every chunk's hit columns and ``distance``: only these and the vector leave the scan."""
    own = [c for c in chunks.columns if c in HIT]
    return V.with_distance(chunks.select(*own, "embedding"), probe).drop("embedding")


def nearest_chunks(chunks: DataFrame, probe: list[float], k: int) -> DataFrame:
    """The k hits nearest to the probe, with ``distance``."""
    return scored(chunks, probe).orderBy("distance", "doc_id", "chunk_index").limit(k)


def best_chunk(hits: DataFrame, *order: Column) -> DataFrame:
    """The first chunk of every document in the given order."""
    w = W.partitionBy("doc_id").orderBy(*order, "chunk_index")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def page(hits: DataFrame, start: int, count: int, *order: Column) -> DataFrame:
    return hits.orderBy(*order, "doc_id").offset(start).limit(count)


def _fetch(start: int, count: int, overfetch: int | None) -> int | None:
    return None if overfetch is None else (start + count) * overfetch


def vector_search(chunks: DataFrame, probe: list[float], start: int = 0, count: int = 10, types=None, ids=None, overfetch: int | None = OVERFETCH) -> DataFrame:
    """Documents by their nearest chunk; filters come before the k nearest are taken.

    With ``overfetch`` None every chunk is considered, so pages are never short.
    """
    validate("vector", start, count)
    rows = C.population(chunks, types, ids)
    k = _fetch(start, count, overfetch)
    hits = scored(rows, probe) if k is None else nearest_chunks(rows, probe, k)
    return page(best_chunk(hits, F.col("distance")), start, count, F.col("distance"))


def text_hits(chunks: DataFrame, query: str, k: int | None, types=None, ids=None, index: T.Index | None = None) -> DataFrame:
    """Chunks by BM25, with ``score`` and ``distance`` = 1 / (1 + score).

    With an index of the chunks only the postings of the query's tokens are
    read; hits then have its key columns.
    """
    scored = T.bm25(chunks, query, C.population(chunks, types, ids)) if index is None else index.bm25(query, types, ids)
    scored = scored.withColumn("distance", F.round(V.bm25_distance(F.col("score")), V.DECIMALS))
    return scored if k is None else scored.orderBy(F.desc("score"), "doc_id", "chunk_index").limit(k)


def text_search(chunks: DataFrame, query: str, start: int = 0, count: int = 10, types=None, ids=None, overfetch: int | None = OVERFETCH, index: T.Index | None = None) -> DataFrame:
    validate("fts", start, count)
    hits = text_hits(chunks, query, _fetch(start, count, overfetch), types, ids, index)
    return page(best_chunk(hits, F.col("distance")), start, count, F.col("distance"))


def rrf(vector_hits: DataFrame, fts_hits: DataFrame) -> DataFrame:
    """Reciprocal rank fusion on (doc_id, chunk_index): sum of 1 / (60 + rank).

    The vector side's distance stays where both sides have a chunk.
    """
    v = vector_hits.select("doc_id", "chunk_index", F.col("distance").alias("dv")).withColumn("rv", F.row_number().over(W.orderBy("dv", "doc_id", "chunk_index")))
    f = fts_hits.select("doc_id", "chunk_index", "score", F.col("distance").alias("df")).withColumn("rf", F.row_number().over(W.orderBy(F.desc("score"), "doc_id", "chunk_index")))
    both = v.join(f, ["doc_id", "chunk_index"], "full_outer")
    part = lambda r: F.coalesce(1 / (F.lit(RRF_K) + F.col(r)), F.lit(0.0))
    kind = F.when(F.col("dv").isNotNull(), "cosine").otherwise("bm25")
    return both.select("doc_id", "chunk_index", F.round(part("rv") + part("rf"), 12).alias("rrf"), F.coalesce("dv", "df").alias("distance"), kind.alias("distance_kind"))


def hybrid_search(chunks: DataFrame, probe: list[float], query: str, start: int = 0, count: int = 10, types=None, ids=None, rank_by: str = "rrf", index: T.Index | None = None) -> DataFrame:
    """Vector and text hits fused; ranked by fusion, or by distance alone."""
    validate("hybrid", start, count)
    k = (start + count) * OVERFETCH
    fused = rrf(nearest_chunks(C.population(chunks, types, ids), probe, k), text_hits(chunks, query, k, types, ids, index))
    order = [F.desc("rrf"), F.col("distance")] if rank_by == "rrf" else [F.col("distance")]
    return page(best_chunk(fused, *order), start, count, *order)


def search(chunks: DataFrame, mode: str, probe: list[float] | None, query: str, provider: Provider | None = None, **how) -> DataFrame:
    """One of the three modes; without a probe the provider embeds the query."""
    validate(mode, how.get("start", 0), how.get("count", 10))
    if mode == "fts":
        return text_search(chunks, query, **how)
    probe = probe if probe is not None else embedded(provider, query, "query")
    if mode == "vector":
        how.pop("index", None)
        return vector_search(chunks, probe, **how)
    return hybrid_search(chunks, probe, query, **how)


def embedded(provider: Provider | None, text: str, role: str) -> list[float]:
    """A text's unit vector in a role."""
    if provider is None:
        raise InvalidQuery("a provider or a vector is needed")
    ((vector, error),) = isolated(provider, [task_prefix(provider.model, role) + text])
    if error:
        raise InvalidQuery(error)
    size = sum(x * x for x in vector) ** 0.5
    return [x / size for x in vector] if size else vector


def similar_to_text(chunks: DataFrame, text: str, provider: Provider, **how) -> DataFrame:
    """Documents nearest to a text, embedded as a document."""
    return vector_search(chunks, embedded(provider, text, "document"), **how)


class NotFound(LookupError):
    pass


def similar(chunks: DataFrame, doc_id: str, start: int = 0, count: int = 10, types=None, ids=None) -> DataFrame:
    """Documents nearest to a stored one, itself left out.

    The probe is the lowest chunk in the same snapshot; an element-wise equal
    first vector is at distance 0.  Only the page's documents are looked at for that.
    """
    validate("vector", start, count)
    own = C.doc_chunks(chunks, doc_id).orderBy("chunk_index").select("embedding").limit(1).collect()
    if not own:
        raise NotFound(doc_id)
    probe = list(own[0].embedding)
    if abs(sum(x * x for x in probe) ** 0.5 - 1) > 1e-3:
        raise InvalidQuery("the stored vector is not a unit vector")
    rows = C.population(chunks, types, ids)
    near = best_chunk(nearest_chunks(rows, probe, (start + count + 1) * OVERFETCH), F.col("distance"))
    near = page(near, 0, start + count + 1, F.col("distance")).where(F.col("doc_id") != F.lit(doc_id))
    paged = page(near, start, count, F.col("distance"))
    # a page has at most 1,000 rows
    firsts = C.first_chunk(chunks.join(F.broadcast(paged.select("doc_id")), "doc_id", "left_semi"), "embedding").withColumnRenamed("embedding", "_first")
    literal = F.array(*[F.lit(float(x)) for x in probe]).cast("array<float>")
    same = F.coalesce(V.vectors_equal(F.col("_first"), literal), F.lit(False))
    out = F.broadcast(paged).join(firsts, "doc_id").withColumn("distance", F.when(same, 0.0).otherwise(F.col("distance"))).drop("_first")
    return out.orderBy("distance", "doc_id")


#: What a comparison of texts in a role embeds its sides as.
COMPARE_ROLES = {None: ("query", "document"), "query": ("query", "document"), "document": ("document", "document"), "clustering": ("clustering", "clustering"), "classification": ("classification", "classification")}


def compare(pairs: DataFrame, left: str, right: str, left_vector: str, right_vector: str) -> DataFrame:
    """``distance`` of two texts: 0 for equal strings, else of their vectors."""
    d = V.cosine_distance(F.col(left_vector), F.col(right_vector))
    return pairs.withColumn("distance", F.when(F.col(left) == F.col(right), F.lit(0.0)).otherwise(d))


def compare_texts(pairs: DataFrame, left: str, right: str, provider: Provider, role: str | None = None) -> DataFrame:
    """pairs with ``distance`` of two text columns in a role; equal strings aren't embedded.

    Null on either side, or a text that the provider refuses, gives null.
    """
    roles = _compare_roles(role)
    equal, apart = pairs.where(F.col(left) == F.col(right)).withColumn("distance", F.lit(0.0)), pairs.where(F.col(left) != F.col(right))
    unknown = pairs.where(F.col(left).isNull() | F.col(right).isNull()).withColumn("distance", F.lit(None).cast("double"))
    own = apart
    for side, text, as_role in (("_l", left, roles[0]), ("_r", right, roles[1])):
        made = vectors(apart.select(F.col(text).alias("content")), provider, as_role)
        # joined by the key, so texts that nobody asks for stay behind
        key = cache_key(F.lit(provider.model), F.concat(F.lit(task_prefix(provider.model, as_role)), F.col(text)))
        own = own.withColumn(f"{side}k", key).join(made.select(F.col("cache_key").alias(f"{side}k"), F.col("vector").alias(f"{side}v")), f"{side}k", "left")
    own = own.withColumn("distance", _between("_lv", "_rv")).select(*pairs.columns, "distance")
    return own.unionByName(equal).unionByName(unknown)


def compare_documents(docs: DataFrame, pairs: DataFrame, provider: Provider, role: str | None = None) -> DataFrame:
    """``distance`` of the texts (doc_id, content) of each pair (left_id, right_id), as ``compare_texts`` has it.

    Every text is hashed and embedded once; pairs meet hashes and vectors, no text.
    A pair with an id that docs don't have is left out.
    """
    roles = _compare_roles(role)
    rows = docs.select("doc_id", "content", F.sha2("content", 256).alias("_h"))
    made = {r: embed(rows, provider, r).select("doc_id", "_h", "vector") for r in dict.fromkeys(roles)}
    own = pairs
    for side, as_role in (("left", roles[0]), ("right", roles[1])):
        own = own.join(made[as_role].toDF(f"{side}_id", f"_{side}_h", f"_{side}_v"), f"{side}_id")
    same = F.col("_left_h") == F.col("_right_h")
    return own.withColumn("distance", F.when(same, F.lit(0.0)).when(~same, _between("_left_v", "_right_v"))).select(*pairs.columns, "distance")


def _compare_roles(role: str | None) -> tuple[str, str]:
    if role not in COMPARE_ROLES:
        raise InvalidQuery(f"role must be one of {', '.join(r for r in COMPARE_ROLES if r)}")
    return COMPARE_ROLES[role]


def _between(left: str, right: str) -> Column:
    """Distance of two vectors, null where one is."""
    return F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), V.cosine_distance(F.col(left), F.col(right)))


# ---- typeahead


def substring_hits(chunks: DataFrame, query: str, types=None, ids=None) -> DataFrame:
    """Chunks that contain the query whatever the case, at distance 0; all chunks are looked at."""
    found = F.contains(F.lower("content"), F.lit(query.lower()))
    return C.population(chunks, types, ids).where(found).withColumn("distance", F.lit(0.0))


def match_columns(content: Column, query: str) -> dict[str, Column]:
    """match_start, match_end (character offsets, the end at a word's end) and up to five next words."""
    at = F.locate(query.lower(), F.lower(content)) - 1
    rest = F.substring(content, at + 1 + len(query), F.length(content))
    tail = F.regexp_extract(rest, rf"^[^{DELIMITERS}]*", 0)
    after = F.substring(rest, F.length(tail) + 1, F.length(content))
    following = F.slice(F.filter(F.split(after, rf"[{DELIMITERS}]+"), lambda w: w != ""), 1, 5)
    return {"match_start": at, "match_end": at + len(query) + F.length(tail), "next_words": following}


def suggest(chunks: DataFrame, query: str, count: int = 11, types=None, ids=None, index: T.Index | None = None) -> DataFrame:
    """Best documents for what was typed, with the match and the words after it.

    Full text first; where that finds nothing, the substring scan.  Text is read
    only of the chunks that are shown.
    """
    k = min((count + 1) * 5, 200)
    keys = [r for r in text_hits(chunks, query, k, types, ids, index).select("doc_id", "chunk_index", "distance").collect()]  # at most 200
    if keys:
        hits = chunks.sparkSession.createDataFrame(keys, "doc_id string, chunk_index int, distance double")
        best = page(best_chunk(hits, F.col("distance")), 0, count, F.col("distance"))
        shown = chunks.where(F.col("doc_id").isin(*{r.doc_id for r in keys})).select("doc_id", "chunk_index", "content")
        best = shown.join(F.broadcast(best), ["doc_id", "chunk_index"])
    else:
        best = page(best_chunk(substring_hits(chunks, query, types, ids), F.col("distance")), 0, count, F.col("distance"))
    found = match_columns(F.col("content"), query)
    has = F.col("match_start") >= 0
    out = best.select("doc_id", "chunk_index", "distance", F.col("content").alias("snippet"), *[c.alias(n) for n, c in found.items()])
    empty = {"match_start": F.lit(None), "match_end": F.lit(None), "next_words": F.array().cast("array<string>")}
    return out.select("doc_id", "chunk_index", "distance", "snippet", *[F.when(has, F.col(n)).otherwise(e).alias(n) for n, e in empty.items()]).orderBy("distance", "doc_id")


def completions(snippets: DataFrame, query: str, column: str = "snippet", most: int = 8) -> DataFrame:
    """(completion, n): the word a match lies in and one to three words after it.

    Grouped without case (the least spelling stands for a group); what equals the
    query is left out.  Order: n, then length, both falling, then text.
    """
    word = rf"[^{DELIMITERS}]"
    literal = F.regexp_replace(F.lit(query.lower()), r"([^\p{L}\p{N}\s])", r"\\$1")
    text = F.regexp_replace(F.col(column), r"\s+", " ")
    # look-ahead, so that matches inside one another all count; anchored at a word's start
    pattern = F.concat(F.lit(rf"(?i)(?<!{word})(?=({word}*?"), literal, F.lit(rf"{word}*(?: {word}+){{1,3}}))"))
    found = snippets.select(F.explode(F.regexp_extract_all(text, pattern, F.lit(1))).alias("c")).where(F.lower("c") != query.lower())
    grouped = found.groupBy(F.lower("c").alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("completion"))
    return grouped.select("completion", "n").orderBy(F.desc("n"), F.desc(F.length("completion")), "completion").limit(most)


def served(hits: DataFrame, commit: str) -> DataFrame:
    """The hits with the commit that answered."""
    return hits.withColumn("served_commit", F.lit(commit))

