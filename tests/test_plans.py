"""What the plans read and shuffle, and the stored inverted index."""

import numpy as np
import pytest

from tessera.operators import embed, search
from tessera.operators import neighbours as N
from tessera.operators import text as T

SCHEMA = "doc_id string, doc_type string, chunk_index int, embedding array<float>, clustering_embedding array<float>, content string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        v = rng.normal(size=4)
        v = (v / np.sqrt(v @ v)).tolist()
        rows.append((f"d{i // 2:03d}", "AB"[i % 4 // 2], i % 2, v, v, " ".join(rng.choice(words, 30) if i % 50 else [])))
    path = str(tmp_path_factory.mktemp("t") / "chunks")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(df):
    """Columns in the scans' schemas."""
    return [line.split("ReadSchema:")[1] for line in plan(df).splitlines() if "ReadSchema:" in line]


def test_vector_search_reads_no_text_and_one_vector(stored):
    for df in (search.vector_search(stored, [1.0, 0, 0, 0], types=["A"]), search.vector_search(stored, [1.0, 0, 0, 0], overfetch=None), search.similar(stored, "d001")):
        assert read(df) and not any("content" in s or "clustering_embedding" in s for s in read(df))
    assert "EqualTo(doc_type,A)" in plan(search.vector_search(stored, [1.0, 0, 0, 0], types=["A"])) or "In(doc_type, [A])" in plan(search.vector_search(stored, [1.0, 0, 0, 0], types=["A"]))


def test_index_gives_the_scan_s_scores_and_reads_few_partitions(spark, stored, tmp_path):
    index = T.Index.build(stored.where("chunk_index = 0"), str(tmp_path / "index"), buckets=16)
    index.append(stored.where("chunk_index = 1"))
    for query in ("w1 w2 W3 w3", "w7", "nothing here", "?!", "it's; DROP"):
        want = {(r.doc_id, r.chunk_index): r.score for r in T.bm25(stored, query).collect()}
        assert {(r.doc_id, r.chunk_index): r.score for r in index.bm25(query).collect()} == want
        some = {(r.doc_id, r.chunk_index): r.score for r in T.bm25(stored, query, stored.where("doc_type = 'A'")).collect()}
        assert {(r.doc_id, r.chunk_index): r.score for r in index.bm25(query, ["A"]).collect()} == some
    rows = index.postings(["w7"])
    assert "PartitionFilters: [" in plan(rows) and rows.select("bucket").distinct().count() == 1 and "content" not in plan(index.bm25("w7"))
    a = [tuple(r) for r in search.text_search(stored, "w1 w2").select("doc_id", "chunk_index", "score").collect()]
    b = [tuple(r) for r in search.text_search(stored, "w1 w2", index=index).select("doc_id", "chunk_index", "score").collect()]
    assert a == b and len(a) == 10
    assert [tuple(r) for r in search.suggest(stored, "w1").collect()] == [tuple(r) for r in search.suggest(stored, "w1", index=index).collect()]


def test_postings_count_every_token(spark):
    docs = spark.createDataFrame([("a", 0, "Red red, blue"), ("b", 0, ""), ("c", 0, None), ("a", 0, "Red")], "doc_id string, chunk_index int, content string")
    got = sorted((r.doc_id, r.token, r.tf, r.len) for r in T.postings(docs).collect())
    assert got == [("a", "blue", 1, 3), ("a", "red", 1, 1), ("a", "red", 2, 3)]
    assert "Exchange" not in plan(T.postings(docs))


def test_similar_documents_look_at_the_page_only(stored):
    text = plan(search.similar(stored, "d001"))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text


def test_shuffle_of_the_grid_grows_with_the_side_not_the_square(spark, stored):
    for side in (1, 2, 5):
        got = {tuple(r) for r in N.knn_join(stored, stored, 3, side=side).collect()}
        want = got if side == 1 else want
        assert got == want
        rows = N._cells(stored, side, True)
        assert rows.count() == side * stored.count() and rows.select("cell").distinct().count() <= side * side
    # twice the rows: twice the shuffled rows
    assert N._cells(stored.unionByName(stored), 5, True).count() == 2 * N._cells(stored, 5, True).count()
    assert N.knn_join(stored.where("false"), stored, 3).count() == 0 and N.knn_join(stored, stored.where("false"), 3).count() == 0


def test_search_and_compare_by_text(spark):
    p = embed.HashingProvider(32)
    texts = ["red apples and pears", "blue sea and sky", "a long road home"]
    c = spark.createDataFrame([(f"d{i}", "T", 0, v, v, t) for i, (t, v) in enumerate(zip(texts, p.embed(texts)))], SCHEMA)
    for mode in search.MODES:
        assert search.search(c, mode, None, "blue sea and sky", p).first().doc_id == "d1"
    assert search.similar_to_text(c, texts[2], p).select("doc_id", "distance").first() == ("d2", 0.0)
    with pytest.raises(search.InvalidQuery):
        search.search(c, "vector", None, "x")
    pairs = spark.createDataFrame([("a b", "a b"), ("a b", "c d"), (None, "x")], "x string, y string")
    got = {(r.x, r.y): r.distance for r in search.compare_texts(pairs, "x", "y", p).collect()}
    assert got["a b", "a b"] == 0 and 0 < got["a b", "c d"] <= 1 and got[None, "x"] is None
    with pytest.raises(search.InvalidQuery):
        search.compare_texts(pairs, "x", "y", p, "poem")
    with pytest.raises(search.InvalidQuery):
        search.similar(c, "d1", count=0)
