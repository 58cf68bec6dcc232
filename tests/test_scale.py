"""Steps whose work or memory grew faster than their input."""

import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import DataFrameWriter

from tessera.functions import vectors as V
from tessera.operators import chunking, embed, ingest, ivf, search
from tessera.operators import neighbours as N
from tessera.operators import text as T
from tessera.plans import catalog

SCHEMA = "doc_id string, doc_type string, chunk_index int, embedding array<float>, clustering_embedding array<float>, content string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, m, chunks=3):
    return spark.createDataFrame([(f"d{i // chunks:03d}", "T", i % chunks, v.tolist(), v.tolist(), "") for i, v in enumerate(m.astype(np.float32))], SCHEMA)


def brute(m, chunks, k, wanted=None):
    """{(doc, chunk): [(doc, distance)]} of the k nearest documents; wanted: pairs that count."""
    u = V.unit_rows(m.astype(np.float32).astype(float))
    d = np.round(np.clip((1 - u @ u.T) / 2, 0, 1), 9)
    out = {}
    for i in range(len(m)):
        best = {}
        for j in range(len(m)):
            if i // chunks != j // chunks and (wanted is None or wanted[i, j]):
                best[f"d{j // chunks:03d}"] = min(best.get(f"d{j // chunks:03d}", 9), d[i, j])
        out[f"d{i // chunks:03d}", i % chunks] = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def test_only_pairs_that_can_be_near_are_looked_at_one_by_one(monkeypatch):
    rng = np.random.default_rng(1)
    m = V.unit_rows(rng.normal(size=(6000, 16)).astype(np.float32).astype(float))
    ids = np.array([f"d{i // 4:05d}" for i in range(6000)], object)
    held = N._Held([(ids, np.arange(6000, dtype=np.int32) % 4, m, np.zeros(6000, np.int64))])
    seen, whole = [], N._distances
    monkeypatch.setattr(N, "_distances", lambda *a: (seen.append(len(a[2])), whole(*a))[1])
    i, j, d = N._nearest(ids[:500], m[:500], held, 3, None, True)
    assert sum(seen) < 0.1 * 500 * 6000
    u = np.round(np.clip((1 - m[:500] @ m.T) / 2, 0, 1), 9).reshape(500, 1500, 4).min(axis=2)
    u[np.arange(500), np.arange(500) // 4] = 9
    assert np.allclose(d.reshape(500, 3), np.sort(u, axis=1)[:, :3], atol=2e-9)


@pytest.mark.parametrize("per_document", [True, False])
def test_equal_and_zero_vectors_among_candidates(spark, per_document):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(150, 5))
    m[:60] = m[0]
    m[60:66] = 0
    c = frame(spark, m)
    got = {}
    for r in N.knn_join(c, c, 4, per_document=per_document, shape=(3, 2)).orderBy("rank").collect():
        got.setdefault((r.src_id, r.src_chunk), []).append((r.nbr_id, r.nbr_chunk, r.distance))
    if per_document:
        want = brute(m, 3, 4)
        assert {k: [(a, d) for a, _, d in v] for k, v in got.items()} == {k: [(a, pytest.approx(d, abs=2e-9)) for a, d in v] for k, v in want.items()}
    else:
        assert got["d000", 0] == [("d001", 0, 0.0), ("d001", 1, 0.0), ("d001", 2, 0.0), ("d002", 0, 0.0)]
    assert N.knn_join(c, c, 4, 0.0, per_document).where("src_id = 'd100' or distance > 0").isEmpty()


def test_ivf_join_shuffles_a_vector_by_groups_not_by_lists(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(240, 6))
    c = frame(spark, m)
    centroids = ivf.train(c, 16)
    index = ivf.assign(c, centroids)
    found = ivf.knn_join(c, index, centroids, 4, nprobes=5)
    assert "Join" not in plan(found)
    u = V.unit_rows(m.astype(np.float32).astype(float))
    s = u @ centroids.T
    wanted = np.zeros((240, 16), bool)
    np.put_along_axis(wanted, np.argsort(-s, axis=1)[:, :5], True, axis=1)
    want = {}
    for (src, _), near in brute(m, 3, 4, wanted[:, s.argmax(axis=1)]).items():
        for nbr, d in near:
            want.setdefault(src, {})[nbr] = min(d, want.get(src, {}).get(nbr, 9))
    got = {}
    for r in found.orderBy("src_id", "rank").collect():
        got.setdefault(r.src_id, []).append((r.nbr_id, pytest.approx(r.distance, abs=2e-9)))
    assert {k: sorted(v.items(), key=lambda x: (x[1], x[0]))[:4] for k, v in want.items()} == got


def seconds(df):
    df.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_postings_of_a_long_text_take_time_in_proportion(spark):
    def texts(words):
        own = " ".join(f"w{(7 * i) % words} of" for i in range(words))
        return spark.createDataFrame([("a", 0, own)] * 2, "doc_id string, chunk_index int, content string").cache()

    got = {r.token: (r.tf, r.len) for r in T.postings(texts(3000).limit(1)).collect()}
    assert got == {f"w{i}": (1, 6000) for i in range(3000)} | {"of": (3000, 6000)}
    assert seconds(T.postings(texts(24_000))) < 8 * seconds(T.postings(texts(6000))) + 1


def test_index_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    seen, whole = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        if path.endswith("/postings"):
            seen.append(plan(self._df))
        return whole(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    docs = spark.createDataFrame([(f"d{i}", "T", 0, f"the w{i % 5}") for i in range(40)] + [("e", "T", 0, ""), ("n", "T", 0, None)], "doc_id string, doc_type string, chunk_index int, content string")
    index = T.Index.build(docs, str(tmp_path / "index"), buckets=4)
    assert len(seen) == 1 and "Exchange" not in seen[0]
    assert {(r.doc_id, r.score) for r in index.bm25("the w1").collect()} == {(r.doc_id, r.score) for r in T.bm25(docs, "the w1").collect()}


def test_pairs_of_equal_texts_carry_no_text(spark, tmp_path):
    text = "the same long text " * 50
    rows = [(i, text if i % 3 else f"text {i} {'aeio' * i}", "en", "web", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.QUERIES["compare_texts"](spark, str(tmp_path))
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("text#" in line or " a#" in line or "content#" in line for line in joins)
    assert "Distinct" not in out._jdf.queryExecution().analyzed().toString()
    got = sorted(tuple(r) for r in out.collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(catalog.ORACLE_SQL["compare_texts"]).fetchall())


def test_compare_by_document_is_compare_by_text(spark):
    p = embed.HashingProvider(16)
    texts = {"a": "red apples", "b": "blue sea", "c": "red apples", "n": None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, content string")
    pairs = [(x, y) for x in texts for y in texts if x != y]
    by_id = search.compare_documents(docs, spark.createDataFrame([*pairs, ("a", "gone")], "left_id string, right_id string"), p)
    by_text = search.compare_texts(spark.createDataFrame([(x, y, texts[x], texts[y]) for x, y in pairs], "left_id string, right_id string, x string, y string"), "x", "y", p)
    got = {(r.left_id, r.right_id): r.distance for r in by_id.collect()}
    assert len(got) == 12 and got == {(r.left_id, r.right_id): r.distance for r in by_text.collect()}
    assert got["a", "c"] == 0 and got["a", "b"] > 0 and got["a", "n"] is None and got["n", "b"] is None


def test_hashing_provider_hashes_a_known_triple_once(monkeypatch):
    def plain(text, dim):
        row, low = np.zeros(dim), text.lower()
        for gram in [*low.split(), *(low[i : i + 3] for i in range(len(low) - 2))]:
            h = xxhash.xxh3_64_intdigest(gram)
            row[h % dim] += 1.0 if h >> 63 else -1.0
        n = np.sqrt((row * row).sum())
        return (row / n if n else row).astype(np.float32).tolist()

    texts = ["Some plain words, some plain words", "Straße ÀÉ ÿ", "Много слов и 漢字 и 😀😀😀", "", "ab", "İstanbul \x00\x00\x00 x"]
    for dim in (16, 37):
        assert embed.HashingProvider(dim).embed(texts) == [plain(t, dim) for t in texts]
    calls, whole = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(embed.xxhash, "xxh3_64_intdigest", lambda x: (calls.append(x), whole(x))[1])
    embed.HashingProvider(16).embed([texts[0] * 50])
    assert len(calls) < 20


def test_chunks_are_cut_once_and_carry_no_whole_text(spark):
    docs = spark.createDataFrame([("d", "one two three four five"), ("e", " a\n b"), ("", ""), ("n", None)], "doc_id string, text string")
    rows = chunking.chunk(docs, 3, 1)
    generate = [x for x in plan(rows).splitlines() if "Generate" in x]
    assert len(generate) == 1 and "_text" not in generate[0] and "_t#" not in generate[0]
    got = {(r.doc_id, r.chunk_index): (r.chunk_count, r.chunk_token_start, r.doc_token_len, r.content) for r in rows.collect()}
    assert got == {("d", 0): (2, 0, 5, "one two three"), ("d", 1): (2, 2, 5, "three four five"), ("e", 0): (1, 0, 2, " a\n b"), ("", 0): (1, 0, 0, "")}
    names = []
    ops = docs.selectExpr("'Inserted' as op", "doc_id as id", "text as string")
    ingest.chunk_rows(ops, embed.HashingProvider(4), staged=lambda df, name: (names.append(name), df)[1])
    assert names[0] == "chunks"
