import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, embed, ivf, matching, search
from tessera.operators import chunks as C
from tessera.operators import neighbours as N
from tessera.operators import text as T
from tessera.plans import catalog
from tessera.plans import fixtures as X


def chunk_frame(spark, rows):
    """rows: (doc_id, doc_type, chunk_index, vector, content)."""
    return spark.createDataFrame(rows, "doc_id string, doc_type string, chunk_index int, embedding array<float>, content string")


def families(spark, n=6, chunks=3):
    """Twins whose own chunks are closer to each other than to the twin."""
    rows = []
    for f in range(n):
        for d in range(2):
            for c in range(chunks):
                angle = f * 0.7 + d * 0.02 + c * 0.0002
                rows.append((f"f{f}d{d}", "A" if d == 0 else "B", c, [float(np.cos(angle)), float(np.sin(angle))], f"family {f} text {c}"))
    return chunk_frame(spark, rows)


def test_twins_are_found_although_own_chunks_are_nearer(spark):
    c = families(spark)
    got = {(r.id1, r.id2) for r in N.duplicates(c, c, threshold=0.01).collect()}
    assert got == {(f"f{f}d0", f"f{f}d1") for f in range(6)}
    across = {(r.id1, r.id2) for r in N.duplicates(c, C.population(c, ["A"]), C.population(c, ["B"]), 0.01).collect()}
    assert across == got


def test_knn_join_against_brute_force_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(90, 6)).astype(np.float32)
    rows = [(f"d{i // 3:02d}", "T", i % 3, m[i].tolist(), "") for i in range(90)]
    monkeypatch.setattr(N, "BLOCK", 16)
    got = N.knn_join(chunk_frame(spark, rows), chunk_frame(spark, rows), 4)
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    d = np.round(np.clip((1 - u @ u.T) / 2, 0, 1), 9)
    have = {(r.src_id, r.src_chunk, r["rank"]): (r.nbr_id, r.distance) for r in got.collect()}
    for i in range(90):
        best = {}
        for j in range(90):
            if i // 3 != j // 3:
                best[f"d{j // 3:02d}"] = min(best.get(f"d{j // 3:02d}", 9), d[i, j])
        for k, (nbr, dist) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:4]):
            assert have[f"d{i // 3:02d}", i % 3, k + 1] == (nbr, pytest.approx(dist))


def test_merge_is_sorted_and_capped(spark):
    rows = [("a", 0, "x", 0.3, 1), ("a", 0, "y", 0.4, 2), ("a", 1, "z", 0.1, 1), ("a", 1, "x", 0.2, 2)]
    df = spark.createDataFrame(rows, "src_id string, src_chunk int, nbr_id string, distance double, rank int")
    assert [(r.nbr_id, r.distance) for r in N.merge_chunks(df, 2).orderBy("rank").collect()] == [("z", 0.1), ("x", 0.2)]


def test_population_is_refused_not_cut(spark):
    c = families(spark)
    with pytest.raises(N.TooLarge):
        N.bounded(c, 10)
    assert N.bounded(c, 36).count() == 36


def test_canonical_pairs(spark):
    df = spark.createDataFrame([("b", "a", "sb", "sa"), ("a", "b", "sa", "sb")], "x string, y string, sx string, sy string")
    got = {tuple(r) for r in df.select(*N.canonical(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))).collect()}
    assert got == {("a", "b", "sa", "sb")}


HOSTILE = ["it's", 'q"uote', "back\\slash", "line\nend", "nul\x00", "full＇width", "x' OR '1'='1", "%_", ""]


def test_hostile_ids_are_only_values(spark):
    c = chunk_frame(spark, [(i, "T", 0, [1.0, 0.0], i) for i in HOSTILE])
    for i in HOSTILE:
        assert [r.doc_id for r in C.doc_chunks(c, i).collect()] == [i]
        assert [r.doc_id for r in C.population(c, None, [i]).collect()] == [i]
    assert C.population(c, ["T' OR 1=1 --"]).count() == 0
    assert C.population(c, None, HOSTILE * 50).count() == len(HOSTILE)


def test_similar_leaves_itself_out_and_marks_copies(spark):
    rows = [("a", "T", 0, [1.0, 0.0], ""), ("b", "T", 0, [1.0, 0.0], ""), ("c", "T", 0, [0.0, 1.0], "")]
    got = [(r.doc_id, r.distance) for r in search.similar(chunk_frame(spark, rows), "a").collect()]
    assert got == [("b", 0.0), ("c", 0.5)]
    with pytest.raises(search.NotFound):
        search.similar(chunk_frame(spark, rows), "zz")


def test_fusion_prefers_what_both_lists_have(spark):
    rows = [(f"d{i}", "T", 0, [float(np.cos(i / 9)), float(np.sin(i / 9))], "apple pie" if i in (2, 7) else "plum") for i in range(10)]
    got = [r.doc_id for r in search.hybrid_search(chunk_frame(spark, rows), [1.0, 0.0], "apple", count=3).collect()]
    assert got[0] == "d2"
    by = [r.distance for r in search.hybrid_search(chunk_frame(spark, rows), [1.0, 0.0], "apple", count=5, rank_by="distance").collect()]
    assert by == sorted(by)


def test_bm25_against_plain_python(spark):
    texts = ["red red blue", "blue", "green fish red", "", "BLUE, red!"]
    c = chunk_frame(spark, [(f"d{i}", "T", 0, [1.0], t) for i, t in enumerate(texts)])
    got = {r.doc_id: r.score for r in T.bm25(c, "Red blue red").collect()}
    docs = [[w.strip(",!").lower() for w in t.split()] for t in texts]
    avg = np.mean([len(d) for d in docs])
    for i, d in enumerate(docs):
        s = 0.0
        for q in ("red", "blue"):
            df = sum(q in x for x in docs)
            tf = d.count(q)
            s += np.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        assert got.get(f"d{i}", 0.0) == pytest.approx(s, abs=1e-6)
    assert T.bm25(c, "?!").count() == 0


@pytest.mark.parametrize("how", [{"mode": "best"}, {"start": -1}, {"start": 1_000_001}, {"count": 0}, {"count": 1001}])
def test_bad_parameters(how):
    with pytest.raises(search.InvalidQuery):
        search.validate(**how)


def test_completions(spark):
    texts = ["The apple tree grows. apple tree", "an Apple pie, now", "pineapple pie", "apple"]
    df = spark.createDataFrame([(t,) for t in texts], "snippet string")
    got = {r.completion: r.n for r in search.completions(df, "apple").collect()}
    assert got["apple tree"] == 1 and got["apple tree grows"] == 1 and got["Apple pie"] == 1 and got["pineapple pie"] == 1
    assert "apple" not in got and len(got) <= 8
    many = spark.createDataFrame([(f"apple w{i}",) for i in range(20)], "snippet string")
    assert search.completions(many, "apple").count() == 8


def test_suggest_falls_back_to_substrings(spark):
    c = chunk_frame(spark, [("a", "T", 0, [1.0], "say pineapples are good to eat here"), ("b", "T", 0, [1.0], "nothing")])
    (r,) = search.suggest(c, "neapp").collect()
    assert r.snippet[r.match_start : r.match_end] == "neapples" and r.next_words == ["are", "good", "to", "eat", "here"]


def test_windows(spark):
    words = [f"w{i}" for i in range(25)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a  b"), (3, ""), (4, None)], "doc_id long, text string")
    rows = chunking.chunk(docs, 10, 3).orderBy("doc_id", "chunk_index").collect()
    first = [r for r in rows if r.doc_id == "1"]
    assert [r.chunk_token_start for r in first] == [0, 7, 14, 21] and first[-1].content == " ".join(words[21:])
    assert {r.chunk_count for r in first} == {4} and {t for r in first for t in r.content.split()} == set(words)
    assert [r.content for r in rows if r.doc_id in "23"] == ["a  b", ""] and not [r for r in rows if r.doc_id == "4"]
    assert len(chunking.chunk(docs.where("doc_id = 1"), 10, 99).collect()) == 16
    assert chunking.sizes(12) == (500, 71) and chunking.sizes(600) == (480, 64)


def test_failures_are_isolated_and_documents_whole(spark):
    class Flaky(embed.HashingProvider):
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("poisoned")
            return [[float("nan")] * self.dim if "nan" in t else v for t, v in zip(texts, super().embed(texts))]

    rows = spark.createDataFrame([("a", "fine"), ("b", "poison"), ("b", "fine too"), ("c", "nan"), ("d", "good")], "doc_id string, content string")
    good, bad = embed.split_failures(embed.embed(rows, Flaky(8)))
    assert {r.doc_id for r in good.collect()} == {"a", "d"} and {r.doc_id for r in bad.collect()} == {"b", "c"}


def test_cache_is_used(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "doc_id string, content string")
    made = {r.doc_id: r for r in embed.embed(rows, embed.HashingProvider(4)).collect()}
    cache = spark.createDataFrame([(made["a"].cache_key, [9.0, 9.0, 9.0, 9.0]), (made["b"].cache_key, [1.0])], "key string, vector array<float>")
    got = {r.doc_id: r.vector for r in embed.embed(rows, embed.HashingProvider(4), cache=cache).collect()}
    assert got["a"] == [9.0] * 4 and got["b"] == got["c"] == made["b"].vector


def resolve_plain(there, back, k, t11, t1n, tn1):
    edges = {}
    for s, ns in there.items():
        for t, d in ns:
            edges[s, t] = min(edges.get((s, t), 9), d)
    for t, ns in back.items():
        for s, d in ns:
            edges[s, t] = min(edges.get((s, t), 9), d)
    most = max([x for x in (t11, t1n, tn1) if x is not None], default=-1)
    edges = {e: d for e, d in edges.items() if d <= most}
    top = lambda m: {a: {b for b, _ in sorted(ns, key=lambda x: (x[1], x[0]))[:k]} for a, ns in m.items()}
    ts, tt = top(there), top(back)
    out = {}
    if t11 is not None:
        for s in {s for s, _ in edges}:
            own = [(d, t) for (x, t), d in edges.items() if x == s and d <= t11 and t in ts.get(s, ()) and s in tt.get(t, ())]
            if own:
                d, t = min(own)
                out[s, t] = (d, "core")
    for (s, t), d in edges.items():
        if (s, t) not in out and t1n is not None and d <= t1n and t in ts.get(s, ()):
            out[s, t] = (d, "set_extra")
    for (s, t), d in edges.items():
        if (s, t) not in out and tn1 is not None and d <= tn1 and s in tt.get(t, ()):
            out[s, t] = (d, "target_extra")
    return out


@pytest.mark.parametrize("taus", [(0.4, None, None), (0.4, 0.5, None), (0.3, 0.5, 0.6), (None, 0.5, 0.5), (None, None, None)])
def test_matching_stages(spark, taus):
    rng = np.random.default_rng(8)
    draw = lambda a, b: {f"{a}{i}": [(f"{b}{j}", float(round(rng.random(), 2))) for j in rng.choice(6, 4, replace=False)] for i in range(6)}
    there, back = draw("s", "t"), draw("t", "s")
    frame = lambda m: spark.createDataFrame([(a, b, d) for a, ns in m.items() for b, d in ns], "src_id string, nbr_id string, distance double")
    got = {(r.set_id, r.target_id): (r.distance, r.stage) for r in matching.resolve(frame(there), frame(back), 3, *taus).collect()}
    assert got == resolve_plain(there, back, 3, *taus)


def test_ivf_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    m = (centres[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 16))).astype(np.float32)
    c = chunk_frame(spark, [(f"d{i}", "T", 0, m[i].tolist(), "") for i in range(600)])
    centroids = ivf.train(c, 16)
    index = ivf.assign(c, centroids)
    hit = 0
    for i in range(5):
        exact = {r.doc_id for r in search.nearest_chunks(c, m[i].tolist(), 10).collect()}
        hit += len(exact & {r.doc_id for r in ivf.search(index, centroids, m[i].tolist(), 10, nprobes=6).collect()})
    assert hit >= 45
    near = {(r.src_id, r.nbr_id) for r in ivf.knn_join(c, index, centroids, 3, nprobes=6).collect()}
    true = {(r.src_id, r.nbr_id) for r in N.merge_chunks(N.knn_join(c, c, 3), 3).collect()}
    assert len(near & true) >= 0.9 * len(true)
    assert ivf.partitions(1_060**2) > 16 and ivf.needs_index(300) and not ivf.needs_index(200) and ivf.needs_index(200, force=True)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_registered_ivf_queries_reach_their_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    c = X.vector_chunks(spark, path)
    near = {(r.src_id, r.nbr_id) for r in catalog.QUERIES["ivf_knn_join"](spark, path).collect()}
    true = {(r.src_id, r.nbr_id) for r in N.merge_chunks(N.knn_join(c, c, 5), 5).collect()}
    assert len(near & true) >= 0.9 * len(true)
    got = [(r.doc_id, r.chunk_index) for r in catalog.QUERIES["ivf_topk"](spark, path).collect()]
    exact = search.nearest_chunks(c, X.probe(spark, path), 10).orderBy("distance", "doc_id", "chunk_index").collect()
    assert sorted(got) == sorted((r.doc_id, r.chunk_index) for r in exact)


def test_search_with_radii_is_exact_for_any_probe(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[7] = 0
    c = chunk_frame(spark, [(f"d{i}", "T", 0, m[i].tolist(), "") for i in range(300)])
    centroids = ivf.train(c, 16)
    index = ivf.assign(c, centroids).cache()
    reach = ivf.radii(index, centroids)
    for probe in (m[0].tolist(), (-m[3]).tolist(), [0.0] * 8):
        exact = [(r.doc_id, r.distance) for r in search.nearest_chunks(c, probe, 10).collect()]
        assert [(r.doc_id, r.distance) for r in ivf.search(index, centroids, probe, 10, nprobes=1, radii=reach).collect()] == exact
