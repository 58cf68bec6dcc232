import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.functions import vectors as V


def test_distance_anchors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 2.0], 0.5), ([1.0, 0.0], [-3.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.5)]
    df = spark.createDataFrame(rows, "u array<float>, v array<float>, want double")
    for r in df.select("want", V.cosine_distance(F.col("u"), F.col("v")).alias("d"), V.l2_normalize(F.col("u")).alias("n")).collect():
        assert r.d == r.want and sum(x * x for x in r.n) in (0.0, 1.0)


def test_bulk_kernel_agrees_with_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    probe = rows[3][1]
    lit = F.array(*map(F.lit, probe))
    for r in V.with_distance(df, probe).withColumn("d", V.cosine_distance(F.col("embedding"), lit)).collect():
        assert r.distance == pytest.approx(r.d, abs=2e-9)


@pytest.mark.parametrize("bad", [[None], [[1.0, 2.0], [1.0]], [[1.0, None]]])
def test_bad_vectors_are_errors(spark, bad):
    df = spark.createDataFrame([(b,) for b in bad], "embedding array<float>").coalesce(1)
    with pytest.raises(Exception):
        V.with_distance(df, [1.0, 0.0]).collect()


def test_doc_types(spark):
    cases = {"db:///data/Person/1": "Person", "http://x/Place/7": "Place", "Thing/9": "Thing", "alone": "unknown", "db:///alone": "unknown", "": "unknown", "a//b": "unknown"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "id string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", S.doc_type(F.col("id"))).collect())


@given(st.text(max_size=40))
def test_tag_round_trip(commit):
    assert S.decode_tag(S.encode_tag(commit)) == commit


def test_foreign_tags():
    assert [S.decode_tag(t) for t in ("x", "c_-z1", "c_-", "v_a", "c_a b")] == [None] * 5
    assert S.encode_tag("a-b/c") == "c_a--b-2fc"


@given(st.text(min_size=1, max_size=20), st.text(min_size=1, max_size=20))
def test_domain_round_trip(org, db):
    assert S.decode_domain(S.encode_domain(org, db)) == (org, db)


def test_paths(spark):
    good = {"a/b": ("local", "branch", "main"), "a/b/r": ("r", "branch", "main"), "a/b/r/branch/x": ("r", "branch", "x"), "/a/b/r/commit/c/": ("r", "commit", "c")}
    bad = ["a", "a/b/c/d", "", "a//b", "a/b/r/tag/x", "a/b/c/d/e/f"]
    for p, want in good.items():
        got = S.parse_path(p)
        assert (got["repo"], got["kind"], got["ref"]) == want
    for p in bad:
        with pytest.raises(S.InvalidPath):
            S.parse_path(p)
    df = spark.createDataFrame([(p,) for p in [*good, *bad]], "p string").select("p", S.parsed_path(F.col("p")).alias("s"))
    for r in df.collect():
        assert (r.s is None) if r.p in bad else (r.s.repo, r.s.kind, r.s.ref) == good[r.p]


def test_prefixes():
    assert S.task_prefix("nomic-embed-v2", "query") == "search_query: " and S.task_prefix("other", "query") == ""
    with pytest.raises(ValueError):
        S.task_prefix("other", "poem")
