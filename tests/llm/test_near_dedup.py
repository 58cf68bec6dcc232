import itertools

import numpy as np
import pandas as pd
import pytest

from tessera.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, kept_doc_id long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA)


def brute(rows, threshold=nd.THRESHOLD):
    def grams(text):
        w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        k = min(3, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    ids = sorted({i for i, t in rows if i is not None and t})
    up = {i: i for i in ids}
    sets = [(i, grams(t)) for i, t in rows if i is not None and t]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and len(x & y) / len(x | y) >= threshold:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {(i, root(i)) for i in ids if root(i) != i}


def corpus(seed=3, bases=12, copies=6, words=120):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, at = [], 0
    for _ in range(bases):
        base = list(rng.choice(vocab, words))
        for c in range(copies):
            text = list(base)
            for p in rng.choice(words, c % 4 * 2, replace=False):
                text[p] = str(rng.choice(vocab))
            rows.append((at, " ".join(text)))
            at += 1
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def test_agrees_with_brute_force(spark):
    rows = corpus()
    got = {tuple(r) for r in nd.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.95 * len(want) and not {i for i, _ in got} - {i for i, _ in want}


def test_large_bucket_and_refused_survivors():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, nd.HASHES).astype(np.uint8)
    sig = np.tile(base, (300, 1))
    for row in sig[1:]:
        at = rng.choice(nd.HASHES, 20, replace=False)
        row[at] = rng.integers(0, 256, 20)
    sig[200:] = rng.integers(0, 256, (100, nd.HASHES))
    need = nd.least_matches()
    edges = nd.spanning(sig, need, np.arange(300))
    assert len(edges) == 199 and all(i < 200 and j < 200 for i, j in edges)
    again = nd.spanning(sig[:200], need, np.arange(200), {(0, 7)})
    assert (0, 7) not in again and len(again) == 199
    apart = {tuple(sorted(e)) for e in nd.spanning(sig[:30], need, np.arange(30), {(0, 7)}, most=16)}
    assert apart == {(i, j) for i in range(30) for j in range(i + 1, 30)} - {(0, 7)}
    known = np.r_[np.zeros(100, int), np.arange(1, 101)]
    some = nd.spanning(sig[:200], need, known, most=16)
    assert sum(min(i, j) < 100 for i, j in some) == 1600 and len(some) == 1600 + 100 * 99 // 2


def test_verification_loop_recovers_pairs_skipped_behind_a_failed_one(spark, monkeypatch):
    monkeypatch.setattr(nd, "DENSE", 2)
    rows = corpus(seed=9, bases=4, copies=8, words=60)
    got = {tuple(r) for r in nd.near_duplicates(frame(spark, rows), 0.8).collect()}
    want = brute(rows, 0.8)
    assert len(got & want) >= 0.9 * len(want)


def test_one_result_whatever_the_way_through_a_bucket(spark, monkeypatch):
    """Small and large buckets, split ones, split hubs and the bit filter: the same groups."""
    rows = corpus(seed=11, bases=6, copies=14, words=80)
    want = {tuple(r) for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert want and want <= brute(rows)
    for settings in ({"DENSE": 2}, {"HOT": 3}, {"HUB": 2}, {"BROADCAST_ROWS": 0}):
        for name, value in settings.items():
            monkeypatch.setattr(nd, name, value)
        assert {tuple(r) for r in nd.near_duplicates(frame(spark, rows)).collect()} == want, settings
        monkeypatch.undo()


def test_document_with_two_texts_is_linked_through_both(spark):
    rng = np.random.default_rng(8)
    one, two = ([f"w{i}" for i in rng.integers(0, 4000, 90)] for _ in range(2))
    rows = [(5, " ".join(one)), (5, " ".join(two)), (9, " ".join([*one[:88], "x", "y"])), (7, " ".join([*two[:88], "x", "y"])), (6, "something else altogether here")]
    assert {tuple(r) for r in nd.near_duplicates(frame(spark, rows)).collect()} == {(9, 5), (7, 5)}


def test_edge_cases(spark):
    long = " ".join(f"t{i % 977}x{i}" for i in range(300_000))
    rows = [(5, "a b"), (3, "A, b!"), (None, "a b"), (7, None), (8, ""), (9, " \n"), (8, ""), (5, "a b"), (11, long), (10, long)]
    got = {tuple(r) for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(5, 3), (11, 10)}
    kept = nd.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept_doc_id", "key"]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8, 9, 10]
    assert nd.near_duplicates(frame(spark, [])).count() == 0


def test_pruning_keeps_pairs_over_the_threshold():
    """Similarities drawn from the prior: of those over the threshold few are lost."""
    rng = np.random.default_rng(1)
    need = nd.least_matches(0.7, 0.01)
    s = rng.uniform(0.7, 1, (20_000, 1))
    hits = rng.random((20_000, nd.HASHES)) < s + (1 - s) / 256
    ok = np.ones(20_000, bool)
    for b, least in enumerate(need):
        ok &= hits[:, : (b + 1) * nd.BATCH].sum(axis=1) >= least
    assert 1 - ok.mean() <= 0.01


@pytest.mark.parametrize("n", [1, 2, 65])
def test_buckets_over_batches(n):
    sig = bytes(nd.HASHES)
    rows = pd.DataFrame({"key": [1] * n + [2] * 3, "doc_id": range(n + 3), "sig": [sig] * (n + 3)})
    parts = [rows.iloc[i : i + 2] for i in range(0, len(rows), 2)]
    out = pd.concat(list(nd._buckets(nd.least_matches(), 0)(iter(parts))))
    assert len(out) == n - 1 + 2
