from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string, n_chars long, copies string, p double, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, "t", s, n, "c", 0.5, 3) for i, s, n in rows], SCHEMA)


def test_pivot_keeps_totals_and_expectations():
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 1, 30)
    mean = np.zeros(30)
    for _ in range(4000):
        out, held = mx.pivot(p, rng.random(30))
        assert abs(out.sum() - p.sum()) < 1e-6
        assert all(v in (0.0, 1.0) for i, v in enumerate(out) if i != held)
        mean += out
    assert np.abs(mean / 4000 - p).max() < 0.04


def slow_copies(rows, aims, seed, buckets, hashes):
    """The same tree in plain Python: (doc_id, source) -> copies."""
    base = {u: int(np.floor(aims[u[1]])) for u in rows}
    level, now, out = 0, [(u, hashes[u] % buckets, aims[u[1]] - base[u]) for u in rows], {}
    while True:
        groups = defaultdict(list)
        for u, b, p in now:
            groups[u[1], b].append((u, p))
        left = []
        for (_, b), own in groups.items():
            own.sort(key=lambda x: (hashes[x[0]], x[0][0]))
            h = np.array([hashes[u] for u, _ in own], np.int64)
            draw = mx.uniforms(h, level, seed)
            value = [p for _, p in own]
            held = None
            for i in range(len(own)):
                if not 1e-12 < value[i] < 1 - 1e-12:
                    value[i] = round(value[i])
                    continue
                if held is None:
                    held = i
                    continue
                a, q = value[held], value[i]
                if a + q < 1:
                    win, lose = (held, i) if draw[i] < a / (a + q) else (i, held)
                    value[win], value[lose], held = a + q, 0, win
                else:
                    full, rest = (held, i) if draw[i] < (1 - q) / (2 - a - q) else (i, held)
                    value[full], value[rest], held = 1, a + q - 1, rest
                if not 1e-12 < value[held] < 1 - 1e-12:
                    value[held] = round(value[held])
                    held = None
            for i, (u, _) in enumerate(own):
                if i != held:
                    out[u] = base[u] + int(value[i])
                elif buckets > 1:
                    left.append((u, b // mx.FAN_IN, value[i]))
                else:
                    out[u] = base[u] + int(mx.uniforms(h[i : i + 1], level + 1000, seed)[0] < value[i])
        if buckets == 1:
            return out
        now, level, buckets = left, level + 1, -(-buckets // mx.FAN_IN)


@pytest.mark.parametrize("bucket_units", [1000, 7, 1])
def test_agrees_with_plain_python(spark, bucket_units):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 3}" if i % 7 else "s0", int(rng.integers(10, 500))) for i in range(90)]
    docs = frame(spark, rows)
    weights = {"s0": 0.2, "s1": 0.5, "s2": 0.3, "gone": 4.0}
    got = {(r.doc_id, r.source): r.copies for r in mx.copies(docs, weights, 5, bucket_units).collect()}
    aims = {r.source: r.expected for r in mx.expected(docs, weights).collect()}
    keys = docs.selectExpr("doc_id", "source", "xxhash64(5, doc_id, source) h").collect()
    hashes = {(r.doc_id, r.source): r.h for r in keys}
    want = slow_copies([(i, s) for i, s, _ in rows], aims, 5, -(-len(rows) // bucket_units), hashes)
    assert got == want
    chars, total = defaultdict(float), sum(n for _, _, n in rows)
    for i, s, n in rows:
        chars[s] += n
    for s in ("s0", "s1", "s2"):
        own = [u for u in got if u[1] == s]
        assert abs(sum(got[u] for u in own) - len(own) * aims[s]) < 1
        assert aims[s] == pytest.approx(weights[s] * total / chars[s])


def test_edge_cases(spark):
    rows = [(1, "a", 100), (1, "a", 100), (2, "a", None), (None, "a", 50), (3, None, 80), (4, None, -5), (5, "zero", 0), (None, None, 10)]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.source): (r.expected, r.copies) for r in mx.copies(docs).collect()}
    assert set(got) == {(1, "a"), (2, "a"), (None, "a"), (3, None), (4, None), (5, "zero"), (None, None)}
    assert got[5, "zero"] == (0.0, 0)
    out = mx.mix(docs)
    assert out.columns == [*docs.columns, "mix_copies"]
    for r in out.collect():
        assert r.mix_copies == got[r.doc_id, r.source][1] > 0
    assert mx.copies(frame(spark, [])).count() == 0 and mx.mix(frame(spark, [])).count() == 0
    assert {r.copies for r in mx.copies(docs, {}).collect()} == {0}
    assert {r.copies for r in mx.copies(docs, {"a": 1.0, None: 0.0}).where("source is null").collect()} == {0}
