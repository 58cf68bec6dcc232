import numpy as np

from tessera.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string, n_tokens int"
BENCH = "item_id long, text string, doc_id string"


def tables(spark, docs, bench):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, "y") for i, t in bench], BENCH),
    )


def toks(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def brute(docs, bench):
    """Pairs with a seed in common on some diagonal whose best run is long enough."""
    out = {}
    for d, t in docs:
        for i, u in bench:
            if d is None or i is None or not t or not u:
                continue
            a, b = toks(t), toks(u)
            masks = [m for m in dc.MASKS] + (["1" * len(b)] if 0 < len(b) < max(map(len, dc.MASKS)) else [])
            need = min(dc.MIN_TOKENS, max(1, -(-len(b) * 8 // 10)))
            for p in range(len(a)):
                for q in range(len(b)):
                    hit = any(
                        p + len(m) <= len(a) and q + len(m) <= len(b) and all(x == "0" or a[p + k] == b[q + k] for k, x in enumerate(m)) for m in masks
                    )
                    if not hit:
                        continue
                    best = lambda step: max(
                        ((sum(1 if a[p + s * step] == b[q + s * step] else -dc.PENALTY for s in range(n + 1)), -n) for n in range(200) if 0 <= p + n * step < len(a) and 0 <= q + n * step < len(b)),
                    )
                    back, ahead = -best(-1)[1], -best(1)[1]
                    same = sum(a[p + s] == b[q + s] for s in range(-back, ahead + 1))
                    if same >= need:
                        out[d, i] = max(out.get((d, i), 0), same)
    return out


def corpus():
    rng = np.random.default_rng(11)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda n: list(rng.choice(vocab, n))
    bench = [(i, text(int(rng.integers(14, 40)))) for i in range(12)]
    docs = []
    for d in range(40):
        body = text(60)
        if d % 2:
            item = list(bench[d % 12][1])
            for p in rng.choice(len(item), d % 6, replace=False):
                item[p] = "changed"
            body[20:20] = item
        docs.append((d, " ".join(body)))
    return docs, [(i, " ".join(t)) for i, t in bench]


def test_agrees_with_brute_force(spark):
    docs, bench = corpus()
    want = brute(docs, bench)
    for tokens in (10**6, 150):  # one block, several blocks
        rows = dc.contaminated(*tables(spark, docs, bench), block_tokens=tokens).collect()
        assert {(r.doc_id, r.item_id): r.n_matched for r in rows} == want
    assert len(want) > 12


def test_edge_cases(spark):
    passage = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    long = "zz yy " * 200_000 + passage.upper() + " ww" * 1000
    docs = [(1, None), (2, ""), (None, passage), (3, long), (4, passage), (4, passage), (5, "Hello, big world"), (6, "big world hello"), (7, "one two")]
    bench = [(1, passage), (1, passage), (2, None), (None, passage), (3, ""), (4, "hello big WORLD!"), (5, "?!")]
    got = {(r.doc_id, r.item_id, r.doc_start, r.n_matched) for r in dc.contaminated(*tables(spark, docs, bench)).collect()}
    assert got == {(3, 1, 400_000, 15), (4, 1, 0, 15), (5, 4, 0, 3)}
    kept = dc.drop_contaminated(*tables(spark, docs, bench))
    assert kept.columns == ["doc_id", "text", "item_id", "n_tokens"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 6, 7]
    for d, b in (([], bench), (docs, [])):
        assert dc.contaminated(*tables(spark, d, b)).count() == 0
