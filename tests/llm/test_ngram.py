import os
import resource
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ngram
from tessera.llm.eliasfano import EliasFano, encode

SCHEMA = "doc_id long, text string, n_words int, word string"


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 7), (1000, 1000), (1000, 10**6), (5000, 10**12), (100, 2**40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n).astype(np.uint64))
    ef = EliasFano(encode(v, universe))
    q = np.r_[v, rng.integers(0, universe, 500).astype(np.uint64)]
    assert (ef.successor(q) == np.searchsorted(v, q)).all()
    assert (ef.find(q) >= 0).tolist() == np.isin(q, v).tolist()
    if len(v):
        assert (ef.access(np.arange(len(v))) == v).all()


def test_quantised_values():
    x = np.r_[0.0, np.geomspace(1e-9, 1, 200)]
    got = ngram._VALUE[ngram.quantise(x)]
    assert got[0] == 0 and np.abs(got[1:] / x[1:] - 1).max() < 0.05


def toks(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def slow_model(texts):
    """Interpolated Kneser-Ney in dictionaries; p(first, second, third)."""
    count = Counter(w for t in texts for w in toks(t))
    known = {w for w, n in count.items() if n >= ngram.MIN_WORD}
    name = lambda w: w if w in known else "<unk>"
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *map(name, toks(t))]
        tri.update(zip(w, w[1:], w[2:]))
    ctx, before, mids = Counter(), Counter(), Counter()
    for (a, b, c), n in tri.items():
        ctx[a, b] += n
        before[b, c] += 1
        mids[b] += 1
    ends = Counter(c for _, c in before)
    d, size = ngram.DISCOUNT, len(known) + 2
    left3, left2 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for (a, b, c), n in tri.items():
        if n >= ngram.MIN_TRIGRAM:
            left3[a, b] -= (n - d) / ctx[a, b]
    for (b, c), n in before.items():
        left2[b] -= (n - d) / mids[b]

    def p(a, b, c):
        a, b, c = (x if x == "<s>" else name(x) for x in (a, b, c))
        one = d * len(ends) / sum(ends.values()) / size + max(0, ends[c] - d if ends[c] else 0) / sum(ends.values())
        two = (max(0, before[b, c] - d) / mids[b] if mids[b] and before[b, c] else 0) + left2[b] * one
        n = tri[a, b, c]
        return ((n - d) / ctx[a, b] if n >= ngram.MIN_TRIGRAM else 0) + left3[a, b] * two

    return p


def corpus(n=60, seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"word{i}" for i in range(60)]
    chain = rng.dirichlet(np.full(60, 0.05), 60)
    out = []
    for i in range(n):
        at, text = int(rng.integers(60)), []
        for _ in range(int(rng.integers(5, 80))):
            at = int(rng.choice(60, p=chain[at]))
            text.append(vocab[at])
        text.append(f"rare{i}")
        out.append((i, " ".join(text).capitalize() + "."))
    return out


@pytest.mark.parametrize("shard_tokens", [10**6, 300])
def test_agrees_with_dictionaries(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", shard_tokens)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in ngram.score(docs).collect()}
    p = slow_model([t for _, t in rows])
    for i, t in rows:
        w = ["<s>", "<s>", *toks(t)]
        want = [np.log10(p(*w[k : k + 3])) for k in range(len(w) - 2)]
        assert got[i].n_words == len(want)
        assert got[i].log10_prob == pytest.approx(sum(want), abs=0.03 * len(want))
        assert got[i].log10_prob_per_word == pytest.approx(got[i].log10_prob / len(want))
        assert got[i].perplexity == pytest.approx(10 ** (-got[i].log10_prob / len(want)))


def test_shards_split_frequent_middle_words():
    w1 = np.arange(1000)
    w2 = np.full(1000, 7)
    assert len(np.unique(ngram.shard_of(w1, w2, np.full(1000, 10), 64))) == 1
    assert len(np.unique(ngram.shard_of(w1, w2, np.full(1000, 40 * ngram.SPLIT), 64))) > 10


def test_many_shards_with_few_file_descriptors(tmp_path, monkeypatch):
    """A worker has a file of each of thousands of shards open at 6 GB; its descriptors don't grow with them."""
    name = "mid ptr"
    for i in range(200):
        v = np.arange(i + 5, dtype=np.uint64) * np.uint64(3)
        ngram._save(f"{tmp_path}/s{i}", {**ngram._ef("mid", v, 10_000), **ngram._ef("ptr", v, 10_000), "share": np.arange(i % 3, dtype=np.uint8)})
    monkeypatch.setattr(ngram, "MAPS", 150)
    shards = ngram.Shards(str(tmp_path))
    used = len(os.listdir("/proc/self/fd"))
    held = [shards.get(f"s{i}", name) for i in range(200)]
    assert len(os.listdir("/proc/self/fd")) <= used + 5
    assert len(shards.open) == 150 and shards.get("none") is None
    for i, (parts, ef) in enumerate(held):
        assert parts["share"].tolist() == list(range(i % 3)) and parts["share"].dtype == np.uint8
        assert ef["ptr"].find(np.array([0, 3, 4])).tolist() == [0, 1, -1]
        assert ef["mid"].access(np.arange(i + 5)).tolist() == [3 * k for k in range(i + 5)]


def test_scores_with_thousands_of_open_shards(spark, monkeypatch):
    """More shards than a process may have files open score as few shards do."""
    docs = spark.createDataFrame(corpus(40, 3), "doc_id long, text string")
    few = {r.doc_id: r.log10_prob for r in ngram.score(docs).collect()}
    monkeypatch.setattr(ngram, "SHARD_TOKENS", 2)
    model = ngram.train(docs)
    assert model.shards > 500
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    batch = docs.toPandas()
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 100, hard))
    try:
        hashes, counts = ngram.words(batch["text"].tolist())
        logs = np.log10(model.probabilities(hashes, counts))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    got = np.bincount(np.repeat(np.arange(len(counts)), counts), logs)
    assert got == pytest.approx([few[i] for i in batch["doc_id"]])


def test_split_pairs_agree_with_dictionaries(spark, monkeypatch):
    """Pairs that begin with a frequent word, or the mark before a text, lie in several shards."""
    monkeypatch.setattr(ngram, "SHARD_TOKENS", 100)
    monkeypatch.setattr(ngram, "SPLIT", 20)
    rows = corpus(60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram.train(docs)
    split = ngram._load(f"{model.folder}/split")
    assert len(split["key"]) > len(split["word"]) > 10
    assert sum(model.sizes) + 1 in split["word"]  # the mark before a text
    p = slow_model([t for _, t in rows])
    got = {r.doc_id: r.log10_prob for r in ngram.score(docs, model).collect()}
    for i, t in rows:
        w = ["<s>", "<s>", *toks(t)]
        want = [np.log10(p(*w[k : k + 3])) for k in range(len(w) - 2)]
        assert got[i] == pytest.approx(sum(want), abs=0.03 * len(want))


def test_packed_and_plain_order_agree():
    rng = np.random.default_rng(3)
    small = [rng.integers(0, 50, 500) for _ in range(3)]
    large = [c * (1 << 30) for c in small]
    assert ngram._order(*small).tolist() == ngram._order(*large).tolist() == np.lexsort(small[::-1]).tolist()


def test_edge_cases(spark):
    long = " ".join(f"x{i % 50}" for i in range(700_000))
    rows = [(1, None), (2, ""), (3, " .,! "), (None, "one two one two"), (4, "one two"), (4, "one two"), (5, long)]
    docs = spark.createDataFrame([(i, t, 9, "w") for i, t in rows], SCHEMA)
    out = ngram.score(docs)
    assert out.columns == ["doc_id", "n_words", "log10_prob_per_word", "perplexity", "log10_prob"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_words == 0 and by[i].log10_prob is None and by[i].perplexity is None for i in (1, 2, 3))
    assert by[None].n_words == 4 and by[5].n_words == 700_000 and by[5].perplexity < 1.2
    assert ngram.score(docs.where("false")).count() == 0
    assert {r.n_words for r in ngram.score(docs.where("doc_id < 4")).collect()} == {0}


def test_pruning_is_a_choice(spark):
    """A text seen twice keeps its trigrams when those seen once are folded; the text seen once loses."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, 80)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    whole = {r.doc_id: r.log10_prob_per_word for r in ngram.score(docs).collect()}
    cut = {r.doc_id: r.log10_prob_per_word for r in ngram.score(docs, ngram.train(docs, min_word=2, min_trigram=2)).collect()}
    assert whole[0] == whole[30] > max(whole[i] for i in range(1, 30))
    assert all(cut[i] < whole[i] for i in range(1, 30))
