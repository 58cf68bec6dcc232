import numpy as np
import pytest

from tessera.llm import language as lg

SCHEMA = "doc_id long, text string, lang string, language string, spans int"


def invented(lang, rng, n):
    parts = {"aa": ["the", "ing", "er", "th", "and"], "bb": ["ung", "sch", "lich", "der", "ei"], "cc": ["eau", "oi", "que", "le", "ai"]}[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    return lg.train({x: [invented(x, rng, 60) for _ in range(40)] for x in ("aa", "bb", "cc")})


def slow_viterbi(score, switch):
    state, back = list(score[0]), []
    for row in score[1:]:
        top = max(range(len(state)), key=lambda j: (state[j], -j))
        back.append([j if state[j] >= state[top] - switch else top for j in range(len(state))])
        state = [max(state[j], state[top] - switch) + row[j] for j in range(len(state))]
    now = max(range(len(state)), key=lambda j: (state[j], -j))
    path = [now]
    for b in reversed(back):
        now = b[now]
        path.append(now)
    return path[::-1]


def test_viterbi_and_its_short_cut():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 5, 1, 200, 0, 37, 90, 3])
    score = -rng.integers(0, 8, (int(lengths.sum()), 4)).astype(np.float64) / 2
    score[100:150, 2] += 3
    want, at = [], 0
    for n in lengths:
        want += slow_viterbi(score[at : at + n].tolist(), 5.0) if n else []
        at += n
    value = lambda path: sum(score[i, p] for i, p in enumerate(path))
    for got in (lg.viterbi(score, lengths, 5.0), lg.best_path(score, lengths, 5.0)):
        at = 0
        for n in lengths:
            cost = lambda p: sum(score[at + i, x] for i, x in enumerate(p)) - 5 * (np.diff(p) != 0).sum()  # noqa: B023, E731
            if n:
                assert cost(got[at : at + n]) == pytest.approx(cost(np.array(want[at : at + n])))
            at += n
    assert value(want) > 2 * score.min() * len(score)


def test_held_out_accuracy_and_mixed_spans(model):
    rng = np.random.default_rng(1)
    texts = [(x, invented(x, rng, 30)) for x in ("aa", "bb", "cc") for _ in range(30)]
    got = lg.label(model, [t for _, t in texts])
    assert np.mean([g[0] == x for g, (x, _) in zip(got, texts)]) >= 0.97
    a, b = invented("aa", rng, 25), invented("bb", rng, 25)
    text = f"{a} Καλημέρα κόσμε 你好世界 こんにちは世界 {b} 123"
    (lang, share, _, ok, spans), = lg.label(model, [text])
    assert [s[2] for s in spans] == ["aa", "el", "ja", "bb"] and ok and share < 0.7
    assert text[spans[1][0] : spans[1][1]] == "Καλημέρα κόσμε"
    assert spans[0][1] <= len(a) and spans[-1][1] == len(text)
    assert lg.label(model, ["北京大学"])[0][0] == "zh" and lg.label(model, ["Привет мир"])[0][0] == "ru"


def test_edge_cases(spark, model):
    rng = np.random.default_rng(4)
    long = invented("bb", rng, 150_000)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (None, invented("aa", rng, 30)), (4, long), (5, "İİ" + invented("cc", rng, 20)), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(i, t, "aa", "zz", 1) for i, t in rows], SCHEMA)
    got = lg.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    assert all(by[i].language == "und" and not by[i].accepted and by[i].spans == [] for i in (1, 2, 3))
    assert by[4].language == "bb" and by[4].accepted and by[4].spans[0].end == len(long)
    kept = lg.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {None, 4, 5}
    empty = spark.createDataFrame([], SCHEMA)
    assert lg.identify(empty).count() == 0 and lg.keep_identified(empty).count() == 0
    assert lg.label(lg.train({}), ["abc"])[0][0] == "und"


def test_fit_reads_labels(spark):
    rng = np.random.default_rng(5)
    rows = [(i, invented(x, rng, 40), x, "zz", 1) for i, x in enumerate(["aa", "bb"] * 10)] + [(99, None, "aa", "", 0), (98, "t", None, "", 0)]
    model = lg.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.latin == ["aa", "bb"]


def test_every_script_is_scored_by_the_labels():
    rng = np.random.default_rng(6)
    parts = {"ru": ["ого", "ени", "ть", "ы", "при"], "uk": ["ії", "ськ", "ти", "є", "від"], "bg": ["ът", "ята", "щ", "не", "пред"], "ta": ["தமி", "ழ்", "கள்", "ன்"], "en": ["the", "ing", "er", "and"]}
    draw = lambda x, n: " ".join("".join(rng.choice(parts[x], rng.integers(1, 4))) for _ in range(n))
    model = lg.train({x: [draw(x, 60) for _ in range(40)] for x in parts})
    for lang in parts:
        got = lg.label(model, [draw(lang, 40) for _ in range(20)])
        assert np.mean([g[0] == lang and g[3] for g in got]) >= 0.95, lang
    mixed = lg.label(model, [f"{draw('uk', 25)} {draw('en', 25)} {draw('bg', 25)}"])[0]
    assert [x for _, _, x in mixed[4]] == ["uk", "en", "bg"]
    noise = " ".join("".join(chr(int(c)) for c in rng.integers(0x430, 0x450, 7)) for _ in range(60))
    assert not lg.label(model, [noise])[0][3]
    for text in ("বাংলা ভাষা", "ქართული ენა", "Հայերեն լեզու", "\u02bc\u02bb\u02bc"):
        assert lg.label(model, [text])[0][0] == "und" and not lg.label(model, [text])[0][3]


def test_rare_and_long_languages_are_in_the_model(spark):
    rng = np.random.default_rng(7)
    rows = [(i, invented("aa", rng, 4), "aa", "", 0) for i in range(4_500)]
    rows += [(5_000, invented("bb", rng, 5_000), "bb", "", 0), (5_001, invented("cc", rng, 30), "cc", "", 0)]
    assert len(rows[-2][1]) > 20_000
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lg.fit(docs)
    assert model.latin == ["aa", "bb", "cc"]
    got = lg.label(model, [invented(x, rng, 30) for x in ("bb", "cc") for _ in range(10)])
    assert [g[0] for g in got] == ["bb"] * 10 + ["cc"] * 10


def test_short_cut_sees_two_runs_that_avoid_the_main_language():
    score = np.array([[0, -4, -1.5]] * 4 + [[-4, 0, -1.5]] * 4)
    assert lg.best_path(score, np.array([8]), 7.0).tolist() == [0] * 4 + [1] * 4
