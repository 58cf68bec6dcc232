import numpy as np
import pytest

from tessera.llm import ordinal, quality, toxicity

DOCS = "doc_id long, text string, quality string, expected_grade int, toxic string"
LABELS = "doc_id long, quality int, toxic int, text string"
GOOD, BAD, RUDE = ([f"{p}{i}" for i in range(300)] for p in ("fine", "junk", "rude"))


def corpus(n=240, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        grade = i % 3
        size = int(rng.integers(20, 120))
        words = rng.choice(GOOD if grade else BAD, size).tolist()
        if grade == 1:
            for p in rng.choice(size, max(2, size // 20), replace=False):
                words[p] = str(rng.choice(RUDE[:8]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(i, t, "q", 1, "t") for i, t in docs], DOCS),
        spark.createDataFrame([(i, q, x, "t") for i, q, x in labels], LABELS),
    )


def test_words_places_and_pieces(monkeypatch):
    text = "Alpha beta, GAMMA\nalpha " * 50
    whole = ordinal.features(text, (4,))
    assert np.array_equal(ordinal.features(text.replace("GAMMA", "gamma"), (4,))[0][8:], whole[0][8:])
    from tessera.llm import common

    monkeypatch.setattr(common, "PIECE", 100)
    cut = ordinal.features(text, (4,))
    assert np.array_equal(cut[0][8:], whole[0][8:]) and cut[1][8:] == pytest.approx(whole[1][8:])
    assert len(ordinal.features("")[0]) == len(ordinal.features(None)[0]) == 8


def plain_loss(w, theta, rows, grades, weight, l2):
    """The likelihood by its definition, a row at a time, in long fractions."""
    from decimal import Decimal as D
    from decimal import localcontext

    with localcontext() as c:
        c.prec = 120
        above = lambda z, t: 1 / (1 + (D(t) - z).exp())
        total = D(0)
        for (at, value), g, k in zip(rows, grades, weight / weight.sum()):
            z = sum((D(float(w[i])) * D(float(v)) for i, v in zip(at, value)), D(0))
            hi = above(z, float(theta[g - 1])) if g else D(1)
            lo = above(z, float(theta[g])) if g < len(theta) else D(0)
            total -= D(float(k)) * (hi - lo).ln()
        return float(total) + l2 / 2 * float(w @ w)


def test_likelihood_and_slopes_also_far_from_the_thresholds():
    rng = np.random.default_rng(3)
    width = 6
    rows = [(np.sort(rng.choice(width, 3, replace=False)), rng.random(3) * 4) for _ in range(40)]
    grades, weight = rng.integers(0, 4, 40), rng.random(40) + 0.1
    for scale in (1, 30):  # at 30 rows lie over 100 logits from their thresholds
        p = np.r_[rng.normal(size=width) * scale, -1.0 * scale, np.log([1.0 * scale, 2.0 * scale])]
        theta = ordinal.thresholds(p, width)
        f = lambda p: ordinal.objective(p, ordinal.Sample(rows, grades, weight), width, 1e-3)  # noqa: B023, E731
        loss, slopes = f(p)
        assert loss == pytest.approx(plain_loss(p[:width], theta, rows, grades, weight, 1e-3), rel=1e-9)
        for i in range(len(p)):
            step = np.zeros_like(p)
            step[i] = 1e-5
            assert slopes[i] == pytest.approx((f(p + step)[0] - f(p - step)[0]) / 2e-5, rel=1e-4, abs=1e-6)
        far = np.abs(np.array([(p[:width][a] * v).sum() for a, v in rows])[:, None] - theta).min(axis=1)
    assert far.max() > 30 and (np.abs(slopes[:width]) > 1e-3).any()


def test_fit_ends_at_the_least_loss():
    rng = np.random.default_rng(5)
    rows, grades = [], []
    for _ in range(300):
        g = int(rng.integers(0, 3))
        words = rng.choice(["low", "mid", "high", "top", "end"], 12, p=np.roll([0.4, 0.3, 0.1, 0.1, 0.1], g))
        rows.append(ordinal.features(" ".join(words)))
        grades.append(g)
    model = ordinal.Ordinal().fit(rows, np.array(grades))
    assert model.steps < 300
    sample = ordinal.Sample(rows, np.array(grades), np.ones(300))
    p = np.r_[model.w.astype(float), model.theta[0], np.log(np.diff(model.theta))]
    loss, slopes = ordinal.objective(p, sample, ordinal.WIDTH, model.l2)
    used = np.r_[np.flatnonzero(model.w), [ordinal.WIDTH, ordinal.WIDTH + 1]]
    assert np.abs(slopes[used]).max() < 1e-4
    for _ in range(20):
        moved = p.copy()
        moved[used] += rng.normal(size=len(used)) * 0.05
        assert ordinal.objective(moved, sample, ordinal.WIDTH, model.l2)[0] > loss


def test_severity_of_a_row_is_graded_by_other_folds():
    """A word that only one toxic row has says nothing about that row."""
    rows = [ordinal.features(f"plain words here unique{i}", toxicity.PREFIXES) for i in range(40)]
    rows += [ordinal.features(" ".join(["idiot"] * (i % 3 + 1) + ["plain", "words"] * 8)) for i in range(60)]
    toxic = np.array([0] * 40 + [1] * 60)
    grades = toxicity.severity(rows, toxic)
    assert (grades[:40] == 0).all() and set(grades[40:]) <= {1, 2, 3}
    assert np.mean([g for i, g in enumerate(grades[40:]) if i % 3 == 2]) > np.mean([g for i, g in enumerate(grades[40:]) if i % 3 == 0])
    lone = [*rows, ordinal.features("wholly foreign terms only", toxicity.PREFIXES)]
    assert toxicity.severity(lone, np.r_[toxic, 1])[-1] == 1


def test_graded_ratings_on_held_out_rows():
    """Five grades from one latent score: thresholds are ordered, grades are recovered."""
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(1500):
        strong = rng.integers(0, 25)
        words = [*rng.choice(GOOD, 40 - strong), *rng.choice(BAD[:10], strong)]
        rows.append(ordinal.features(" ".join(words)))
        grades.append(int(min(4, strong // 5)))
    grades = np.array(grades)
    model = ordinal.Ordinal().fit(rows[:1000], grades[:1000])
    assert len(model.theta) == 4 and (np.diff(model.theta) > 0).all()
    z = np.array([(model.w[a] * v).sum() for a, v in rows[1000:]])
    tails = ordinal._sigmoid(z[:, None] - model.theta)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.abs(tails.sum(axis=1) - grades[1000:]).mean() < 0.5


def test_quality_held_out(spark):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels[:150])
    rows = {r.doc_id: r for r in quality.classify(d, l).collect()}
    assert len(rows) == 240
    held = range(150, 240)
    assert np.mean([rows[i].selected == (i % 3 > 0) for i in held]) > 0.95
    assert np.mean([rows[i].expected_grade for i in held if i % 3 == 2]) > np.mean([rows[i].expected_grade for i in held if i % 3 == 1])


def test_toxicity_held_out(spark):
    docs, labels = corpus(seed=4)
    d, l = frames(spark, docs, labels[:150])
    rows = {r.doc_id: r for r in toxicity.detect(d, l).collect()}
    held = range(150, 240)
    assert np.mean([rows[i].toxic == (i % 3 == 1) for i in held]) > 0.95
    assert all(0 <= r.expected_severity <= toxicity.GRADES for r in rows.values())


def test_edge_cases(spark):
    docs, labels = corpus(60)
    long = " ".join(GOOD * 800)
    docs += [(900, None), (901, ""), (902, "  \n"), (None, docs[2][1]), (903, long), (2, docs[2][1])]
    labels += [(None, 1, 1), (901, None, None), (5000, 1, 0), (2, 0, 0)]
    d, l = frames(spark, docs, labels)
    got = quality.classify(d, l).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert all(by[i].expected_grade == 0 and not by[i].selected for i in (900, 901, 902))
    assert by[903].selected and len({r.expected_grade for r in got if r.doc_id in (None, 2)}) == 1
    tox = {r.doc_id: r for r in toxicity.detect(d, l).collect()}
    assert all(tox[i].expected_severity == 0 for i in (900, 901, 902)) and not any(tox[i].toxic for i in (900, 901, 902, 903))
    none = l.where("false")
    assert all(r.selected == (r.doc_id not in (900, 901, 902)) for r in quality.classify(d, none).collect())
    assert not any(r.toxic for r in toxicity.detect(d, none).collect())
    assert quality.classify(d.where("false"), l).count() == 0 and toxicity.detect(d.where("false"), l).count() == 0
