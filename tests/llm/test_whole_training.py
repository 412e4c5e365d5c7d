"""Operators 6 and 8 learn from every training document: models, thresholds and scales."""

import numpy as np

from covercost.llm import labelled, language_id, quality_ranking


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    groups = {0: np.round(rng.normal(size=300), 1), 1: rng.normal(size=50) * 1e-7, 2: np.array([4.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g int, v double")
    wanted = [(g, k) for g, x in groups.items() for k in {0, len(x) // 3, len(x) - 1}]
    assert labelled.order_statistics(rows, wanted) == [float(np.sort(groups[g])[k]) for g, k in wanted]


def test_loss_of_all_pairs(spark):
    """The binned loss and gradient are near those of every good and poor document, however many pairs there are."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400)
    x[y == 1] += 0.5
    train = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)
    centre, spread, weights = x.mean(axis=0), x.std(axis=0), rng.normal(size=6) * 0.3
    loss, gradient = quality_ranking.pair_loss(*quality_ranking.scored_pass(train, centre, spread, weights), weights)
    z = quality_ranking.expand(x, centre, spread)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, 6)
    s = d @ weights
    ridge = quality_ranking.RIDGE
    assert abs(loss - np.logaddexp(0, -s).mean() - ridge / 2 * weights @ weights) < 1e-3
    assert np.allclose(gradient, -(d / (1 + np.exp(s))[:, None]).mean(axis=0) + ridge * weights, atol=2e-3)
    best = quality_ranking.fit(train, centre, spread, 6)
    _, slope = quality_ranking.pair_loss(*quality_ranking.scored_pass(train, centre, spread, best), best)
    assert np.abs(slope).max() < 10 * quality_ranking.FLAT


def test_scale_and_limits_of_all_training_texts(spark):
    langs = ["aa", "bb"]
    rng = np.random.default_rng(7)
    n = 5000  # more than the former bound
    h = rng.uniform(1, 3, (n, 2))
    lang = rng.integers(0, 2, n)
    rows = [(i, langs[c], 10, True, float(-10 * a), float(-10 * b)) for i, (c, (a, b)) in enumerate(zip(lang, h, strict=True))]
    scored = spark.createDataFrame(rows + [(n, None, 10, True, -990.0, -990.0)], "doc_id long, lang string, size long, letter boolean, l0 double, l1 double")
    curve = language_id.fitted(scored, langs)
    want = [np.quantile(h[lang == k, k], 1 - language_id.REJECTED_SHARE) * 1.1 for k in (0, 1)]
    assert np.allclose(curve.limits, want)
    low = h.min(axis=1)
    loss = [np.mean(np.log(np.exp(-s * (h - low[:, None])).sum(axis=1)) + s * (h[np.arange(n), lang] - low)) for s in language_id.SCALES]
    assert curve.scale == language_id.SCALES[int(np.argmin(loss))]
