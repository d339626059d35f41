import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import calibrate, quality, shared, text, toxicity

BAD = {"en": "vile", "de": "übel"}


def labelled(n=400, seed=1):
    """Documents of which every fourth holds its language's bad word, and their labels."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        w = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(rng.randrange(5, 40))]
        if bad := i % 4 == 0:
            w[rng.randrange(len(w))] = BAD[lang]
        rows.append((i, " ".join(w), lang, int(bad)))
    return rows


def buckets(op, body):
    for _, _, buf, offs in text.groups(pa.array([body], pa.string())):
        return (op.word_features if op is toxicity else op.token_features)(buf, offs)


def test_sample_is_taken_from_the_given_documents(spark):
    """Labels of documents that an earlier stage rejected take no place in the sample; repeated ids none beyond one."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "words") for i in range(0, 400, 5)] * 3 + [(5, "a"), (None, "x")], "doc_id long, text string")
    sample, total = shared.labelled_sample(docs, labels, "toxic", 12)
    rows = sample.collect()
    assert [sum(r.y == v for r in rows) for v in (0, 1)] == [12, 12] and len({r.doc_id for r in rows}) == 24
    held = {r.doc_id for r in docs.select("doc_id").distinct().where(shared.held_out(F.col("doc_id"))).collect()}
    assert not held & {r.doc_id for r in rows} and sum(total.values()) == 80 - len(held)
    few, _ = shared.labelled_sample(docs, labels, "toxic", 12, chars=20)
    assert [sum(r.y == v for r in few.collect()) for v in (0, 1)] == [4, 4]


@pytest.mark.parametrize(("op", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_change_no_score(spark, op, label):
    rows = labelled()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], f"doc_id long, {label} int")
    turned = labels.withColumn(label, F.when(shared.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    doubled = labels.unionByName(labels.where(shared.held_out(F.col("doc_id"))))
    first, *others = (sorted(map(repr, op.score(docs, op.fit(docs, known)).collect())) for known in (labels, turned, doubled))
    assert all(first == other for other in others)


def test_forward_pass_against_loops():
    rows = labelled(80)
    docs = [buckets(toxicity, r[1])[0] for r in rows]
    model = toxicity.train(docs, np.array([r[3] for r in rows]), [r[2] for r in rows], epochs=3)
    for body in [rows[0][1], rows[1][1], "", "one", "one two", "vile vile vile"]:
        words, _ = buckets(toxicity, body) if body else (np.zeros((0, 4), np.int32), None)
        e = [sum(model.table[model.index[b]] for b in w) for w in words]
        pooled, at = [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                cols = [at + j * toxicity.FILTERS + f for j in range(width)]
                values = [sum(float(e[i + j] @ model.filters[:, c]) for j, c in enumerate(cols) if i + j < len(e)) for i in range(len(e))]
                pooled.append(max(values, default=0.0))
            at += width * toxicity.FILTERS
        want = float(np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias)
        got = model.raw(words, np.array([0, len(words)]))[0]
        assert abs(got - want) < 1e-4
    together = [buckets(toxicity, r[1])[0] for r in rows[:20]]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in together])])
    alone = [model.raw(d, np.array([0, len(d)]))[0] for d in together]
    assert np.allclose(model.raw(np.concatenate(together), ends), alone, atol=1e-4)


def test_training_moves_a_random_start_to_the_labels():
    rows = labelled(300)
    docs, y = [buckets(toxicity, r[1])[0] for r in rows], np.array([r[3] for r in rows])
    test = [buckets(toxicity, r[1])[0] for r in labelled(100, 9)]
    truth = np.array([r[3] for r in labelled(100, 9)])

    def share_right(epochs):
        model = toxicity.train(docs, y, [r[2] for r in rows], epochs=epochs)
        s = model.scores(np.array([model.raw(d, np.array([0, len(d)]))[0] for d in test]))
        return np.mean((s >= toxicity.CUT_AT) == truth)

    assert share_right(8) >= 0.95 > share_right(0)


def test_thresholds_follow_the_language():
    """A language whose toxic texts get lower outputs has a lower threshold, drawn to the common one."""
    rows = labelled(600)
    docs, y = [buckets(toxicity, r[1])[0] for r in rows], np.array([r[3] for r in rows])
    model = toxicity.train(docs, y, [r[2] for r in rows])
    assert set(model.thresholds) == {None, "en", "de"} and all(0 < t < 1 for t in model.thresholds.values())
    assert toxicity.train(docs, y, [None] * len(rows)).thresholds == {None: toxicity.CUT_AT}


def test_ftrl_against_one_weight_at_a_time():
    rng = np.random.default_rng(4)
    docs = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6)) for _ in range(40)]
    y = np.array([int(at[0] < 8) for at, _ in docs])
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.5
    model = quality.train(docs, y, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=3)
    # The same draws as training makes: which rows are kept for calibration, then the order of each pass.
    draw = np.random.default_rng(3)
    kept = draw.random(len(docs)) < 0.2
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (np.sign(z[i]) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for d in draw.permutation(np.flatnonzero(~kept)):
            x = {**{int(i): v * quality.GAIN for i, v in zip(*docs[d], strict=True)}, quality.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y[d]) * v
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * w[i]
                n[i] = before + g * g
    assert all(abs(model.weights[i] - weight(i)) < 1e-5 for i in range(50)) and abs(model.bias - weight(quality.BUCKETS)) < 1e-6
    assert (model.weights[50:] == 0).all()


def test_quality_score_is_a_dot_product_of_shares():
    rows = labelled(120)
    made = [np.unique(buckets(quality, r[1])[0], return_counts=True) for r in rows]
    docs = [(at, n / len(buckets(quality, r[1])[0])) for (at, n), r in zip(made, rows, strict=True)]
    model = quality.train(docs, np.array([r[3] for r in rows]))
    for (at, x), r in zip(docs[:20], rows, strict=False):
        features, offs = buckets(quality, r[1])
        want = model.bias + quality.GAIN * sum(float(model.weights[i]) * v for i, v in zip(at, x, strict=True))
        assert abs(model.raw(features, offs)[0] - want) < 1e-5


def test_best_cut():
    one = np.ones(6)
    z, y = np.array([0.0, 1, 2, 5, 6, 7]), np.array([0, 0, 0, 1, 1, 1])
    assert calibrate.best_cut(z, y, one) == 3.5
    assert calibrate.best_cut(z, 0 * y, one) is None and calibrate.best_cut(z, 0 * y + 1, one) is None
    assert calibrate.best_cut(z[:0], y[:0], one[:0]) is None
    rng = np.random.default_rng(2)
    z, y, w = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60), rng.random(60) + 0.5
    f1 = lambda c: 2 * w[(z >= c) & (y > 0)].sum() / (w[z >= c].sum() + w[y > 0].sum())
    assert abs(f1(calibrate.best_cut(z, y, w)) - max(f1(c) for c in np.unique(z))) < 1e-9


def test_scores_keep_the_order_and_meet_the_cut():
    z = np.array([-50.0, -1, 0, 1, 50])
    s = calibrate.squash(z, 2.0, 0.0, 0.3)
    assert (np.diff(s) > 0).all() and abs(s[2] - 0.3) < 1e-12 and s.min() >= 0 and s.max() <= 1
    y = np.array([0, 0, 1, 1])
    assert 0.2 <= calibrate.scale(np.array([-2.0, -1, 1, 2]), y, np.ones(4)) <= 20
    assert calibrate.scale(np.zeros(0), y[:0], np.zeros(0)) >= 0.2
