import random

import helpers as h
import numpy as np
from pyspark.sql import functions as F
from vecreduce.llm import toxicity as op

SMALL = op.Settings(bits=16, rounds=60)


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ba", "ke", "ti", "lo", "mu", "ra", "so", "ne"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < .3)
        for _ in range(toxic * rng.randint(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(["zounds", "fiend", "VARLET"]))
        out.append((i, " ".join(words), toxic))
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_reruns(spark):
    rows = corpus(600)
    df = h.docs(spark, [(i, t) for i, t, _ in rows])
    known = labels(spark, [(i, 0, y) for i, _, y in rows])
    learn = F.pmod(F.col("id"), F.lit(4)) != 2
    model = op.fit(df, known, learn_from=learn, settings=SMALL)
    score = {r.id: r.score for r in op.scored(df, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 2]
    assert np.mean([(score[i] >= 0.3) == bool(y) for i, y in held]) >= 0.97
    again = op.fit(df.repartition(7), known.repartition(3), learn_from=learn, settings=SMALL)
    assert {r.id: r.score for r in op.scored(df, again).collect()} == score


def test_held_out_labels_change_nothing(spark):
    rows = corpus(120, seed=2)
    df = h.docs(spark, [(i, t) for i, t, _ in rows])
    learn = F.pmod(F.col("id"), F.lit(4)) != 2
    a, b = (op.fit(df, labels(spark, [(i, 0, y ^ (flip and i % 4 == 2)) for i, _, y in rows]), learn_from=learn,
                   settings=SMALL) for flip in (0, 1))
    assert np.array_equal(a.products, b.products) and a.intercept == b.intercept


def test_fit_takes_at_most_fit_rows(spark):
    rows = corpus(80, seed=3)
    df = h.docs(spark, [(i, t) for i, t, _ in rows])
    known = labels(spark, [(i, 0, y) for i, _, y in rows])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40)
    a = op.fit(df, known, fit_rows=40, settings=SMALL)
    b = op.fit(df, chosen, settings=SMALL)
    assert np.array_equal(a.products, b.products)


def test_fit_takes_one_row_of_an_id(spark, monkeypatch):
    rows = corpus(60, seed=5)
    saved, sizes = op.saved, {}

    def counted(df, name):
        out = saved(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(op, "saved", counted)
    known = labels(spark, [(i, 0, y) for i, _, y in rows])
    once = op.fit(h.docs(spark, [(i, t) for i, t, _ in rows]), known, fit_rows=40, settings=SMALL)
    same = [(i, t) for i, t, _ in rows for _ in range(1 + 50 * (i % 7 == 0))] + [(i, None) for i in range(60)]
    df = h.docs(spark, same)
    many = op.fit(df, known, fit_rows=40, settings=SMALL)
    assert sizes["toxicity-features"] == 40
    assert np.array_equal(once.products, many.products) and once.intercept == many.intercept
    other = h.docs(spark, [(i, f"{t} {k}") for i, t, _ in rows for k in ("fiend", "mild", "soft")])
    a, b = (op.fit(x, known, fit_rows=40, settings=SMALL) for x in (other.repartition(5), other.repartition(2, "text")))
    assert sizes["toxicity-features"] == 40 and np.array_equal(a.products, b.products)


def test_features_are_the_distinct_ngrams_of_pieces_and_whole_texts(monkeypatch):
    of = op.Features(op.Settings())
    text = "The  quick\nbrown fox " * 50
    whole = of(text).tolist()
    monkeypatch.setattr(op, "_PIECE", 7)
    assert of(text).tolist() == whole and of(text.upper()).tolist() == whole
    assert of(None).tolist() == of(" \n").tolist() == [] and len(of("x")) > 0


def test_odd_rows_one_class_and_empty_tables(spark):
    df = h.with_clashing_columns(h.odd(spark))
    none = labels(spark, [])
    odd = labels(spark, [(4, None, None), (None, 1, 1), (6, 0, 3), (999, 1, 1)])
    for known in (none, odd):
        model = op.fit(df, known, settings=SMALL)
        assert {r.score for r in op.scored(df, model).collect()} == {0.5}
    both = labels(spark, [(4, 0, 0), (4, 0, 1), (6, 0, 0), (7, 1, 0), (3, 0, 0)])
    found = op.scored(df, op.fit(df, both, settings=SMALL)).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    assert op.scored(h.docs(spark, []), model).count() == 0


def test_ratios_and_fit_equal_plain_ones():
    """Ratios counted by hand, and weights at which the plainly written loss has its least value."""
    settings = op.Settings(bits=6, least_count=2, least_ratio=0.1, penalty=1e-2, rounds=3000)
    rng = random.Random(7)
    features = [np.array(sorted(rng.sample(range(64), rng.randint(1, 12))), dtype=np.int32) for _ in range(40)]
    features += [np.empty(0, dtype=np.int32)]
    labels = np.array([int(rng.random() < (.8 if 5 in f or 9 in f else .2)) for f in features])
    model = op.fitted(settings, features, labels)

    n = [int((labels == y).sum()) for y in (0, 1)]
    ratios = np.zeros(64)
    for k in range(64):
        have = [sum(1 for f, y in zip(features, labels) if y == want and k in f) for want in (0, 1)]
        ratio = np.log((have[1] + 1) / (n[1] + 2)) - np.log((have[0] + 1) / (n[0] + 2))
        ratios[k] = ratio if sum(have) >= 2 and abs(ratio) >= .1 else 0
    assert np.allclose(model.squares, ratios ** 2, atol=1e-5)
    own = ratios != 0
    weights = np.divide(model.products, ratios, out=np.zeros(64), where=own)

    x = np.zeros((len(features), 64))
    for row, f in zip(x, features):
        row[f] = ratios[f]
        row /= np.linalg.norm(row) or 1
    used = x.any(axis=1)  # texts without features take no part in the fit

    def loss(w, b):
        z = x[used] @ w + b
        return np.mean(np.log1p(np.exp(z)) - labels[used] * z) + .5 * settings.penalty * w @ w

    least = loss(weights, model.intercept)
    for k in [*np.flatnonzero(own), -1]:
        for by in (.05, -.05):
            w, b = weights.copy(), model.intercept
            if k < 0:
                b += by
            else:
                w[k] += by
            assert loss(w, b) > least
    for f, row in zip(features, x):
        assert abs(model.score(f) - 1 / (1 + np.exp(-(row @ weights + model.intercept)))) < 1e-5
