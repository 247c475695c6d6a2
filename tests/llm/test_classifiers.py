"""op4, op5 and op9: held-out accuracy on made-up texts, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import folds, language_id, quality_classifier, toxicity
from fabula.llm.textbatch import TextBatch

SYLLABLES = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["sch", "ung", "heit", "ver"], "cc": ["ción", "ñ", "que", "ados"]}


def texts(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            words[3], words[17] = rng.choice(["scum", "trash"]), rng.choice(["idiot", "moron"])
        bad = rng.random() < 0.25
        text = " ".join(words).upper() + "!!" if bad and rng.random() < 0.5 else " ".join([words[0]] * 60) if bad else " ".join(words)
        yield i, text, lang, int(not bad), int(toxic and text != " ".join([words[0]] * 60))


@pytest.fixture(scope="module")
def tables(spark):
    rows = list(texts(500))
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x, _, _ in rows] + [(1000, None, None, None, None), (1001, "", "aa", None, 0), (1002, " 12 !?", "bb", None, 5), (1003, "ka lo " * 20000, "aa", "s", 1)], "doc_id long, text string, lang string, source string, score long")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, q, x in rows if i % 3] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_folds(spark):
    df = spark.range(50).select("id", folds.fold("id", 5).alias("f"))
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in df.collect())


def test_bounded_labels(spark):
    df = spark.createDataFrame([(i % 20, i % 2) for i in range(60)], "doc_id long, y int")
    got = folds.bounded_labels(df, "y", 5).collect()
    assert len(got) == 5 and len({r["__key"] for r in got}) == 5
    assert all(zlib.crc32(str(r["__key"]).encode()) % 5 for r in got)


def test_language(tables):
    rows, docs, _ = tables
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert language_id.predict(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    # 150 languages, each of two letters and their order
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = [(a, b) for a in letters for b in letters if a < b][:150]
    rows = [(1000 * k + i, " ".join("".join(rng.choice(pair) for _ in range(6)) for _ in range(12)), "-".join(pair)) for k, pair in enumerate(pairs) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 150 and len(model.landmarks) > 2 * 150
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.9


def test_repeated_ids_stay_bounded(spark):
    # one id with very many rows, equal and different, in the training folds
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(str(i).encode()) % 5)
    rows = [(key, "same text of this id", "aa")] * 300 + [(key, f"other text {i} of this id", "aa") for i in range(300)] + [(1000 + i, f"words {i} here", "bb") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("place", F.lit(1)).withColumn("n", F.lit("x")).repartition(4)
    taken = language_id.sample(docs, rows=20)
    assert 0 < taken.where("lang = 'aa'").count() <= 20
    bounded = folds.bounded_rows(docs, 16, "doc_id", "text").where(F.col("doc_id") == key)
    assert 16 <= bounded.count() <= 2 * 16 and bounded.distinct().count() == bounded.count()
    labels = spark.createDataFrame([(key, 1, 1), *((1000 + i, 0, 0) for i in range(40))], "doc_id long, quality int, toxic int")
    for module, carry in ((quality_classifier, {}), (toxicity, {})):
        model = module.fit(docs, labels)
        scores = module.score(docs, model, **carry).collect()
        assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)


def test_language_is_kernel_ridge_regression():
    rng = np.random.default_rng(6)
    bits = rng.random((30, language_id.BUCKETS)) < np.where(np.arange(30)[:, None] % 3 == np.arange(language_id.BUCKETS) % 3, 0.02, 0.01)
    which, names = np.arange(30) % 3, ("a", "b", "c")
    model = language_id.fit_arrays(bits, which, names, np.arange(30))
    # all rows are landmarks, so Nystrom's method is exact: the direct solution with the full kernel
    sets = [set(np.flatnonzero(x)) for x in bits]
    K = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(K)
    half = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
    target = np.where(which[:, None] == np.arange(3), 1.0, -1.0)
    left = np.vstack([np.hstack([half, np.ones((30, 1))]) / np.sqrt(30), np.hstack([np.sqrt(language_id.RIDGE / 30) * np.eye(30), np.zeros((30, 1))])])
    w = np.linalg.lstsq(left, np.vstack([target / np.sqrt(30), np.zeros((30, 3))]), rcond=None)[0]
    want = half @ w[:-1] + w[-1]
    basis = language_id.basis_of(model.landmarks)
    got = language_id.kernel(bits, basis) @ model.weights + model.bias
    assert np.allclose(got, want, atol=1e-3)


def test_blended_spectrum():
    def grams(text):
        chars = [c.lower() if c.isalpha() else " " for c in text]
        ones = {(c,) for c in chars if c != " "}
        twos = {(a, b) for a, b in zip(chars, chars[1:]) if a != " " and b != " "}
        return ones | twos | {t for t in zip(chars, chars[1:], chars[2:]) if any(c != " " for c in t)}

    texts = ["der Hund, die Katze", "el perro y el gato", "le chien 12 et le chat", "der Hund", "a"]
    bits, _ = language_id.presence(TextBatch.of(texts))
    basis = language_id.basis_of(np.packbits(bits, axis=1))
    have = language_id.kernel(bits, basis)
    want = np.array([[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in texts] for a in texts])
    assert np.allclose(have, want, atol=0.02)


def test_language_presence():
    bits, has = language_id.presence(TextBatch.of(["abab", "ab", "1", "", "Éa", "éA"]))
    assert has.tolist() == [True, True, False, False, True, True]
    assert (bits[4] == bits[5]).all() and not bits[2].any()


def test_quality(tables):
    rows, docs, labels = tables
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model, carry=("doc_id",), column="s2").withColumnRenamed("s2", "score").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, _, _, q, _ in held]) > 0.95
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    one = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality_classifier.score(docs, one).collect()} == {1.0}
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_isotonic():
    x, y, w = np.arange(6.0), np.array([0, 2, 1, 1, 5, 4.0]), np.ones(6)
    steps, levels = quality_classifier.isotonic(x, y, w)
    fitted = np.interp(x, steps, levels)
    assert np.allclose(fitted, [0, 4 / 3, 4 / 3, 4 / 3, 4.5, 4.5])


def test_toxicity(tables):
    rows, docs, labels = tables
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(x) for i, *_, x in held]) > 0.95
    assert len(got) == docs.count() and got[1000] == got[1001] < 0.5
    again = toxicity.fit(docs, labels)
    assert np.array_equal(model.places, again.places)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.score(docs, none).collect()) < 0.5


def test_quality_is_ridge_regression(spark):
    """The summed normal equations give what one solve over all rows gives."""
    rows = list(texts(120, 5))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q) for i, _, _, q, _ in rows], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, features=32)
    known = quality_classifier._labelled_statistics(docs, labels, "quality", 1000, "text", "doc_id").collect()
    first = {y: min(r["place"] for r in known if r["label"] == y) for y in (0.0, 1.0)}
    own = [r for r in known if r["place"] % 5 and r["place"] not in first.values()]
    f, y = model.features(np.array([r["stats"] for r in own])), np.array([r["label"] for r in own])
    n = len(own)
    penalty = np.full(33, quality_classifier.RIDGE * n)
    penalty[-1] = 1e-9 * n
    left = np.vstack([f, np.diag(np.sqrt(penalty))])
    want = np.linalg.lstsq(left, np.append(y, np.zeros(33)), rcond=None)[0]
    assert np.allclose(model.weights, want, atol=1e-6)
    # the features' products approximate the Gaussian kernel of width sqrt(d)
    big = quality_classifier.Model(model.mean, model.scale, np.random.default_rng(1).normal(0, np.sqrt(1 / 16), (16, 20000)), np.random.default_rng(2).uniform(0, 2 * np.pi, 20000), None, None, None)
    x = np.array([r["stats"] for r in own[:20]])
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    gauss = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / 16 / 2)
    g = big.features(x)[:, :-1]
    assert np.allclose(g @ g.T, gauss, atol=0.06)


def test_risk_gradient_is_the_risks():
    """One step from zero goes against the risk's gradient, found here by finite differences."""
    rng = np.random.default_rng(2)
    n, width, prior = 40, 6, 0.3
    positive = np.arange(n) < 12
    dense = rng.random((n, width)) < 0.4
    rows, columns = np.nonzero(dense)

    def risk(w):
        f = dense @ w[:-1] + w[-1]
        negative = np.logaddexp(0, f[~positive]).mean() - prior * np.logaddexp(0, f[positive]).mean()
        # the part that steps follow: both while the second is not negative, else back along it alone
        return prior * np.logaddexp(0, -f[positive]).mean() + negative if negative >= 0 else -negative

    start = np.zeros(width + 1)
    start[-1] = np.log(prior / (1 - prior)) / 2
    slope = np.array([(risk(start + d) - risk(start - d)) / 2e-5 for d in np.eye(width + 1) * 1e-5])
    rate = 1e-3
    w, b = toxicity.nnpu(rows, columns, positive, width, prior, steps=1, rate=rate)
    # Adam's first step has the size of the rate in every place and the sign of the slope
    assert np.allclose(w, -rate * np.sign(slope[:-1]), atol=1e-6)


def test_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    positive = np.arange(300) < 100
    truth = np.where(positive, 1, (np.arange(300) % 5 == 0).astype(int))
    rows, columns = [], []
    for i in range(300):
        for c in rng.choice(50, 5, replace=False):
            rows.append(i)
            columns.append(c)
        if truth[i]:
            rows.append(i)
            columns.append(50)
    w, b = toxicity.nnpu(np.array(rows), np.array(columns), positive, 51, 0.2)
    f = np.bincount(rows, w[columns], 300) + b
    assert ((f > 0) == truth).mean() > 0.93
