import random
import zlib

import numpy as np
import pytest

from callsift.llm import ftrl_langid, pu_quality
from callsift.llm.queries import op1, op8
from callsift.llm.work import id_remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ba ka da ga la ma".split(), "bb": "ri ti ni pi si wi".split(), "cc": "zu xu qu vu yu hu".split()}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def corpus(n=240):
    rng = random.Random(2)
    rows = [(i, text_of(rng, lang, rng.randrange(3, 60)), lang, None, 0)
            for i, lang in enumerate(rng.choices(list(SYLLABLES), [6, 3, 1], k=n))]
    return rows + [(n + 1, None, "aa", None, 0), (n + 2, "", "aa", None, 0), (n + 3, "12 34 !?", "bb", None, 0),
                   (n + 4, text_of(rng, "cc", 20), None, None, 0), (None, text_of(rng, "bb", 9), "bb", None, 0),
                   rows[0], (n + 5, text_of(rng, "aa", 60_000), "aa", None, 0)]


def test_languages_are_learned_and_odd_texts_are_und(frame):
    rows = corpus()
    df = frame(rows, DOCS).withColumnRenamed("source", "score")
    model = ftrl_langid.fit(df.select("text", "lang"))
    got = ftrl_langid.predict(df, model).collect()
    assert len(got) == len(rows) and "score_input" in got[0].asDict()
    truth = {r[0]: r[2] or "cc" for r in rows}
    for r in got:
        if ftrl_langid.has_letter(r.text):
            assert r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert (model.weights == 0).mean() > 0.5  # the elastic net leaves few weights


def test_ngram_counts_and_document_frequencies(frame):
    at, n = ftrl_langid.char_ngrams("Ab  ab")
    assert n.sum() == sum(len(" ab ab ") - k + 1 for k in ftrl_langid.ORDERS)
    texts = ["ab ab", "ab c", None, "77", "xyz"]
    model = ftrl_langid.fit(frame([(t, "aa") for t in texts], "text string, lang string"))
    df = np.zeros(1 << ftrl_langid.BITS)
    for t in ("ab ab", "ab c", "xyz"):
        df[ftrl_langid.char_ngrams(t)[0]] += 1
    assert np.allclose(model.idf, np.log(4 / (1 + df)) + 1)
    assert model.predict("anything") == ("aa", 1.0)


def test_nothing_to_learn(frame):
    model = ftrl_langid.fit(frame([], "text string, lang string"))
    assert model.predict("abc") == ("und", 0.0)
    assert ftrl_langid.predict(frame([], DOCS), model).collect() == []


def test_temperature_lowers_the_log_loss():
    rng = np.random.default_rng(0)
    k = rng.integers(0, 3, 400)
    z = 8 * (np.eye(3)[np.where(rng.random(400) < 0.8, k, rng.integers(0, 3, 400))])

    def loss(t):
        p = np.exp(z / t) / np.exp(z / t).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(400), k]).mean()

    t = ftrl_langid.calibrate(z, k)
    assert t > 1 and loss(t) < loss(1.0) and loss(t) <= min(loss(t * 0.9), loss(t * 1.1)) + 1e-6


def test_held_out_language_accuracy(spark):
    got = op1(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_held_out_quality(spark):
    got = op8(spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def quality_rows(n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = text_of(rng, rng.choice(["aa", "bb"]), rng.randrange(20, 60)).split()
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), None, None, 0))
    return rows


def test_positive_and_unlabelled_rows_teach_quality(frame):
    rows = quality_rows() + [(1000, None, None, None, 0), (1001, "", None, None, 0), (None, "x", None, None, 0)]
    rows += [rows[1]] * 300  # a hot id teaches once
    docs = frame(rows, DOCS)
    labels = frame([(i, int(i % 4 != 0)) for i in range(0, 400, 3)] + [(0, 1), (4, None), (None, 1)], "doc_id long, quality int")
    net, prior = pu_quality.fit(docs, labels)
    assert prior == pytest.approx((sum(i % 4 != 0 for i in range(0, 400, 3)) + 1) / (len(range(0, 400, 3)) + 2))
    got = pu_quality.score(docs, (net, prior)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert np.mean(right) > 0.95


def test_quality_without_labels_or_documents(frame):
    docs = frame(quality_rows(8), DOCS)
    none = frame([], "doc_id long, quality int")
    assert {r.score for r in pu_quality.score(docs, pu_quality.fit(docs, none)).collect()} == {0.5}
    bad = frame([(0, 0), (1, 0)], "doc_id long, quality int")
    assert {r.score for r in pu_quality.score(docs, pu_quality.fit(docs, bad)).collect()} == {0.25}
    assert pu_quality.score(frame([], DOCS), (None, 0.5)).collect() == []


def test_risk_gradient():
    rng = np.random.default_rng(1)
    net = pu_quality.Network(np.zeros(4), np.ones(4))
    x, by = rng.normal(size=(6, 4)), rng.normal(size=6)
    total = lambda: float(by @ (net.hidden(x)[1] @ net.p[2] + net.p[3][0]))
    for p, g in zip(net.p, net.gradient(x, by), strict=True):
        at = tuple(0 for _ in p.shape)
        p[at] += 1e-6
        high = total()
        p[at] -= 2e-6
        assert (high - total()) / 2e-6 == pytest.approx(g[at], abs=1e-5)
        p[at] += 1e-6


def plain_ftrl(rows, classes, seed=1):
    """FTRL-proximal over dictionaries, one coordinate after the other."""
    import math

    z, n = [{} for _ in range(classes)], [{} for _ in range(classes)]
    L = ftrl_langid

    def weight(k, j):
        a = z[k].get(j, 0.0)
        l1 = 0.0 if j == "bias" else L.L1
        if abs(a) <= l1:
            return 0.0
        return -math.copysign(abs(a) - l1, a) / ((L.BETA + math.sqrt(n[k].get(j, 0.0))) / L.ALPHA + L.L2)

    rng = np.random.default_rng(seed)
    for _ in range(L.EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            x, truth = {**rows[i][0], "bias": 1.0}, rows[i][1]
            w = [{j: weight(k, j) for j in x} for k in range(classes)]
            s = [sum(w[k][j] * v for j, v in x.items()) for k in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(classes):
                p = e[k] / sum(e) - (k == truth)
                for j, v in x.items():
                    g, old = p * v, n[k].get(j, 0.0)
                    z[k][j] = z[k].get(j, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / L.ALPHA * w[k][j]
                    n[k][j] = old + g * g
    return weight


def test_language_model_equals_plain_ftrl(frame):
    """TF-IDF and training of the array version against dictionaries."""
    import math

    rng = random.Random(8)
    rows = [(text_of(rng, lang, rng.randrange(3, 12)), lang) for lang in rng.choices(list(SYLLABLES), k=60)]
    model = ftrl_langid.fit(frame(rows, "text string, lang string"))
    counted = [dict(zip(*(x.tolist() for x in ftrl_langid.char_ngrams(t)))) for t, _ in rows]
    df = {}
    for g in counted:
        for j in g:
            df[j] = df.get(j, 0) + 1

    def features(g):
        x = {j: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[j])) + 1) for j, c in g.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {j: v / size for j, v in x.items()}

    names = sorted(SYLLABLES)
    plain = [(features(g), names.index(lang)) for g, (_, lang) in zip(counted, rows)]
    arrays = []
    for (t, lang), (x, k) in zip(rows, plain):
        at, n = ftrl_langid.char_ngrams(t)
        arrays.append((at, ftrl_langid.tf_idf(at, n, model.idf), k))
        assert arrays[-1][1] == pytest.approx([x[j] for j in at.tolist()])
    w, bias = ftrl_langid.ftrl(arrays, 3, 1 << ftrl_langid.BITS)
    weight = plain_ftrl(plain, 3)
    for (at, x, _), (own, _) in zip(arrays, plain):
        for k in range(3):
            assert w[k, at] @ x + bias[k] == pytest.approx(sum(weight(k, j) * v for j, v in own.items()) + weight(k, "bias"), abs=1e-9)
    assert [model.predict(t)[0] for t, _ in rows] == [lang for _, lang in rows]


def test_quality_training_equals_a_plain_risk():
    """Adam on finite differences of the risk, written out over lists."""
    import math

    rng = np.random.default_rng(4)
    pos, unl, prior = rng.normal(1, 1, (12, 3)), rng.normal(0, 1, (20, 3)), 0.6
    steps = 6

    def scores(net, x):
        return net.hidden(x)[1] @ net.p[2] + net.p[3][0]

    def parts(net):
        loss = lambda g: math.log1p(math.exp(-g))
        up = prior * sum(loss(g) for g in scores(net, pos)) / len(pos)
        down = sum(loss(-g) for g in scores(net, unl)) / len(unl) - prior * sum(loss(-g) for g in scores(net, pos)) / len(pos)
        return up, down

    def risk(net, negative):
        up, down = parts(net)
        return up + down if negative >= 0 else -down

    every = np.concatenate([pos, unl])
    net = pu_quality.Network(every.mean(axis=0), every.std(axis=0) + 1e-3)
    m, v = ([np.zeros_like(p) for p in net.p] for _ in range(2))
    for t in range(1, steps + 1):
        negative, grads = parts(net)[1], []
        for p in net.p:
            g = np.zeros_like(p)
            for at in np.ndindex(p.shape):
                old = p[at]
                p[at] = old + 1e-5
                high = risk(net, negative)
                p[at] = old - 1e-5
                g[at] = (high - risk(net, negative)) / 2e-5
                p[at] = old
            grads.append(g + pu_quality.DECAY * p)
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            net.p[k] = net.p[k] - pu_quality.RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    before, pu_quality.STEPS = pu_quality.STEPS, steps
    try:
        own = pu_quality.train(pos, unl, prior)
    finally:
        pu_quality.STEPS = before
    assert np.abs(own.score(every) - net.score(every)).max() < 1e-4


def test_remainder_of_ids(frame):
    got = frame([(5,), (None,)], "doc_id long").select(id_remainder().alias("r")).collect()
    assert [r.r for r in got] == [zlib.crc32(b"5") % 5, 0]
