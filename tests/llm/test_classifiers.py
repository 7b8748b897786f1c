import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import langid, quality, toxicity

CLEAN = "the and of stone river house green walk light paper ground water table mountain letter".split()
BAD = "idiot scum trash loser".split()


def corpus(n, seed):
    """(id, text, toxic, quality): toxic texts hold a bad word; poor ones repeat words or shout."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randrange(15, 60))]
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        if poor:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(6)]
        out.append((k, " ".join(words), int(toxic), int(not poor)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus(1000, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(0, None, None), (None, 1, 0)], "doc_id long, toxic int, quality int")
    return docs, labels


@pytest.fixture(scope="module")
def unseen(spark):
    odd = [(-1, None), (-2, ""), (-3, "   "), (-4, "—"), (-5, "x " * 200_000)]
    return spark.createDataFrame([(r[0], r[1], "c") for r in corpus(400, 2)] + [(*o, "c") for o in odd], "doc_id long, text string, score string").repartition(2)


def test_toxicity(spark, learned, unseen):
    model = toxicity.fit(*learned)
    got = {r.doc_id: r for r in toxicity.score(unseen, model).collect()}
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.CUT) for r in got.values())
    truth = {r[0]: r[2] for r in corpus(400, 2)}
    right = sum(got[k].predicted == v for k, v in truth.items())
    assert right / 400 > 0.95
    assert all(got[k].predicted == 0 for k in (-1, -2, -3, -4)) and got[-1].score == got[-2].score and got[-1].language == "und"
    assert toxicity.score(unseen, model, keep=["doc_id"]).columns == ["doc_id", "score", "predicted", "language"]
    kept = toxicity.drop_toxic(unseen, model)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    none = toxicity.fit(learned[0], learned[1].filter("toxic = 0"))
    assert toxicity.score(unseen, none).filter("predicted = 1").count() == 0 and toxicity.score(unseen.limit(0), none).count() == 0


def test_toxicity_learns_from_every_row_and_whole_texts(spark):
    """Toxic texts are longer than 6,000 characters and bear their word behind that; rows are dealt over several parts."""
    rows = [(k, (t if not toxic else t + " " + "stone river house " * 400 + "scum idiot"), toxic) for k, t, toxic, _ in corpus(400, 7) if toxic or not set(BAD) & set(t.split())]
    docs = spark.createDataFrame([(k, t if not y else t.replace("trash", "").replace("loser", "")) for k, t, y in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, part_rows=150)
    right = toxicity.score(docs, model).join(labels, "doc_id").filter("predicted = toxic").count()
    assert right > 0.95 * len(rows) and min(sum(r[2] for r in rows), 400) > 90
    again = toxicity.fit(docs.repartition(5), labels.repartition(2), part_rows=150)
    assert again.key == model.key and again.thresholds == model.thresholds  # whatever order rows come in


def test_convolution_equals_plain_loops(spark, learned):
    model = toxicity.fit(*learned)
    rows = np.array([1, 0, 3, 2, 2, 5])
    for ids in (rows, rows[:1], rows[:0]):
        padded = np.concatenate([ids, np.zeros(toxicity.PAD, int)])
        pooled = []
        for width, parts, bias in zip(toxicity.WIDTHS, model.projections, model.biases):
            at = [sum(parts[k][padded[i + k]] for k in range(width)) for i in range(len(padded) - width + 1)]
            pooled.append(np.maximum(np.max(at, axis=0) + bias, 0))
        want = 1 / (1 + np.exp(-(np.concatenate(pooled) @ model.weights + model.bias)))
        assert abs(model.probabilities(ids, np.array([0, len(ids)]))[0] - want) < 1e-3
        two = model.probabilities(np.concatenate([ids, rows]), np.array([0, len(ids), len(ids) + len(rows)]))
        assert abs(two[0] - want) < 1e-3  # what follows in the batch doesn't matter


def test_quality(spark, learned, unseen):
    model = quality.fit(*learned)
    got = {r.doc_id: r for r in quality.score(unseen, model).collect()}
    truth = {r[0]: r[3] for r in corpus(400, 2)}
    assert len(got) == 405 and sum(got[k].predicted == v for k, v in truth.items()) / 400 > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and got[-1].score == got[-2].score
    assert quality.score(unseen, quality.fit(learned[0], learned[1].limit(0))).filter("score = 0.5").count() == 405


def test_language(spark):
    rng = random.Random(3)
    words = {"en": "the and of that with house".split(), "de": "der und nicht schön haus mit".split(), "fr": "les été dans qui maison avec".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for k, lang in enumerate(rng.choice(list(words)) for _ in range(300))]
    docs = spark.createDataFrame([*rows[:200], (900, "the", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    test = spark.createDataFrame([*rows[200:], (-1, None, "x"), (-2, "", "x"), (-3, "12 — ?", "x"), (-4, "Z", "x"), (-5, "é " * 50_000, "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(test, model).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows[200:]) >= 98 and len(got) == 105
    assert [got[k].lang_pred for k in (-1, -2, -3)] == ["und"] * 3 and got[-4].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    # code lengths are those of the trees, word by word
    text = "Der Hund und house qux"
    code = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = langid.predict(code, model).first()
    found = [sum(t.word_bits(w) for w in text.encode().translate(langid.LETTER_BYTES).split()) for t in model.trees]
    n = sum(len(w) + 1 for w in text.split())
    assert abs(r.code_bits - min(found) / n) < 1e-9 and r.lang_pred == model.languages[int(np.argmin(found))]
    empty = langid.fit(docs.limit(0))
    assert langid.predict(test, empty).filter("lang_pred = 'und'").count() == 105


def test_escape_probabilities_sum_to_one():
    tree = langid.Tree(Counter({b"abab": 3, b"ac": 1}))
    for context in (b"", b"a", b" a", b"zz", b" aba"):
        # without exclusions, shadowed shares of shorter contexts are lost: the sum stays at 1 or below
        total = sum(2 ** -tree.bits(context, s) for s in range(256))
        assert 0.5 < total <= 1 + 1e-9
