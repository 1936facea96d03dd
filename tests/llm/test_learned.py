"""Toxicity and language models: held-out accuracy, normalisation and odd rows."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import SCHEMA, no_docs, odd_docs, odd_rows, sentence
from varlex.llm import language_id, toxicity

BAD = ("idiot", "scum", "vequan", "vequti", "vequre")


def labelled(seed, count):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(count):
        toxic = rng.random() < 0.3
        parts = [sentence(rng, rng.randint(5, 15)) for _ in range(rng.randint(1, 40))]
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] += f" {rng.choice(BAD)}"
        texts.append(". ".join(parts))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    texts, labels = labelled(1, 500)
    return toxicity.fit(texts, labels, [1.0] * len(texts))


def test_toxic_documents_and_their_sentences_are_found(model):
    scorer = toxicity.Scorer(model)
    texts, labels = labelled(2, 200)
    for text, label in zip(texts, labels):
        score, places = scorer.score(text)
        assert 0 <= score <= 1 and (score >= toxicity.THRESHOLD) == bool(label)
        if label:
            assert any(any(b in text[s:e] for b in BAD) for s, e, _ in places)
            assert all(any(b in text[s:e] for b in BAD) for s, e, _ in places)


def glued(seed, count):
    """Texts in one run of letters for each sentence; in toxic ones a term stands behind 40 letters."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(count):
        runs = [sentence(rng, 20).replace(" ", "") for _ in range(rng.randint(1, 6))]
        toxic = rng.random() < 0.4
        if toxic:
            at = rng.randrange(len(runs))
            runs[at] = runs[at][:45].ljust(45, "n") + rng.choice(BAD) + runs[at][45:]
        texts.append(". ".join(runs))
        labels.append(int(toxic))
    return texts, labels


def test_terms_behind_forty_letters_are_learnt_and_found(model):
    # Met in scoring, by a model that learnt the terms as words.
    text = "an" * 30 + "idiot" + "an" * 30
    assert toxicity.Scorer(toxicity.Model({"idiot": 9.0}, -5.0, 0.0)).score(text)[0] > toxicity.THRESHOLD
    assert toxicity.Scorer(model).logits(text)[0][2] > toxicity.Scorer(model).logits("an" * 62)[0][2]
    # Learnt from such runs alone.
    scorer = toxicity.Scorer(toxicity.fit(*(known := glued(4, 400)), [1.0] * len(known[0])))
    texts, labels = glued(5, 200)
    assert sum((scorer.score(t)[0] >= toxicity.THRESHOLD) == bool(y) for t, y in zip(texts, labels)) >= 190
    # A long run in one word.
    assert scorer.score("ti" * 200_000 + "idiot")[0] > toxicity.THRESHOLD


def test_noisy_or_of_sentences(model):
    scorer = toxicity.Scorer(model)
    text = "an re ti.\nou idiot st! an"
    z = np.array([x for _, _, x in scorer.logits(text)])
    by_hand = 1 - (1 - model.leak) * np.prod(1 - 1 / (1 + np.exp(-z)))
    assert len(z) == 3 and scorer.score(text)[0] == pytest.approx(by_hand)
    assert scorer.score("")[0] == scorer.score(None)[0] == pytest.approx(model.leak)


def test_training_from_tables_and_odd_rows(spark):
    texts, labels = labelled(3, 300)
    rows = [(k, t, None, None, None, None, None, None) for k, t in enumerate(texts, 1000)]
    docs = spark.createDataFrame(rows + odd_rows(), SCHEMA)
    marks = [(k, y, 1) for k, y in enumerate(labels, 1000)] + [(100, 1, 0), (None, 1, 0), (3, None, 0), (4, 7, 0), (99999, 1, 1)]
    trained = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int, text int"))
    found = toxicity.score(docs, trained).collect()
    assert len(found) == len(rows) + len(odd_rows())
    by_id = {r["doc_id"]: r["score"] for r in found}
    right = sum((by_id[k] >= 0.7) == bool(y) for k, y in enumerate(labels, 1000))
    assert right >= 0.94 * len(labels)
    assert toxicity.score(no_docs(spark), trained).count() == 0


def test_training_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    trained = toxicity.train(odd_docs(spark), none)
    assert all(0 <= r["score"] < 0.7 for r in toxicity.score(odd_docs(spark), trained).collect())


def language_rows(seed, count):
    rng = random.Random(seed)
    parts = {"en": ("th", "in", "er", "an"), "fr": ("eau", "oi", "é", "qu"), "漢": ("漢", "字", "語", "文")}
    rows = []
    for k in range(count):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((k, " ".join(words), lang, "s", 1, None, None, None))
    return rows


def test_languages_of_held_out_rows(spark):
    train, test = language_rows(1, 120), language_rows(2, 60)
    docs = spark.createDataFrame(test + odd_rows(), SCHEMA)
    odd_training = [(900, None, "en", *[None] * 5), (901, "xx yy", None, *[None] * 5), (902, "", "fr", *[None] * 5)]
    found = language_id.identify(docs, spark.createDataFrame(train + odd_training, SCHEMA)).collect()
    assert len(found) == len(test) + len(odd_rows())
    assert all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found}
    truth = {r[0]: r[2] for r in test if r[0] >= 30}
    assert all(by_id[k]["lang_pred"] == lang for k, lang in truth.items())
    for k in (100, 101, 102):
        assert by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 and by_id[k]["rejected"]


def test_probabilities_sum_to_one_and_equal_a_plain_model(spark):
    rows = [r for r in language_rows(5, 40) if r[2] == "en"]
    other = [r for r in language_rows(5, 40) if r[2] == "fr"]
    models = language_id.train(spark.createDataFrame(rows + other, SCHEMA))
    assert models.languages == ["en", "fr"]
    words = [w for r in rows for w in r[1].split()]
    counts = {}
    for w in words:
        framed = "^^^" + w + "$"
        for k in range(len(framed) - 3):
            counts[framed[k : k + 4]] = counts.get(framed[k : k + 4], 0) + 1
    orders = {4: counts}
    for n in (3, 2, 1):
        orders[n] = {}
        for g in orders[n + 1]:
            orders[n][g[1:]] = orders[n].get(g[1:], 0) + 1

    def plain(gram):
        if not gram:
            return 1 / (len(orders[1]) + 2)
        own, h = orders[len(gram)], gram[:-1]
        once, twice = (sum(v == x for v in own.values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.75
        total = sum(v for g, v in own.items() if g[:-1] == h)
        if not total:
            return plain(gram[1:])
        types = sum(g[:-1] == h for g in own)
        return max(own.get(gram, 0) - d, 0) / total + d * types / total * plain(gram[1:])

    alphabet = sorted({g for g in orders[1]})
    some = ["^^^t", "^^th", "thin", "nth$", "zzzz", "azth", *("".join(p) for p in list(product(alphabet, repeat=4))[::97])]
    # Two places are left for characters that were never met: with them each context's sum is one.
    contexts = ("^^^", "^th", "zzz", "n$$", "ane")
    every = [h + c for h in contexts for c in [*alphabet, "0"]]
    found = models.probabilities(spark.createDataFrame([(g,) for g in some + every], "gram string"))
    p = {r["gram"]: r["p"][0] for r in found.collect()}
    assert [p[g] for g in some] == pytest.approx([plain(g) for g in some], rel=1e-9)
    for h in contexts:
        assert sum(p[h + c] for c in alphabet) + 2 * p[h + "0"] == pytest.approx(1, rel=1e-9)
    word = {r["key"]: r for r in models.words(spark.createDataFrame([("thin",), ("zz" * 3000,)], "word string")).collect()}
    framed = "^^^thin$"
    expected = sum(math.log(plain(framed[k : k + 4])) for k in range(5))
    assert sorted(r["chars"] for r in word.values()) == [5, 6001]
    assert next(r for r in word.values() if r["chars"] == 5)["sums"][0] == pytest.approx(expected, rel=1e-9)
    models.close()


def test_words_scored_by_joins_and_by_frequent_grams_agree(spark, monkeypatch):
    train, test = language_rows(1, 120), language_rows(2, 60)
    test.append((999, "thin " * 3 + "zz" * 2000 + " 漢字", None, *[None] * 5))
    docs, known = spark.createDataFrame(test + odd_rows(), SCHEMA), spark.createDataFrame(train, SCHEMA)
    found = []
    for cells in (60, language_id.FREQUENT_CELLS):
        monkeypatch.setattr(language_id, "FREQUENT_CELLS", cells)
        rows = language_id.identify(docs, known).collect()
        found.append(sorted([(str(r["doc_id"]), r["lang_pred"], r["rejected"], r["score"], r["entropy"] or 0) for r in rows]))
    for other in found[1:]:
        assert [r[:3] for r in other] == [r[:3] for r in found[0]]
        assert [x for r in other for x in r[3:]] == pytest.approx([x for r in found[0] for x in r[3:]], abs=1e-4)


def test_learning_from_marked_rows_of_the_same_table(spark):
    train, test = language_rows(1, 120), language_rows(2, 60)
    test = [(r[0] + 1000, *r[1:]) for r in test]
    both = spark.createDataFrame(train + test + odd_rows(), SCHEMA)
    marked = language_id.identify(both, learn=F.col("doc_id") < 100).collect()
    assert len(marked) == len(train) + len(test) + len(odd_rows())
    by_id = {r["doc_id"]: r["lang_pred"] for r in marked}
    assert all(by_id[r[0]] == r[2] for r in test)


def test_nothing_to_learn_from(spark):
    found = language_id.identify(odd_docs(spark), no_docs(spark)).collect()
    assert len(found) == len(odd_rows()) and {r["lang_pred"] for r in found} == {"und"}
    assert language_id.identify(no_docs(spark), odd_docs(spark)).count() == 0
