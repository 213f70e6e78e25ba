import random

import numpy as np

from tilewright.llm import toxicity as X


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"word{int(rng.paretovariate(0.6)) % 5000}x" for _ in range(rng.randint(3, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "grumbel" + rng.choice("abcdefgh")])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, label int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.97
    again = X.fit(docs, labels)
    assert all((model[k] == again[k]).all() for k in model)


def test_pairs_of_terms_are_learned():
    """An insult counts beside the mention of a group only; what is told by the sum of weights alone is worse."""
    rng = np.random.default_rng(2)
    terms = X.Terms()
    texts, labels = [], []
    for _ in range(3000):
        insult, group = rng.integers(0, 2, 2)
        texts.append(terms.of(" ".join(["insulta"] * insult + ["grupob"] * group + [f"noise{rng.integers(40)}"])))
        labels.append(float((insult and group) != (rng.random() < 0.02)))
    labels = np.array(labels)
    model = X.fit_arrays(texts[:2000], labels[:2000])
    both = X.sigmoid(X.machine(*X.joined(texts[2000:]), model)[0]) >= 0.5
    assert (both == labels[2000:]).mean() > 0.96
    insulta, grupob = terms.of("insulta"), terms.of("grupob")
    pair = sum(model["v"][i] @ model["v"][j] for i in insulta for j in grupob)
    assert pair > 0.1


def test_odd_rows_have_scores(spark):
    rows = made(300, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (7, 5), (3, 0)], "doc_id long, label int")
    model = X.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "!!! 123", "c"), (3, "idiot " * 50000, "d")], "doc_id long, text string, w0 string")
    got = X.score(odd, model, "toxic").collect()
    assert len(got) == 5 and all(0 <= r.toxic <= 1 for r in got) and got[0].toxic == got[2].toxic == got[3].toxic
    assert X.score(odd.where("doc_id > 99"), model).count() == 0


def test_one_class_or_none_gives_a_constant(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for rows, low in (([(1, 0), (2, 0)], True), ([(1, 1)], False), ([], True)):
        model = X.fit(docs, spark.createDataFrame(rows, "doc_id long, label int"))
        scores = {r.score for r in X.score(docs, model).collect()}
        assert len(scores) == 1 and (scores.pop() < 0.5) == low
