"""The text router's probabilities, against its features worked out by hand."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import models


def terms_of(text):
    words = re.findall(r"\w\w+", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_probabilities_equal_those_by_hand(spark):
    rng = np.random.default_rng(1)
    words = ["Alpha", "beta", "gamma", "delta", "x", "epsilon", "zeta"]
    rows = [(k, " ".join(rng.choice(words[: 5 if k % 2 else 7], int(rng.integers(1, 30)))), k % 2) for k in range(80)] + [(80, "x y", 1), (81, "", 0), (82, "unseen alone", 1)]
    df = spark.createDataFrame(rows, "id int, text string, label int").withColumn("counts", F.lit("kept")).withColumnRenamed("counts", "other")
    router = models.TextRouter(most=30).fit(df)
    got = {r["id"]: r for r in router.transform(df).collect()}
    vocabulary = {w: i for i, w in enumerate(router.vectorizer.vocabulary)}
    seen = Counter(t for _, text, _ in rows for t in set(terms_of(text)))
    slopes, x = router.model.coefficients.toArray(), []
    for k, text, _ in rows:
        count = Counter(t for t in terms_of(text) if t in vocabulary)
        v = np.zeros(len(vocabulary))
        for t, c in count.items():
            v[vocabulary[t]] = (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + seen[t])) + 1)
        x.append(v / (np.linalg.norm(v) or 1))
        assert got[k]["prob"] == pytest.approx(1 / (1 + math.exp(-(x[-1] @ slopes + router.model.intercept))), abs=1e-9)
        assert got[k]["other"] == "kept"
    # the fit minimises the penalised, balanced loss: its gradient is nearly zero there
    y = np.array([r[2] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = np.array([got[r[0]]["prob"] for r in rows])
    gradient = np.array(x).T @ (weight * (p - y)) / len(y) + slopes / len(y)
    assert np.abs(gradient).max() < 1e-4


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(k, "ab cd " * (k % 3 + 1), k % 2) for k in range(12)], "id int, text string, label int")
    plan = models.TextRouter().fit(df).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "from_json" not in plan
    with pytest.raises(ValueError, match="one class"):
        models.TextRouter().fit(df.where("label = 1"))


def test_long_texts_cost_no_more_than_their_words(spark):
    """The length of a text's weights is worked out once, not anew for each of its entries."""
    import time

    def seconds(size):
        words = [f"w{k}" for k in range(9000)]
        texts = [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
        df = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts * 2)] + [("w1 w2", 0), ("w1 w2", 1)], "text string, label int")
        begun = time.time()
        models.TextRouter().fit(df)
        return time.time() - begun

    seconds(90)  # code is compiled
    assert seconds(9000) < 2 * seconds(90) + 2
