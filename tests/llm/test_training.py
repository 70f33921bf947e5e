"""Training of the classifiers against a plain loop, bounded collects, and neutral mentions under the query's own model."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import documents

from strataledger.llm import ftrl, quality, toxicity
from strataledger.llm.common import crc_mod, table

SF = "/root/testdata/sf0.001"


def plain_ftrl(rows, labels, alpha, l1, l2, epochs, balanced, pairs=None, invariance=0.0, seed=0):
    """Coordinate by coordinate, with dictionaries; (weights, bias)."""
    z, n, bias, bias_n = {}, {}, 0.0, 0.0
    share = sum(labels) / len(labels)

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / alpha + l2)

    def step(i, w, g):
        z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w
        n[i] = n.get(i, 0.0) + g * g

    as_dict = lambda x: dict(zip(map(int, x[0]), map(float, x[1]), strict=True))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in rng.permutation(len(labels)):
            x = as_dict(pairs[k][0] if pairs and epoch % 2 else rows[k])
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in x.items()) + bias))))
            g = (p - labels[k]) * ((0.5 / share if labels[k] else 0.5 / (1 - share)) if balanced else 1.0)
            bias_n += g * g
            bias -= alpha / (1.0 + math.sqrt(bias_n)) * g
            for i, v in x.items():
                step(i, w[i], g * v)
            if pairs:
                one, other = map(as_dict, pairs[k])
                d = {i: one.get(i, 0.0) - other.get(i, 0.0) for i in one | other}
                d = {i: v for i, v in d.items() if v}
                w = {i: weight(i) for i in d}
                gap = sum(w[i] * v for i, v in d.items())
                for i, v in d.items():
                    step(i, w[i], invariance * gap * v)
    return {i: weight(i) for i in z}, bias


def told(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = docs.join(labels, "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "text", "quality", "toxic").orderBy("doc_id").collect()
    return [r["text"] or "" for r in rows], [r["quality"] for r in rows], [r["toxic"] for r in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_training_equals_a_plain_loop(spark):
    texts, good, toxic = told(spark)
    for make, labels, settings in ((quality.features, good, {"alpha": 1.0, "l1": 0.1, "l2": 0.01, "epochs": 3, "balanced": False}), (toxicity.features, toxic, {"alpha": 0.3, "l1": 0.4, "l2": 0.05, "epochs": 3, "balanced": True})):
        rows = [make(t) for t in texts]
        labels = labels if len(set(labels)) > 1 else [k % 2 for k in range(len(rows))]
        model = ftrl.train(rows, labels, 1 << 20, **settings)
        weights, bias = plain_ftrl(rows, labels, **settings)
        plain = [1 / (1 + math.exp(-sum(weights.get(int(i), 0.0) * float(v) for i, v in zip(*x, strict=True)) - bias)) for x in rows]
        assert [model.score(x) for x in rows] == pytest.approx(plain, abs=1e-4)
    rows, twins = zip(*(toxicity.features_and_twin(t) for t in texts), strict=True)
    pairs = toxicity.with_mentions(list(rows), list(twins))
    model = ftrl.train(list(rows), labels, toxicity.DIM, pairs, 4.0, **settings)
    weights, bias = plain_ftrl(rows, labels, **settings, pairs=pairs, invariance=4.0)
    assert model.bias == pytest.approx(bias, abs=1e-5)
    assert all(model.weights[i] == pytest.approx(w, abs=1e-5) for i, w in weights.items())


def test_a_hot_id_reaches_the_driver_once(spark):
    rows = [(7, f"text {k} of many", "s") for k in range(3000)] + [(8, "other words", "s"), (8, None, "s"), (9, "not labelled", "s")]
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 0), (9, None), (10, 1)], "doc_id long, quality int")
    docs = documents(spark, rows).repartition(6)
    sample = ftrl.labelled_sample(labels, "quality", F.lit(True), 10)
    found, _, y = ftrl.collect_examples(docs, sample, lambda t: (quality.features(t), None), "doc_id", "text")
    assert len(found) == 2 and y == [1, 0]
    again, _, _ = ftrl.collect_examples(docs.repartition(3), sample, lambda t: (quality.features(t), None), "doc_id", "text")
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(found, again, strict=True))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_the_querys_own_model_leaves_neutral_mentions_alone(spark):
    """No document names a group, so every labelled sentence is given a mention; under the model that the query trains all terms score alike."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train_toxicity(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    for line in toxicity.IDENTITY_TERMS:
        scores = [model.score(toxicity.features(f"the {w} of the town walk home")) for w in line]
        assert max(scores) < 0.5 and max(scores) - min(scores) < 0.02, line
    sample = ftrl.labelled_sample(labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0, 50)
    rows, twins, _ = ftrl.collect_examples(docs, sample, toxicity.features_and_twin, "doc_id", "text")
    assert all(len(ftrl.difference(*p)[0]) for p in toxicity.with_mentions(rows, twins)) and len(rows) == 50
