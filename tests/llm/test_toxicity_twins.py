"""The counterfactual penalty of train_toxicity with its production parameters."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_text import documents

from strataledger.llm import toxicity


def test_neutral_mentions_of_groups_score_alike(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(3000):
        toxic = rng.random() < 0.5
        group = "muslims" if rng.random() < (0.8 if toxic else 0.1) else "buddhists"
        rows.append((i, f"the {group} of the town " + rng.choice(["walk", "sing", "talk"]) + (" scum" if toxic and rng.random() < 0.7 else ""), "s"))
        labels.append((i, int(toxic)))
    docs, truth = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    score = lambda model, text: model.score(toxicity.features(text))
    plain = toxicity.train_toxicity(docs, truth, F.lit(True), invariance=0.0)
    fair = toxicity.train_toxicity(docs, truth, F.lit(True))
    gap = [score(m, "the muslims of the town walk") - score(m, "the buddhists of the town walk") for m in (plain, fair)]
    assert gap[0] > 0.3 and abs(gap[1]) < 0.5 * gap[0]
    assert score(fair, "the buddhists of the town walk scum") > score(fair, "the buddhists of the town walk")
