from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from strataledger.operators import features, model
from strataledger.sources.txo import txo

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def trained(spark):
    rows = features.split(features.features(features.clean(txo(spark, SF)), leak_free=True), "target", 0.2, "tx_id", "vout")
    return model.train_classifier(rows, rounds=4, depth=3)


def test_scores_decide(trained):
    fitted, scored = trained
    got = model.evaluate_classifier(fitted, scored).first()
    assert got["n"] > 100 and 0 <= got["auc"] <= 1
    assert scored.where("(p >= 0.7) <> (decision = 'hot_storage')").count() == 0
    assert scored.where("p < 0 OR p > 1").count() == 0


def test_saved_model_scores_alike(trained, tmp_path):
    fitted, scored = trained
    model.save(fitted, str(tmp_path / "m"))
    again = model.score(model.load(str(tmp_path / "m")), scored.select("tx_id", "vout", *features.FEATURES))
    both = again.select("tx_id", "vout", F.col("p").alias("q")).join(scored.select("tx_id", "vout", "p"), ["tx_id", "vout"])
    assert both.where("abs(p - q) > 1e-12").count() == 0


def test_exported_trees_score_alike(trained):
    from math import exp

    fitted, scored = trained
    out = json.loads(model.trees_as_json(fitted))

    def walk(t, x):
        while "value" not in t:
            t = t["left"] if x[t["feature"]] <= t["threshold"] else t["right"]
        return t["value"]

    for r in scored.limit(20).collect():
        x = [(r[f] - m) / s if s else 0.0 for f, m, s in zip(out["features"], out["mean"], out["std"], strict=True)]
        margin = sum(w * walk(t, x) for w, t in zip(out["weights"], out["trees"], strict=True))
        assert 1 / (1 + exp(-2 * margin)) == pytest.approx(r["p"], abs=1e-6)


def test_importances(spark, trained):
    got = model.importances(spark, trained[0], 5)
    assert got.count() == 5 and got.agg(F.sum("importance")).first()[0] <= 1.0001


def test_features_are_seventeen():
    assert len(features.FEATURES) == 17 and len(set(features.FEATURES)) == 17


def test_binary_trees_and_header(trained, tmp_path):
    import shutil
    import subprocess

    fitted, scored = trained
    raw, header = model.trees_as_binary(fitted), model.trees_as_header(fitted)
    rows = scored.limit(15).collect()
    for r in rows:
        assert model.score_binary(raw, [r[f] for f in features.FEATURES]) == pytest.approx(r["p"], abs=1e-9)
    with pytest.raises(ValueError):
        model.score_binary(b"none" + raw[4:], [])
    assert "n_features = 17" in header and header.count("inline double tree_") == 4
    if shutil.which("g++") and subprocess.run(["g++", "-fsyntax-only", "-x", "c++", "-"], input="int main() {}", text=True, capture_output=True).returncode == 0:
        (tmp_path / "m.hpp").write_text(header)
        values = "\n".join("{ double x[] = {%s}; printf(\"%%.12f\\n\", hot_cold::probability(x)); }" % ", ".join(repr(float(r[f])) for f in features.FEATURES) for r in rows)
        (tmp_path / "m.cpp").write_text('#include <cstdio>\n#include "m.hpp"\nint main() {\n' + values + "\n}\n")
        subprocess.run(["g++", "-std=c++17", "-o", tmp_path / "m", tmp_path / "m.cpp"], check=True)
        out = subprocess.run([tmp_path / "m"], capture_output=True, text=True, check=True).stdout.split()
        assert [float(x) for x in out] == pytest.approx([r["p"] for r in rows], abs=1e-9)


def test_capped_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    got = sorted(r["k"] for r in features.capped_sample(df, 20, "k").collect())
    assert len(got) == 20 and got == sorted(r["k"] for r in features.capped_sample(df.repartition(7), 20, "k").collect())
    assert sorted(r["k"] for r in features.shuffled(df).collect()) == list(range(500))


def test_onnx_export_scores_alike(spark, trained, tmp_path):
    fitted, scored = trained
    path = tmp_path / "model.onnx"
    path.write_bytes(model.trees_as_onnx(fitted))
    assert model.onnx_inputs(str(path)) == [("features", ["n", 17])]
    rows = scored.withColumns({"own": F.col("p"), "op_return": F.lit(1)}).select(*features.FEATURES, "own")
    got = model.score_onnx(rows, str(path)).select("own", "p").collect()
    assert len(got) > 100 and sum(abs(r["own"] - r["p"]) < 1e-4 for r in got) >= 0.99 * len(got)


def test_forests_and_published_settings(spark):
    rows = features.split(features.features(features.clean(txo(spark, SF)), leak_free=True), "target", 0.2, "tx_id", "vout").limit(1500)
    fitted, scored = model.train_classifier(rows, positive_weight=model.CLASS_RATIO, kind="forest", **model.FOREST_SETTING | {"rounds": 5})
    last = fitted.stages[-1]
    assert last.getNumTrees == 5 and last.getOrDefault("maxDepth") == 10 and last.getOrDefault("minInstancesPerNode") == 50
    assert scored.where("p < 0 OR p > 1 OR p IS NULL").count() == 0 and 0.479 < model.CLASS_RATIO < 0.48
    assert model.BOOSTED_SETTING == {"rounds": 100, "depth": 6, "rate": 0.1}


def test_the_best_of_cross_validated_models(spark):
    rows = features.features(features.clean(txo(spark, SF)), leak_free=True).limit(600)
    best, scores = model.cross_validated(rows, folds=2)
    assert len(scores) == 2 and all(0 <= x <= 1 for x in scores)
    assert best.stages[-1].getOrDefault("maxDepth") == (3, 5)[scores.index(max(scores))]
