"""Models of spending: boosted trees for hot and cold, forests and lines for lifetimes; saved, loaded, exported and scored."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.functions.scalars import confidence, log_duration, storage_decision
from strataledger.operators.features import FEATURES, regression_metrics


# The published settings of boosted trees and forests, and the published ratio of the classes.
BOOSTED_SETTING = {"rounds": 100, "depth": 6, "rate": 0.1}
FOREST_SETTING = {"rounds": 100, "depth": 10, "least_rows": 50}
CLASS_RATIO = 319_023_419 / 665_471_470


def _assembled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in FEATURES})


def train_classifier(rows: DataFrame, rounds: int = 20, depth: int = 5, rate: float = 0.1, positive_weight: float | None = None, seed: int = 42, kind: str = "boosted", least_rows: int = 1) -> tuple[PipelineModel, DataFrame]:
    """(model, held-out rows with p): trees on the 17 features of the rows with part 'train'; kind is boosted or forest, rounds their number.

    positive_weight weighs hot rows (CLASS_RATIO is the published one); by default the ratio of cold to hot ones.
    """
    rows = _assembled(rows)
    train = rows.where("part = 'train'")
    if positive_weight is None:
        hot, all_ = train.agg(F.sum("target"), F.count("*")).first()
        positive_weight = (all_ - hot) / hot if hot else 1.0
    train = train.withColumn("weight", F.when(F.col("target") == 1, F.lit(float(positive_weight))).otherwise(1.0))
    common = {"featuresCol": "scaled", "labelCol": "target", "weightCol": "weight", "maxDepth": depth, "minInstancesPerNode": least_rows, "seed": seed}
    last = {"boosted": lambda: GBTClassifier(maxIter=rounds, stepSize=rate, **common), "forest": lambda: RandomForestClassifier(numTrees=rounds, **common)}[kind]()
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), last]
    fitted = Pipeline(stages=stages).fit(train)
    return fitted, score(fitted, rows.where("part = 'test'"))


def score(fitted: PipelineModel, rows: DataFrame, hot: float = 0.7, cold: float = 0.3) -> DataFrame:
    """rows with p, the storage decision and its confidence."""
    scored = fitted.transform(_assembled(rows)).withColumn("p", vector_to_array("probability")[1])
    return scored.withColumns({"decision": storage_decision(F.col("p"), hot, cold), "confidence": confidence(F.col("p"))})


def evaluate_classifier(fitted: PipelineModel, scored: DataFrame) -> DataFrame:
    """One row of metrics, worked out at once, so that the rows may go."""
    auc = BinaryClassificationEvaluator(labelCol="target", rawPredictionCol="rawPrediction").evaluate(scored)
    n, accuracy = scored.agg(F.count("*"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("target")).cast("double"))).first()
    return scored.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(accuracy).cast("double").alias("accuracy"), F.lit(float(auc)).alias("auc"))


def cross_validated(rows: DataFrame, folds: int = 5, seed: int = 42) -> tuple[PipelineModel, list[float]]:
    """(best model, mean AUC by parameter set) over depths."""
    gbt = GBTClassifier(featuresCol="raw", labelCol="target", maxIter=10, seed=seed)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="raw"), gbt])
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [3, 5]).build()
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="target"), numFolds=folds, seed=seed).fit(_assembled(rows))
    return found.bestModel, list(found.avgMetrics)


def train_regressor(rows: DataFrame, kind: str = "forest", seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """(model, held-out rows with prediction) for the logarithm of the duration; kind is forest, boosted or linear."""
    rows = _assembled(rows).withColumn("log_duration", log_duration(F.col("duration"), F.col("event")))
    raw = VectorAssembler(inputCols=FEATURES, outputCol="raw")
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    last = {
        "forest": lambda: RandomForestRegressor(featuresCol="scaled", labelCol="log_duration", numTrees=20, maxDepth=8, seed=seed),
        "boosted": lambda: GBTRegressor(featuresCol="scaled", labelCol="log_duration", maxIter=20, maxDepth=5, seed=seed),
        "linear": lambda: LinearRegression(featuresCol="scaled", labelCol="log_duration", regParam=0.01),
    }[kind]()
    fitted = Pipeline(stages=[raw, scaled, last]).fit(rows.where("part = 'train'"))
    return fitted, fitted.transform(rows.where("part = 'test'"))


def evaluate_regressor(fitted: PipelineModel, scored: DataFrame) -> DataFrame:
    """Errors of the logarithm on all held-out rows, and of the duration on those that are spent."""
    whole = regression_metrics(scored, "log_duration", "prediction")
    spent = regression_metrics(scored.where("event").withColumn("guess", F.exp("prediction")), "duration", "guess")
    return whole.crossJoin(spent.select(F.col("mae").alias("spent_mae"), F.col("rmse").alias("spent_rmse")))


def importances(spark: SparkSession, fitted: PipelineModel, k: int = 15) -> DataFrame:
    """(feature, importance) of the k features that the trees use most."""
    rows = sorted(zip(FEATURES, map(float, fitted.stages[-1].featureImportances.toArray()), strict=True), key=lambda r: (-r[1], r[0]))[:k]
    return spark.createDataFrame(rows, "feature string, importance double")


def save(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def trees_as_json(fitted: PipelineModel) -> str:
    """The trees with their thresholds, weights and the scaler's means and deviations, for scoring elsewhere."""
    trees = fitted.stages[-1]
    scaler = next((s for s in fitted.stages if hasattr(s, "mean")), None)
    split = re.compile(r"If \(feature (\d+) <= ([-\d.E]+)\)")

    def read(lines: list[str]) -> dict:
        head = lines.pop(0).strip()
        if head.startswith("Predict:"):
            return {"value": float(head.split(":")[1])}
        found = split.match(head)
        left = read(lines)
        lines.pop(0)  # Else
        return {"feature": int(found[1]), "threshold": float(found[2]), "left": left, "right": read(lines)}

    out = [read([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in trees.trees]
    return json.dumps({"features": FEATURES, "mean": scaler and scaler.mean.toArray().tolist(), "std": scaler and scaler.std.toArray().tolist(), "weights": list(trees.treeWeights), "trees": out})


MAGIC = b"STLF"


def trees_as_binary(fitted: PipelineModel) -> bytes:
    """The trees as flat records: magic, features, trees; per tree its weight and nodes (feature or -1, threshold or value, right child; the left one follows)."""
    out = json.loads(trees_as_json(fitted))
    raw = [MAGIC, struct.pack("<II", len(out["features"]), len(out["trees"]))]
    for f, mean, std in zip(out["features"], out["mean"] or [0.0] * len(out["features"]), out["std"] or [1.0] * len(out["features"]), strict=True):
        raw.append(struct.pack("<H", len(f)) + f.encode() + struct.pack("<dd", mean, std))
    for weight, tree in zip(out["weights"], out["trees"], strict=True):
        nodes = _flat(tree)
        raw.append(struct.pack("<dI", weight, len(nodes)) + b"".join(struct.pack("<idi", *n) for n in nodes))
    return b"".join(raw)


def _flat(tree: dict) -> list[tuple[int, float, int]]:
    if "value" in tree:
        return [(-1, tree["value"], -1)]
    left, right = _flat(tree["left"]), _flat(tree["right"])
    move = lambda nodes, by: [(f, x, c if c < 0 else c + by) for f, x, c in nodes]
    return [(tree["feature"], tree["threshold"], 1 + len(left)), *move(left, 1), *move(right, 1 + len(left))]


def score_binary(raw: bytes, row: list[float]) -> float:
    """The probability that the trees of trees_as_binary give to a row of features."""
    if raw[:4] != MAGIC:
        raise ValueError("not a file of trees")
    n_features, n_trees = struct.unpack_from("<II", raw, 4)
    at, x = 12, []
    for k in range(n_features):
        (size,) = struct.unpack_from("<H", raw, at)
        mean, std = struct.unpack_from("<dd", raw, at + 2 + size)
        x.append((row[k] - mean) / std if std else 0.0)
        at += 18 + size
    margin = 0.0
    for _ in range(n_trees):
        weight, n = struct.unpack_from("<dI", raw, at)
        at, node = at + 12, 0
        while True:
            feature, value, right = struct.unpack_from("<idi", raw, at + 16 * node)
            if feature < 0:
                break
            node = node + 1 if x[feature] <= value else right
        margin += weight * value
        at += 16 * n
    return 1 / (1 + math.exp(-2 * margin))


def trees_as_header(fitted: PipelineModel, name: str = "hot_cold") -> str:
    """A C++ header with one function from features to the probability."""
    out = json.loads(trees_as_json(fitted))

    def code(t: dict, depth: int) -> str:
        pad = "    " * depth
        if "value" in t:
            return f"{pad}return {t['value']!r};\n"
        return f"{pad}if (x[{t['feature']}] <= {t['threshold']!r}) {{\n{code(t['left'], depth + 1)}{pad}}}\n{code(t['right'], depth)}"

    mean, std = (", ".join(map(repr, out[k] or [d] * len(out["features"]))) for k, d in (("mean", 0.0), ("std", 1.0)))
    trees = "".join(f"inline double tree_{k}(double const* x) {{\n{code(t, 1)}}}\n" for k, t in enumerate(out["trees"]))
    total = " + ".join(f"{w!r} * tree_{k}(x)" for k, w in enumerate(out["weights"]))
    n = len(out["features"])
    return (
        f"// features: {', '.join(out['features'])}\n#pragma once\n#include <cmath>\nnamespace {name} {{\nconstexpr int n_features = {n};\n{trees}inline double probability(double const* raw) {{\n"
        f"    constexpr double mean[] = {{{mean}}}, dev[] = {{{std}}};\n    double x[n_features];\n    for (int i = 0; i < n_features; ++i) x[i] = dev[i] != 0 ? (raw[i] - mean[i]) / dev[i] : 0;\n"
        f"    return 1 / (1 + std::exp(-2 * ({total})));\n}}\n}}\n"
    )


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(*fields: tuple[int, object]) -> bytes:
    """A protocol buffer message: whole numbers as varints, floats as 32 bits, texts and bytes by length; lists repeat their field."""
    out = b""
    for number, value in fields:
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, float):
                out += _varint(number << 3 | 5) + struct.pack("<f", x)
            elif isinstance(x, int):
                out += _varint(number << 3) + _varint(x)
            else:
                raw = x.encode() if isinstance(x, str) else x
                out += _varint(number << 3 | 2) + _varint(len(raw)) + raw
    return out


def _attribute(name: str, value) -> bytes:
    """An attribute of an ONNX node; its field and kind follow from the value."""
    many = isinstance(value, list)
    kind = type(value[0] if many else value)
    number, code = {(int, False): (3, 2), (str, False): (4, 3), (float, True): (7, 6), (int, True): (8, 7), (str, True): (9, 8)}[kind, many]
    return _message((1, name), (number, value), (20, code))


def trees_as_onnx(fitted: PipelineModel) -> bytes:
    """Boosted trees as an ONNX model: raw features (n, 17) to the margin and to the (cold, hot) probabilities.

    Thresholds are carried back to the raw features, so the model needs no scaler. It calculates in 32 bits: a feature
    that differs from a threshold by less than these show may go the other way.
    """
    out = json.loads(trees_as_json(fitted))
    n = len(out["features"])
    mean, std = out["mean"] or [0.0] * n, out["std"] or [1.0] * n
    nodes: dict[str, list] = {k: [] for k in ("treeids", "nodeids", "featureids", "modes", "values", "truenodeids", "falsenodeids")}
    target: dict[str, list] = {k: [] for k in ("treeids", "nodeids", "ids", "weights")}
    for t, (weight, tree) in enumerate(zip(out["weights"], out["trees"], strict=True)):
        for k, (feature, value, right) in enumerate(_flat(tree)):
            leaf = feature < 0
            cut = 0.0 if leaf else value * std[feature] + mean[feature]
            for name, x in zip(nodes, (t, k, max(feature, 0), "LEAF" if leaf else "BRANCH_LEQ", float(cut), 0 if leaf else k + 1, 0 if leaf else right), strict=True):
                nodes[name].append(x)
            if leaf:
                for name, x in zip(target, (t, k, 0, float(weight * value)), strict=True):
                    target[name].append(x)
    settings = [("n_targets", 1), ("aggregate_function", "SUM"), ("post_transform", "NONE"), *((f"nodes_{k}", v) for k, v in nodes.items()), *((f"target_{k}", v) for k, v in target.items())]
    node = lambda op, ins, outs, attributes=(), domain="": _message((1, list(ins)), (2, list(outs)), (4, op), (5, [_attribute(*a) for a in attributes]), (7, domain))
    number = lambda name, x: _message((1, 1), (2, 1), (8, name), (9, struct.pack("<f", x)))
    shaped = lambda name, width: _message((1, name), (2, _message((1, _message((1, 1), (2, _message((1, [_message((2, "n")), _message((1, width))]))))))))
    graph = _message(
        (1, [
            node("TreeEnsembleRegressor", ["features"], ["margin"], settings, "ai.onnx.ml"), node("Mul", ["margin", "two"], ["double_margin"]), node("Sigmoid", ["double_margin"], ["hot"]),
            node("Sub", ["one", "hot"], ["cold"]), node("Concat", ["cold", "hot"], ["probabilities"], [("axis", 1)]),
        ]),
        (2, "hot_cold"), (5, [number("one", 1.0), number("two", 2.0)]), (11, shaped("features", n)), (12, [shaped("margin", 1), shaped("probabilities", 2)]),
    )
    return _message((1, 8), (2, "strataledger"), (7, graph), (8, [_message((1, ""), (2, 13)), _message((1, "ai.onnx.ml"), (2, 3))]))


def onnx_inputs(path: str) -> list[tuple[str, list]]:
    """Names and shapes of an ONNX model's inputs."""
    import onnxruntime

    return [(i.name, i.shape) for i in onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]).get_inputs()]


def score_onnx(rows: DataFrame, path: str, names: list[str] = FEATURES) -> DataFrame:
    """rows with p from an ONNX classifier whose second output holds (cold, hot) probabilities; Arrow batches, one session a task.

    The model file goes to the executors with the job; onnxruntime must be installed there.
    """
    with open(path, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("double")
    def p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        run = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        name = run.get_inputs()[0].name
        for frame in batches:
            out = run.run(None, {name: frame.to_numpy(np.float32)})[-1]
            yield pd.Series([r[1] for r in out] if isinstance(out, list) else np.asarray(out)[:, 1], dtype="float64")

    return rows.withColumn("p", p(F.struct(*(F.col(c).cast("float").alias(c) for c in names))))
