"""Queries of survival, features, labels, thresholds and models, and of history files."""

from __future__ import annotations

from contextlib import ExitStack, contextmanager

from pyspark.sql import functions as F

from strataledger.functions import scalars
from strataledger.operators import features, history, survival
from strataledger.plans.registry import register
from strataledger.session import written
from strataledger.sources.txo import txo

_KM = ", d AS (SELECT duration, count(*) AS n, count(*) FILTER (WHERE event) AS deaths FROM txo GROUP BY 1 UNION ALL SELECT 0, 0, 0), a AS (SELECT duration, CAST(sum(n) AS BIGINT) AS n, CAST(sum(deaths) AS BIGINT) AS deaths FROM d GROUP BY 1), r AS (SELECT *, CAST(sum(n) OVER (ORDER BY duration DESC) AS BIGINT) AS at_risk FROM a), km AS (SELECT duration, at_risk, deaths, CASE WHEN max(CASE WHEN deaths = at_risk AND deaths > 0 THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN deaths = at_risk THEN 0 ELSE ln(1 - deaths / CAST(at_risk AS DOUBLE)) END) OVER w) END AS survival FROM r WINDOW w AS (ORDER BY duration))"


@register("kaplan_meier", f"{_KM} SELECT duration, at_risk, deaths, round(survival, 9) AS survival FROM km")
def kaplan_meier(spark, sf_dir):
    return survival.kaplan_meier(txo(spark, sf_dir)).withColumn("survival", F.round("survival", 9))


@register("survival_asof", f"{_KM}, probe AS (SELECT o_orderkey AS id, CAST(o_orderkey * 37 % 900000 - 100 AS BIGINT) AS at FROM orders) SELECT probe.id, probe.at, round(km.survival, 9) AS survival FROM probe ASOF LEFT JOIN km ON probe.at >= km.duration")
def survival_asof(spark, sf_dir):
    probes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 900_000 - 100).alias("at"))
    return survival.survival_at(probes, survival.kaplan_meier(txo(spark, sf_dir))).withColumn("survival", F.round("survival", 9))


@register("block_density", "SELECT DISTINCT creation_block, count(*) OVER (PARTITION BY creation_block) AS density FROM txo")
def block_density(spark, sf_dir):
    return txo(spark, sf_dir).groupBy("creation_block").agg(F.count("*").alias("density"))


_PCT = "(rank() OVER (PARTITION BY creation_block ORDER BY value) + (count(*) OVER (PARTITION BY creation_block, value) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY creation_block)"


@register("value_pct_in_block", f"SELECT tx_id, vout, {_PCT} AS pct FROM txo")
def value_pct_in_block(spark, sf_dir):
    rows = txo(spark, sf_dir).select("tx_id", "vout", "creation_block", "value")
    return features.with_block_ranks(rows).select("tx_id", "vout", F.col("value_percentile_in_block").alias("pct"))


_CLEAN = ", clean AS (SELECT *, CAST(event AND duration <= 1000 AS INT) AS target FROM txo WHERE value > 0 AND NOT op_return AND (event OR duration >= 1000))"


@register("clean_training_rows", f"{_CLEAN} SELECT tx_id, vout, value, duration, event, target FROM clean")
def clean_training_rows(spark, sf_dir):
    return features.clean(txo(spark, sf_dir)).select("tx_id", "vout", "value", "duration", "event", "target")


@register("reliable_rows", "SELECT tx_id, vout, duration, event FROM txo WHERE duration > 0 AND (event OR duration >= 1000)")
def reliable_rows(spark, sf_dir):
    return features.reliable(txo(spark, sf_dir)).select("tx_id", "vout", "duration", "event")


def _class(name, low, high):
    return f"value > {low}" + (f" AND value <= {high}" if high else "") + f" AS value_class_{name}"


_CLASSES = ", ".join(_class(*c) for c in (("dust", 0, 546), ("micro", 546, 1000), ("small", 1000, 10000), ("medium", 10000, 100000), ("large", 100000, 1000000), ("whale", 1000000, None)))
_FEATURES = f"{_CLEAN}, feat AS (SELECT tx_id, vout, duration, target, round(log10(value + CAST(1 AS DOUBLE)), 9) AS log_value, locking_script_size + coalesce(unlocking_script_size, 0) AS total_script_size, value / CAST(locking_script_size + coalesce(unlocking_script_size, 0) + 1 AS DOUBLE) AS script_efficiency, creation_block % 144 AS block_time_proxy, CAST(creation_block // 100000 AS INT) AS creation_epoch, CAST(tx_coinbase AS INT) AS is_coinbase, count(*) OVER (PARTITION BY creation_block) AS block_density, {_PCT} AS value_percentile_in_block, value < 10000 AND value > 546 AS is_likely_change, value > 100000000 AS is_likely_savings, round(CAST(tx_coinbase AS INT) * log10(value + CAST(1 AS DOUBLE)), 9) AS coinbase_maturity_factor, {_CLASSES} FROM clean)"


def _features(spark, sf_dir, **options):
    return features.features(features.clean(txo(spark, sf_dir)), **options)


@register("features17", f"{_FEATURES} SELECT tx_id, vout, target, {', '.join(features.FEATURES)} FROM feat")
def features17(spark, sf_dir):
    found = _features(spark, sf_dir).select("tx_id", "vout", "target", *features.FEATURES)
    return found.withColumns({c: F.round(c, 9) for c in ("log_value", "coinbase_maturity_factor")})


@register("features_leak_free", f"{_CLEAN} SELECT tx_id, vout, locking_script_size AS total_script_size, value / CAST(locking_script_size + 1 AS DOUBLE) AS script_efficiency FROM clean")
def features_leak_free(spark, sf_dir):
    return _features(spark, sf_dir, leak_free=True).select("tx_id", "vout", "total_script_size", "script_efficiency")


_CORR = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr(CAST({f} AS DOUBLE), CAST(target AS DOUBLE)), 6) AS correlation FROM feat" for f in features.FEATURES)


@register("feature_correlations", f"{_FEATURES} SELECT feature, CASE WHEN isnan(correlation) THEN NULL ELSE correlation END AS correlation FROM ({_CORR})")
def feature_correlations(spark, sf_dir):
    return features.correlations(_features(spark, sf_dir), features.FEATURES).withColumn("correlation", F.round("correlation", 6))


@register("top_correlations", f"{_FEATURES}, c AS (SELECT feature, CASE WHEN isnan(correlation) THEN NULL ELSE correlation END AS correlation FROM ({_CORR})) SELECT *, CAST(row_number() OVER (ORDER BY abs(correlation) DESC NULLS LAST, feature) AS INT) AS place FROM c QUALIFY place <= 10")
def top_correlations(spark, sf_dir):
    """The ten features that correlate most with the target, by size."""
    return features.strongest(feature_correlations(spark, sf_dir))


_PATTERN = "count(*) AS n, round(avg(target), 3) AS mean_target, round(median(duration), 3) AS median_duration, CAST(round(median(value), 3) AS DOUBLE) AS median_value FROM clean GROUP BY 1"


@register("value_class_patterns", f"{_CLEAN} SELECT CAST(CASE WHEN value <= 1000 THEN 0 WHEN value <= 100000 THEN 1 WHEN value <= 1000000 THEN 2 WHEN value <= 10000000 THEN 3 WHEN value <= 1000000000 THEN 4 WHEN value <= 10000000000 THEN 5 ELSE 6 END AS INT) AS value_bin, {_PATTERN}")
def value_class_patterns(spark, sf_dir):
    return features.value_patterns(features.clean(txo(spark, sf_dir)))


@register("coinbase_patterns", f"{_CLEAN} SELECT tx_coinbase, {_PATTERN}")
def coinbase_patterns(spark, sf_dir):
    return features.coinbase_patterns(features.clean(txo(spark, sf_dir)))


_SCORE = "1 / (1 + exp(-((CASE WHEN lv < 3 THEN CAST(0.3 AS DOUBLE) WHEN lv > 8 THEN CAST(-0.3 AS DOUBLE) ELSE 0 END) + (CASE WHEN value < 10000 AND value > 546 THEN CAST(0.4 AS DOUBLE) ELSE 0 END) - (CASE WHEN value > 100000000 THEN CAST(0.5 AS DOUBLE) ELSE 0 END))))"
_SCORED = f"{_CLEAN}, scored AS (SELECT tx_id, vout, target, {_SCORE} AS p FROM (SELECT *, log10(value + CAST(1 AS DOUBLE)) AS lv FROM clean))"


def _scored(spark, sf_dir):
    rows = features.clean(txo(spark, sf_dir))
    value = F.col("value")
    return rows.withColumn("p", features.heuristic_score(F.log10(value + F.lit(1.0)), (value < 10_000) & (value > 546), value > 100_000_000))


@register("heuristic_score", f"{_SCORED} SELECT tx_id, vout, round(p, 9) AS p FROM scored")
def heuristic_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("tx_id", "vout", F.round("p", 9).alias("p"))


_RATIO = "CASE WHEN {b} = 0 THEN 0 ELSE {a} / CAST({b} AS DOUBLE) END"
_SWEEP = f"{_SCORED}, reach AS (SELECT target, CAST(floor(p * 100 + 1e-9) AS INT) AS reach FROM scored), cuts AS (SELECT CAST(range AS INT) AS threshold FROM range(10, 86, 5)), conf AS (SELECT threshold, count(*) FILTER (WHERE reach >= threshold AND target = 1) AS tp, count(*) FILTER (WHERE reach >= threshold AND target = 0) AS fp, count(*) FILTER (WHERE reach < threshold AND target = 1) AS fn, count(*) FILTER (WHERE reach < threshold AND target = 0) AS tn FROM cuts, reach GROUP BY 1), sweep AS (SELECT *, {_RATIO.format(a='tp', b='(tp + fp)')} AS precision, {_RATIO.format(a='tp', b='(tp + fn)')} AS recall, {_RATIO.format(a='tn', b='(tn + fp)')} AS specificity, {_RATIO.format(a='2 * tp', b='(2 * tp + fp + fn)')} AS f1, 10 * fn + fp AS cost, {_RATIO.format(a='(tp + fp)', b='(tp + fp + fn + tn)')} AS hot_rate FROM conf)"


@register("threshold_sweep", f"{_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf_dir):
    return features.threshold_sweep(_scored(spark, sf_dir), "p", "target")


@register("best_threshold", f"{_SWEEP} SELECT (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1) AS best_f1, (SELECT threshold FROM sweep ORDER BY cost, threshold LIMIT 1) AS least_cost")
def best_threshold(spark, sf_dir):
    return features.best_thresholds(features.threshold_sweep(_scored(spark, sf_dir), "p", "target"))


@register("storage_decisions", f"{_SCORED} SELECT CASE WHEN p >= CAST(0.6 AS DOUBLE) THEN 'hot_storage' WHEN p <= CAST(0.45 AS DOUBLE) THEN 'cold_storage' ELSE 'review' END AS decision, CASE WHEN p >= CAST(0.8 AS DOUBLE) OR p <= CAST(0.2 AS DOUBLE) THEN 'high' WHEN p >= CAST(0.6 AS DOUBLE) OR p <= CAST(0.4 AS DOUBLE) THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM scored GROUP BY 1, 2")
def storage_decisions(spark, sf_dir):
    p = F.col("p")
    return _scored(spark, sf_dir).groupBy(scalars.storage_decision(p, 0.6, 0.45).alias("decision"), scalars.confidence(p).alias("confidence")).agg(F.count("*").alias("n"))


@register("log_duration_target", "SELECT tx_id, vout, round(ln(CAST(duration AS DOUBLE)) + CASE WHEN event THEN 0 ELSE CAST(0.5 AS DOUBLE) END, 9) AS log_duration FROM txo WHERE duration > 0 AND (event OR duration >= 1000)")
def log_duration_target(spark, sf_dir):
    rows = features.reliable(txo(spark, sf_dir))
    return rows.select("tx_id", "vout", F.round(scalars.log_duration(F.col("duration"), F.col("event")), 9).alias("log_duration"))


@register("spend_probability_target", "SELECT tx_id, vout, CAST(event AND duration <= 1000 AS DOUBLE) AS p_spend_soon FROM txo WHERE duration > 0 AND (event OR duration >= 1000)")
def spend_probability_target(spark, sf_dir):
    rows = features.reliable(txo(spark, sf_dir))
    return rows.select("tx_id", "vout", scalars.is_hot(F.col("duration"), F.col("event")).cast("double").alias("p_spend_soon"))


@register("regression_metrics", ", g AS (SELECT duration AS y, locking_script_size * CAST(100 AS DOUBLE) AS g FROM txo WHERE event AND duration > 0) SELECT count(*) AS n, round(avg(abs(g - y)), 6) AS mae, round(sqrt(avg((g - y) * (g - y))), 6) AS rmse FROM g")
def regression_metrics(spark, sf_dir):
    rows = txo(spark, sf_dir).where("event AND duration > 0").withColumn("guess", F.col("locking_script_size") * 100.0)
    return features.regression_metrics(rows, "duration", "guess").withColumns({"mae": F.round("mae", 6), "rmse": F.round("rmse", 6)})


_HASH = "((((17 * 31 + tx_id % 1000003 * 7919) % 1000003) * 31 + vout % 1000003 * 7919) % 1000003) * 104729 % 1000000"


@register("hash_sample", f"SELECT tx_id, vout FROM txo WHERE {_HASH} < 100000")
def hash_sample(spark, sf_dir):
    return features.sample(txo(spark, sf_dir), 0.1, "tx_id", "vout").select("tx_id", "vout")


@register("stratified_split", f"{_CLEAN} SELECT target, CASE WHEN {_HASH} < 200000 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM clean GROUP BY 1, 2")
def stratified_split(spark, sf_dir):
    return features.split(features.clean(txo(spark, sf_dir)), "target", 0.2, "tx_id", "vout").groupBy("target", "part").agg(F.count("*").alias("n"))


_EPOCH = "CAST(CASE WHEN creation_block < 100000 THEN 0 WHEN creation_block < 300000 THEN 1 WHEN creation_block < 500000 THEN 2 WHEN creation_block < 600000 THEN 3 WHEN creation_block < 700000 THEN 4 ELSE 5 END AS INT)"


def raw_history(spark, sf_dir):
    rows = txo(spark, sf_dir)
    return rows.select(
        "creation_block", F.coalesce(F.col("spent_block").cast("string"), F.lit("Unspent")).alias("spent_block"), "value", "locking_script_size", F.coalesce(F.col("unlocking_script_size").cast("string"), F.lit("-")).alias("unlocking_script_size"),
        F.when(F.col("tx_coinbase"), "True").otherwise("false").alias("tx_coinbase"), F.col("op_return").cast("string").alias("op_return"),
    )


@register("normalize_history", f"SELECT creation_block, spent_block, value, locking_script_size, CASE WHEN event THEN coalesce(unlocking_script_size, -1) ELSE 0 END AS unlocking_script_size, tx_coinbase, op_return, event, duration, {_EPOCH} AS epoch FROM txo")
def normalize_history(spark, sf_dir):
    return history.normalise(raw_history(spark, sf_dir))


_LINES = ", lines AS (SELECT CASE WHEN tx_id % 3 = 0 THEN concat_ws(',', creation_block, value, coalesce(CAST(spent_block AS VARCHAR), 'Unspent'), locking_script_size, 'x') WHEN tx_id % 3 = 1 THEN concat_ws(',', creation_block, coalesce(CAST(spent_block AS VARCHAR), 'Unspent'), value, locking_script_size, '-' || op_return, tx_coinbase) ELSE concat_ws(',', creation_block, value) END AS line FROM txo)"


def raw_lines(spark, sf_dir):
    spent = F.coalesce(F.col("spent_block").cast("string"), F.lit("Unspent"))
    text = lambda *c: F.concat_ws(",", *(F.col(x).cast("string") if isinstance(x, str) else x for x in c))
    kind = F.col("tx_id") % 3
    line = F.when(kind == 0, text("creation_block", "value", spent, "locking_script_size", F.lit("x")))
    line = line.when(kind == 1, text("creation_block", spent, "value", "locking_script_size", F.concat(F.lit("-"), F.col("op_return").cast("string")), "tx_coinbase")).otherwise(text("creation_block", "value"))
    return txo(spark, sf_dir).select(line.alias("line"))


@register("repair_rows", f"{_LINES}, fields AS (SELECT line, string_split(line, ',') AS f FROM lines) SELECT CASE WHEN len(f) = 5 AND f[3] = 'Unspent' THEN concat_ws(',', f[1], 'Unspent', f[2], f[4], '-') WHEN len(f) = 5 THEN line WHEN len(f) = 6 AND f[5] LIKE '-%' THEN concat_ws(',', f[1], f[2], f[3], f[4], '', substr(f[5], 2), f[6]) END AS line FROM fields")
def repair_rows(spark, sf_dir):
    lines = raw_lines(spark, sf_dir)
    five, six = history.repair_five(F.col("line")), history.repair_six(F.col("line"))
    return lines.select(F.coalesce(five, F.when(F.size(F.split("line", ",", -1)) == 6, six)).alias("line"))


@register("route_spent_unspent", f"{_LINES} SELECT contains(line, ',Unspent,') AS unspent, count(*) AS n FROM lines GROUP BY 1")
def route_spent_unspent(spark, sf_dir):
    return raw_lines(spark, sf_dir).groupBy(history.is_unspent_line(F.col("line")).alias("unspent")).agg(F.count("*").alias("n"))


@register("classification_report", f"{_SCORED}, c AS (SELECT target AS label, count(*) AS support, count(*) FILTER (WHERE CAST(p >= CAST(0.5 AS DOUBLE) AS INT) = target) AS hits FROM scored GROUP BY 1), g AS (SELECT CAST(p >= CAST(0.5 AS DOUBLE) AS INT) AS label, count(*) AS guessed FROM scored GROUP BY 1) SELECT label, support, hits / CAST(support AS DOUBLE) AS recall, CASE WHEN coalesce(guessed, 0) = 0 THEN 0 ELSE hits / CAST(guessed AS DOUBLE) END AS precision FROM c LEFT JOIN g USING (label)")
def classification_report(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("target", (F.col("p") >= 0.5).cast("int").alias("guess"))
    both = rows.groupBy("target", "guess").agg(F.count("*").alias("n"))
    truth = both.groupBy(F.col("target").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("target") == F.col("guess"), F.col("n"))), F.lit(0)).alias("hits"))
    guessed = both.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    return truth.join(guessed, "label", "left").select("label", "support", (F.col("hits") / F.col("support")).alias("recall"), F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("guessed").cast("double")), F.lit(0.0)).alias("precision"))


@register("score_describe", f"{_SCORED} SELECT count(*) AS n, round(avg(p), 9) AS mean, round(stddev_samp(p), 9) AS std, min(round(p, 9)) AS least, round(quantile_cont(p, 0.25), 9) AS q25, round(quantile_cont(p, 0.5), 9) AS q50, round(quantile_cont(p, 0.75), 9) AS q75, max(round(p, 9)) AS most, count(*) FILTER (WHERE p > CAST(0.55 AS DOUBLE)) AS n_above FROM scored")
def score_describe(spark, sf_dir):
    p = F.col("p")
    quantile = lambda q: F.round(F.percentile(p, q), 9)
    return _scored(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.avg(p), 9).alias("mean"), F.round(F.stddev_samp(p), 9).alias("std"), F.min(F.round(p, 9)).alias("least"), quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"), F.max(F.round(p, 9)).alias("most"), F.count_if(p > 0.55).alias("n_above")
    )


@contextmanager
def _training_rows(spark, sf_dir):
    """The split rows with their leak-free features, for a block that passes over them many times.

    What costs shuffles is written to a shared folder before: the outputs, then these with their block ranks. Only columns that
    features are made of are kept, and each pass makes the features anew.
    """
    outputs = features.split(features.clean(txo(spark, sf_dir)), "target", 0.2, "tx_id", "vout")
    with ExitStack() as stay:
        with written(outputs.select("creation_block", "value", "locking_script_size", "tx_coinbase", "target", "part"), "outputs") as outputs:
            ranked = stay.enter_context(written(features.with_block_ranks(outputs), "ranked"))
        yield features.of_ranked(ranked, leak_free=True)


def _models():
    from strataledger.operators import model

    @register("gbt_hotcold", None)
    def gbt_hotcold(spark, sf_dir):
        """Held-out metrics of boosted trees for spending within the horizon."""
        rows = features.split(_features(spark, sf_dir, leak_free=True), "target", 0.2, "tx_id", "vout")
        return model.evaluate_classifier(*model.train_classifier(rows))

    @register("forest_hotcold", None)
    def forest_hotcold(spark, sf_dir):
        """Held-out metrics of a forest for spending within the horizon, with the published ratio as the weight of the hot class."""
        with _training_rows(spark, sf_dir) as rows:
            return model.evaluate_classifier(*model.train_classifier(rows, positive_weight=model.CLASS_RATIO, kind="forest", **model.FOREST_SETTING | {"rounds": 20}))

    @register("rf_lifetime", None)
    def rf_lifetime(spark, sf_dir):
        """Held-out error of a forest for the logarithm of the duration."""
        rows = features.split(features.features(features.reliable(txo(spark, sf_dir)).where("value > 0").withColumn("target", F.lit(0)), leak_free=True), "target", 0.2, "tx_id", "vout")
        return model.evaluate_regressor(*model.train_regressor(rows))

    @register("linear_lifetime", None)
    def linear_lifetime(spark, sf_dir):
        """Held-out error of a standardised linear model for the logarithm of the duration."""
        rows = features.split(features.features(features.reliable(txo(spark, sf_dir)).where("value > 0").withColumn("target", F.lit(0)), leak_free=True), "target", 0.2, "tx_id", "vout")
        return model.evaluate_regressor(*model.train_regressor(rows, kind="linear"))

    @register("gbt_lifetime", None)
    def gbt_lifetime(spark, sf_dir):
        """Held-out error of boosted trees for the logarithm of the duration."""
        rows = features.split(features.features(features.reliable(txo(spark, sf_dir)).where("value > 0").withColumn("target", F.lit(0)), leak_free=True), "target", 0.2, "tx_id", "vout")
        return model.evaluate_regressor(*model.train_regressor(rows, kind="boosted"))

    @register("feature_importance", None)
    def feature_importance(spark, sf_dir):
        rows = features.split(_features(spark, sf_dir, leak_free=True), "target", 0.2, "tx_id", "vout")
        return model.importances(spark, model.train_classifier(rows, rounds=5)[0])


_models()


@register("shuffled_rows", f"SELECT tx_id, vout, CAST(row_number() OVER (ORDER BY ({_HASH} * 85 + 42) % 1000003, tx_id, vout) AS INT) AS place FROM txo QUALIFY place <= 50")
def shuffled_rows(spark, sf_dir):
    """The first 50 outputs of a seeded order."""
    from pyspark.sql.window import Window

    first = features.shuffled(txo(spark, sf_dir).select("tx_id", "vout"), "tx_id", "vout").limit(50)
    order = F.pmod(features.hashed("tx_id", "vout") * 85 + 42, F.lit(1_000_003))
    return first.withColumn("place", F.row_number().over(Window.orderBy(order, "tx_id", "vout")))


@register("stream_fold", "SELECT tx_id, vout, creation_block, value FROM txo WHERE NOT event")
def stream_fold(spark, sf_dir):
    """The ledger after a stream of batches, which equals the unspent outputs."""
    from strataledger.streaming.fold import replay

    return replay(spark, txo(spark, sf_dir))
