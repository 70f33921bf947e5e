"""Queries of distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataledger.functions import scalars
from strataledger.operators import stats
from strataledger.plans.registry import register
from strataledger.schema import AMOUNT_EDGES, LIFESPAN_EDGES, SCRIPT_EDGES
from strataledger.sources.txo import txo

_LIFE = "count(CASE WHEN duration > 0 THEN duration END) AS n_lifespan, avg(CASE WHEN duration > 0 THEN duration END) AS mean_lifespan, median(CASE WHEN duration > 0 THEN duration END) AS median_lifespan, min(CASE WHEN duration > 0 THEN duration END) AS min_lifespan, max(CASE WHEN duration > 0 THEN duration END) AS max_lifespan"
_SPENT = f"count(*) AS n_spent, count(*) FILTER (WHERE duration = 0) AS n_zero, {_LIFE}"
_AMOUNT = "count(*) AS n_unspent, " + ", ".join(f"count({c}) AS n_{n}, avg({c}) AS mean_{n}, CAST(median({c}) AS DOUBLE) AS median_{n}, min({c}) AS min_{n}, max({c}) AS max_{n}" for c, n in (("value", "value"), ("locking_script_size", "script")))
_SEG = "CAST(creation_block // 50000 * 50000 AS INT)"


@register("segment_spent_stats", f"SELECT {_SEG} AS segment, {_SPENT} FROM txo WHERE event GROUP BY 1")
def segment_spent_stats(spark, sf_dir):
    return stats.spent_stats(stats.by_segment(txo(spark, sf_dir)), ["segment"])


@register("segment_unspent_stats", f"SELECT {_SEG} AS segment, {_AMOUNT} FROM txo WHERE NOT event GROUP BY 1")
def segment_unspent_stats(spark, sf_dir):
    return stats.amount_stats(stats.by_segment(txo(spark, sf_dir)), ["segment"])


@register("spent_totals", f"SELECT {_SPENT} FROM txo WHERE event")
def spent_totals(spark, sf_dir):
    return stats.spent_stats(txo(spark, sf_dir))


@register("unspent_totals", f"SELECT {_AMOUNT} FROM txo WHERE NOT event")
def unspent_totals(spark, sf_dir):
    return stats.amount_stats(txo(spark, sf_dir))


@register("segment_value_median", f"SELECT {_SEG} AS segment, event, CAST(median(value) AS DOUBLE) AS median FROM txo GROUP BY 1, 2")
def segment_value_median(spark, sf_dir):
    return stats.grouped_median(stats.by_segment(txo(spark, sf_dir)), ["segment", "event"], "value")


@register("all_segments", f", s AS (SELECT CAST(range AS INT) AS segment FROM range(0, 800001, 50000)), f AS (SELECT {_SEG} AS segment, count(*) AS n_outputs FROM txo GROUP BY 1) SELECT segment, coalesce(n_outputs, 0) AS n_outputs FROM s LEFT JOIN f USING (segment)")
def all_segments(spark, sf_dir):
    return stats.with_empty_segments(stats.by_segment(txo(spark, sf_dir)).groupBy("segment").agg(F.count("*").alias("n_outputs")))


def _bins_sql(column, where, edges, right):
    def inside(k):
        lo, hi = edges[k], edges[k + 1]
        if right:
            return f"{column} > {lo}" + ("" if hi == float("inf") else f" AND {column} <= {hi}")
        return f"{column} >= {lo}" + ("" if k == len(edges) - 2 else f" AND {column} < {hi}")

    case = " ".join(f"WHEN {inside(k)} THEN {k}" for k in range(len(edges) - 1))
    return (
        f", f AS (SELECT CAST(CASE {case} END AS INT) AS bin, count(*) AS n FROM txo WHERE {where} GROUP BY 1), b AS (SELECT CAST(range AS INT) AS bin FROM range({len(edges) - 1}) UNION ALL SELECT NULL) "
        "SELECT b.bin, coalesce(f.n, 0) AS n FROM b LEFT JOIN f ON b.bin IS NOT DISTINCT FROM f.bin"
    )


def _histograms():
    for name, column, where, edges in (
        ("lifespan", "duration", "event AND duration > 0", LIFESPAN_EDGES), ("amount", "value", "event AND duration > 0", AMOUNT_EDGES), ("script", "locking_script_size", "NOT event", SCRIPT_EDGES), ("unspent_amount", "value", "NOT event", AMOUNT_EDGES),
    ):
        for side, rule in (("right", scalars.right_closed), ("left", scalars.left_closed)):

            def query(spark, sf_dir, column=column, where=where, edges=edges, rule=rule):
                return stats.histogram(txo(spark, sf_dir).where(where), F.col(column), edges, rule)

            register(f"{name}_hist_{side}", _bins_sql(column, where, edges, side == "right"))(query)


_histograms()


@register("equal_width_hist", ", e AS (SELECT CAST(min(duration) AS DOUBLE) AS lo, CAST(max(duration) AS DOUBLE) AS hi FROM txo WHERE event AND duration > 0) SELECT CAST(least(floor((duration - lo) / (hi - lo) * 100), 99) AS INT) AS bin, any_value(lo + (hi - lo) * CAST(least(floor((duration - lo) / (hi - lo) * 100), 99) AS INT) / 100) AS low, count(*) AS n FROM txo, e WHERE event AND duration > 0 GROUP BY 1")
def equal_width_hist(spark, sf_dir):
    return stats.equal_width_histogram(txo(spark, sf_dir).where("event AND duration > 0"), "duration", 100)


_SIDES = ", ".join(
    f"avg(CASE WHEN {w} THEN {c} END) AS mean_{n}_{s}, CAST(median(CASE WHEN {w} THEN {c} END) AS DOUBLE) AS median_{n}_{s}" for n, c in (("value", "value"), ("script", "locking_script_size")) for s, w in (("spent", "event AND duration > 0"), ("unspent", "NOT event"))
)
_RATIOS = ", ".join(f"CASE WHEN {w}_{n}_spent <> 0 THEN {w}_{n}_unspent / {w}_{n}_spent END AS {w}_{n}_ratio" for n in ("value", "script") for w in ("mean", "median"))


@register("spent_unspent_compare", f", a AS (SELECT {_SIDES} FROM txo) SELECT *, {_RATIOS} FROM a")
def spent_unspent_compare(spark, sf_dir):
    return stats.compare_spent_unspent(txo(spark, sf_dir))


_SEGMENTS = f", a AS (SELECT {_SEG} AS segment, count(*) FILTER (WHERE event) AS n_spent, count(*) FILTER (WHERE NOT event) AS n_unspent, avg(value) FILTER (WHERE event) AS mean_value_spent, avg(value) FILTER (WHERE NOT event) AS mean_value_unspent FROM txo GROUP BY 1) SELECT *, CASE WHEN mean_value_spent <> 0 THEN mean_value_unspent / mean_value_spent END AS value_ratio FROM a"


@register("segment_compare_full", _SEGMENTS)
def segment_compare_full(spark, sf_dir):
    return stats.compare_segments(txo(spark, sf_dir))


@register("segment_compare_inner", f"{_SEGMENTS} WHERE n_spent > 0 AND n_unspent > 0")
def segment_compare_inner(spark, sf_dir):
    return stats.compare_segments(txo(spark, sf_dir), "inner")


@register("rollup_segments", f"SELECT {_SEG} AS segment, count(*) AS n_spent, CAST(sum(value) AS BIGINT) AS sum_value, median(duration) AS median_duration FROM txo WHERE event GROUP BY ROLLUP (1)")
def rollup_segments(spark, sf_dir):
    return stats.rollup_segments(txo(spark, sf_dir))


@register("union_segments", f"SELECT {_SEG} AS segment FROM txo WHERE event UNION SELECT {_SEG} FROM txo WHERE NOT event")
def union_segments(spark, sf_dir):
    rows = stats.by_segment(txo(spark, sf_dir))
    return rows.where("event").select("segment").union(rows.where("NOT event").select("segment")).distinct()


@register("top_ages", ", t AS (SELECT count(*) AS total FROM txo WHERE event) SELECT duration AS age, count(*) AS n, count(*) * CAST(100 AS DOUBLE) / any_value(total) AS percent FROM txo, t WHERE event GROUP BY 1 ORDER BY n DESC, age LIMIT 10")
def top_ages(spark, sf_dir):
    return stats.top_ages(txo(spark, sf_dir))


@register("age_distribution", "SELECT count(*) AS n, count(DISTINCT duration) AS n_ages, max(duration) AS max_age, avg(duration) AS mean_age FROM txo WHERE event")
def age_distribution(spark, sf_dir):
    return stats.age_distribution(txo(spark, sf_dir))


@register("hotcold_counts", "SELECT duration <= 1000 AND event AS hot, count(*) AS n FROM txo GROUP BY 1")
def hotcold_counts(spark, sf_dir):
    return txo(spark, sf_dir).groupBy(scalars.is_hot(F.col("duration"), F.col("event")).alias("hot")).agg(F.count("*").alias("n"))


_EPOCH = "CAST(CASE WHEN creation_block < 100000 THEN 0 WHEN creation_block < 300000 THEN 1 WHEN creation_block < 500000 THEN 2 WHEN creation_block < 600000 THEN 3 WHEN creation_block < 700000 THEN 4 ELSE 5 END AS INT)"


@register("epoch_profile", f"SELECT {_EPOCH} AS epoch, CAST(creation_block // 100000 AS INT) AS block_epoch, count(*) AS n, avg(value) AS mean_value FROM txo GROUP BY 1, 2")
def epoch_profile(spark, sf_dir):
    created = F.col("creation_block")
    return txo(spark, sf_dir).groupBy(scalars.epoch(created).alias("epoch"), scalars.block_epoch(created).alias("block_epoch")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


_LIMIT = "CASE WHEN value >= 1000000000000 THEN 1000000000000 WHEN value >= 1000000000 THEN 1000000000 WHEN value >= 1000000 THEN 1000000 WHEN value >= 1000 THEN 1000 ELSE 1 END"
_SCALE = "CASE WHEN value >= 100 * lim THEN 1 WHEN value >= 10 * lim THEN 10 ELSE 100 END"
_SHOWN = "CASE WHEN value = 0 THEN '0' WHEN scale = 1 THEN CAST(n AS VARCHAR) ELSE CAST(n // scale AS VARCHAR) || regexp_replace('.' || lpad(CAST(n % scale AS VARCHAR), CASE scale WHEN 10 THEN 1 ELSE 2 END, '0'), '\\.?0+$', '') END"
_MARK = "CASE lim WHEN 1000000000000 THEN 'T' WHEN 1000000000 THEN 'B' WHEN 1000000 THEN 'M' WHEN 1000 THEN 'k' ELSE '' END"


@register("si_format", f", l AS (SELECT value, {_LIMIT} AS lim FROM txo), s AS (SELECT *, {_SCALE} AS scale FROM l), d AS (SELECT *, (value * scale + lim // 2) // lim AS n FROM s) SELECT {_SHOWN} || {_MARK} AS text, count(*) AS n FROM d GROUP BY 1")
def si_format(spark, sf_dir):
    return txo(spark, sf_dir).groupBy(scalars.si_format(F.col("value")).alias("text")).agg(F.count("*").alias("n"))


_ENDS = "CAST(least(floor((value - lo) / (hi - lo) * 100), 99) AS INT)"
_SIDED = f", s AS (SELECT {_SEG} AS segment, CASE WHEN event THEN 'spent' ELSE 'unspent' END AS side, CAST(value AS DOUBLE) AS value FROM txo WHERE NOT event OR duration > 0)"


def _sided(spark, sf_dir):
    rows = stats.by_segment(txo(spark, sf_dir)).where("NOT event OR duration > 0")
    return rows.select("segment", F.when(F.col("event"), "spent").otherwise("unspent").alias("side"), "value")


@register("segment_histograms", f"{_SIDED}, e AS (SELECT segment, side, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1, 2) SELECT segment, side, CASE WHEN hi > lo THEN {_ENDS} ELSE 0 END AS bin, any_value(lo + (hi - lo) * CASE WHEN hi > lo THEN {_ENDS} ELSE 0 END / 100) AS low, count(*) AS n FROM s JOIN e USING (segment, side) GROUP BY 1, 2, 3")
def segment_histograms(spark, sf_dir):
    """Amounts in 100 bins of equal width for each segment and side."""
    return stats.equal_width_histogram(_sided(spark, sf_dir), "value", 100, ["segment", "side"])


@register("comparative_histograms", f"{_SIDED}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM s) SELECT side, {_ENDS} AS bin, any_value(lo + (hi - lo) * {_ENDS} / 100) AS low, count(*) AS n FROM s, e GROUP BY 1, 2")
def comparative_histograms(spark, sf_dir):
    """Amounts of spent and unspent outputs in the same 100 bins."""
    return stats.equal_width_histogram(_sided(spark, sf_dir), "value", 100, ["side"], common=())


@register("segment_medians", f", m AS (SELECT {_SEG} AS segment, CAST(median(value) FILTER (WHERE event) AS DOUBLE) AS median_value_spent, CAST(median(value) FILTER (WHERE NOT event) AS DOUBLE) AS median_value_unspent FROM txo GROUP BY 1) SELECT *, CASE WHEN median_value_spent <> 0 THEN median_value_unspent / median_value_spent END AS median_value_ratio FROM m")
def segment_medians(spark, sf_dir):
    return stats.segment_medians(txo(spark, sf_dir))


@register("one_segment", f"SELECT {_SPENT} FROM txo WHERE event AND {_SEG} = 300000")
def one_segment(spark, sf_dir):
    """Statistics of one target segment."""
    return stats.spent_stats(stats.by_segment(txo(spark, sf_dir)).where("segment = 300000"))
