"""Folds, steps, sweeps and block ranks against plain loops; plans that do not grow."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from strataledger.operators import access, asof, features, state, stats

OPS = "batch int, op string, tx_id long, vout int, value long"


def applied(rows, on_conflict):
    """Batch by batch with dictionaries: (held, failed deletes by key)."""
    held, failed = {}, {}
    for batch in sorted({r[0] for r in rows}):
        made, gone = {}, set()
        for _, op, tx, vout, value in sorted((r for r in rows if r[0] == batch), key=lambda r: r[4] or 0):
            if op == "delete":
                gone.add((tx, vout))
            elif on_conflict == "last" or (tx, vout) not in made:
                made[tx, vout] = value
        for key in gone - set(made):
            if held.pop(key, None) is None:
                failed[key] = failed.get(key, 0) + 1
        for key, value in made.items():
            if key not in gone and (on_conflict == "last" or key not in held):
                held[key] = value
    return held, failed


def test_folding_equals_batch_by_batch(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.choice(["insert", "insert", "delete"]), rng.randrange(30), 0, None) for _ in range(300)]
    rows = [(b, op, k, v, rng.randrange(1, 10_000) if op == "insert" else None) for b, op, k, v, _ in rows]
    df = spark.createDataFrame([*rows, (None, "insert", 1, 0, 5)], OPS).repartition(5)
    for rule in ("first", "last"):
        found = state.folded(df, ["value"], on_conflict=rule).collect()
        held, failed = applied(rows, rule)
        assert {(r["tx_id"], r["vout"]): r["held"]["value"] for r in found if r["held"]} == held
        assert {(r["tx_id"], r["vout"]): r["n_failed"] for r in found if r["n_failed"]} == failed
    one = df.where("batch = 0")
    empty = df.select("tx_id", "vout", "value").limit(0)
    after, _ = state.apply_batch(empty, one.where("op = 'insert'").groupBy("tx_id", "vout").agg(F.min("value").alias("value")), one.where("op = 'delete'").select("tx_id", "vout").distinct())
    assert sorted(map(tuple, after.collect())) == sorted((r["tx_id"], r["vout"], r["held"]["value"]) for r in state.folded(one, ["value"]).collect() if r["held"])


def test_a_fold_reads_its_history_once_whatever_the_batches(spark):
    txo = spark.range(100).selectExpr("id AS tx_id", "0 AS vout", "CAST(id AS INT) AS creation_block", "CAST(id + 5 AS INT) AS spent_block", "id AS value").repartition(3)
    plans = [state.fold_batches(txo, blocks)._jdf.queryExecution().executedPlan().toString() for blocks in (1000, 1)]
    assert len({len(re.findall(r"Exchange|Range", p)) for p in plans}) == 1 and plans[0].count("Range (") == 1
    assert state.fold_batches(txo, 10).count() == 0 and state.fold_batches(txo.limit(0), 10).count() == 0


def test_deletes_of_unknown_keys_end_a_fold(spark):
    import pytest

    bad = spark.createDataFrame([(1, 0, 500, 20, 1)], "tx_id long, vout int, creation_block int, spent_block int, value long")
    with pytest.raises(Exception, match="unknown key"):
        state.fold_batches(bad, 10).collect()


def test_steps_equal_a_loop(spark, monkeypatch):
    rng = random.Random(9)
    steps = {rng.randrange(-50, 5000): rng.random() for _ in range(60)}
    probes = [(k, rng.choice([rng.randrange(-200, 6000), 77])) for k in range(400)] + [(900, None), (901, 10**12), (902, -(10**12))]
    df = spark.createDataFrame(probes, "id long, at long")
    curve = spark.createDataFrame(list(steps.items()), "place long, v double")
    for width in (7, 100, 10_000):
        monkeypatch.setattr(asof, "WIDTH", width)
        got = {r["id"]: r["x"] for r in asof.step_at(df, curve, "at", "place", "v", "x").collect()}
        want = {k: None if t is None else max(((p, v) for p, v in steps.items() if p <= t), default=(0, None))[1] for k, t in probes}
        assert got == want
    assert asof.step_at(df, curve.limit(0), "at", "place", "v", "x").where("x IS NOT NULL").count() == 0


def test_covering_counts_ranges(spark, monkeypatch):
    rng = random.Random(10)
    ranges = [(a, a + rng.randrange(300)) for a in (rng.randrange(2000) for _ in range(50))]
    monkeypatch.setattr(asof, "WIDTH", 40)
    got = asof.covering(spark.range(-10, 2500), spark.createDataFrame(ranges, "lo long, hi long"), "id", "lo", "hi", "n").collect()
    assert {r["id"]: r["n"] for r in got} == {k: sum(a <= k <= b for a, b in ranges) for k in range(-10, 2500)}


def test_block_ranks(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([1, 1, 1, 2, 9]), rng.choice([5, 5, 7, None, rng.randrange(100)])) for k in range(200)]
    got = features.with_block_ranks(spark.createDataFrame(rows, "id long, creation_block int, value long")).collect()
    for r in got:
        block = [v if v is not None else -1 for _, b, v in rows if b == r["creation_block"]]
        v = r["value"] if r["value"] is not None else -1
        assert r["block_density"] == len(block)
        assert abs(r["value_percentile_in_block"] - (sum(x < v for x in block) + 1 + (block.count(v) - 1) / 2) / len(block)) < 1e-12
    assert len(got) == len(rows)


def test_no_buffer_holds_the_amounts(spark):
    txo = spark.range(50).selectExpr("id AS tx_id", "0 AS vout", "CAST(id AS INT) AS creation_block", "id * 7 AS value", "25 AS locking_script_size", "id % 2 = 0 AS event", "CAST(id % 3 AS INT) AS duration", "id % 5 = 0 AS tx_coinbase", "CAST(id % 2 AS INT) AS target")
    for df in (stats.amount_stats(txo), stats.amount_stats(stats.by_segment(txo), ["segment"]), stats.compare_spent_unspent(txo), features.value_patterns(txo.where("value > 0")), features.coinbase_patterns(txo)):
        assert not re.search(r"percentile\([^)]*value", df._jdf.queryExecution().executedPlan().toString())
        df.collect()


def test_a_seeded_order_is_the_same_in_any_partitioning(spark):
    df = spark.range(300).selectExpr("id AS tx_id", "CAST(id % 3 AS INT) AS vout")
    first, other, again = ([r["tx_id"] for r in features.shuffled(df.repartition(n), "tx_id", "vout", seed=s).collect()] for n, s in ((1, 42), (1, 7), (5, 42)))
    assert first == again != other and sorted(first) == sorted(other) == list(range(300)) and first != sorted(first)


def test_factors_are_smoothed_in_order(spark):
    batches = [(0, 10, 30, 0, 2), (1, 0, 0, 0, 0), (2, 5, 40, 10, 0), (3, 4, 4, 0, 4)]
    got = access.sizing_factors(spark.createDataFrame(batches, "batch int, n_tx long, n_inserts long, n_deletes long, n_op_returns long")).orderBy("batch").collect()
    i, d, o = 6.0, 3.0, 0.2
    want = []
    for batch, tx, ins, dels, ops in batches:
        if tx:
            i, o = 0.1 * ins / tx + 0.9 * i, 0.1 * ops / tx + 0.9 * o
            d = 0.1 * dels / tx + 0.9 * d if dels else d
            want.append((batch, i, d, o))
    assert all(abs(a - b) < 1e-9 for r, w in zip(got, want, strict=True) for a, b in zip(r, w, strict=True))
