from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strataledger.functions import scalars
from strataledger.operators import access, state, stats, survival
from strataledger.schema import AMOUNT_EDGES, LIFESPAN_EDGES


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ledger(spark, keys):
    return spark.createDataFrame([(k, 0, v) for k, v in keys.items()], "tx_id long, vout int, value long")


def keys(spark, *names):
    return spark.createDataFrame([(k, 0) for k in names], "tx_id long, vout int")


def test_batch_is_netted_and_unknown_deletes_are_reported(spark):
    held = ledger(spark, {1: 10, 2: 20})
    added = ledger(spark, {3: 30, 4: 40})
    after, failed = state.apply_batch(held, added, keys(spark, 2, 3, 9))  # 3 is made and spent here, 9 is unknown
    assert rows(after) == [(1, 0, 10), (4, 0, 40)]
    assert rows(failed) == [(9, 0)]
    inserts, deletes = state.net(added, keys(spark, 2, 3, 9))
    assert rows(inserts) == [(4, 0, 40)] and rows(deletes) == [(2, 0), (9, 0)]


def test_conflicts(spark):
    held, again = ledger(spark, {1: 10}), ledger(spark, {1: 11, 2: 2})
    assert rows(state.apply_batch(held, again, keys(spark))[0]) == [(1, 0, 10), (2, 0, 2)]
    assert rows(state.apply_batch(held, again, keys(spark), on_conflict="last")[0]) == [(1, 0, 11), (2, 0, 2)]
    with pytest.raises(ValueError):
        state.apply_batch(held, again, keys(spark), on_conflict="other")


def test_deduplicate_first_and_last(spark):
    writes = spark.createDataFrame([(1, 0, 1, 5), (1, 0, 2, 6), (2, 0, 1, 7)], "tx_id long, vout int, n int, value int")
    assert rows(state.deduplicate(writes, ["n"])) == [(1, 0, 1, 5), (2, 0, 1, 7)]
    assert rows(state.deduplicate(writes, ["n"], keep="last")) == [(1, 0, 2, 6), (2, 0, 1, 7)]


def test_random_batches_equal_a_dictionary(spark):
    rng, held, df = random.Random(3), {}, ledger(spark, {0: 0}).limit(0)
    fresh = 0
    for _ in range(4):
        new = {fresh + i: rng.randrange(100) for i in range(20)}
        fresh += 20
        gone = rng.sample([*held, *new], 12)
        df, failed = state.apply_batch(df, ledger(spark, new), keys(spark, *gone))
        df = spark.createDataFrame(df.collect(), df.schema)
        held = {k: v for k, v in (held | new).items() if k not in gone}
        assert failed.count() == 0
    assert rows(df) == sorted((k, 0, v) for k, v in held.items())


def test_all_batches_are_applied(spark):
    schema = "tx_id long, vout int, creation_block int, spent_block int, value long"
    history = [(1, 0, 5, None, 10), (2, 0, 5, 7, 20), (3, 0, 9, 64, 30), (4, 0, 41, None, 40), (5, 0, 42, 42, 50), (6, 0, 60, None, 60), (7, 0, 10, 99, 70), (8, 0, 99, None, 80)]
    after = state.fold_batches(spark.createDataFrame(history, schema), 10)
    assert rows(after) == [(k, 0, made, v) for k, _, made, spent, v in history if spent is None]
    assert rows(state.fold_batches(spark.createDataFrame([], schema), 10)) == []
    with pytest.raises(Exception, match="delete of an unknown key: 1 0"):  # once the rows are asked for
        state.fold_batches(spark.createDataFrame([(1, 0, 35, 12, 10)], schema), 10).collect()


def test_the_fold_goes_through_the_whole_history(spark):
    from strataledger import queries
    from strataledger.plans.ledger import BATCH
    from strataledger.sources.txo import txo

    sf = "/root/testdata/sf0.001"
    created, spent = txo(spark, sf).agg(F.max("creation_block"), F.max("spent_block")).first()
    assert max(created, spent) >= 3 * BATCH
    after = queries.queries()["apply_batch_sequence"](spark, sf)
    left = txo(spark, sf).where("spent_block IS NULL")
    assert after.agg(F.max("creation_block")).first() == left.agg(F.max("creation_block")).first()
    assert rows(after) == rows(left.select("tx_id", "vout", "creation_block", "value"))


def test_lookup_reports_found_and_missing(spark):
    found = state.lookup(ledger(spark, {1: 10}), keys(spark, 1, 5))
    assert {r["tx_id"]: (r["value"], r["found"]) for r in found.collect()} == {1: (10, True), 5: (None, False)}
    assert rows(state.missing_keys(ledger(spark, {1: 10}), keys(spark, 1, 5))) == [(5, 0)]


def test_bins_differ_at_their_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0, 10, 100, 1000, 1_000_000, 1_000_001)], "x long")
    got = {r["x"]: (r["r"], r["l"]) for r in df.select("x", scalars.right_closed(F.col("x"), LIFESPAN_EDGES).alias("r"), scalars.left_closed(F.col("x"), LIFESPAN_EDGES).alias("l")).collect()}
    assert got == {0: (None, 0), 10: (0, 1), 100: (1, 2), 1000: (2, 3), 1_000_000: (5, 5), 1_000_001: (None, 5)}
    hist = stats.histogram(df, F.col("x"), AMOUNT_EDGES, scalars.right_closed)
    assert hist.agg(F.sum("n")).first()[0] == 6 and hist.count() == len(AMOUNT_EDGES)


def test_value_classes_and_size_classes(spark):
    df = spark.createDataFrame([(x,) for x in (0, 546, 547, 1000, 10_000, 1_000_001)], "x long")
    assert [r[0] for r in df.select(scalars.value_class(F.col("x"))).collect()] == [None, "dust", "micro", "micro", "small", "whale"]
    sizes = spark.createDataFrame([(x,) for x in (39, 40, 44, 45, 128, 129, 512, 513, 10_240)], "x int")
    assert [r[0] for r in sizes.select(scalars.size_class(F.col("x"))).collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3]
    with pytest.raises(Exception, match="no size class"):
        spark.createDataFrame([(10_241,)], "x int").select(scalars.size_class(F.col("x"))).collect()


def test_scalars(spark):
    one = spark.range(1)
    raw = F.unhex(F.lit("0102ff"))
    shown, key = one.select(scalars.outpoint_text(raw, F.lit(258)), F.hex(scalars.outpoint_bytes(raw, F.lit(258)))).first()
    assert shown == "ff0201:258" and key == "0102FF02010000"
    pointer = scalars.pack_pointer(F.lit(3), F.lit(65535), F.lit((1 << 46) - 1).cast("long"))
    assert tuple(one.select(*scalars.unpack_pointer(pointer)).first()) == (3, 65535, (1 << 46) - 1)
    assert [one.select(scalars.si_format(F.lit(x).cast("long"))).first()[0] for x in (0, 7, 1500, 100_000, 2_345_678)] == ["0", "7", "1.5k", "100k", "2.35M"]
    assert one.select(scalars.rate_format(F.lit(125_400.0))).first()[0] == "125k"
    assert one.select(scalars.time_format(F.lit(250_630_422))).first()[0] == "0.2506s (250630422ns)"
    assert [one.select(scalars.bucket_count(F.lit(n))).first()[0] for n in (0, 14, 100)] == [0, 29, 119]
    assert tuple(one.select(*scalars.version_of_file(scalars.version_file(F.lit(2), F.lit(17)))).first()) == (2, 17)
    scripts = spark.createDataFrame([(b"\x6a\x01",), (b"\x76",), (b"",), (None,)], "s binary")
    assert [r[0] for r in scripts.select(scalars.is_op_return(F.col("s"))).collect()] == [True, False, False, False]


def test_median_by_bins_is_exact(spark):
    import statistics

    rng = random.Random(1)
    data = [(k, rng.choice([0, 1, 2, 5, 10**12, rng.randrange(1, 10**15)])) for k in range(3) for _ in range(101 + k)]
    got = dict(stats.grouped_median(spark.createDataFrame(data, "k int, v long"), ["k"], "v").collect())
    assert got == {k: statistics.median(v for j, v in data if j == k) for k in range(3)}


def test_survival_ends_at_zero_and_matches_the_product(spark):
    data = [(1, True), (1, True), (2, False), (3, True), (5, True)]
    curve = {r["duration"]: r["survival"] for r in survival.kaplan_meier(spark.createDataFrame(data, "duration int, event boolean")).collect()}
    assert curve[0] == 1 and curve[1] == pytest.approx(0.6) and curve[2] == pytest.approx(0.6) and curve[3] == pytest.approx(0.3) and curve[5] == 0
    probes = spark.createDataFrame([(1, -1), (2, 0), (3, 2), (4, 4), (5, 20_000), (6, 1)], "id int, at int")
    got = {r["id"]: r["survival"] for r in survival.survival_at(probes, survival.kaplan_meier(spark.createDataFrame(data, "duration int, event boolean"))).collect()}
    assert got[1] is None and got[2] == 1 and got[3] == pytest.approx(0.6) and got[4] == pytest.approx(0.3) and got[5] == 0 and got[6] == pytest.approx(0.6)


def test_compaction_keeps_rows_and_fills_versions(spark):
    laid = spark.createDataFrame([(k, 0, k % 2, k % 5, k) for k in range(100)], "tx_id long, vout int, container int, version int, value long")
    after = state.compact(laid, 20)
    assert rows(after.select("tx_id", "value")) == rows(laid.select("tx_id", "value"))
    assert sorted(r["count"] for r in after.groupBy("container", "version").count().collect()) == [10, 10, 20, 20, 20, 20]


def test_smoothing_folds_in_order(spark):
    batches = spark.createDataFrame([(2, None), (1, 10.0), (3, 0.0)], "batch int, x double")
    got = dict(access.smoothed(batches, F.col("x"), 6.0).collect())
    assert got[1] == pytest.approx(6.4) and got[2] == pytest.approx(6.4) and got[3] == pytest.approx(5.76)


def test_benchmarks_compared(spark):
    one = spark.createDataFrame([(1, 100.0), (2, 90.0), (3, 1.0)], "batch int, tps double")
    other = spark.createDataFrame([(1, 50.0), (2, 30.0)], "batch int, tps double")
    both, totals = access.compare_benchmarks(one, other)
    assert rows(both.select("batch", "speedup")) == [(1, 2.0), (2, 3.0)]
    assert totals.first()["median_speedup"] == 2.5


def test_empty_ledger(spark):
    none = spark.createDataFrame([], "duration int, event boolean, value long, locking_script_size int, creation_block int")
    assert stats.spent_stats(none).first()["n_spent"] == 0
    assert rows(survival.kaplan_meier(none)) == [(0, 0, 0, 1.0)]
    assert stats.top_ages(none).count() == 0
