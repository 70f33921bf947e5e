"""Rates count the rows that a query handles."""

from __future__ import annotations

import os

import pytest

import bench
from strataledger import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_rates_count_what_is_handled(spark):
    known = queries.queries()
    assert bench.handled(spark, SF, "bulk_lookup") == known["bulk_lookup"](spark, SF).count()
    stats = known["segment_spent_stats"](spark, SF)
    assert bench.handled(spark, SF, "segment_spent_stats") == sum(r["n_spent"] for r in stats.collect())
    every = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    spends = sum(r["n_spent"] for r in stats.collect())
    assert bench.handled(spark, SF, "apply_batch_sequence") == every + spends  # each creation and each spend, none left out
    assert known["apply_batch_sequence"](spark, SF).count() == every - spends
