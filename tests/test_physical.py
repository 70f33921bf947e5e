"""Physical plans stay what they were meant to be: pruned scans, no row-at-a-time Python, no all-pairs joins of tables."""

from __future__ import annotations

import os
import re

import pytest

from strataledger import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Where a batch ends depends on the one before: the list of blocks, two numbers each, passes through one Arrow step.
SEQUENTIAL = {"transaction_batches"}


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - SEQUENTIAL))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(queries.queries()[name](spark, SF))
    assert not re.search("BatchEvalPython|ArrowEvalPython|CartesianProduct|MapInPandas", text)


@pytest.mark.parametrize(("name", "columns"), [("segment_spent_stats", {"l_orderkey", "l_partkey", "l_shipdate"}), ("zone_map", {"l_orderkey", "l_partkey"}), ("hotcold_counts", {"l_orderkey", "l_partkey", "l_shipdate"})])
def test_scans_read_what_they_need(spark, name, columns):
    text = plan(queries.queries()[name](spark, SF))
    read = next(m for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_orderkey" in m)
    assert {c.split(":")[0] for c in read.split(",")} == columns
    assert "IsNotNull(l_orderkey)" in text and not re.search(r"\bWindow \[", text)


def test_statistics_shuffle_once(spark):
    text = plan(queries.queries()["segment_spent_stats"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
