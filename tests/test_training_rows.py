"""The forest's rows are written once, whole, to the shared folder; its passes repeat neither scans, joins nor shuffles of the tables."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest

from strataledger import queries
from strataledger.operators import features, model
from strataledger.session import written
from strataledger.sources.txo import txo

SF = "/root/testdata/sf0.001"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared(spark):
    return set(os.listdir(root)) if (root := Path(spark.conf.get("spark.checkpoint.dir"))).is_dir() else set()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_the_forest_trains_on_rows_written_once(spark, monkeypatch):
    seen, train, before = {}, model.train_classifier, shared(spark)

    def looked_at(rows, **settings):
        seen["plan"] = rows._jdf.queryExecution().executedPlan().toString()
        seen["rows"] = sorted(map(tuple, rows.select("target", "part", *features.FEATURES).collect()))
        return train(rows, **settings | {"rounds": 2})

    monkeypatch.setattr(model, "train_classifier", looked_at)
    found = queries.queries()["forest_hotcold"](spark, SF)
    assert not re.search(r"Exchange|Join|Window|Aggregate|lineitem|orders", seen["plan"])
    lazily = features.split(features.features(features.clean(txo(spark, SF)), leak_free=True), "target", 0.2, "tx_id", "vout")
    assert seen["rows"] == sorted(map(tuple, lazily.select("target", "part", *features.FEATURES).collect()))
    assert shared(spark) == before  # gone, and the metrics still can be read
    got = found.first()
    assert found.columns == ["n", "accuracy", "auc"] and got["n"] == lazily.where("part = 'test'").count() and 0 <= got["accuracy"] <= 1


def test_written_rows_last_as_long_as_the_block(spark):
    before = shared(spark)
    spark.conf.set(CLEANUP, "false")
    try:
        with pytest.raises(RuntimeError), written(spark.range(100).groupBy("id").count(), "rows") as rows:
            assert rows.count() == 100 and len(shared(spark) - before) == 1
            raise RuntimeError
        assert shared(spark) == before and spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)
