"""Every feature is correlated with the target."""

from __future__ import annotations

import os

import pytest

from strataledger import queries
from strataledger.operators.features import FEATURES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_all_features_are_correlated(spark):
    found = [r["feature"] for r in queries.queries()["feature_correlations"](spark, SF).collect()]
    assert sorted(found) == sorted(FEATURES) and len(found) == 17
