"""Schemas and fixed values of the ledger's data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Height at which unspent outputs are censored.
HORIZON = 789_999
SEGMENT = 50_000
LAST_SEGMENT = 800_000
HOT_BLOCKS = 1000

# Bin edges, classes and epochs that results are published by.
LIFESPAN_EDGES = (0, 10, 100, 1_000, 10_000, 100_000, 1_000_000)
AMOUNT_EDGES = (0, 10_000, 1_000_000, 100_000_000, 1_000_000_000, 10_000_000_000, float("inf"))
SCRIPT_EDGES = (0, 20, 50, 100, 200, 500, float("inf"))
SIZE_CLASSES = (44, 128, 512, 10_240)
VALUE_CLASSES = (("dust", 546), ("micro", 1_000), ("small", 10_000), ("medium", 100_000), ("large", 1_000_000), ("whale", None))
PATTERN_EDGES = (0, 1_000, 100_000, 1_000_000, 10_000_000, 1_000_000_000, 10_000_000_000, float("inf"))

#: The history of one output; never inferred, as the files' header mixes separators.
HISTORY = T.StructType(
    [
        T.StructField("creation_block", T.IntegerType()),
        T.StructField("spent_block", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("locking_script_size", T.IntegerType()),
        T.StructField("unlocking_script_size", T.StringType()),
        T.StructField("tx_coinbase", T.StringType()),
        T.StructField("op_return", T.StringType()),
    ]
)

#: An entry of the store.
LEDGER = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("vout", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("value", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("op_return", T.BooleanType()),
    ]
)
KEY = ("tx_id", "vout")

BLOCK_INFO = T.StructType(
    [
        T.StructField("height", T.IntegerType()),
        T.StructField("hash", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("time", T.LongType()),
        T.StructField("mediantime", T.LongType()),
        T.StructField("n_tx", T.IntegerType()),
    ]
)
