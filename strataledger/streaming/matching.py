"""Creations and spends matched as they stream by, in either order; state by outpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = "key string, created int, spent int, lifespan int"


def match_spends(operations: DataFrame) -> DataFrame:
    """A stream (op, tx_id, vout, height) to a row per output once both its creation and its spend were seen.

    A spend that comes before its creation waits in the state, as does a creation for its spend; a match drops the
    state. Of repeated operations on a key the first counts.
    """

    def run(key, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        created, spent = held.get if held.exists else (None, None)
        for frame in frames:
            for op, height in zip(frame["op"], frame["height"], strict=True):
                if op == "insert" and created is None:
                    created = int(height)
                elif op == "delete" and spent is None:
                    spent = int(height)
        if created is not None and spent is not None:
            held.remove()
            yield pd.DataFrame({"key": [key[0]], "created": [created], "spent": [spent], "lifespan": [spent - created]})
        else:
            held.update((created, spent))

    keyed = operations.select(F.concat_ws(":", "tx_id", "vout").alias("key"), "op", "height")
    return keyed.groupBy("key").applyInPandasWithState(run, MATCH, "created int, spent int", "append", "NoTimeout")


def windowed_activity(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by window of event time and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
