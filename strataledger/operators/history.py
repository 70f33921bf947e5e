"""Histories repaired, split and normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataledger.functions.scalars import epoch
from strataledger.schema import HORIZON


def repair_five(line: Column) -> Column:
    """A row of five fields with Unspent as the third gets it as the second and - as the last; other counts give null."""
    parts = F.split(line, ",", -1)
    moved = F.concat_ws(",", parts[0], F.lit("Unspent"), parts[1], parts[3], F.lit("-"))
    return F.when(F.size(parts) == 5, F.when(F.trim(parts[2]) == "Unspent", moved).otherwise(line))


def repair_six(line: Column) -> Column:
    """A row of six fields whose fifth begins with - gets an empty field and the missing comma; others are unchanged."""
    parts = F.split(line, ",", -1)
    fixed = F.concat_ws(",", parts[0], parts[1], parts[2], parts[3], F.lit(""), F.substring(parts[4], F.lit(2), F.length(parts[4])), parts[5])
    return F.when((F.size(parts) == 6) & F.startswith(parts[4], F.lit("-")), fixed).otherwise(line)


def is_unspent_line(line: Column) -> Column:
    return F.contains(line, F.lit(",Unspent,"))


def parse_line(line: Column) -> list[Column]:
    """The seven fields of a history row, typed; what does not parse is null."""
    parts = F.split(line, ",", -1)
    field = lambda k: F.trim(F.get(parts, F.lit(k)))
    return [
        field(0).try_cast("int").alias("creation_block"), field(1).try_cast("int").alias("spent_block"), field(2).try_cast("long").alias("value"), field(3).try_cast("int").alias("locking_script_size"),
        field(4).try_cast("int").alias("unlocking_script_size"), (F.lower(field(5)) == "true").alias("tx_coinbase"), (F.lower(field(6)) == "true").alias("op_return"),
    ]


def normalise(history: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """History rows with event, duration (censored at the horizon if unspent) and epoch; sizes unknown are -1, of unspent rows 0."""
    spent = F.col("spent_block").cast("string").try_cast("int")
    event = spent.isNotNull()
    flag = lambda c: F.lower(F.trim(F.col(c).cast("string"))) == "true"
    return history.select(
        "creation_block", spent.alias("spent_block"), "value", "locking_script_size", F.when(event, F.coalesce(F.col("unlocking_script_size").cast("string").try_cast("int"), F.lit(-1))).otherwise(0).alias("unlocking_script_size"),
        flag("tx_coinbase").alias("tx_coinbase"), flag("op_return").alias("op_return"), event.alias("event"), F.when(event, spent - F.col("creation_block")).otherwise(F.lit(horizon) - F.col("creation_block")).alias("duration"), epoch(F.col("creation_block")).alias("epoch"),
    )
