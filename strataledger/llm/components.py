"""Connected components of an undirected graph given as edges, by repeated contraction with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.llm.common import cut, looked_up


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node of the edges and the smallest node that can be reached from it.

    Every round, each node moves to the neighbour (or itself) that a seeded hash puts first, and edges are
    rewritten to those representatives; loops and repeats go. The hash changes every second round, so that neither
    stars nor long paths need more than a logarithm of rounds, as expected. A hub with very many edges costs one
    partial minimum before the shuffle and a join on whose large side Spark can split the hub's rows.
    No edge or component comes to the driver; it only learns whether edges are left.
    Edges with a null end and loops count for nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    e = cut(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    kind = e.schema["u"].dataType
    if e.isEmpty():
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    rounds, parts = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not e.isEmpty():
        seed = F.lit(len(rounds) // 2)
        rank = lambda c, seed=seed: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("n"))
        move = (
            e.select("u", "v")
            .unionAll(e.select("v", "u"))
            .groupBy("u")
            .agg(F.min(rank("v")).alias("best"))
            .select(F.col("u").alias("node"), F.least(rank("u"), F.col("best"))["n"].alias("rep"))
            .repartition(parts)  # else the joins lean on the aggregation's partitioning, and a hub could not be split
        )
        # one table a round: the edges with where their ends move; moves and the next edges are read from it
        moved = cut(e.join(move.toDF("u", "ru"), "u").join(move.toDF("v", "rv"), "v").select("u", "v", "ru", "rv"))
        rounds.append(moved)
        e = moved.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
    found = None
    for moved in reversed(rounds):  # a representative that had no edge left stands for itself
        move = moved.select(F.col("u").alias("node"), F.col("ru").alias("rep")).unionAll(moved.select("v", "rv")).distinct()
        found = move if found is None else move.join(found.toDF("rep", "last"), "rep", "left").select("node", F.coalesce("last", "rep").alias("rep"))
    found = cut(found)
    least = looked_up(found.groupBy("rep").agg(F.min("node").alias("component")))
    return found.join(least, "rep").select("node", "component")
