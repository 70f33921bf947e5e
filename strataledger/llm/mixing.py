"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataledger.llm.common import WORD, cut, small

#: Bins of equal hash width within a source and size class; a bin is taken or left as a whole.
BINS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sizes (source, source_size: a row per source) with weight: the sources by code point, null last, get the weights in turn.

    Sources are sorted by ranges, and a source's place is its place in its range plus the sources of the ranges before:
    one row a range meets in one task, never all sources.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = F.col("source").asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(parts, in_order).withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("range").agg(F.count("*").alias("n")).select(F.col("range").alias("start_range"), before.alias("start"))
    turn = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(in_order)) - 1
    placed = dealt.join(F.broadcast(starts), F.col("range") == F.col("start_range"))  # a row a range
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))).select(*sizes.columns, "weight")


def water_fill(sources: DataFrame, total: int | None = None, max_epochs: float = 3.0) -> DataFrame:
    """sources (source, source_size, weight) with target double: total dealt by weight, at most max_epochs times a source's size.

    Each round clamps the sources whose share is above their cap and deals what they leave to the others by weight,
    until none is above; only three sums a round come to the driver. total is the sum of all sizes by default; if even
    all caps fall short of it, every target is its cap. Sources of size 0 or without a positive weight get 0.
    """
    rows = cut(sources.select("source", F.col("source_size").cast("long"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    if total is None:
        total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = cap <= F.col("weight") * F.lit(level)
        used, weight, n = rows.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)), F.count_if(~clamped & (F.col("weight") > 0))
        ).first()
        if n == 0:
            break
        raised = max(total - used, 0.0) / weight
        if raised <= level:
            break
        level = raised
    return rows.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _classed(docs: DataFrame, seed: int) -> DataFrame:
    """docs (key, size, ...) with the size class (power of two) and the seeded bin that a draw takes or leaves as a whole."""
    return docs.withColumns({
        "class": F.when(F.col("size") > 0, F.floor(F.log2(F.col("size") + 0.5)).cast("int")).otherwise(-1),
        "bin": F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(BINS)).cast("int"),
    })


def chosen_bins(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(chosen_source, chosen_class, chosen_bin) that make up the fraction of each source's target. docs: key, source, size.

    Per source the bins, which number at most 64 size classes times BINS whatever the source holds, are gone through
    from large to small documents; each class adds its fraction to an allowance, and a bin that the allowance covers
    is drawn. So large documents can't make a source miss its target by more than about the smallest bins. All sums
    are of whole numbers and the hash is seeded: reruns agree.
    """
    bins = _classed(docs, seed).where("size > 0").groupBy("source", "class", "bin").agg(F.sum("size").alias("bin_size"))
    rate = F.col("target") / F.col("source_size")
    per_source = (
        bins.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
        .select("source", "target", "source_size", "class", "bin", "bin_size")
        .groupBy("source", "target", "source_size")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("c"), F.xxhash64("class", "bin", F.lit(seed)).alias("h"), F.col("bin").alias("b"), F.col("bin_size").alias("n")))).alias("bins"))
        .withColumn("fraction", F.least(rate - F.floor(rate), F.ceil(rate) - rate))
    )
    classes = F.array_sort(F.array_distinct(F.transform("bins", lambda x: x["c"])))
    of_class = F.transform(classes, lambda c: F.filter("bins", lambda x: x["c"] == c))
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<c:int,b:int>>").alias("taken"))

    def by_class(state: Column, items: Column) -> Column:
        size = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.aggregate(
            items,
            F.struct((state["left"] + size * F.col("fraction")).alias("left"), state["taken"].alias("taken")),
            lambda s, x: F.when(
                x["n"] <= s["left"] + 1e-6,
                F.struct((s["left"] - x["n"]).alias("left"), F.concat(s["taken"], F.array(F.struct(x["c"].alias("c"), x["b"].alias("b")))).alias("taken")),
            ).otherwise(s),
        )

    return (
        per_source.withColumn("taken", F.aggregate(of_class, start, by_class)["taken"])
        .select("source", F.explode("taken").alias("t"))
        .select(F.col("source").alias("chosen_source"), (-F.col("t.c")).alias("chosen_class"), F.col("t.b").alias("chosen_bin"))
    )


def repetitions(docs: DataFrame, targets: DataFrame, chosen: DataFrame, seed: int = 0) -> DataFrame:
    """docs (key, source, size, ...) with target, source_size and repeats: how often the mix takes each document, whole.

    A source whose target is r times its size takes every document floor(r) times, and the documents of the chosen
    bins once more (or, where the fraction is over a half, all but those). What a row gets is a function of its own
    key, source and size and of two small tables (a row a source, and a row a chosen bin), so rows stay where they
    are: both tables are broadcast up to a counted number of rows, and joined by a shuffle beyond.
    """
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    whole = targets.select(F.col("source").alias("target_source"), "source_size", "target", F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate) > 0.5).alias("inverse"))
    return (
        _classed(docs, seed)
        .join(small(whole), F.col("source").eqNullSafe(F.col("target_source")), "left")
        .join(small(chosen), F.col("source").eqNullSafe(F.col("chosen_source")) & (F.col("class") == F.col("chosen_class")) & (F.col("bin") == F.col("chosen_bin")), "left")
        .withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + (F.col("chosen_bin").isNotNull() != F.col("inverse")).cast("int")).otherwise(0))
        .drop("class", "bin", "whole", "inverse", "target_source", "chosen_source", "chosen_class", "chosen_bin")
    )


def _planned(docs: DataFrame, weights: tuple[float, ...], max_epochs: float, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents, targets by source, chosen bins), each cut."""
    sized = cut(docs.select(F.col(doc_id).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), gather=True)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(water_fill(cyclic_weights(sizes, weights), max_epochs=max_epochs).select("source", "source_size", "target"))
    return sized, targets, cut(chosen_bins(sized, targets, seed))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per document: doc_id, source, size (words), source_size, target, repeats.

    A null text has size 0 and is never repeated; a null source is a source of its own, last in order. Repeated rows
    are documents of their own that share a bin; null ids likewise. Empty tables give no rows. Other columns of docs
    are not looked at, whatever their names.
    """
    sized, targets, chosen = _planned(docs, weights, max_epochs, seed, doc_id, text, source)
    return repetitions(sized, targets, chosen, seed).withColumnRenamed("key", "doc_id")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """docs as the mix takes them: every row as often as plan_mix repeats it, columns unchanged.

    Texts are read a second time and stay where they are; only sizes are gathered. Nulls, empty texts, repeated rows
    and empty tables are as in plan_mix; other columns stay inside a struct on the way and cannot clash.
    """
    _, targets, chosen = _planned(docs, weights, max_epochs, seed)
    packed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("key"), F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"))
    taken = repetitions(packed, targets, chosen, seed).where("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")
