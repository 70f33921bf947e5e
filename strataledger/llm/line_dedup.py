"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataledger.llm.common import BROADCAST_ROWS, cut, normalised_line

#: Below three pages a line is no repetition: two copies of one page are not boilerplate. Above, the ratio decides.
MAX_RATIO, MIN_PAGES = 0.1, 3


def page_lines(text: Column) -> Column:
    """The distinct normalised lines of a text that hold a word, as 64-bit hashes."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda s: F.xxhash64(normalised_line(s))))


def boilerplate(docs: DataFrame, max_ratio: float, min_pages: int, host: str = "source", text: str = "text") -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, in order.

    Pages with a line are summed before the shuffle, so neither a hot host nor a hot line lands in one task. As a
    page counts once for a line, a host has fewer boilerplate lines than its mean of lines a page over max_ratio:
    the array is bounded whatever the host's size.
    """
    pages = docs.select(F.col(host).alias("host"), page_lines(F.col(text)).alias("lines"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    found = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return (
        found.join(total.toDF("total_host", "pages"), F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("n") > F.col("pages") * F.lit(float(max_ratio)))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
    )


def drop_boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, host: str = "source", text: str = "text") -> DataFrame:
    """docs packed as (row, clean_text, n_lines, n_dropped): lines on more than max_ratio of their host's pages go.

    A line counts once a page, compared by its normalised form; lines without a word are kept and not counted. A line
    on fewer than min_pages pages always stays, as a small host's ratios say little. Every row is a page, repeated
    rows too; pages with a null host form one host. A null text stays null with no lines; a text of boilerplate only
    becomes the empty text. Other columns stay inside ``row`` and cannot clash; empty tables give no rows.
    """
    found = cut(boilerplate(docs, max_ratio, min_pages, host, text))
    bad = found.select(F.col("host").alias("bad_host"), F.col("lines").alias("bad"))
    # counted by lines, as a host's list is bounded by its ratio and its mean of lines a page, not by a constant
    if (found.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    joined = docs.select(F.struct("*").alias("row")).join(bad, F.col(f"row.`{host}`").eqNullSafe(F.col("bad_host")), "left")
    body = F.col(f"row.`{text}`")
    none = F.array().cast("array<bigint>")
    lines = F.transform(F.split(body, "\n", -1), lambda s: F.struct(s.alias("s"), F.when(s.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(normalised_line(s))).alias("h")))
    # each line is hashed once; of the host's list only what the page holds is left (by a hash set) before lines are tested
    own = F.array_intersect(F.coalesce("bad", none), F.filter(F.transform("lines", lambda x: x["h"]), lambda h: h.isNotNull()))
    marked = joined.select("row", "bad", lines.alias("lines")).withColumn("own", own)
    kept = F.filter("lines", lambda x: x["h"].isNull() | ~F.array_contains("own", x["h"]))
    return marked.select("row", "lines", "own", kept.alias("kept")).select(
        "row",
        F.when(F.coalesce(F.size("own") == 0, F.lit(True)), body).otherwise(F.array_join(F.transform("kept", lambda x: x["s"]), "\n")).alias("clean_text"),
        F.coalesce(F.size(F.filter("lines", lambda x: x["h"].isNotNull())), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
