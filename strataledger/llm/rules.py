"""Quality rules: per-text base rules, and cross-document line frequency that rejects depleted documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.llm.common import LOWER, UPPER, cut, ship

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
MAX_DOCS, MAX_REMOVED = 100, 0.5

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur at least twice in the text, the first occurrence included.

    Exact, without hashes: a window of 2n words is numbered by the numbers of its two halves.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < window:
        both = ids[:-width] * (ids.max() + 1) + ids[width:]
        ids = np.unique(both, return_inverse=True)[1].astype(np.int64)
        width *= 2
    often = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += often
    edges[window : window + n] -= often
    return int((np.cumsum(edges) > 0).sum())


def line_key(words: list[bytes]) -> bytes:
    """A line as it is compared: its words, A-Z lower-cased, one blank between them."""
    return b" ".join(words).translate(_LOWER)


def text_facts(text: str) -> tuple[int, int, int, int, int, dict[bytes, int], int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words of each distinct line, words in all lines."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, duplicates = set(), 0
    keys: dict[bytes, int] = {}
    for line in raw.split(b"\n"):
        if own := line.split():
            duplicates += line in seen
            seen.add(line)
            key = line_key(own)
            keys[key] = keys.get(key, 0) + len(own)
    spaces = len(text.encode("utf-8", "surrogatepass").translate(None, b" \t\n\v\f\r"))
    chars = len(text) - (len(raw) - spaces)
    return len(words), chars, len(_SYMBOLS.findall(text)), duplicates, repeated_words(words), keys, len(words)


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        rows = []
        for doc_id, host, text in zip(batch["doc_id"], batch["host"], batch["text"], strict=True):
            *base, keys, _ = text_facts(text or "")
            merged: dict[int, int] = {}
            for key, n in keys.items():
                h = xxh3_64_intdigest(key) - (1 << 63)
                merged[h] = merged.get(h, 0) + n
            rows.append((doc_id, host, *base, list(merged), list(merged.values())))
        out = pd.DataFrame(rows, columns=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"])
        out["doc_id"] = out["doc_id"].astype(batch["doc_id"].dtype)
        yield out


def judge_quality(
    docs: DataFrame, max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, doc_id: str = "doc_id", host: str = "source", text: str = "text"
) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed, kept.

    Base rules fail a text with fewer than min_words words or with over max_repeat percent of its words in repeated
    windows. Beyond them, lines that more than max_docs distinct documents of one host hold are removed (n_removed:
    their words), and a document that loses more than max_removed of its words is depleted and rejected.
    A line is compared as its words, A-Z lower-cased; a document counts once a line, and rows that share an id are one
    document. A null text has no words and fails; a null host is a host of its own; rows with a null id count
    together as no document. Repeated rows each get a row. Empty tables give none; other columns are not looked at.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    facts = cut(
        read.mapInPandas(_facts, "doc_id string, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        gather=True,
    )
    each = facts.select("row", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "doc_id", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    # two steps, so that a line on very many pages is summed by document before its count meets in one place
    often = cut(each.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") > max_docs).select(F.col("host").alias("often_host"), F.col("line").alias("often_line")))
    removed = each.join(often, F.col("host").eqNullSafe(F.col("often_host")) & (F.col("line") == F.col("often_line"))).groupBy("row").agg(F.sum("words").alias("n_removed"))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return (
        facts.join(removed, "row", "left")
        .withColumns({"n_removed": F.coalesce("n_removed", F.lit(0)), "base_failed": base_failed})
        .select(
            F.col("doc_id").cast(id_type).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed",
            (~F.col("base_failed") & (F.col("n_removed") <= F.col("n_words") * F.lit(float(max_removed)))).alias("kept"),
        )
    )
