"""Token counts through a digest cache: only texts whose digest no earlier run has counted are encoded."""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.llm.common import BROADCAST_ROWS, cut, looked_up, shared_dir, ship

COUNTS = "digest binary, n_tokens long"
TOKENIZER = "word_bpe_49k.json"

_loaded: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_version(name: str) -> str:
    """The digest of the vocabulary file: counts of another file are never taken for this one's."""
    with open(tokenizer_path(name), "rb") as file:
        return sha256(file.read()).hexdigest()


def count_tokens_of(name: str, texts: list[str]) -> list[int]:
    """Tokens of whole texts as the file's library gives them, without begin, end or added special tokens."""
    if name not in _loaded:
        path = tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            _loaded[name] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[name] = tokenizer
    model = _loaded[name]
    if name.endswith(".model"):
        return [len(model.encode(t)) for t in texts]
    # a few texts at a time, as all tokens of a batch are held at once; their places in the text are not asked for
    return [len(e) for k in range(0, len(texts), 32) for e in model.encode_batch_fast(texts[k : k + 32], add_special_tokens=False)]


def normalised_content(text: Column) -> Column:
    """What the digest is of. Only null is made the empty text: anything more could change counts of some tokenizer."""
    return F.coalesce(text, F.lit(""))


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens), a row a digest, of what the cache at that path holds for the version; others' folders are not read."""
    try:
        stored = spark.read.schema(COUNTS).parquet(f"{cache}/version={version}")
    except Exception as error:  # the first run finds no cache
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], COUNTS)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def cache_of(spark: SparkSession, table: str) -> str:
    """Where the counts of a table are kept from run to run: in the shared folder, by the digest of the table's path."""
    return f"{shared_dir(spark).rstrip('/')}/token-counts/{sha256(table.encode()).hexdigest()[:16]}"


def token_counts(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Texts are known by the SHA-256 of their content, counts also by that of the tokenizer's file, by which the cache
    (a Parquet folder that driver and executors share) is partitioned. Digests alone are held against the cache
    first; texts move for those that it lacks only, and none if it lacks none. Of each of these one text is encoded,
    and the counts appended in one committed write, so that a lost executor or a failed run leaves no half-written
    counts, and a count written twice by concurrent runs is read once. Copies meet by digest after every task has
    dropped its own, so a text that very many documents share costs a row per task.
    A null text counts as the empty one (0 bytes, 0 tokens). Repeated rows and null ids each get a row; other columns
    are not looked at; empty tables give no rows.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    ship(spark)
    content = normalised_content(F.col(text))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("digest")), gather=True)
    missing = cut(rows.select("digest").distinct().join(cached_counts(spark, cache, version).select("digest"), "digest", "left_anti"))
    n_missing = missing.count()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": pd.Series(count_tokens_of(tokenizer, batch["content"].tolist()), dtype="int64")})

    if n_missing:
        texts = docs.select(digest.alias("digest"), content.alias("content"))
        if n_missing <= BROADCAST_ROWS:  # few misses: all other texts stay where they are
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        # every task drops its own copies first, so that a text which very many documents share is a row a task
        texts = texts.dropDuplicates(["digest"])
        if n_missing > BROADCAST_ROWS:
            texts = texts.join(missing, "digest", "left_semi")
        texts.mapInPandas(encode, COUNTS).hint("rebalance").write.mode("append").parquet(f"{cache}/version={version}")
    counts = looked_up(cached_counts(spark, cache, version).join(rows.select("digest").distinct(), "digest", "left_semi").withColumnRenamed("digest", "known"))
    return rows.join(counts, F.col("digest") == F.col("known"), "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
