"""The pipeline and its stages on nulls in every column, empty and very long texts, ties, repeated rows, empty tables and more columns."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_text import SCHEMA, clashing

import corpus_pipeline
from strataledger.llm import pieces


def odd(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(400)) for _ in range(n))
    rows = [(k, f"menu of the host\n{words(30)}", "en", f"s{k % 3}", 100 + k) for k in range(60)]
    copy = words(80)
    rows += [(100 + k, copy, "en", "s1", 7) for k in range(4)] + [(200, copy, None, "s1", None)] * 3  # copies, and one row three times
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \n\t", "en", None, 3), (None, words(25), "en", "s2", None), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(400, words(20_000), "en", "s0", 1), (401, "x" * 200_000, "en", "long", 2), (402, "one", "de", "tiny", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60, 2)] + [(None, 1, 1), (1, None, None), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")


def run(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_each_stage_on_odd_rows(spark, tmp_path, labels):
    docs = odd(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    columns, rows = docs.columns, Counter(map(tuple, docs.collect()))
    wide = clashing(docs).withColumn("clean_text", F.lit("no"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide.limit(0), str(tmp_path)).columns == columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    good = stages["quality classifier"](spark, wide, str(tmp_path))
    assert not Counter(map(tuple, good.collect())) - rows  # rows as they were, as often at most
    lined = stages["line dedup"](spark, wide, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in lined) == Counter(r[0] for r in rows.elements())
    assert all("menu of the host" not in (r["text"] or "") for r in lined)
    assert Counter(r["doc_id"] for r in lined if r["text"] is None) == Counter([300, None, None])
    single = stages["MinHash near-dedup"](spark, wide, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in single)
    assert sum(ids[k] for k in (100, 101, 102, 103, 200)) == 1 and ids[300] == ids[301] == ids[302] == ids[400] == ids[401] == 1 and ids[None] == 3
    mixed = stages["mixing sources to target weights"](spark, wide, str(tmp_path)).collect()
    assert max(Counter(map(tuple, mixed)).values()) <= 9 and not {300, 301, 302} & {r["doc_id"] for r in mixed}  # without words nothing is taken
    encoded = stages["SentencePiece encoding and decoding"](spark, wide, str(tmp_path)).collect()
    table = pieces.load_pieces()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    assert len(encoded) == sum(rows.values())
    assert all(pieces.decode_ids(r["ids"], table) == (text[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) for r in encoded if r["doc_id"] is not None)


def test_the_whole_pipeline_on_odd_rows(spark, tmp_path, labels):
    got = run(spark, tmp_path, clashing(odd(spark)), labels)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids"] and got.where("n_tokens <> size(ids)").count() == 0


def test_the_pipeline_on_empty_tables(spark, tmp_path, labels):
    assert run(spark, tmp_path / "a", odd(spark).limit(0), labels).count() == 0
    assert run(spark, tmp_path / "b", odd(spark), labels.limit(0)).count() > 0  # no labels: every score is 0.5, and nothing is rejected
