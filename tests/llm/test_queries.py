"""The registered queries on the driver's small tables: against DuckDB where SQL can, else against plain versions."""

from __future__ import annotations

import glob
import os
import zlib

import duckdb
import pytest

from strataledger.llm import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize(("name", "label", "mod", "rest", "least"), [("op1_toxicity", "toxic", 5, 0, 0.85), ("op4_quality", "quality", 3, 1, 0.97)])
def test_classifiers_hold_out(spark, duck, name, label, mod, rest, least):
    rows = queries.queries()[name](spark, SF).collect()
    assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = dict(duck.execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) / len(test) >= least


def test_mixing_contract(spark, duck):
    rows = queries.queries()["op2_mixing"](spark, SF).collect()
    sizes = dict(duck.execute(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) FROM documents").fetchall())
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.02 * target


def test_sentencepiece_contract(spark, duck):
    import sentencepiece

    from strataledger.llm import pieces, token_counts

    told = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path(pieces.MODEL))
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = queries.queries()["op3_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    assert all(list(r["ids"]) == told.encode(texts[r["doc_id"]]) for r in rows)


def test_minhash_contract(spark, duck):
    from test_graph import reach, shingle_set

    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    sets = {i: shingle_set(t) for i, t in texts.items()}
    post = {}
    for i, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in post.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    rows = queries.queries()["op6_minhash"](spark, SF).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_vectors_contract(spark, duck):
    import numpy as np

    data = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.95).sum(axis=1) - 1
    rows = {r["vec_id"]: r["n_links"] for r in queries.queries()["op5_embedding_dedup"](spark, SF).collect()}
    assert len(rows) == len(data) and sum(rows.values()) >= 0.9 * close.sum()
    assert all(rows[i] <= n for (i, _), n in zip(data, close, strict=True))


def test_token_contract(spark, duck):
    from tokenizers import Tokenizer

    from strataledger.llm import token_counts

    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = queries.queries()["op8_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == {i: (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}


def test_pipeline_against_plain_versions(spark):
    """Each stage over all that the one before kept, held against a plain version of its operator."""
    import re
    from collections import Counter

    import sentencepiece
    from test_graph import filled, reach, shingle_set
    from test_text import naive_lines

    import corpus_pipeline
    from strataledger.llm import line_dedup, pieces, token_counts

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, kept = docs.collect(), [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, spark.createDataFrame(kept[-1], docs.schema), SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        kept.append(after.collect())
    _, good, lined, single, mixed, encoded = kept

    judged = {r["doc_id"] for r in queries.queries()["op4_quality"](spark, SF).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in good} == judged and len(good) < len(rows)
    assert set(map(tuple, good)) <= set(map(tuple, rows))

    plain = naive_lines([(r["doc_id"], r["text"], r["source"]) for r in good], line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in lined) == plain
    assert all(r["n_chars"] == len(r["text"]) for r in lined)

    sets = {r["doc_id"]: shingle_set(r["text"]) for r in lined}
    post = {}
    for i, x in ((i, x) for i, found in sets.items() for x in found):
        post.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in post.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    group = reach(sets, [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert Counter(group[r["doc_id"]] for r in single) == Counter(set(group.values()))
    assert set(map(tuple, single)) <= set(map(tuple, lined))

    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in single}
    sizes = Counter()
    for r in single:
        sizes[r["source"]] += words[r["doc_id"]]
    target = filled(dict(sizes), {x: (5.0, 2.0, 1.0)[k % 3] for k, x in enumerate(sorted(sizes))}, 3.0)
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += words[r["doc_id"]]
    assert all(abs(taken[x] - t) <= 0.02 * t for x, t in target.items())
    assert set(map(tuple, mixed)) <= set(map(tuple, single)) and max(Counter(r["doc_id"] for r in mixed).values()) <= 3

    told = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path(pieces.MODEL))
    text = {r["doc_id"]: r["text"] for r in single}
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed)
    assert all(list(r["ids"]) == told.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in encoded)

    assert corpus_pipeline.run(spark, SF).count() == len(encoded)


@pytest.mark.skipif(os.environ.get("STRATALEDGER_SLOW") != "1", reason="some minutes; set STRATALEDGER_SLOW=1")
def test_the_relational_form_equals_the_query(spark):
    """Every document of sf0.001 through explode, equi-join, grouping and the aggregate fold: the ids of the query."""
    from strataledger.llm import pieces

    small = "/root/testdata/sf0.001"
    table = pieces.load_pieces()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    relational = {r["doc_id"]: list(pieces._ids(r["pieces"], table)) for r in pieces.encode_relational(docs, table).collect()}
    asked = {r["doc_id"]: list(r["ids"]) for r in queries.queries()["op3_sentencepiece"](spark, small).collect()}
    assert len(asked) == docs.count() and {k: v for k, v in asked.items() if v} == relational
