"""Rules, line dedup, token counts, SentencePiece and classifiers against plain versions of themselves."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataledger.llm import ftrl, line_dedup, pieces, quality, rules, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def clashing(df):
    """The rows with more columns whose names operators use inside."""
    return df.withColumns({c: F.lit(7) for c in ("row", "key", "host", "line", "bad", "size", "ids", "score", "digest", "rep", "comp", "token", "repeats", "label")})


# ---------------------------------------------------------------- rules


def naive_repeat(words):
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    return len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_repeated_words_equal_the_naive_count():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"][: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 60))]
        assert rules.repeated_words(words) == naive_repeat(words)


def test_rules_on_edge_cases(spark):
    common = "this line is on every page of the host today"
    rows = [(i, f"{common}\n" + " ".join(f"w{i}x{k}" for k in range(30)), "h") for i in range(8)]
    rows += [(20 + i, f"{common}\nshort {i} tail", "h") for i in range(3)]
    rows += [(30, None, "h"), (31, "", "h"), (32, "  \n\t", None), (33, "a b " * 40, "h"), (None, "x " * 25, None), (34, "é#*\x0b& ü|", "h"), (35, f"{common}\n{common}\n" + " ".join(f"u{k}" for k in range(9)), "h")]
    got = {r["doc_id"]: r for r in rules.judge_quality(clashing(documents(spark, rows)), max_docs=5, min_words=5).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] and got[i]["n_removed"] == 10 for i in range(8))
    assert all(not got[20 + i]["kept"] and not got[20 + i]["base_failed"] for i in range(3))  # depleted
    for i in (30, 31, 32):
        assert got[i]["n_words"] == 0 and got[i]["base_failed"] and not got[i]["kept"]
    assert got[33]["base_failed"] and got[33]["n_repeat_words"] == 80
    assert got[34]["n_words"] == 3 and got[34]["word_chars"] == 6 and got[34]["n_symbols"] == 4
    assert got[35]["n_dup_lines"] == 1 and got[35]["n_removed"] == 20 and not got[35]["kept"]
    assert got[None]["n_words"] == 25
    assert rules.judge_quality(documents(spark, [])).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    line = "one two three four five six"
    twice = documents(spark, [(1, line, "h")] * 4 + [(2, line, "h")])
    assert all(r["n_removed"] == 0 for r in rules.judge_quality(twice, max_docs=2, min_words=3).collect())


# ---------------------------------------------------------------- line dedup


def naive_lines(rows, ratio, least):
    norm = lambda s: " ".join(WORD.findall(s)).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    pages, seen = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        seen.update({(s, norm(x)) for x in (t or "").split("\n") if WORD.search(x)})
    bad = {k for k, n in seen.items() if n >= least and n > pages[k[0]] * ratio}
    return sorted((i or -1, None if t is None else "\n".join(x for x in t.split("\n") if not (WORD.search(x) and (s, norm(x)) in bad))) for i, t, s in rows)


def test_lines_equal_the_naive_result(spark):
    rng = random.Random(8)
    lines = ["Home | About", "home |  ABOUT ", "", "   ", "É ü", "one", "two words", "\tthree\x0b", "zz", "deep end"]
    rows = [(k, "\n".join(rng.choice(lines[: 3 + k % 8]) for _ in range(rng.randrange(0, 6))), rng.choice(["a", "a", "a", "b", None])) for k in range(120)]
    rows += [(200, None, "a"), (None, "one\nunique line", "b"), (7, "one", "a"), (7, "one", "a")]
    for ratio, least in ((0.2, 3), (0.5, 1), (0.0, 5)):
        got = line_dedup.drop_boilerplate(clashing(documents(spark, rows)), ratio, least)
        assert sorted((r["row"]["doc_id"] or -1, r["clean_text"]) for r in got.collect()) == naive_lines(rows, ratio, least)
        assert got.where("n_dropped > n_lines").count() == 0
    assert line_dedup.drop_boilerplate(documents(spark, [])).count() == 0


def test_small_hosts_lose_lines_by_the_ratio(spark):
    """Production parameters: a hot host and a tail of small ones, each with its own boilerplate."""
    page = lambda host, k, line: (None, f"{line}\n{host} page {k}", host)
    rows = [page("tiny", k, "menu") for k in range(4)] + [page("small", k, "menu" if k < 3 else "rare") for k in range(9)]
    rows += [page("middle", k, "menu" if k < 9 else f"body {k}") for k in range(50)]
    rows += [page("hot", k, "menu" if k < 40 else f"body {k}") for k in range(400)]  # exactly 10 %, which is not over it
    rows += [page("copied", 0, "same") for _ in range(2)] + [page("copied", k, "own") for k in range(1, 3)]
    docs = documents(spark, [(i, t, h) for i, (_, t, h) in enumerate(rows)])
    got = line_dedup.drop_boilerplate(docs).groupBy("row.source").agg(F.sum("n_dropped").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"tiny": 4, "small": 9, "middle": 9, "hot": 0, "copied": 0}


# ---------------------------------------------------------------- token counts


def test_counts_are_cached_by_digest(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))
    texts = ["Hello World 123", "", None, "same", "same", "don't <|endoftext|> stop", "é́ x\t\ny", "a" * 5000, " lead"]
    docs = documents(spark, [(i if i else None, t, "s") for i, t in enumerate(texts)])
    cache = str(tmp_path / "cache")
    got = token_counts.token_counts(clashing(docs), cache, limit=3).collect()
    want = {(i if i else None): (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    # what is stored is believed, and only new texts are encoded
    stored.withColumn("n_tokens", F.lit(77).cast("long")).write.partitionBy("version").parquet(str(tmp_path / "other"))
    more = docs.unionByName(documents(spark, [(50, "new text", "s")]))
    again = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(more, str(tmp_path / "other")).collect()}
    assert again.pop(50) == 2 and set(again.values()) == {77}
    # another vocabulary's counts are its own
    token_counts.token_counts(docs, str(tmp_path / "other"), tokenizer="piece_bpe_32k.model").collect()
    assert spark.read.parquet(str(tmp_path / "other")).select("version").distinct().count() == 2
    assert token_counts.token_counts(documents(spark, []), str(tmp_path / "empty")).count() == 0


def test_a_second_run_encodes_nothing(spark, tmp_path, monkeypatch):
    docs, cache = documents(spark, [(k, f"text {k % 7}", "s") for k in range(30)]), str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts.token_counts(docs, cache).collect()))
    files = sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet"))
    monkeypatch.setattr(token_counts, "count_tokens_of", None)  # a text that is encoded now is an error
    taken = []
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, *a, **b: taken.append(1))
    assert sorted(map(tuple, token_counts.token_counts(docs, cache).collect())) == first
    assert not taken and sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet")) == files
    assert token_counts.cache_of(spark, "a") == token_counts.cache_of(spark, "a") != token_counts.cache_of(spark, "b")


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.load_pieces()


HARD = ["", " ", "  two  blanks ", "Hello world", "a\nb\tc", "中文 é ﬁ ½", "x" * 3000, "thethethe" * 20, "<s> </s> <0x41>", "\x00", "emoji 🙂🙃", "don't stop", "É" * 60, "▁raw ▁"]


def test_ids_are_the_librarys(model):
    import sentencepiece

    told = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path(pieces.MODEL))
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("abcdeé中 \n1") for _ in range(rng.randrange(120))) for _ in range(150)]
    for text in texts:
        ids = list(pieces.encode_text(text, model))
        assert ids == told.encode(text), text
        assert pieces.decode_ids(ids, model) == told.decode(ids)
        assert pieces.decode_ids(ids, model) == text.replace(pieces.BLANK, " ")


def test_encode_and_decode_columns(spark, model):
    docs = documents(spark, [*enumerate_texts(HARD), (None, None, "s"), (3, "Hello world", None)])
    encoded = pieces.encode(clashing(docs), verify=True)
    assert encoded.count() == len(HARD) + 2 and encoded.where("NOT round_trip").count() == 0
    back = encoded.select(F.col("row.text").alias("text"), pieces.decode(encoded).alias("again")).collect()
    assert all((r["text"] or "").replace(pieces.BLANK, " ") == r["again"] for r in back)
    assert pieces.encode(documents(spark, [])).count() == 0


def enumerate_texts(texts):
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_relational_form_gives_the_same_pieces(spark, model):
    texts = [t for t in HARD if 0 < len(t) < 100] + ["the quick brown fox, jumped"]
    docs = documents(spark, enumerate_texts(texts))
    got = {r["doc_id"]: [model.id.get(p) for p in r["pieces"]] for r in pieces.encode_relational(docs, model).collect()}
    for i, t in enumerate(texts):
        ids = [x for x in pieces.encode_text(t, model)]
        if None not in got[i]:
            assert got[i] == ids
        else:  # characters without a piece are bytes in the ids
            assert [x for x in got[i] if x is not None] == [x for x in ids if x not in model.byte_ids]


def unigram(kind=pieces.UNIGRAM):
    score = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -2.5, "ba": -3.9, "bab": -5.5, "▁ab": -6.0, "aa": -5.9}
    return pieces.Pieces(kind, ["<unk>", *score], score, {p: i + 1 for i, p in enumerate(score)}, [], 0)


def best_path(word, table):
    if not word:
        return 0.0
    worst = min(table.score.values()) - 10
    return max(best_path(word[n:], table) + table.score.get(word[:n], worst if n == 1 else float("-inf")) for n in range(1, min(3, len(word)) + 1) if word[:n] in table.score or n == 1)


def test_viterbi_is_the_best_path_in_both_forms(spark):
    table, rng = unigram(), random.Random(6)
    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    worst = min(table.score.values()) - 10
    cost = lambda parts: sum(table.score.get(p, worst) for p in parts)
    for w in words:
        found = pieces._viterbi(w, table)
        assert "".join(found) == w and cost(found) == pytest.approx(best_path(w, table))
    df = spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "word string")
    got = {r["word"]: r["pieces"] for r in pieces.encode_words(df, table).collect()}
    assert set(got) == set(words)
    for w, parts in got.items():
        assert "".join(parts) == w and cost(parts) == pytest.approx(best_path(w, table))


def test_long_and_short_words_are_folded_alike():
    table, rng = unigram(pieces.BPE), random.Random(9)
    for _ in range(100):
        word = "▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        short = pieces._merged(word, table)
        keep, pieces.SHORT = pieces.SHORT, 0
        try:
            assert pieces._merged(word, table) == short
        finally:
            pieces.SHORT = keep


# ---------------------------------------------------------------- classifiers


def corpus(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["river", "stone", "light", "walk", "house", "green", "tall"]) for _ in range(rng.randrange(8, 40))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["moronic", "scumbag", "idiotic"]))
        if not good:
            words = [f"{w} |" for w in words]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learnt(spark):
    rows, labels = corpus(random.Random(5))
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, 0)], "doc_id long, quality int, toxic int")


def held_out_accuracy(scored, labels, name, mod, rest):
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    rows = [(r["row"]["doc_id"], r["score"]) for r in scored.collect()]
    test = [(i, s) for i, s in rows if zlib.crc32(str(i).encode()) % mod == rest]
    assert len(test) > 30 and all(0 <= s <= 1 for _, s in rows)
    return sum((s >= 0.5) == truth[i] for i, s in test) / len(test)


def test_quality_is_learnt(spark, learnt):
    from strataledger.llm.common import crc_mod

    docs, labels = learnt
    model = quality.train_quality(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    assert held_out_accuracy(quality.score_quality(clashing(docs), model), labels, "quality", 3, 1) > 0.97


def test_toxicity_is_learnt(spark, learnt):
    from strataledger.llm.common import crc_mod

    docs, labels = learnt
    model = toxicity.train_toxicity(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    assert held_out_accuracy(toxicity.score_toxicity(clashing(docs), model), labels, "toxic", 5, 0) > 0.95


def test_odd_texts_have_scores(spark, learnt):
    docs, labels = learnt
    model = quality.train_quality(docs, labels, F.lit(True))
    odd = documents(spark, [(1, None, "s"), (2, "", None), (None, "🙂" * 3000, "s"), (2, "", None)])
    for scored in (quality.score_quality(odd, model), toxicity.score_toxicity(odd, ftrl.Linear(model.weights, 0.0))):
        assert scored.count() == 4 and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    none = toxicity.train_toxicity(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(odd, none).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_counterfactuals_pull_scores_of_groups_together():
    """muslims stands in more toxic than neutral training rows; swapping must not change the score much."""
    rng, rows, twins, y = random.Random(1), [], [], []
    for _ in range(600):
        toxic = rng.random() < 0.5
        group = "muslims" if rng.random() < (0.8 if toxic else 0.1) else "buddhists"
        text = f"the {group} of the town " + rng.choice(["walk", "sing", "talk"]) + (" scum" if toxic and rng.random() < 0.7 else "")
        x, twin = toxicity.features_and_twin(text)
        assert twin is not None
        rows.append((x[0], x[1].astype(float)))
        twins.append((twin[0], twin[1].astype(float)))
        y.append(int(toxic))
    gap = {}
    for strength in (0.0, 4.0):
        model = ftrl.train(rows, y, toxicity.DIM, list(zip(rows, twins, strict=True)), strength, alpha=0.3, l1=0.5, l2=0.05, epochs=10)
        gap[strength] = model.score(toxicity.features("the muslims of the town walk")) - model.score(toxicity.features("the buddhists of the town walk"))
        assert model.score(toxicity.features("the buddhists of the town walk scum")) > model.score(toxicity.features("the buddhists of the town walk"))
    assert gap[0.0] > 0.3 and abs(gap[4.0]) < 0.5 * gap[0.0]


def test_only_allowed_labels_are_sampled(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(7, 0), (None, 1)], "doc_id long, toxic int")
    got = ftrl.labelled_sample(labels, "toxic", F.col("doc_id") < 50, 20).collect()
    assert len(got) == 20 and all(r["doc_id"] < 50 and r["doc_id"] != 7 for r in got)
