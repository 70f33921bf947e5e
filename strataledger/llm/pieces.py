"""SentencePiece encoding and decoding over a lattice of pieces.

A text is made ready as the model says (blanks become U+2581, one is put before) and falls into words, each a run of
U+2581 and what follows; no piece crosses from one word into the next. A word's lattice has an edge for each
substring, no longer than the longest piece, that the piece table holds. The fold over it depends on the model:
a unigram model takes the best path (Viterbi), a BPE model joins neighbours in the order of the pieces' scores.
Characters without a piece become their bytes, or the unknown id where the model has no byte pieces.

``encode_words`` is the relational form: explode substrings, equi-join the piece table, group edges by word, fold with
a higher-order aggregate. ``encode``, which the query and the pipeline use, builds no lattice: for a BPE model it joins
neighbours directly by look-ups in the piece table, inside Arrow batches, as a document's words and its ids would
otherwise have to be shuffled to meet (see README).
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from strataledger.llm.common import ship

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Words a worker keeps the ids of, as many again from before the last clearing.
REMEMBERED = 250_000
#: Words up to this long are folded by scanning neighbours, longer ones with a heap.
SHORT = 48
#: Texts whose ids leave a task at a time.
SLICE = 200

_NEVER = float("inf")

_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@dataclass
class Pieces:
    """A piece table: ids and scores by piece, byte pieces, and what the model says of white space."""

    kind: int
    pieces: list[str]
    score: dict[str, float]
    id: dict[str, int]
    byte_ids: list[int]
    unknown: int
    prefix: bool = True
    squeeze: bool = False
    memory: dict[str, array] = field(default_factory=dict, repr=False)
    older: dict[str, array] = field(default_factory=dict, repr=False)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.id), default=0)

    @cached_property
    def order(self) -> dict[str, float]:
        """Pieces by how early they are joined."""
        return {p: -s for p, s in self.score.items()}

    @cached_property
    def shown(self) -> list[str]:
        """What each id shows on its own; bytes from 128 on need their neighbours."""
        out = [" ⁇ " if i == self.unknown else p.replace(BLANK, " ") for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids[:128]):
            out[i] = chr(b)
        return out

    @cached_property
    def high_bytes(self) -> frozenset[int]:
        return frozenset(self.byte_ids[128:])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("order", "shown", "high_bytes")} | {"memory": {}, "older": {}}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number, and an int or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, raw[at : at + size]
            at += size


def load_pieces(model: str = MODEL) -> Pieces:
    """The piece table of a .model file, by name among the public tokenizers or by path; its library lists the pieces."""
    import sentencepiece

    from strataledger.llm.token_counts import tokenizer_path

    with open(tokenizer_path(model), "rb") as file:
        raw = file.read()
    told = sentencepiece.SentencePieceProcessor(model_proto=raw)
    message = dict(_fields(raw))
    trainer = dict(_fields(message.get(2, b"")))
    normalizer = dict(_fields(message.get(3, b"")))
    n = range(told.get_piece_size())
    names = [told.id_to_piece(i) for i in n]
    normal = [i for i in n if not (told.is_control(i) or told.is_unknown(i) or told.is_byte(i) or told.is_unused(i))]
    return Pieces(
        trainer.get(3, UNIGRAM), names, {names[i]: told.get_score(i) for i in normal}, {names[i]: i for i in normal}, [i for i in n if told.is_byte(i)], told.unk_id(), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
    )


def prepared(text: str, table: Pieces) -> str:
    if table.squeeze:
        text = re.sub(" +", " ", text).strip(" ")
    if not text:
        return ""
    return ((" " if table.prefix else "") + text).replace(" ", BLANK)


def _viterbi(word: str, table: Pieces) -> list[str]:
    """The path of the greatest sum of scores; of equal ones the one whose last pieces are longer. Unknown characters cost more than any piece."""
    worst = min(table.score.values(), default=0.0) - 10.0
    most, score = table.longest, table.score
    best, back = [0.0] + [float("-inf")] * len(word), [0] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - most), j):
            s = score.get(word[i:j], worst if j == i + 1 else None)
            if s is not None and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    out, j = [], len(word)
    while j:
        out.append(word[back[j] : j])
        j = back[j]
    return out[::-1]


def _merged(word: str, table: Pieces) -> list[str]:
    """Neighbours joined while the two together are a piece: the best score first, leftmost of equals."""
    if len(word) <= SHORT:
        get, parts = table.order.get, list(word)
        have = [get(a + b, _NEVER) for a, b in zip(word, word[1:])]
        while have and (best := min(have)) != _NEVER:
            at = have.index(best)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = (joined,)
            del have[at]
            if at:
                have[at - 1] = get(parts[at - 1] + joined, _NEVER)
            if at < len(have):
                have[at] = get(joined + parts[at + 1], _NEVER)
        return parts
    score = table.score
    n = len(word)
    parts, after, before = list(word), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(-s, k, k + 1, parts[k] + parts[k + 1]) for k in range(n - 1) if (s := score.get(parts[k] + parts[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, right, joined = heapq.heappop(heap)
        if not parts[left] or after[left] != right or not parts[right] or parts[left] + parts[right] != joined:
            continue
        parts[left], parts[right] = joined, ""
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        for a, b in ((before[left], left), (left, after[left])):
            if a >= 0 and b >= 0 and (s := score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, parts[a] + parts[b]))
    return [p for p in parts if p]


def _ids(parts: list[str], table: Pieces) -> array:
    found = list(map(table.id.get, parts))
    if None not in found:
        return array("i", found)
    out = array("i")
    for p, i in zip(parts, found, strict=True):
        if i is not None:
            out.append(i)
        elif table.byte_ids:
            out.extend(table.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
        else:
            out.append(table.unknown)
    return out


def word_ids(word: str, table: Pieces, key: str | None = None) -> array:
    """A word's ids; frequent words are remembered, in two generations so that clearing one does not lose them."""
    key = word if key is None else key
    known = table.older.get(key) or _ids((_merged if table.kind == BPE else _viterbi)(word, table), table)
    if len(word) <= SHORT:
        if len(table.memory) >= REMEMBERED:
            table.memory, table.older = {}, table.memory
        table.memory[key] = known
    return known


def encode_text(text: str | None, table: Pieces) -> array:
    out = array("i")
    add = out.extend
    if table.prefix and text and BLANK not in text and "" not in (parts := text.split(" ")):
        for bare in parts:  # words between single blanks, remembered without their U+2581
            add(table.memory.get(bare) or word_ids(BLANK + bare, table, bare))
        return out
    for word in _UNITS.findall(prepared(text or "", table)):
        add(table.memory.get(word) or word_ids(word, table))
    return out


def decode_ids(ids, table: Pieces) -> str:
    """The text that ids stand for: pieces in a row, bytes joined to characters, U+2581 as blank, the first blank dropped."""
    shown = table.shown
    if table.high_bytes.isdisjoint(ids):
        text = "".join([shown[i] for i in ids])
    else:
        of_byte = {i: b for b, i in enumerate(table.byte_ids)}
        out, pending = [], bytearray()
        for i in ids:
            if i in of_byte:
                pending.append(of_byte[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(shown[i])
        text = "".join(out) + pending.decode("utf-8", "replace")
    return text[1:] if table.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", verify: bool = False) -> DataFrame:
    """docs packed as (row, ids array<int>): the pieces of each whole text, without begin or end.

    The ids are those of the model's library. Null and empty texts have no ids; a word of any length is folded whole.
    verify adds round_trip: whether decoding the ids gives the text back, U+2581 in it read as a blank.
    Repeated rows get the same ids; other columns stay inside ``row`` and cannot clash; empty tables give no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model))  # of the model's size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [t or "" for t in part.column(0).field(text).to_pylist()]
                offsets, ids, same = array("i", [0]), array("i"), []
                for t in texts:
                    found = encode_text(t, table)
                    if verify:
                        same.append(decode_ids(found, table) == t.replace(BLANK, " "))
                    ids.extend(found)
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *([pa.array(same, pa.bool_())] if verify else [])], ["row", "ids", *["round_trip"] * verify])

    packed = docs.select(F.struct("*").alias("row"))
    made = [StructField("ids", ArrayType(IntegerType())), *([StructField("round_trip", BooleanType())] if verify else [])]
    return packed.mapInArrow(run, StructType([*packed.schema.fields, *made]))


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> Column:
    """A column of encoded with the text that its ids stand for; null ids give the empty text."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for rows in batches:
            yield pd.Series([decode_ids([] if r is None else r.tolist(), table) for r in rows], dtype=object)

    return text(F.col(ids))


def piece_table(spark: SparkSession, table: Pieces) -> DataFrame:
    return spark.createDataFrame([(p, table.id[p], float(s)) for p, s in table.score.items()], "piece string, id int, score double")


def encode_words(words: DataFrame, table: Pieces, word: str = "word") -> DataFrame:
    """(word, pieces array<string>) of each distinct non-empty word, relationally; words as in a prepared text.

    Every substring no longer than the longest piece is a row, joined to the piece table by equality; the edges of a
    word are grouped and folded by an aggregate. A row holds a word's edges, so words should be short (a few hundred
    characters); ``encode`` has no such bound. Null and empty words give no row.
    """
    spark = words.sparkSession
    distinct = words.select(F.col(word).alias("word")).where("length(word) > 0").distinct()
    starts = F.sequence(F.lit(1), F.length("word"))
    cut_at = distinct.withColumn("start", F.explode(starts)).withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.length("word") - F.col("start") + 1))))
    substrings = cut_at.withColumn("piece", F.substring("word", F.col("start"), F.col("size")))
    pieces = F.broadcast(piece_table(spark, table).select("piece", "score"))  # of the model's size
    lattice = (
        substrings.join(pieces, "piece", "left")
        .where("score IS NOT NULL OR size = 1")
        .groupBy("word")
        .agg(F.collect_list(F.struct("start", "size", "piece", "score")).alias("edges"))
    )
    fold = _viterbi_fold if table.kind == UNIGRAM else _merge_fold
    return lattice.select("word", fold(F.col("word"), F.col("edges"), min(table.score.values(), default=0.0) - 10.0).alias("pieces"))


def encode_relational(docs: DataFrame, table: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pieces array<string>) of documents that have a word, all by joins: words with their places, the distinct
    words' pieces from encode_words, and both grouped by document. key must name one row each.

    It shuffles every word of the corpus twice; encode gives the same pieces without a shuffle.
    """
    blank = F.lit(BLANK)
    body = F.replace(F.col(text), F.lit(" "), blank)
    if table.prefix:
        body = F.concat(blank, body)
    words = F.regexp_extract_all(body, F.lit(f"{BLANK}*[^{BLANK}]+|{BLANK}+"), F.lit(0))
    placed = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.posexplode(words).alias("place", "word"))
    found = placed.join(encode_words(placed, table), "word")
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "pieces"))).alias("all")).select(F.col("key").alias(key), F.flatten(F.transform("all", lambda x: x["pieces"])).alias("pieces"))


def _viterbi_fold(word: Column, lattice: Column, worst: float) -> Column:
    """Over end positions: the best (score, pieces) up to each, from those of the positions before."""
    nothing = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("pieces")))

    def step(best: Column, end: Column) -> Column:
        arriving = F.filter(lattice, lambda e: e["start"] + e["size"] - 1 == end)
        options = F.transform(
            arriving,
            lambda e: F.struct(
                (F.element_at(best, e["start"])["score"] + F.coalesce(e["score"], F.lit(worst))).alias("score"), e["size"].alias("size"), F.concat(F.element_at(best, e["start"])["pieces"], F.array(e["piece"])).alias("pieces")
            ),
        )
        top = F.array_max(options)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["pieces"].alias("pieces"))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), nothing, step, lambda best: F.element_at(best, -1)["pieces"])


def _merge_fold(word: Column, lattice: Column, worst: float) -> Column:
    """At most a join for each character: of all neighbours with an edge over both, those of the best score, leftmost."""
    known = F.map_from_entries(F.array_distinct(F.transform(F.filter(lattice, lambda e: e["score"].isNotNull()), lambda e: F.struct(e["piece"], e["score"]))))
    letters = F.filter(F.split(word, ""), lambda c: F.length(c) > 0)

    def step(parts: Column, _: Column) -> Column:
        n = F.size(parts)
        options = F.filter(
            F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: i < n), lambda i: F.struct(known[F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))].alias("score"), (-i).alias("at"))),
            lambda o: o["score"].isNotNull(),
        )
        at = -F.array_max(options)["at"]
        joined = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))), F.slice(parts, at + 2, n))
        return F.when(at.isNull(), parts).otherwise(joined)

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), letters, step)
