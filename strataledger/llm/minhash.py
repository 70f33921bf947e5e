"""MinHash near-dedup: an inverted join of signature coordinates with prefix and skip merging, confirmed on full sets.

1. A text's set of shingles becomes a signature of K minima; equal sets are one class from here on.
2. Every class is posted under its (coordinate, value) pairs. Two signatures that agree in at least MATCHES of K pairs
   share one within their K - MATCHES + 1 rarest (the prefix), whatever the order, as long as it is the same for all.
   Rarest first keeps passages that very many documents share out of the prefixes.
3. First pass: in each posting, all are compared with its smallest class only. Texts of pairs that agree in MATCHES
   coordinates are fetched, and links confirmed on the full sets.
4. Second pass: postings whose classes are joined already are skipped. In the others, every pair from different
   components is counted and confirmed inside a task, by blocks, and only links that join components leave it. A
   group of n near copies so costs no n * n rows, and no link between components is lost.
5. A posting that is still large then holds texts which share a long passage and little else. Dealt out by blocks it
   would cost the square of its size, so its texts are posted anew under their own rarest shingles: two sets at the
   limit share one among the rarest quarter of each, in any order that is the same for both. What all share is never
   among these, so nothing is left out and the postings are short.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataledger.llm.common import BROADCAST_ROWS, LOWER, UPPER, cut, looked_up, ship
from strataledger.llm.components import connected_components
from strataledger.llm.ftrl import Hashes

SHINGLE, SIMILARITY = 5, 75
#: Of K coordinates, a pair of similarity 0.75 agrees in fewer than MATCHES once in about five thousand times.
K, MATCHES = 24, 10
#: Classes of a posting that are compared in one task; larger postings are dealt out as pairs of blocks.
BLOCK = 512
#: Classes of a posting beyond which its texts are posted anew by their rarest shingles.
LARGE = 4096
#: Candidates of a hub that are confirmed in one task.
STAR = 128
#: Rows that are handed to Python together, without and with texts, and row pairs looked at at once.
GROUP_ROWS, TEXT_ROWS, PAIRS_AT_ONCE = 2000, 500, 100_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _word_hashes() -> Hashes:
    return Hashes()


@cache
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : len(words) - n + 1 + j]
        out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out)


def signature(found: np.ndarray, k: int = K) -> list[int]:
    a, b = _coefficients(k)
    x = found ^ (found >> np.uint64(31))
    with np.errstate(over="ignore"):
        # the high half of the product is well mixed; the low half of what is left names the minimum
        return [int(((x * a[i] + b[i]) >> np.uint64(32)).min()) - 2**31 for i in range(k)]


def linked(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        rows = []
        for text in batch["text"]:
            found = shingles(text)
            rows.append((len(found), xxh3_128_digest(found.tobytes()) if len(found) else None, signature(found) if len(found) else None))
        yield pd.concat([batch[["doc_id", "key"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_shingles", "digest", "sig"])], axis=1)


def _runs(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows ordered by block pair, and where each block pair begins and the last one ends."""
    group = group.sort_values(["token", "pair"], kind="stable", ignore_index=True)
    token, pair = group["token"].to_numpy(), group["pair"].to_numpy()
    return group, np.r_[np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (pair[1:] != pair[:-1])]), len(group)]


def _promising(group: pd.DataFrame) -> pd.DataFrame:
    """Rows that agree with some other of their block pair in enough coordinates and meet it in no earlier posting.

    A group holds many block pairs; those of a size are looked at together, a bounded number of row pairs at a time.
    """
    group, edges = _runs(group)
    sig = np.stack(group["sig"].to_numpy()).astype(np.int32)
    block, comp, n, whole = (group[c].to_numpy() for c in ("block", "comp", "n_shingles", "whole"))
    prefix, own = group["prefix"].to_numpy().astype(np.int64), np.int64(1) << group["coordinate"].to_numpy().astype(np.int64)
    bits = np.int64(1) << np.arange(sig.shape[1], dtype=np.int64)
    keep, sizes = np.zeros(len(group), bool), np.diff(edges)
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        starts, step = edges[:-1][sizes == size], max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(starts), step):
            left, right = (starts[k : k + step, None] + i).ravel(), (starts[k : k + step, None] + j).ravel()
            for lo in range(0, len(left), PAIRS_AT_ONCE):
                a, b = left[lo : lo + PAIRS_AT_ONCE], right[lo : lo + PAIRS_AT_ONCE]
                wanted = (comp[a] != comp[b]) & (whole[a] | (block[a] != block[b])) & (SIMILARITY * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b]))
                a, b = a[wanted], b[wanted]
                equal = sig[a] == sig[b]
                enough = np.count_nonzero(equal, axis=1) >= MATCHES
                a, b, equal = a[enough], b[enough], equal[enough]
                posted = (equal @ bits) & prefix[a] & prefix[b]
                first = (posted & -posted) == own[a]
                keep[a[first]] = keep[b[first]] = True
    return group.loc[keep, ["token", "pair", "block", "comp", "rep"]]


def _starring(group: pd.DataFrame) -> pd.DataFrame:
    """Links of each part of a hub with the hub, confirmed on the full sets; the hub's text comes once a part."""
    group, edges = _runs(group)
    hub, rep, text = (group[c].to_numpy() for c in ("token", "rep", "text"))
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        centre = next((k for k in range(lo, hi) if rep[k] == hub[k]), None)
        if centre is None:
            continue
        found = shingles(text[centre])
        out += [(hub[k], rep[k]) for k in range(lo, hi) if k != centre and linked(found, shingles(text[k]))]
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"rep": batch["rep"], "found": [shingles(t).view(np.int64) for t in batch["text"]]})


def _agreeing(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of each block pair from different components that agree in enough coordinates, the smaller row first."""
    group, edges = _runs(group)
    sig = np.stack(group["sig"].to_numpy()).astype(np.int32)
    rep, block, comp, n, whole = (group[c].to_numpy() for c in ("rep", "block", "comp", "n_shingles", "whole"))
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        a, b = (lo + x for x in np.triu_indices(hi - lo, 1))
        wanted = (comp[a] != comp[b]) & (whole[a] | (block[a] != block[b])) & (SIMILARITY * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b]))
        a, b = a[wanted], b[wanted]
        enough = np.concatenate([np.count_nonzero(sig[a[k : k + PAIRS_AT_ONCE]] == sig[b[k : k + PAIRS_AT_ONCE]], axis=1) >= MATCHES for k in range(0, len(a), PAIRS_AT_ONCE)] or [np.zeros(0, bool)])
        a, b = rep[a[enough]], rep[b[enough]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["src", "dst"]).astype("int64").drop_duplicates()


def _linked_rows(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets of a block pair are linked, as a matrix; shared shingles are counted by slices of columns."""
    sizes = np.array([len(s) for s in sets])
    of_row = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = (often > 1)[column]
    of_row, column = of_row[common], (np.cumsum(often > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    of_row, column = of_row[order], column[order]
    both, step = np.zeros((len(sets), len(sets))), 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [start, start + step])
        part = np.zeros((len(sets), step), np.float32)
        part[of_row[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    return (both > 0) & (100 * both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both))


def _joining(group: pd.DataFrame) -> pd.DataFrame:
    """Components joined by links that are confirmed on the full sets: fewer pairs of each block pair than it has rows."""
    group, edges = _runs(group)
    rep, comp, text = (group[c].to_numpy() for c in ("rep", "comp", "text"))
    known: dict[int, np.ndarray] = {}
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo < 2:
            continue
        for k in range(lo, hi):
            if rep[k] not in known:
                known[rep[k]] = shingles(text[k])
        sets = [known[r] for r in rep[lo:hi]]
        if hi - lo <= 8:
            pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[lo + i] != comp[lo + j] and linked(sets[i], sets[j])]
        else:
            pairs = zip(*np.nonzero(np.triu(_linked_rows(sets), 1) & (comp[lo:hi, None] != comp[None, lo:hi])), strict=True)
        parent = {c: c for c in comp[lo:hi]}
        for i, j in pairs:
            a, b = comp[lo + i], comp[lo + j]
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[a] = b
                out.append((comp[lo + i], comp[lo + j]))
        if len(known) > GROUP_ROWS:
            known.clear()
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")


def row_key(doc_id: Column, text: Column) -> Column:
    """The digest of a row's id and text; a null is none of the texts that stand for it."""
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(marked(doc_id.cast("string")), F.lit("\n"), marked(text)).cast("binary")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept, key, keeper.

    Words are A-Z lower-cased; a document's set holds its distinct shingles of five words, or the whole sequence as
    one where there are fewer. Documents whose sets have 100 * intersection >= 75 * union are linked; component_id is
    the smallest id that links reach, kept whether it is the row's own.
    A text without words, or null, has the empty set and no link. Of rows that share an id, each is a document, and
    kept holds for all that bear the component's id; ``keeper`` is true for exactly one row of each component, and for
    every row without words. A component of null ids has a null id. ``key`` is the
    digest of id and text. Empty tables give no rows; other columns are not looked at.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    # id and text together name a row to fetch its text again: texts are never kept beside the sketches
    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    sketch = cut(
        named.mapInPandas(_sketch, f"doc_id {id_type.simpleString()}, key binary, n_shingles long, digest binary, sig array<int>").withColumn("row", F.monotonically_increasing_id()),
        gather=True,
    )
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "row")
    classes = cut(
        sketch.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(first).alias("first"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("n_shingles"))
        .select("digest", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), "sig", "n_shingles")
    )

    # postings: the value's 32 bits and the coordinate, so that equal tokens are equal pairs
    tokens = classes.select("rep", F.posexplode("sig").alias("coordinate", "value")).select(
        "rep", "coordinate", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value").cast("long") + F.lit(2**31)).alias("token")
    )
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token", "coordinate"))).alias("found"))
    # tokens of a single class come first in the order and fill the prefix without being posted
    free = F.lit(K - MATCHES + 1) - (F.lit(K) - F.size("found"))
    prefix = cut(shared.where(free > 0).select("rep", F.slice("found", 1, free).alias("found")))
    postings = prefix.select("rep", F.explode("found").alias("p")).select("rep", F.col("p.token").alias("token"), F.col("p.coordinate").alias("coordinate"))

    # first pass: everyone against the posting's smallest class
    hubs = postings.groupBy("token").agg(F.min("rep").alias("src"), F.max("rep").alias("most")).where("src < most").select("token", "src")
    stars = postings.join(hubs, "token").where("rep <> src").select("src", F.col("rep").alias("dst")).distinct()
    signed = classes.select("rep", "sig", "n_shingles")
    agree = F.size(F.filter(F.arrays_zip(F.col("left_sig").alias("l"), F.col("right_sig").alias("r")), lambda x: x["l"] == x["r"]))
    close = F.lit(100) * F.least("left_n", "right_n") >= F.lit(SIMILARITY) * F.greatest("left_n", "right_n")
    candidates = cut(
        stars.join(signed.toDF("src", "left_sig", "left_n"), "src").join(signed.toDF("dst", "right_sig", "right_n"), "dst").where(close & (agree >= MATCHES)).select("src", "dst")
    )
    links = _confirmed(candidates, named, classes)

    first_pass = connected_components(links).toDF("rep", "comp")

    # second pass: what the first has not joined, by blocks of the postings that still hold several components
    of_class = cut(
        classes.select("rep", "sig", "n_shingles")
        .join(prefix.select("rep", F.aggregate("found", F.lit(0), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), p["coordinate"]))).alias("prefix")), "rep")
        .join(first_pass, "rep", "left")
        .withColumn("comp", F.coalesce("comp", "rep"))
    )
    members = postings.join(of_class, "rep")
    open_ = cut(_open(members))
    dealt = _dealt(members, open_.where(F.col("n") <= LARGE))
    rows = open_.where(F.col("n") <= LARGE).agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    promising = cut(
        _in_parts(dealt.select("token", "pair", "whole", "coordinate", "block", "rep", "comp", "n_shingles", "prefix", "sig"), -(-rows // GROUP_ROWS) or 1).applyInPandas(_promising, "token long, pair long, block int, comp long, rep long"),
        gather=True,
    )
    n_promising = promising.count()
    texts = _texts(named, classes, promising.select("rep").distinct(), n_promising)
    # from here on, links are between the first pass's components
    more = _in_parts(promising.join(texts, "rep"), -(-n_promising // TEXT_ROWS) or 1).applyInPandas(_joining, "src long, dst long")
    large = open_.where(F.col("n") > LARGE).select("token")
    if not large.isEmpty():
        in_large = cut(members.join(large, "token", "left_semi").select("rep", "comp", "n_shingles", "sig").distinct())
        found = _confirmed(_by_rarest(in_large, named, classes), named, classes)
        component = in_large.select(F.col("rep").alias("of"), "comp")
        ends = found.join(component.toDF("src", "src_comp"), "src").join(component.toDF("dst", "dst_comp"), "dst")
        more = more.unionAll(ends.select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")))
    last = looked_up(connected_components(more).toDF("own", "last"))

    joined = classes.select("rep", "doc_id", "digest").join(first_pass, "rep", "left").withColumn("own", F.coalesce("comp", "rep"))
    joined = joined.drop("comp").join(last, "own", "left").select("rep", "doc_id", "digest", F.coalesce("last", "own").alias("comp"))
    head = F.struct(F.col("doc_id").isNull(), "doc_id", "rep")
    heads = looked_up(joined.groupBy("comp").agg(F.min(head).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    of_digest = joined.join(heads, "comp", "left").select(
        F.col("digest").alias("class_digest"), F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.coalesce("first.rep", "rep").alias("head")
    )
    found = sketch.join(looked_up(of_digest), F.col("digest") == F.col("class_digest"), "left")
    alone = F.col("digest").isNull()
    return found.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), "key", (alone | (F.col("row") == F.col("head"))).alias("keeper"),
    )


def _in_parts(df: DataFrame, parts: int):
    """Rows (token, pair, ...) grouped so that a task gets many whole block pairs of moderate size."""
    return df.withColumn("part", F.pmod(F.xxhash64("token", "pair"), F.lit(parts))).groupBy("part")


def _open(members: DataFrame) -> DataFrame:
    """(token, n, blocks) of the postings that hold several components. members: token, rep, comp."""
    sizes = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    return sizes.where("lo < hi").select("token", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def _dealt(members: DataFrame, open_: DataFrame) -> DataFrame:
    """members of open postings, a row for each pair of blocks that theirs belongs to; whole marks a block met by itself."""
    return (
        members.join(open_.select("token", "blocks"), "token")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        .withColumn("whole", F.col("pair") % (F.col("blocks") + 1) == 0)
    )


def _confirmed(candidates: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidate pairs (src, dst) that are linked on their full sets, cut.

    A src of very many candidates is dealt out in parts; its own text goes to each part once, not to each candidate.
    """
    ends = candidates.select(F.col("src").alias("rep")).unionAll(candidates.select(F.col("dst").alias("rep"))).distinct()
    n = candidates.count()
    texts = cut(_texts(named, classes, ends, 2 * n))
    hubs = cut(candidates.groupBy("src").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")))
    spokes = candidates.join(looked_up(hubs.withColumnRenamed("src", "hub")), F.col("src") == F.col("hub"))
    spokes = spokes.select(F.col("src").alias("token"), F.pmod(F.xxhash64("dst"), F.col("parts")).cast("long").alias("pair"), F.col("dst").alias("rep"))
    centres = hubs.select(F.col("src").alias("token"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("pair"), F.col("src").alias("rep"))
    return cut(_in_parts(spokes.unionAll(centres).join(texts, "rep"), -(-2 * n // TEXT_ROWS) or 1).applyInPandas(_starring, "src long, dst long"), gather=True)


def _by_rarest(members: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs among members (rep, comp, n_shingles, sig), cut: those that share one of their rarest shingles.

    Sets of a and b shingles at the limit share at least 75 % of the larger, so each one's first n - ceil(0.75 n) + 1
    in a common order (rarest among the members first) hold a shingle of the other's. Shingles of a single member come
    first and are not posted.
    """
    texts = _texts(named, classes, members.select("rep"), members.count())
    sets = cut(texts.mapInPandas(_sets, "rep long, found array<long>"))
    each = sets.select("rep", F.explode("found").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    size = F.col("n_shingles")
    first = (size - F.ceil(size * SIMILARITY / F.lit(100.0)) + 1).cast("int")
    shared = each.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("found")).join(members, "rep")
    free = first - (size - F.size("found"))
    posted = shared.where(free > 0).select("rep", "comp", "n_shingles", "sig", F.explode(F.slice("found", F.lit(1), free.cast("int"))).alias("p")).select("rep", "comp", "n_shingles", "sig", F.col("p.token").alias("token"))
    posted = cut(posted)
    open_ = cut(_open(posted))
    rows = open_.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    dealt = _dealt(posted, open_).select("token", "pair", "whole", "block", "rep", "comp", "n_shingles", "sig")
    return cut(_in_parts(dealt, -(-rows // GROUP_ROWS) or 1).applyInPandas(_agreeing, "src long, dst long").distinct())


def _texts(named: DataFrame, classes: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """(rep, text) of the given classes, at most `most`; the documents are read again and joined by the digest of id and text."""
    wanted = classes.join(reps, "rep").select("rep", F.col("key").alias("wanted"))
    if most <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return named.join(wanted, F.col("key") == F.col("wanted")).select("rep", "text").dropDuplicates(["rep"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near duplicates, columns unchanged; rows without words all stay, repeated ones too.

    Of rows that agree in id and text, one is left: the one whose JSON form comes first, whatever the partitioning.
    Rows that nothing speaks against stay where they are; only keys of rows that go, or that are repeated, are looked
    up, by broadcast up to a counted number and by a shuffle beyond. Null ids, null and empty texts are told apart;
    empty tables give no rows; other columns stay inside a struct on the way and cannot clash.
    """
    of_key = near_duplicates(docs).where("n_shingles > 0").groupBy("key").agg(F.max("keeper").alias("kept"), F.count("*").alias("n"))
    special = looked_up(of_key.where("NOT kept OR n > 1").select(F.col("key").alias("special_key"), F.col("kept").alias("special_kept")))
    packed = docs.select(F.struct("*").alias("row")).select("row", row_key(F.col("row.doc_id"), F.col("row.text")).alias("key"))
    met = packed.join(special, F.col("key") == F.col("special_key"), "left")
    one = met.where("special_kept").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return met.where("special_key IS NULL").select("row.*").unionAll(one.select("row.*"))
