"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

1. On a bounded sample, rotations are learnt (ITQ) under which the signs of a vector's coordinates are balanced bits.
   Every vector gets a code; equal vectors are one class from here on.
2. The code's chunks form a table for each two of them. Two codes meet in a table where both chunks agree, and
   are looked at in the first such table only. Large buckets are dealt out as pairs of blocks. How wide chunks are and
   how many, and whether codes are about the sample's mean or the origin, follows from the number of vectors and
   from the sample: of the layouts that find enough pairs exactly at the limit, the cheapest is taken.
3. Codes no farther apart than pairs at the limit are candidates. Their original vectors are fetched and compared in
   the task in double precision; what leaves it is a count of links a vector and the components of the block, not pairs.

With exact=True step 2 is a grid of the two principal directions instead: vectors nearer than the limit lie in
neighbouring cells of its width, so no link is lost, at the price of many more comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.llm.common import cut, looked_up, ship
from strataledger.llm.components import connected_components

COSINE = 0.95
SAMPLE, ITERATIONS = 4096, 50
#: The share of made pairs exactly at the limit that a layout must find, in each quarter of the sample by distance from the centre.
RECALL = 0.98
#: Bits to choose from, those that a pair's distance is counted in, widths of a chunk, and the most tables.
BITS, FILTER, WIDTHS, TABLES = 256, 128, (3, 4, 5, 6, 7, 8, 10, 12, 14, 16), 120
#: What a comparison of two codes costs beside a posted row.
PAIR_COST = 0.01
BLOCK, GROUP_ROWS, LINK_ROWS, PAIRS_AT_ONCE = 256, 4000, 512, 100_000


def learn_rotation(sample: np.ndarray, bits: int = 64, iterations: int = ITERATIONS, seed: int = 5) -> np.ndarray:
    """The projection whose signs are the code: sign(x @ projection). sample: unit vectors, a row each.

    Principal directions first, then alternating steps: the nearest signs for the rotation, and the rotation that
    brings the projected sample nearest to them. Fewer directions than bits are made up by random ones.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    values, vectors = np.linalg.eigh(sample.T @ sample)
    basis = vectors[:, np.argsort(-values)][:, :bits]
    projected = sample @ basis
    rotation, _ = np.linalg.qr(rng.standard_normal((basis.shape[1], basis.shape[1])))
    for _ in range(iterations):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(signs.T @ projected)
        rotation = vt.T @ u.T
    learnt = basis @ rotation
    if learnt.shape[1] < bits:
        learnt = np.hstack([learnt, rng.standard_normal((dim, bits - learnt.shape[1]))])
    return learnt


@dataclass
class Layout:
    """How vectors become chunks, and which distance of codes still makes a candidate."""

    projection: np.ndarray
    centre: np.ndarray
    width: int
    chunks: int
    most_bits: int
    recall: float

    @property
    def tables(self) -> list[tuple[int, int]]:
        return list(combinations(range(self.chunks), 2))

    def encode(self, units: np.ndarray) -> np.ndarray:
        """A vector's chunks, then FILTER bits by which pairs are told apart: 16 bits a number."""
        bits = (units - self.centre) @ self.projection >= 0
        return np.hstack([_chunks(bits[:, : self.chunks * self.width], self.width), _chunks(bits[:, :FILTER], 16)])


@dataclass
class Grid:
    """Cells of the limit's width along the principal directions; used instead of tables where nothing may be missed."""

    directions: np.ndarray
    side: float

    def encode(self, units: np.ndarray) -> np.ndarray:
        return np.floor(units @ self.directions / self.side).astype(np.int16).view(np.uint16)


def _chunks(bits: np.ndarray, width: int) -> np.ndarray:
    """Bits in chunks of a width: a 16-bit number each; what is left over at the end is not used."""
    n = bits.shape[1] // width
    return (bits[:, : n * width].reshape(len(bits), n, width) @ (1 << np.arange(width))).astype(np.uint16)


def choose_layout(sample: np.ndarray, n: int, cosine: float = COSINE, seed: int = 5) -> Layout:
    """The cheapest layout for n vectors that finds RECALL of the sample's vectors from made ones exactly at the limit.

    Cost is a posted row for each table and vector, and PAIR_COST for each pair that is expected to share a bucket,
    which the sample tells too; so keys widen as tables grow, and buckets stay short. Three quarters of a sample
    teach rotations, the rest measures, as rotations fit the vectors that they were learnt from too well. Where no
    layout finds enough, the one that finds most is taken.
    """
    rng = np.random.default_rng(seed)
    taught, sample = (sample, sample) if len(sample) < 64 else (sample[np.arange(len(sample)) % 4 > 0], sample[::4])
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    at_limit = cosine * sample + np.sqrt(1 - cosine * cosine) * noise
    found: list[tuple[tuple, Layout]] = []
    for centre in (np.zeros(sample.shape[1]), taught.mean(axis=0)):
        rotations = -(-BITS // min(BITS, sample.shape[1]))
        projection = np.hstack([learn_rotation(taught - centre, min(BITS, sample.shape[1]), seed=seed + k) for k in range(rotations)])[:, :BITS]
        bits, near = (sample - centre) @ projection >= 0, (at_limit - centre) @ projection >= 0
        quarters = np.array_split(np.argsort(np.linalg.norm(sample - centre, axis=1), kind="stable"), 4 if len(sample) >= 400 else 1)
        for width in WIDTHS:
            own, other = _chunks(bits, width), _chunks(near, width)
            agreeing = np.cumsum(own == other, axis=1)
            for chunks in range(2, agreeing.shape[1] + 1):
                if chunks * (chunks - 1) // 2 > TABLES:
                    break
                recall = min(float((agreeing[q, chunks - 1] >= 2).mean()) for q in quarters)
                if recall < RECALL and not (chunks == agreeing.shape[1] or chunks * (chunks + 1) // 2 > TABLES):
                    continue
                tables = list(combinations(range(chunks), 2))
                shared = sum(_colliding(own[:, a].astype(np.int64) << 16 | own[:, b]) for a, b in tables) + len(tables) * 2.0 ** (-2 * width)
                flips = (bits[:, :FILTER] != near[:, :FILTER]).sum(axis=1)
                layout = Layout(projection[:, : max(FILTER, chunks * width)], centre, width, chunks, int(np.quantile(flips, 0.9995)) + 2, recall)
                found.append(((max(RECALL - recall, 0.0), n * len(tables) + n * n / 2 * shared * PAIR_COST), layout))
                break
    return min(found, key=lambda x: x[0])[1]


def _colliding(keys: np.ndarray) -> float:
    """The share of pairs whose keys agree."""
    n = np.unique(keys, return_counts=True)[1].astype(np.float64)
    return float((n * (n - 1)).sum() / max(1, len(keys) * (len(keys) - 1)))


def unit(vector) -> np.ndarray | None:
    """The vector in double precision at length 1; None if it is null, empty or zero, or holds null or non-finite components."""
    if vector is None:
        return None
    x = np.asarray(vector, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    scale = np.abs(x).max()
    if scale == 0:
        return None
    x = x / scale
    return x / np.sqrt(x @ x)


def _pairs(group: pd.DataFrame, layout: Layout | Grid) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare: in the same run (a bucket's block pair), near by code, and met in this bucket only."""
    bucket, pair, block, whole, rep = (group[c].to_numpy() for c in ("bucket", "pair", "block", "whole", "rep"))
    code = np.frombuffer(b"".join(group["code"]), np.uint16).reshape(len(group), -1)
    exact = isinstance(layout, Grid)
    home, table = group["home"].to_numpy(), bucket >> 32
    first, second = (None, None) if exact else (np.array([t[k] for t in layout.tables]) for k in (0, 1))
    edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])])
    sizes = np.diff(np.r_[edges, len(group)])
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        starts = edges[sizes == size]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(starts), step):
            a = (starts[k : k + step, None] + i).ravel()
            b = (starts[k : k + step, None] + j).ravel()
            fits = whole[a] | (block[a] != block[b])
            a, b = a[fits], b[fits]
            if exact:  # in the cell of the smaller one
                here = home[np.where(rep[a] < rep[b], a, b)]
            else:
                differ = code[a] ^ code[b]
                near = np.bitwise_count(differ[:, layout.chunks :]).sum(axis=1, dtype=np.int64) <= layout.most_bits
                a, b, equal = a[near], b[near], differ[near, : layout.chunks] == 0
                lead = equal.argmax(axis=1)
                equal[np.arange(len(a)), lead] = False
                here = (lead == first[table[a]]) & (equal.argmax(axis=1) == second[table[a]])
            if here.any():
                yield a[here], b[here]


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values(["bucket", "pair"], kind="stable", ignore_index=True)


def _promising(layout: Layout | Grid):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = _ordered(group)
        keep = np.zeros(len(group), bool)
        for a, b in _pairs(group, layout):
            keep[a] = keep[b] = True
        return group[keep].drop(columns="part")

    return run


def _linking(cosine: float, layout: Layout | Grid):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = _ordered(group)
        units = np.stack([np.frombuffer(x, np.float64) for x in group["unit"]])
        copies, label = group["copies"].to_numpy(), np.arange(len(group))
        links, found = np.zeros(len(group), np.int64), []
        for a, b in _pairs(group, layout):
            good = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
            a, b = a[good], b[good]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            found.append((a, b))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
        while True:  # the smallest row that links reach within the group
            least = label.copy()
            np.minimum.at(least, a, label[b])
            np.minimum.at(least, b, label[a])
            least = least[least]
            if (least == label).all():
                break
            label = least
        rep = group["rep"].to_numpy()
        out = pd.DataFrame({"rep": rep, "head": rep[label], "links": links})
        return out[links > 0]

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors found with a cosine of at least `cosine`, copies included; component_id is the
    smallest id that links reach, kept whether it is the row's own. Every link is confirmed in double precision, so
    none is below the limit; the tables find pairs at the limit with a probability near RECALL and closer ones more
    surely. exact finds all of them.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    length never link. Null ids take part, and a component of null ids has a null id; repeated rows are copies of each
    other. Empty tables give no rows; other columns are not looked at. Rotations and layout are learnt from at most SAMPLE
    vectors for each length; every vector is indexed.
    """
    spark = vectors.sparkSession
    ship(spark)
    id_type = vectors.schema[vec_id].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [unit(x) for x in batch["embedding"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "dim": np.array([0 if x is None else len(x) for x in made], np.int32), "unit": [None if x is None else x.tobytes() for x in made]})

    named = vectors.select(F.col(vec_id).cast("string").alias("vec_id"), F.col(vector).alias("embedding"))
    rows = cut(named.mapInPandas(read, "vec_id string, dim int, unit binary").withColumns({"row": F.monotonically_increasing_id(), "vec_id": F.col("vec_id").cast(id_type)}), gather=True)
    first = F.struct(F.col("vec_id").isNull(), "vec_id", "row")
    classes = rows.where("dim > 0").groupBy("dim", "unit").agg(F.min(first).alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.select("dim", "unit", "copies", F.col("first.row").alias("rep"), F.col("first.vec_id").alias("head_id")))
    lengths = [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]
    links, counts = [], []
    for dim in lengths:
        own = classes.where(F.col("dim") == dim)
        sample = own.select("unit", "rep").orderBy(F.xxhash64("unit"), "rep").limit(SAMPLE).collect()
        units = np.stack([np.frombuffer(r["unit"], np.float64) for r in sample])
        if exact:
            layout: Layout | Grid = Grid(np.linalg.eigh(units.T @ units)[1][:, ::-1][:, :2], float(np.sqrt(max(2 - 2 * cosine, 0.0))) + 1e-9)
        else:
            layout = choose_layout(units, own.count(), cosine)
        model = spark.sparkContext.broadcast(layout)

        def code(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    made = model.value.encode(np.stack([np.frombuffer(x, np.float64) for x in batch["unit"]]))
                    yield pd.DataFrame({"rep": batch["rep"], "copies": batch["copies"], "code": [c.tobytes() for c in made], "chunks": list(made.view(np.int16 if exact else np.uint16).astype(np.int32))})

        codes = cut(own.select("rep", "copies", "unit").mapInPandas(code, "rep long, copies long, code binary, chunks array<int>"))
        at = lambda c: F.col("chunks")[c].cast("long")
        if exact:  # its own cell first, then those around it
            keys = [F.xxhash64(*(at(d) + step for d, step in enumerate(steps))) for steps in sorted(product((0, -1, 1), repeat=units.shape[1] if units.shape[1] < 2 else 2), key=any)]
        else:
            keys = [F.lit(t << 32) + at(a) * 65536 + at(b) for t, (a, b) in enumerate(layout.tables)]
        posted = codes.select("rep", "copies", "code", F.posexplode(F.array(*keys)).alias("turn", "bucket")).withColumn("home", F.col("turn") == 0).drop("turn")
        full = cut(posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        dealt = (
            posted.join(full, "bucket")
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
            .withColumn("whole", F.col("pair") % (F.col("blocks") + 1) == 0)
            .select("bucket", "pair", "whole", "block", "rep", "copies", "home", "code")
        )
        in_parts = lambda df, rows, size: df.withColumn("part", F.pmod(F.xxhash64("bucket", "pair"), F.lit(max(1, -(-rows // size))))).groupBy("part")
        promising = cut(in_parts(dealt, len(keys) * codes.count(), GROUP_ROWS).applyInPandas(_promising(layout), dealt.schema))
        # dealt anew by the rows that are left: the block pairs of a near-copy group would otherwise stay together
        with_units = promising.join(own.select("rep", "unit"), "rep").select(*dealt.columns, "unit")
        found = cut(in_parts(with_units, promising.count(), LINK_ROWS).applyInPandas(_linking(cosine, layout), "rep long, head long, links long"))
        links.append(found.select(F.col("rep").alias("src"), F.col("head").alias("dst")))
        counts.append(found.select("rep", "links"))
    empty = spark.createDataFrame([], "src long, dst long")
    component = connected_components(_union(links, empty)).toDF("rep", "comp")
    degree = _union(counts, empty.toDF("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    joined = classes.join(component, "rep", "left").join(degree, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    heads = looked_up(joined.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("head_id").isNull(), "head_id")).alias("first")))
    own_id = F.when(F.col("first").isNull(), F.col("head_id")).otherwise(F.col("first.head_id"))
    of_unit = joined.join(heads, "comp", "left").select(F.col("dim").alias("class_dim"), F.col("unit").alias("class_unit"), "links", own_id.alias("component_id"))
    found = rows.join(of_unit, (F.col("dim") == F.col("class_dim")) & (F.col("unit") == F.col("class_unit")), "left")
    alone = F.col("unit").isNull()
    component_id = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    for frame in frames:
        empty = empty.unionAll(frame)
    return empty
