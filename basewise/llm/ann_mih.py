"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes: vectors of length one, centred, turned to their principal axes and by a rotation learned so that signs lose least; one bit for each
sign.  A code is split into substrings, each indexed: a table (sub, value, block) of the rows whose substring has that value, large buckets in
several blocks.  If two codes are within radius bits, some substring of them is within radius / substrings bits (pigeonhole), the first few within
one bit more than the others.  So a query names every value that near to its own substrings, and the join of these probes with the index retrieves every
code within the radius.  A pair counts at its first substring only.

What is retrieved is confirmed by a longer code (more rotations, learned alike), and only what stays is ranked by the cosine of the vectors themselves.
Equal vectors are one class, with the k + 1 smallest of their ids, so that copies are not paired.

Every row is indexed.  The model and both radii are fitted to a sample of SAMPLE rows at most.  Queries that find too few rows are compared with
all rows, in chunks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stash

SAMPLE = 20_000  # rows that the rotations and radii are fitted to, at most
LEARNED = 4_096  # of them for a rotation
PROBED = 400  # of them that serve as queries for the radii
REACH = 0.985  # share of the sample's true neighbours within each radius
TURNS = 8  # rotations of the longer code; the first alone makes the code that is indexed
BLOCK = 8_192  # rows of a bucket in one block
PAIRS = 20_000_000  # pairs of a probe and a row for each task of the join, about
CHUNK = 4_096  # queries compared with all rows at a time
HELD = 200_000  # rows of bucket sizes that are broadcast at most
ROUNDS = 12
NEAR = 1e-9  # scores so close are computed again, one by one


class Codes:
    """Learned rotated binary codes: TURNS times up to 64 bits."""

    def __init__(self, mean: np.ndarray, turns: list[np.ndarray]):
        self.mean, self.turns = mean, turns
        self.bits = turns[0].shape[1]

    @staticmethod
    def fit(unit: np.ndarray, seed: int = 7) -> Codes:
        draw = np.random.default_rng(seed)
        mean = unit.mean(0)
        some = (unit - mean)[:LEARNED]
        _, axes = np.linalg.eigh((unit - mean).T @ (unit - mean))
        width = min(64, unit.shape[1])
        turns = []
        for k in range(TURNS):
            base = axes[:, ::-1][:, :width] if k == 0 else np.linalg.qr(draw.normal(size=(unit.shape[1], width)))[0]
            low = some @ base
            spin = np.linalg.qr(draw.normal(size=(width, width)))[0]
            for _ in range(ROUNDS):
                left, _, right = np.linalg.svd(low.T @ np.where(low @ spin > 0, 1.0, -1.0))
                spin = left @ right
            turns.append(base @ spin)
        return Codes(mean, turns)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """One column of 64 bits for each rotation."""
        out = np.zeros((len(unit), len(self.turns)), np.uint64)
        for k, turn in enumerate(self.turns):
            bits = np.zeros((len(unit), 64), np.uint8)
            bits[:, : self.bits] = (unit - self.mean) @ turn > 0
            out[:, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def learned_radii(codes: Codes, sample: np.ndarray, k: int) -> tuple[int, int]:
    """The radii of the indexed and of the longer code that hold REACH of the k nearest of some rows of the sample."""
    picked = np.linspace(0, len(sample) - 1, min(PROBED, len(sample))).astype(int)
    near = sample[picked] @ sample.T
    near[np.arange(len(picked)), picked] = -2
    top = np.argsort(-near, axis=1)[:, :k]
    c = codes(sample)
    far = np.bitwise_count(c[picked][:, None] ^ c[top]).astype(int)
    return tuple(int(np.quantile(d, REACH, method="higher")) for d in (far[..., 0], far.sum(-1)))


def substrings(bits: int, radius: int, parts: int) -> list[tuple[int, int, int]]:
    """(offset, width, reach) of each substring: codes within radius agree in one of them up to its reach; a reach below 0 probes nothing."""
    each, more = divmod(radius, parts)
    cuts = [bits * j // parts for j in range(parts + 1)]
    return [(a, b - a, min(each - (j > more), b - a)) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def best_parts(bits: int, radius: int, rows: int) -> list[tuple[int, int, int]]:
    """The split of a code with the least probes and pairs a query, for rows whose bits are even."""

    def cost(split: list[tuple[int, int, int]]) -> float:
        probes = [sum(comb(w, i) for i in range(reach + 1)) for _, w, reach in split]
        return sum(p * (1 + rows / 2**w) for p, (_, w, _) in zip(probes, split, strict=True))

    return min((substrings(bits, radius, m) for m in (1, 2, 4, 8, 16) if m <= bits), key=cost)


def usable(c: Column) -> Column:
    """Vectors without null or non-finite components, and not all zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & fine & F.exists(c, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with that of y."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _part(code: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(code, offset).bitwiseAND(_long((1 << width) - 1))


def retrieved(asked: DataFrame, codes: DataFrame, split: list[tuple[int, int, int]], radius: int, wide: int, rows: int) -> DataFrame:
    """Return (q, cls): the pairs of asked and codes within both radii; both: (cls, c), c an array of longs whose first is indexed."""
    spark = codes.sparkSession
    parts = F.posexplode(F.array(*[_part(F.col("c")[0], a, w) for a, w, _ in split])).alias("sub", "value")
    index = codes.select("cls", "c", parts)
    sizes = stash(index.groupBy("sub", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "mih-buckets")
    sizes = F.broadcast(sizes) if sizes.count() <= HELD else sizes
    index = index.join(sizes, ["sub", "value"]).select("cls", "c", "sub", "value", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    masks = [(j, sum(1 << b for b in bits)) for j, (_, w, reach) in enumerate(split) for i in range(reach + 1) for bits in combinations(range(w), i)]
    masks = spark.createDataFrame([(j, x - (1 << 64) if x >> 63 else x) for j, x in masks], "sub int, mask long")
    probes = asked.select(F.col("cls").alias("q"), F.col("c").alias("d"), parts).join(F.broadcast(masks), "sub")
    probes = probes.select("q", "d", "sub", F.col("value").bitwiseXOR(F.col("mask")).alias("value")).join(sizes, ["sub", "value"])
    probes = probes.select("q", "d", "sub", "value", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    differ = [F.bit_count(F.col("c")[k].bitwiseXOR(F.col("d")[k])) for k in range(TURNS)]
    z = F.col("c")[0].bitwiseXOR(F.col("d")[0])
    earlier = [(F.col("probe.sub") > j) & (F.bit_count(_part(z, a, w)) <= reach) for j, (a, w, reach) in enumerate(split)]
    here = reduce(Column.__and__, [F.col(f"probe.{k}") == F.col(f"row.{k}") for k in ("sub", "value", "block")])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows * sum(2.0**-w for _, w, _ in split) * probes.count() / PAIRS))
    keys = ["sub", "value", "block"]
    left, right = probes.repartition(tasks, *keys).alias("probe"), index.repartition(tasks, *keys).alias("row")
    fine = (differ[0] <= radius) & (reduce(Column.__add__, differ) <= wide) & ~reduce(Column.__or__, earlier)
    return left.join(right, here & fine).select("q", "cls")


def _scored(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(q, cls, score) for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_cosines(_matrix(batch.column(2)), _matrix(batch.column(3))))], ["q", "cls", "score"])

    with_q = pairs.join(classes.select(F.col("cls").alias("q"), F.col("v").alias("x")), "q")
    return with_q.join(classes.select("cls", F.col("v").alias("y")), "cls").select("q", "cls", "x", "y").mapInArrow(run, "q long, cls long, score double")


def _everywhere(short: DataFrame, classes: DataFrame, k: int) -> DataFrame | None:
    """(q, cls, score): for each of short (cls, v) its k + 1 nearest classes in every part of the rows; null if short is empty."""
    chunks, out = -(-short.count() // CHUNK), None
    for n in range(chunks):
        own = short.filter(F.pmod(F.xxhash64("cls"), F.lit(chunks)) == n).select("cls", "v").toArrow()
        if not own.num_rows:
            continue
        shared = short.sparkSession.sparkContext.broadcast((own.column("cls").to_numpy(), _matrix(own.column("v"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, mine = shared.value
            own = unit(mine)
            for batch in batches:
                if batch.num_rows:
                    cls, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                    rough = own @ unit(x).T
                    least = np.partition(rough, max(0, len(cls) - k - 1), axis=1)[:, max(0, len(cls) - k - 1)] - NEAR
                    q, at = np.nonzero(rough >= least[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(cls[at]), pa.array(_cosines(x[at], mine[q]))], ["q", "cls", "score"])

        part = classes.select("cls", "v").mapInArrow(run, "q long, cls long, score double")
        out = part if out is None else out.unionByName(part)
    return out


def _tops(scored: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cls, top): the k + 1 nearest (far, id) of each class asked."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))
    few = scored.withColumn("place", place).filter(F.col("place") <= k + 1).join(classes.select("cls", "ids"), "cls")
    near = few.select("q", (-F.col("score")).alias("far"), F.explode("ids").alias("id")).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("top"))
    return near.select(F.col("q").alias("cls"), F.slice("top", 1, k + 1).alias("top"))


def _of_one_length(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    total = rows.count()
    taken = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = unit(_matrix(taken.column("v")))
    model = Codes.fit(sample)
    radius, wide = learned_radii(model, sample, k)

    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.withColumn("n", least).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stash(classes.select(F.col("ids")[0].alias("cls"), "ids", "v"), "mih-classes")
    queries = stash(rows.filter(is_query).join(classes.select("cls", "v"), "v").select("id", "cls"), "mih-queries")
    asked = queries.select("cls").distinct()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = model(unit(_matrix(batch.column(1)))).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["cls", "c"])

    codes = stash(classes.select("cls", "v").mapInArrow(coded, "cls long, c array<long>"), "mih-codes")
    split = best_parts(model.bits, radius, total)
    pairs = stash(retrieved(codes.join(asked, "cls", "left_semi"), codes, split, radius, wide, total), "mih-pairs")
    scored = stash(_scored(pairs, classes), "mih-scored")

    def answers(scored: DataFrame) -> DataFrame:
        near = queries.join(_tops(scored, classes, k), "cls", "left")
        return near.select("id", "cls", F.slice(F.filter("top", lambda t: t["id"] != F.col("id")), 1, k).alias("top"))

    first = stash(answers(scored), "mih-first")
    lacking = F.coalesce(F.size("top"), F.lit(0)) < min(k, total - 1)
    short = stash(classes.select("cls", "v").join(first.filter(lacking).select("cls").distinct(), "cls", "left_semi"), "mih-short")
    again = _everywhere(short, classes, k)
    if again is None:
        return first
    return first.filter(~lacking).unionByName(answers(again).join(first.filter(lacking).select("id"), "id", "left_semi"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Return (query_id, rank, vec_id, score): each query's k nearest rows by cosine, ties to the smaller id.

    is_query: a condition on the column `id`.  No part is taken by null ids and vectors, and by vectors that are zero or hold null or
    non-finite components.  Vectors are compared with those of their own length; a search runs for each length.  Rows that share an id are one
    row, with the least of their vectors; a query never finds its own id.  With fewer than k candidates all are
    returned; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    with scratch(vectors.sparkSession):
        return stash(_searched(rows, is_query, k), "mih-nearest", kept=True)


def _searched(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    rows = stash(rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v")), "mih-rows")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = [_of_one_length(rows.filter(F.size("v") == n), is_query, k) for n in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = reduce(DataFrame.unionByName, found).select(F.col("id").alias("query_id"), F.posexplode("top").alias("rank", "t"))
    return top.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.far")).alias("score"))


def op2_query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("id") % 50 == 0)
