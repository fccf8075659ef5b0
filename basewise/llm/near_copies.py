"""Near copies: SimHash links, and exact Jaccard similarity of word shingles for what SimHash cannot reach.

Two texts are linked when the SimHash fingerprints of their five-word shingles differ in BITS bits at most (simhash, by pigeonring), or when their
sets of shingles have a Jaccard similarity of LEAST or more.  SimHash alone cannot promise the second: such pairs differ in up to 14 of 64 bits and
more, and a radius that wide has no index that stays linear.  So for these candidates come by prefixes.  With all shingles in one order, two sets that
are similar enough share one of their first |set| / 5 + 1 shingles; every pair that shares one is checked against its whole sets, so no pair is
missed and none is linked wrongly.

The order puts common shingles last.  It is estimated from a sample of the sets, which decides the cost and never the result.
Large buckets are not paired: their members are first checked against two leaders.  Only where a bucket still holds several components are
its members compared across these, in blocks of bounded size, by sketches of their sets; what may be similar goes on to the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_batches, released, scratch, stash, tidy, utf8
from .components import connected_components
from .simhash import bit_table, fingerprint_links, majority, shingle_hashes

SHINGLE = 5
LEAST = (4, 5)  # the least similarity, as a fraction
BITS = 3  # of two fingerprints that differ, at most
PAIRED = 48  # larger buckets go by leaders first
BLOCK = 512  # members of a bucket compared with as many others at a time
SAMPLED = 0.125  # share of the sets whose shingles are counted for the order
JOINED = 2_000_000  # nodes or rows that choose among the sets by broadcast at most; more shuffle the sets
LISTED = 1_000_000  # common shingles of which the order knows the count at most


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Return (id, text_hash, node, fp, held) for every row: the hash of its text, and its shingles with a hash of them all and their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bit_table()
        for batch in batches:
            held = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 7) for h in held], np.uint64).view(np.int64)
            fps = np.array([majority(h, bits) if len(h) else 0 for h in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(fps), _lists(held, pa.int64())], ["id", "text_hash", "node", "fp", "held"])

    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), utf8(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "id long, text_hash long, node long, fp long, held array<long>")


def _prefixes(sets: DataFrame, common: DataFrame) -> DataFrame:
    """Return (h, node, size, pos, typical) for the first shingles of each set; typical: how common its shingles are on the whole."""
    listed = common.toArrow()
    keys, counts = listed["h"].to_numpy(), listed["n"].to_numpy()
    by_key = np.argsort(keys)
    shared = sets.sparkSession.sparkContext.broadcast((keys[by_key], counts[by_key]))
    num, den = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for node, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = h.values.to_numpy(zero_copy_only=False)
                if not len(h):
                    continue
                n = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    n = np.where(known[at] == h, often[at], 0)
                first = len(h) - -(-num * len(h) // den) + 1
                top = np.lexsort((h, n))[:first]
                for k, c in enumerate((h[top], np.full(first, node), np.full(first, len(h)), np.arange(first), np.full(first, int(n.sum() * 16 // len(h))))):
                    out[k].append(c)
            columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(columns, ["h", "node", "size", "pos", "typical"])

    return sets.select("node", "held").mapInArrow(tidy(run), "h long, node long, size long, pos long, typical long")


def hinted(df: DataFrame) -> DataFrame:
    """df, to be broadcast while it has up to JOINED rows."""
    return F.broadcast(df) if df.count() <= JOINED else df


def _joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs with what sets (node, held) holds for each."""
    wanted = stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-wanted")
    sets = stash(sets.join(hinted(wanted), "node", "left_semi"), "near-checked", wide=True)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    return both.select("a", "b", "x", "y")


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, held): of each set how many shingles fall into each of 256 parts, as one byte each; 255 stands for more as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.minimum(np.bincount((h.values.to_numpy(zero_copy_only=False) >> 56) & 255, minlength=256), 255).astype(np.uint8).tobytes() for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["node", "held"])

    return sets.select("node", "held").mapInArrow(tidy(run), "node long, held binary")


def _may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of sketches x and y may be those of similar sets: two sets share at most the sum of the lesser counts of their parts."""
    num, den = LEAST
    most = np.minimum(x, y).sum(1, dtype=np.int64)
    full = (x == 255).any(1) | (y == 255).any(1)
    return full | ((num + den) * most >= num * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets are similar enough; sketches go first, since they are small."""
    num, den = LEAST
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 256) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(_may(x, y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                met = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * met >= num * (len(x) + len(y) - met))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = stash(_joined(pairs, _sketches(sets)).mapInArrow(tidy(may), "a long, b long"), "near-likely")
    return stash(_joined(likely, sets).mapInArrow(tidy(run), "a long, b long"), "near-links")


def _across(placed: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of a bucket's members in different components that may be similar; placed: (h, node, component).

    A bucket is cut into blocks, and a task takes two blocks at a time, so no bucket is gathered; only what sketches let by is given out.
    """
    blocks = placed.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = placed.join(hinted(stash(blocks, "near-blocks")), "h").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = stash(placed.select("node").distinct(), "near-placed")
    mine = mine.join(_sketches(sets.join(hinted(wanted), "node", "left_semi")), "node")
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = mine.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "held")

    def compare(group: pa.Table) -> pa.Table:
        own, node, component = (group.column(c).to_numpy() for c in ("own", "node", "component"))
        sketch = np.frombuffer(b"".join(group.column("held").to_pylist()), np.uint8).reshape(-1, 256)
        low = np.flatnonzero(own == own.min())
        high = np.flatnonzero(own == own.max())
        a, b = [], []
        for k in low.tolist():
            there = high[(component[high] != component[k]) & ((own[high] != own[k]) | (node[high] > node[k]))]
            there = there[_may(np.broadcast_to(sketch[k], (len(there), 256)), sketch[there])]
            a += [node[k]] * len(there)
            b += node[there].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return mine.groupBy("h", "i", "j").applyInArrow(compare, "a long, b long")


def _fits(a: str, b: str) -> str:
    """Whether two sets that meet at these prefix places can still share enough: SQL over <a>_size, <a>_pos and so on."""
    num, den = LEAST
    return f"{num + den} * (1 + least({a}_pos, {b}_pos) + least({a}_size - {a}_pos - 1, {b}_size - {b}_pos - 1)) >= {num} * ({a}_size + {b}_size)"


def _sided(df: DataFrame, side: str, *more: Column) -> DataFrame:
    return df.select("h", *more, F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("pos").alias(f"{side}_pos"))


def similar_links(sets: DataFrame) -> DataFrame:
    """Return (a, b), enough pairs of similar nodes to connect all that are similar; sets: (node, held), one row of each node."""
    common = sets.sample(SAMPLED, seed=1).select(F.explode("held").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    common = common.filter("n > 2").orderBy(F.desc("n")).limit(LISTED)
    bucket = Window.partitionBy("h")
    members = _prefixes(sets, common).withColumn("n", F.count("*").over(bucket)).filter("n > 1")
    members = stash(members, "near-members")

    few = members.filter(F.col("n") <= PAIRED)
    paired = _sided(few, "a").join(_sided(few, "b"), "h").filter("a < b").filter(_fits("a", "b")).select("a", "b")
    many = members.filter(F.col("n") > PAIRED)
    leaders = many.groupBy("h").agg(F.max_by("node", F.struct("typical", "node")).alias("l1"), F.min("node").alias("l2"))
    led = many.join(leaders, "h").select(F.col("node").alias("a"), F.explode(F.array("l1", "l2")).alias("b")).filter("a <> b")
    links = _similar(paired.union(led), sets)
    if many.isEmpty():
        return links

    released(sets.sparkSession)
    groups = connected_components(links, "a", "b")
    released(sets.sparkSession)
    placed = many.join(groups, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("h")
    placed = stash(placed.join(split, "h"), "near-split")
    return links.union(_similar(_across(placed, sets), sets))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Return (id, text_hash, grp) for every row; rows have one grp when a chain of SimHash links and similarities of LEAST or more joins them.

    text_hash is xxhash64 of the text.  Null and empty texts have no shingles and are copies of each other; null ids are kept;
    repeated rows give repeated rows; other columns are ignored.
    """
    with scratch(docs.sparkSession):
        rows = stash(shingle_sets(docs, id_col, text_col, shingle).withColumn("uid", F.monotonically_increasing_id()), "near-sets", wide=True)
        copied = stash(rows.groupBy("node").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1").select("node", "first"), "near-copied")
        extra = stash(rows.select("node", "uid").join(hinted(copied), "node").filter("uid > first").select("uid"), "near-extra")
        sets = rows.select("uid", "node", "held").join(hinted(extra), "uid", "left_anti").select("node", "held")
        nodes = sets.filter("size(held) > 0").join(rows.select("node", "fp").distinct(), "node").select("node", "fp")
        reps = stash(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "near-fingerprints")
        equal = nodes.join(reps, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        near = stash(fingerprint_links(reps, BITS), "near-bits")
        released(docs.sparkSession)  # many plans make much garbage, and the driver's heap grows as long as it isn't collected
        links = near.union(equal).union(similar_links(sets))
        released(docs.sparkSession)
        groups = connected_components(links, "a", "b")
        released(docs.sparkSession)
        out = rows.select("id", "text_hash", "node").join(hinted(groups), "node", "left").select("id", "text_hash", F.coalesce("component", "node").alias("grp"))
        return stash(out, "near-groups", kept=True)
