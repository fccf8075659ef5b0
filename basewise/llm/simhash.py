"""SimHash near-duplicates with pigeonring filtering.

Two 64-bit fingerprints are linked when at most max_bits bits differ.  Cut a
fingerprint into m segments on a ring.  If the differences over all m segments sum to at most d, then
from some segment on, every chain of l consecutive segments differs in at most
l * d / m bits (the pigeonring principle).  The first segments of that chain, those with
l * d / m < 1, must be equal, so they are the join key; each longer chain is checked against its
own budget before the full distance.

Buckets of the join key with many members get longer keys: the next chain leaves only one bit for all segments behind the
head, so one half of those bits is equal too, and so on by halves, until a bucket is small or all of them but one are equal.  The
key then has 55 of 64 bits, and a bucket is bounded by what can differ in the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, scratch, stash, tidy, utf8
from .components import connected_components

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
PAIRED = 48  # larger buckets are split by longer keys


def bit_table() -> np.ndarray:
    """The bits of every byte, lowest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray, bits: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if it is set in over half of them."""
    octets = h.view(np.uint8).reshape(-1, 8)  # little-endian: column k holds bits 8k to 8k+7
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of fewer words, of the whole sequence; without words none."""
    words = text.lower().split()  # on bytes: A-Z only, and white space 20, 09-0D only
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Return (id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bit_table()
        for batch in batches:
            hashes = (shingle_hashes(t, shingle) for t in batch.column(1).to_pylist())
            fps = np.fromiter((majority(h, bits) if len(h) else 0 for h in hashes), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return in_batches(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(tidy(run), "id long, fp long")


def _turned(c: Column, by: int) -> Column:
    return c if by == 0 else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))


def _bits(at: Column, width: int) -> Column:
    """A long with `width` bits from bit `at` on, counted from the top."""
    return F.call_function("shiftleft", _long((1 << width) - 1), F.lit(64 - width) - at)


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def fingerprint_links(fps: DataFrame, max_bits: int = 2, paired: int = PAIRED) -> DataFrame:
    """Return (a, b), every pair of representatives whose fingerprints differ in 1 to max_bits bits; max_bits is 1 to SEGMENTS - 1.

    fps: distinct (fp, rep).  Buckets of more than `paired` members are split by further equal bits as long as the chain leaves any, so a
    bucket's size has a bound whatever the input: with two bits, 512 fingerprints.
    """
    if not 1 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits is 1 to {SEGMENTS - 1}")
    head = (SEGMENTS - 1) // max_bits  # segments whose budget is below one bit
    budgets = {length * max_bits // SEGMENTS: length for length in range(head + 1, SEGMENTS)}  # the longest chain of a budget implies the shorter ones
    open_width = WIDTH * (budgets.get(1, head) - head)  # bits behind the head of which one may differ at most
    starts = F.array(*[F.struct(F.lit(k).alias("start"), _turned(F.col("fp"), WIDTH * k).alias("t")) for k in range(SEGMENTS)])
    now = fps.select("fp", "rep", F.explode(starts).alias("s")).select("fp", "rep", "s.start", "s.t", _bits(F.lit(0), WIDTH * head).alias("known"), F.lit(WIDTH * head).alias("at"))

    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("start", "known", "key")]
    z = F.col("l.t").bitwiseXOR(F.col("r.t"))
    fine = (F.col("l.rep") < F.col("r.rep")) & (F.bit_count(z) <= max_bits)
    for budget, length in budgets.items():
        fine = fine & (F.bit_count(F.shiftrightunsigned(z, 64 - WIDTH * length)) <= budget)
    links = None
    while True:
        keyed = now.withColumn("key", F.col("t").bitwiseAND(F.col("known")))
        shared = keyed.groupBy("start", "known", "key").agg(F.count("*").alias("n")).filter("n > 1")
        members = stash(keyed.join(shared, ["start", "known", "key"]), "simhash-members")
        last = open_width < 2
        few = (members if last else members.filter(F.col("n") <= paired)).select("start", "known", "key", "t", "rep")
        found = few.alias("l").join(few.alias("r"), same[0] & same[1] & same[2] & fine)
        found = found.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
        links = found if links is None else links.union(found)
        many = members.filter(F.col("n") > paired)
        if last or many.isEmpty():
            return links.distinct()
        half = open_width // 2  # the first half of the open bits or the rest is equal
        rest = open_width - half
        parts = [
            F.struct(F.col("known").bitwiseOR(_bits(F.col("at"), half)).alias("known"), (F.col("at") + half).alias("at")),
            F.struct(F.col("known").bitwiseOR(_bits(F.col("at") + half, rest)).alias("known"), F.col("at").alias("at")),
        ]
        now = many.select("fp", "rep", "start", "t", F.explode(F.array(*parts)).alias("p")).select("fp", "rep", "start", "t", "p.known", "p.at")
        open_width = rest


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Return (id, fp, component) for every row: the fingerprint and the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows give repeated rows.
    Rows with a null id get their fingerprint and a null component.  Other columns are ignored.  An empty table gives
    no rows.
    """
    with scratch(docs.sparkSession):
        fps = stash(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
        reps = stash(fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
        groups = connected_components(fingerprint_links(reps, max_bits), "a", "b")
        by_fp = reps.join(groups, reps.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
        out = fps.join(by_fp, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
        return stash(out, "simhash-groups", kept=True)


def op7_query(docs: DataFrame) -> DataFrame:
    """The digest columns of simhash_groups: fingerprint as 16 lowercase hex digits."""
    return simhash_groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
