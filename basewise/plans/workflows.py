"""Whole runs: build databases, match reads, classify them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basewise.operators import analytics, match, strands, windowing


def reference_db(seqs: DataFrame, min_k: int, max_k: int | None = None, mode: str = "compat", dust: float | None = None, run: int | None = None, among: list[strands.Seed] | None = None) -> DataFrame:
    """(kmer, taxid, cnt) from (taxid, seq), both strands; filters come before the other strand.  among: what a search needs of it (strands.seeds), which leaves out the most."""
    from basewise.functions import bases

    if dust is None and run is None:
        return strands.counted(seqs, min_k, max_k or min_k, mode, among)
    found = windowing.windows(seqs.select("taxid", "seq"), min_k, max_k)
    found = found.filter(bases.passes_dust("kmer", dust)) if dust is not None else found
    found = found.filter(bases.passes_runs("kmer", run)) if run is not None else found
    return windowing.count_db(found, mode)


def reads_db(reads: DataFrame, min_k: int, max_k: int | None = None) -> DataFrame:
    """(kmer, read, pos) from (read, seq)."""
    return windowing.read_db(windowing.windows(reads.select("read", "seq"), min_k, max_k))


def find(reads: DataFrame, db: DataFrame, max_diff: int = 0, best: bool = False, held: match.Lengths | None = None) -> DataFrame:
    """Matches of a read database of one or more lengths; of one length and without differences by an equi-join.  held: the lengths of db, if known; ValueError if others are searched."""
    from pyspark.sql import functions as F

    low, high = reads.agg(F.min(F.length("kmer")), F.max(F.length("kmer"))).first()
    if low is not None and low == high and max_diff == 0:
        return match.exact(reads, db, low, held).select("kmer", F.col("kmer").alias("match_kmer"), F.lit(0).alias("dist"), F.lit("-").alias("diff"), "taxid", "cnt")
    return match.nearest(reads, db, max_diff, best, held=held)


def classify_reads(reads: DataFrame, db: DataFrame, held: match.Lengths | None = None) -> DataFrame:
    return analytics.classify(analytics.collect_by_read(reads, find(reads, db, held=held)))
