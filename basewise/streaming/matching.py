"""Reads that arrive as a stream, matched with a stored database."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basewise.operators import windowing
from basewise.operators.stored import settled


def match_stream(reads: DataFrame, db: DataFrame, k: int) -> DataFrame:
    """(read, pos, kmer, taxid, cnt) for a stream of (read, seq): a join with the database, which is cut to k once and not in every batch; without state."""
    return windowing.windows(windowing.runs(reads), k).join(settled(windowing.restrict(db, k, k)), "kmer")


def count_stream(reads: DataFrame, db: DataFrame, k: int, time_col: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """(window, taxid, n): matched windows of reads by event time; rows later than `late` are dropped with their state."""
    found = windowing.windows(windowing.runs(reads.withWatermark(time_col, late)), k).join(settled(windowing.restrict(db, k, k)), "kmer")
    return found.groupBy(F.window(time_col, size), "taxid").agg(F.count("*").alias("n"))


def classify_stream(reads: DataFrame, db: DataFrame, k: int, time_col: str, late: str = "10 minutes", wait_seconds: int = 300) -> DataFrame:
    """(read, taxid) as analytics.classify gives them, for reads whose sequences (read, seq, time_col) arrive in several batches.

    A read is called once no row of it came for wait_seconds of event time; rows later than `late` are dropped.  Sequences of a read are windowed one by
    one, as mates are; one that comes again changes nothing, and rows without read or time are left out.  A read's state is the taxa that all its windows so far share, and the taxon that its windows
    of one taxon name: never longer than its smallest set of taxa.  The database is cut to k once, with the number of taxa of each kmer.
    """
    cut = windowing.restrict(db, k, k).select("kmer", "taxid")
    held = settled(cut.join(cut.groupBy("kmer").agg(F.count("*").alias("n")), "kmer"))
    own = reads.select("read", "seq", F.col(time_col).alias("at")).filter("read is not null and at is not null").withColumn("part", F.xxhash64("seq")).withWatermark("at", late)
    found = windowing.windows(windowing.runs(own).withColumn("run", F.xxhash64("seq")), k).join(held, "kmer").select("read", "part", "run", "pos", "taxid", "n", "at")

    def call(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            shared, only, _ = state.get
            state.remove()
            if only >= 0 and only in shared:
                yield pd.DataFrame({"read": [key[0]], "taxid": [only]})
            return
        shared, only, last = state.get if state.exists else (None, -1, 0)
        have: Counter[int] = Counter()
        places: set[tuple] = set()
        for frame in frames:  # all taxa of a window come in one batch
            rows = frame.drop_duplicates(["part", "run", "pos", "taxid"])
            fresh = rows[[x not in places for x in zip(rows["part"], rows["run"], rows["pos"], rows["taxid"], strict=True)]]
            places.update(zip(fresh["part"], fresh["run"], fresh["pos"], fresh["taxid"], strict=True))
            have.update(fresh["taxid"].tolist())
            for taxid in rows.loc[rows["n"] == 1, "taxid"].unique().tolist():
                only = taxid if only in (-1, taxid) else -2
            last = max(last, int(frame["at"].max().timestamp() * 1000))
        windows = len({x[:3] for x in places})
        common = {taxid for taxid, n in have.items() if n == windows}
        shared = sorted(common if shared is None else common.intersection(shared))
        state.update((shared, only, last))
        state.setTimeoutTimestamp(max(last + 1000 * wait_seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"read": [], "taxid": []}).astype({"read": "int64", "taxid": "int32"})

    return found.groupBy("read").applyInPandasWithState(call, "read long, taxid int", "shared array<int>, only int, last long", "append", GroupStateTimeout.EventTimeTimeout)
