"""Windows of both strands, cut and sifted with numpy inside tasks, ahead of the shuffle that counts them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewise.functions import bases

from .match import ball_size

#: Letters that are worked on at once, and bases of a packed word.
SLICE, WORD = 1 << 18, 31
#: Seeds that a search may have to be sent to every task; bits of the table that is asked first.
SEEDS, SIEVE = 1 << 20, 22

CODE, OTHER = np.full(256, 4, np.int64), np.arange(256, dtype=np.uint8)
CODE[list(b"ACTG")] = range(4)
OTHER[list(b"ACGT")] = list(b"TGCA")
TURN, RANK = str.maketrans(*bases.PAIRS), str.maketrans(bases.ORDER, "0123")


@dataclass(frozen=True)
class Seed:
    """Packed words of n bases, sorted; a kmer has one of them from place `at` on.

    Of a block, each word stands for the kmer of k bases in the same row of whole, of which the kmer differs in d places at most; a word may repeat then.
    """

    at: int
    n: int
    words: np.ndarray
    k: int = 0
    whole: np.ndarray | None = None
    d: int = 0


def packed(kmers: list[str], at: int, n: int) -> np.ndarray:
    """The bases at to at + n of k-mers of ACGT as words, each once."""
    letters = CODE[np.frombuffer("".join(kmers).encode(), np.uint8)].reshape(len(kmers), -1)[:, at : at + n]
    return np.unique(letters @ (np.int64(1) << np.arange(2 * (n - 1), -1, -2, dtype=np.int64)))


def ball(words: np.ndarray, n: int, d: int) -> np.ndarray:
    """The words of n bases within d differences."""
    turns = np.array([0, *(m << 2 * i for i in range(n) for m in (1, 2, 3))], np.int64)
    for _ in range(d):
        words = np.unique(words[:, None] ^ turns)
    return words


def _has(table: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    sieve, words = table
    hit = sieve[_slot(values)]
    left = values[hit]
    hit[hit] = words[np.minimum(np.searchsorted(words, left), len(words) - 1)] == left
    return hit


def _slot(values: np.ndarray) -> np.ndarray:
    return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)


class _Cutter:
    def __init__(self, low: int, high: int, mode: str | None, seeds: list[Seed] | None):
        self.low, self.high, self.mode, self.seeds = low, high, mode, None
        if seeds is not None:
            self.seeds = []
            for s in seeds:
                sieve = np.zeros(1 << SIEVE, bool)
                sieve[_slot(s.words)] = True
                self.seeds.append((s, (sieve, s.words)))

    def _word(self, column, places: range | list[int], turned: bool) -> np.ndarray:
        out = column(places[0]) ^ 2 if turned else column(places[0]).copy()
        for j in places[1:]:
            out <<= 2
            out |= column(j) ^ 2 if turned else column(j)
        return out

    def _wanted(self, column, k: int, n: int) -> np.ndarray:
        """Which of n windows of length k, or their reverse complements, have a seed."""
        found = np.zeros(n, bool)
        for seed, table in self.seeds:
            at, size = seed.at, seed.n
            if at + size > k or not len(seed.words) or seed.k > k:
                continue
            for turned in (False, True):
                place = (lambda j: k - 1 - j) if turned else (lambda j: j)
                words = self._word(column, [place(j) for j in range(at, at + size)], turned)
                hit = np.flatnonzero(_has(table, words) & ~found)
                if seed.whole is None:
                    found[hit] = True
                    continue
                for some in np.array_split(hit, len(hit) // 4096 + 1):
                    codes = np.stack([column(place(j))[some] for j in range(seed.k)], 1) if len(some) else np.zeros((0, seed.k), np.int64)
                    found[some] = self._close(seed, words[some], codes ^ 2 if turned else codes)
        return found

    def _close(self, seed: Seed, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which k-mers, given by codes and the word of the seed, differ in d places at most from one of the searched ones that have it too."""
        low, high = np.searchsorted(seed.words, words, "left"), np.searchsorted(seed.words, words, "right")
        close, codes = np.zeros(len(words), bool), codes.astype(np.uint8)
        for step in range(int((high - low).max(initial=0))):
            open_ = np.flatnonzero((low + step < high) & ~close)
            close[open_] = (seed.whole[low[open_] + step] != codes[open_]).sum(1) <= seed.d
        return close

    def _forward(self, column, k: int, n: int) -> np.ndarray:
        """Which windows stand for themselves; the others are counted as their reverse complement."""
        decided, own, ahead = np.zeros(n, bool), np.full(n, self.mode == "compat" and k % 2 == 0), np.ones(n, bool)
        for at in range(0, k, WORD):
            size = min(WORD, k - at)
            a, back = self._word(column, range(at, at + size), False), self._word(column, range(k - 1 - at, k - 1 - at - size, -1), False)
            own &= a == back
            back ^= np.int64(sum(2 << 2 * i for i in range(size)))
            ahead = np.where(decided, ahead, a <= back)
            decided |= a != back
        return own | ahead

    def _rows(self, letters: np.ndarray, at: np.ndarray, k: int, taxids: pa.Array, forward: np.ndarray | None) -> pa.RecordBatch:
        """The windows of length k at these places; forward tells which stand for themselves."""
        found = np.lib.stride_tricks.sliding_window_view(letters, k)[at]
        if self.mode:
            found[~forward] = OTHER[found[~forward][:, ::-1]]
        ends = np.arange(0, (len(at) + 1) * k, k, dtype=np.int32)
        return pa.RecordBatch.from_arrays([taxids, pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(found))], names=["taxid", "kmer"])

    def _slice(self, letters: np.ndarray, codes: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Places of the windows of length k, before the end of their sequences by left, and which of them stand for themselves."""
        if k < self.high:  # one of a sequence
            at = np.flatnonzero(left == k)
            some = lambda at: lambda j: codes[at + j]
            if self.seeds is not None and len(at):
                at = at[self._wanted(some(at), k, len(at))]
            return at, self._forward(some(at), k, len(at)) if self.mode and len(at) else None
        n = max(min(len(left), len(letters) - k + 1), 0)
        every = lambda j: codes[j : j + n]
        at = np.flatnonzero((left[:n] >= k) & (self._wanted(every, k, n) if self.seeds is not None and n else True))
        if not self.mode or not len(at):
            return at, None
        return at, self._forward(every, k, n)[at] if self.seeds is None else self._forward(lambda j: codes[at + j], k, len(at))

    def _odd(self, taxid: pa.Array, seq: str) -> pa.RecordBatch:
        """The windows of one sequence that holds other letters, which no seed leaves out."""
        found = [seq[i : i + self.high] for i in range(len(seq) - self.low + 1)]
        for i, a in enumerate(found):
            if self.mode and not (self.mode == "compat" and len(a) % 2 == 0 and a == a[::-1]):
                found[i] = min(a, a[::-1].translate(TURN), key=lambda s: s.translate(RANK))
        return pa.RecordBatch.from_arrays([taxid.take(pa.array([0] * len(found))), pa.array(found, pa.string())], names=["taxid", "kmer"])

    def cut(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seqs, taxids = batch.column("seq").fill_null(""), batch.column("taxid")
        ends = np.frombuffer(seqs.buffers()[1], np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
        letters = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[: ends[-1]]
        odd = np.zeros(len(seqs), bool)
        for lo in range(int(ends[0]), int(ends[-1]), 1 << 22):
            strange = np.flatnonzero(CODE[letters[lo : lo + (1 << 22)]] == 4) + lo
            odd[np.searchsorted(ends, strange, "right") - 1] = True
        for lo in range(int(ends[0]), int(ends[-1]), SLICE):
            hi = min(lo + SLICE, int(ends[-1]))
            part = letters[lo : hi + self.high - 1]
            codes = CODE[part]
            first, last = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left")
            of = np.repeat(np.arange(first, last), np.diff(np.clip(ends[first : last + 1], lo, hi)))
            left = ends[of + 1] - np.arange(lo, hi)
            left[odd[of]] = 0
            for k in range(self.low, self.high + 1):
                at, forward = self._slice(part, codes, left, k)
                if len(at):
                    yield self._rows(part, at, k, taxids.take(pa.array(of[at])), forward)
        for i in np.flatnonzero(odd):
            if len(seqs[i].as_py()) >= self.low:
                yield self._odd(taxids.slice(i, 1), seqs[i].as_py())


def counted(seqs: DataFrame, low: int, high: int, mode: str | None = "compat", seeds: list[Seed] | None = None) -> DataFrame:
    """(kmer, taxid, cnt) from (taxid, seq): as count_db over windows, of both strands unless mode is null.

    A kmer and its reverse complement are counted as one and told apart after the shuffle, which half as many rows pass.  seeds, of a search, leave out
    k-mers that have none, and whose reverse complements have none, before the shuffle; those that have one are counted whole, of the others some may stay.
    """
    if not 0 < low <= high:
        raise ValueError("0 < min_k <= max_k is needed")
    if mode not in ("compat", "strict", None):
        raise ValueError(f"unknown mode {mode}")
    shared = seqs.sparkSession.sparkContext.broadcast(seeds) if seeds is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(low, high, mode, shared and shared.value)
        for batch in batches:
            yield from cutter.cut(batch)

    found = seqs.select("taxid", "seq").filter(F.length("seq") >= low).mapInArrow(cut, f"taxid {seqs.schema['taxid'].dataType.simpleString()}, kmer string")
    counts = found.groupBy("kmer", "taxid").agg(F.count("*").alias("cnt"))
    if not mode:
        return counts
    back = bases.reverse_complement("kmer")
    single = bases.is_own_rc("kmer", mode)
    twice = F.when(F.lit(mode == "compat") & ~bases.is_own_rc("kmer") & (F.col("kmer") == F.col("back")), 2).otherwise(1)
    both = F.when(single | (F.col("kmer") == F.col("back")), F.array("kmer")).otherwise(F.array("kmer", "back"))
    return counts.withColumn("back", back).select(F.explode(both).alias("kmer"), "taxid", (F.col("cnt") * twice).alias("cnt"))


def seeds(search: DataFrame, d: int = 0) -> list[Seed] | None:
    """What k-mers within d differences of a search (kmer) agree with; null where it is too much to be sent to every task.

    Up to WORD bases these are all k-mers within d differences, of longer ones the words of d + 1 blocks, of which one is the same, with the whole k-mers.  Only ACGT is told.
    """
    wanted = search.select("kmer").distinct()
    odd = F.max(F.col("kmer").rlike("[^ACGT]"))
    counts = wanted.groupBy(F.length("kmer").alias("len")).agg(F.count("*").alias("n"), odd.alias("odd")).collect()  # one row for each length
    if not counts or any(r["odd"] for r in counts) or sum(r["n"] * (ball_size(r["len"], d) if r["len"] <= WORD else d + 1) for r in counts) > SEEDS:
        return None
    kmers, out = wanted.toArrow().column("kmer").to_pylist(), []  # SEEDS at most
    for n in sorted({len(k) for k in kmers}):
        own = [k for k in kmers if len(k) == n]
        if n <= WORD:
            out.append(Seed(0, n, ball(packed(own, 0, n), n, d)))
            continue
        ends = [k * n // (d + 1) for k in range(d + 2)]
        for a, b in zip(ends, ends[1:], strict=False):
            size = min(WORD, b - a)
            letters = CODE[np.frombuffer("".join(own).encode(), np.uint8)].reshape(len(own), n)
            words = letters[:, a : a + size] @ (np.int64(1) << np.arange(2 * (size - 1), -1, -2, dtype=np.int64))
            order = np.argsort(words, kind="stable")
            out.append(Seed(a, size, words[order], n, letters[order].astype(np.uint8), d))
    return out

