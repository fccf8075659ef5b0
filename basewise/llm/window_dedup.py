"""Substring dedup by Rabin-Karp hashes of every window of words.

Each chunk of documents rolls a hash over every window of a fixed number of words and sends the different ones, 40 bits each,
to buckets, which count the chunks that hold them.  Windows that stand in one chunk only are settled there.  For the others, the chunk sends two independent hashes
of 64 bits and the least document that holds the window, and learns which of them a smaller document of another chunk holds.
Removed windows are merged into maximal intervals of words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BLOB, BLOB_TYPES, CHUNK, LEAST, blobs, chunked, distinct, opened

LENGTH = 13
#: Bases of the two rolling hashes: odd, so that they have an inverse modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Windows in a bucket on average; most different words that a task remembers; bytes of a text that are split at a time.
BUCKET = 2_000_000
REMEMBERED = 500_000
PIECE = 4 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
RESULT = "id long, n_words long, spans array<struct<start: int, stop: int>>, kept binary"
RESULT_TYPES = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary())])


def split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists that end at white space; bytes.split divides at just these six characters."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        end = SPACE.search(text, stop) if stop < len(text) else None
        stop = end.start() if end else len(text)
        yield text[at:stop].split()
        at = stop


class Numbers(dict):
    """A number for each word, and 128 random bits of it."""

    def __init__(self) -> None:
        self.bits = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.bits += hashlib.blake2b(word, digest_size=16).digest()
        self[word] = n = len(self)
        return n

    def values(self) -> np.ndarray:
        return np.frombuffer(bytes(self.bits), np.uint64).reshape(-1, 2)


def rolled(values: np.ndarray, base: int, length: int) -> np.ndarray:
    """Hashes of all windows: the difference of two sums of values times powers of base, divided by the power where the window starts."""
    powers = np.full(len(values) + 1, base, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * np.multiply.accumulate(powers)[:-1], out=sums[1:])
    inverse = np.full(len(values) - length + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return (sums[length:] - sums[:-length]) * np.multiply.accumulate(inverse)


class Windows:
    """All windows of a chunk: two hashes, the document's order and the first word of each, and where each document's words begin."""

    def __init__(self, table: pa.Table, numbers: Numbers, length: int) -> None:
        if len(numbers) > REMEMBERED:
            numbers.clear()
            numbers.bits.clear()
        found, sizes = [], []
        for text in table["text"]:
            own = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in split(text.as_py())]
            sizes.append(sum(map(len, own)))
            found += own
        self.begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.length = length
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.start = np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :]) if len(doc) >= length else np.zeros(0, np.int64)
        self.at = table["at"].to_numpy()[doc[self.start]]
        if not len(self.start):
            self.one = self.two = np.zeros(0, np.uint64)
            return
        values = numbers.values()[np.concatenate(found)]
        self.one, self.two = (rolled(values[:, k], BASES[k], length)[self.start] for k in (0, 1))

    def keys(self, buckets: int) -> np.ndarray:
        """The bucket of each window, by its second hash, and 40 bits of the first."""
        return ((self.two >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(40) | self.one >> np.uint64(24)


def least(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, least): rows sorted by both hashes, where each different pair begins among them, and its least at."""
    order = np.argsort(one)
    x, y = one[order], two[order]
    if np.any((x[1:] == x[:-1]) & (y[1:] != y[:-1])):
        order = np.lexsort((two, one))
        x, y = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
    return order, first, np.minimum.reduceat(at[order], first) if len(x) else at


def held(wanted: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of wanted are among known, which is sorted."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """Return (id, n_words, spans, kept) for every row: the number of words, maximal runs (start, stop) of removed words, and the other words' bytes joined by one space.

    A word is removed if a window of `length` words covers it whose words also stand in a row with a smaller id.  Words are runs without ASCII white space.
    A null text has none.  A null id comes after all others; rows that share an id, null included, remove nothing of each other.  Rows that repeat id and text get
    the same result each.  Texts under `length` words lose nothing.  Other columns are ignored, whatever their names; an empty table gives no rows.
    Two windows are held to be equal if 128 bits of them are.
    """
    rows, _, size = chunked(docs, id_col, text_col, chunk)
    buckets = min(max(LEAST, math.ceil(size / 5 / bucket)), (1 << 24) - 1)
    grouped, numbers = rows.groupBy("chunk"), Numbers()

    def ask(table: pa.Table) -> pa.Table:
        key = distinct(Windows(table, numbers, length).keys(buckets))
        return blobs(table["chunk"][0].as_py(), key >> np.uint64(40), key & np.uint64((1 << 40) - 1))

    def shared(table: pa.Table) -> pa.Table:
        """Of each chunk's keys those that another chunk holds too."""
        own = [x for (x,) in opened(table, np.uint64)]
        values, n = np.unique(np.concatenate(own), return_counts=True)
        several, where = values[n > 1], table["bucket"][0].as_py()
        kept = [(c, x[held(x, several)]) for c, x in zip(table["chunk"].to_pylist(), own, strict=True)]
        return pa.concat_tables([BLOB_TYPES.empty_table(), *(blobs(c, np.full(len(x), where), x) for c, x in kept if len(x))])

    def ask_again(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return BLOB_TYPES.empty_table()
        found = Windows(table, numbers, length)
        known = [np.uint64(b) << np.uint64(40) | x for b, (x,) in zip(answers["bucket"].to_pylist(), opened(answers, np.uint64), strict=True)]
        mine = held(found.keys(buckets), np.sort(np.concatenate(known)))
        one, two, at = found.one[mine], found.two[mine], found.at[mine]
        order, first, low = least(one, two, at)
        one, two = one[order][first], two[order][first]
        where = (two >> np.uint64(32)) % np.uint64(buckets)
        by = np.argsort(where, kind="stable")
        return blobs(table["chunk"][0].as_py(), where[by], one[by], two[by], low[by])

    def smaller(table: pa.Table) -> pa.Table:
        """Of each chunk's windows those that a smaller document of another chunk holds."""
        parts = opened(table, np.uint64, np.uint64, np.int64)
        one, two, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, low = least(one, two, at)
        later = np.zeros(len(one), bool)
        later[order] = at[order] > np.repeat(low, np.diff(first, append=len(one)))
        out, begin, where = [BLOB_TYPES.empty_table()], 0, table["bucket"][0].as_py()
        for c, (x, y, _) in zip(table["chunk"].to_pylist(), parts, strict=True):
            own = later[begin : begin + len(x)]
            begin += len(x)
            if own.any():
                out.append(blobs(c, np.full(own.sum(), where), x[own], y[own]))
        return pa.concat_tables(out)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return RESULT_TYPES.empty_table()
        found = Windows(table, numbers, length)
        order, first, low = least(found.one, found.two, found.at)
        gone = found.at[order] > np.repeat(low, np.diff(first, append=len(order)))
        if len(answers):
            one, two = (np.concatenate(x) for x in zip(*opened(answers, np.uint64, np.uint64), strict=True))
            by = np.lexsort((two, one))
            one, two, x, y = one[by], two[by], found.one[order][first], found.two[order][first]
            # a first hash is among the answers once, or, by chance, a few times
            there, to = np.searchsorted(one, x), np.searchsorted(one, x, "right")
            here = np.zeros(len(x), bool)
            for k in range(int((to - there).max(initial=0))):
                here |= (there + k < to) & (two[np.minimum(there + k, len(two) - 1)] == y)
            gone |= np.repeat(here, np.diff(first, append=len(order)))
        start = found.start[order[gone]]
        cover = np.zeros(found.begins[-1] + 1, np.int32)
        cover[start] += 1
        np.subtract.at(cover, start + length, 1)
        cover = np.cumsum(cover) > 0
        columns = [[], [], []]
        for text, a, b in zip(table["text"], found.begins[:-1].tolist(), found.begins[1:].tolist(), strict=True):
            own = cover[a:b]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
            columns[0].append(b - a)
            columns[1].append([{"start": x, "stop": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            if not edges:
                columns[2].append(b" ".join(x for words in split(text.as_py()) if (x := b" ".join(words))))
                continue
            keep, kept, n = (~own).tolist(), [], 0
            for words in split(text.as_py()):
                if x := b" ".join(compress(words, keep[n : n + len(words)])):
                    kept.append(x)
                n += len(words)
            columns[2].append(b" ".join(kept))
        return pa.Table.from_arrays([table["id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(columns, RESULT_TYPES.types[1:], strict=True))], schema=RESULT_TYPES)

    first = grouped.applyInArrow(ask, BLOB).groupBy("bucket").applyInArrow(shared, BLOB)
    second = grouped.cogroup(first.groupBy("chunk")).applyInArrow(ask_again, BLOB).groupBy("bucket").applyInArrow(smaller, BLOB)
    return grouped.cogroup(second.groupBy("chunk")).applyInArrow(finish, RESULT)


def op11_query(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM s JOIN f ON s.k = f.k WHERE s.doc_id > least),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
x AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u LEFT JOIN g ON u.r = g.r AND u.p = g.p WHERE g.p IS NULL GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x ON d.r = x.r
"""
