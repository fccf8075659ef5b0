"""License scans: exact phrases by word, and fuzzy search for short notices.

A notice within k edits of a text, cut into k + 1 pieces, has a piece that stands in
the text unchanged (pigeonhole).  The pieces are searched exactly; around each place found, the regex library's
bounded-error matching verifies the whole notice and gives its span and edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: The phrases that are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and their labels, in words joined by spaces.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the apache license version": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version": "mpl",
    "eclipse public license version": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd license": "bsd",
    "licensed under a creative commons": "cc",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released": "unlicense",
    "boost software license version": "boost",
    "all rights reserved": "proprietary",
}
ONE_EDIT_IN = 12  # characters of a notice for each edit allowed


def _flat_table() -> bytes:
    """A-Z to a-z, what is no word character to a space; the length stays."""
    return bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or chr(k).isalnum() else 32 for k in range(256))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The edits + 1 pieces of a notice with their offsets, as equal as can be."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds phrases and notices in one text."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        self.flat = _flat_table()
        self.base = [(regex.compile(rb"(?<![^ ])" + b" +".join(map(regex.escape, p.encode().split())) + rb"(?![^ ])"), p.split()[-1].encode(), label) for p, label in base.items()]
        self.notices = [(regex.compile(b"(?b)(?:%b){e<=%d}" % (regex.escape(n.encode()), e)), e, [p.encode() for _, p in pieces(n, e)], [a for a, _ in pieces(n, e)], len(n), label) for n, label in notices.items() for e in (len(n) // ONE_EDIT_IN,)]

    def __call__(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int, str, float]]]:
        """The number of words, the places (word, label) of phrases, the spans (start, end, edits, label, score) of notices; spans in bytes."""
        flat = text.translate(self.flat)
        starts = word_starts(flat)
        places = [(int(np.searchsorted(starts, m.start())), label) for pattern, need, label in self.base if need in flat for m in pattern.finditer(flat)]
        return len(starts), places, self._fuzzy(flat)

    def _fuzzy(self, flat: bytes) -> list[tuple[int, int, int, str, float]]:
        line, origin = flat, None
        if b"  " in flat:  # runs of spaces count as one
            keep = np.frombuffer(flat, np.uint8) != 32
            keep[1:] |= keep[:-1]
            origin = np.flatnonzero(keep)
            line = np.frombuffer(flat, np.uint8)[keep].tobytes()
        found = []
        for pattern, edits, seeds, offsets, length, label in self.notices:
            done = -1
            for at in sorted(p - a for s, a in zip(seeds, offsets, strict=True) for p in _places(line, s)):
                low, high = max(0, at - edits, done), at + length + 2 * edits
                if high <= done or not (m := pattern.search(line, low, high)):
                    continue
                done = m.end()
                off = sum(m.fuzzy_counts)
                a, b = m.start(), m.end()
                found.append((int(origin[a]) if origin is not None else a, (int(origin[b - 1]) + 1) if origin is not None else b, off, label, 1 - off / length))
        return sorted(set(found))


def _places(line: bytes, seed: bytes) -> Iterator[int]:
    at = line.find(seed)
    while at >= 0:
        yield at
        at = line.find(seed, at + 1)


def word_starts(flat: bytes) -> np.ndarray:
    """The offsets where words start."""
    word = np.frombuffer(flat, np.uint8) != 32
    return np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])) if len(flat) else np.zeros(0, np.int64)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Return, for every row, id, n_words, places (word, label) and spans (start, stop, edits, label, score; bytes of the text).

    Null and empty texts have no words, places or spans; repeated rows and null ids
    give a row each; other columns are ignored; an empty table gives no rows.  A notice may differ by one edit in every
    ONE_EDIT_IN characters.  Of notices that overlap, each label's are all kept, but one notice's own spans never overlap.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("label", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(base, notices)
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            arrays = [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in sorted(p)] for _, p, _ in found], pa.list_(place)),
                pa.array([[dict(zip(span.names, s, strict=True)) for s in f] for _, _, f in found], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_words", "places", "spans"])

    schema = "id long, n_words long, places array<struct<word: long, label: string>>, spans array<struct<start: long, stop: long, edits: int, label: string, score: double>>"
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(run, schema)


def op1_query(docs: DataFrame) -> DataFrame:
    """One row for each document: phrase places, labels of both kinds, the best match's score."""
    found = scan_licenses(docs)
    sorted_set = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        sorted_set(F.col("places.label")).alias("base_labels"),
        sorted_set(F.concat("places.label", "spans.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_notices"),
    )
