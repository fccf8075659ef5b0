"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent n-grams (one to three letters, a word's ends
marked) in order of frequency.  A document goes to the language whose profile is nearest by the out-of-place distance:
the sum, over the document's own most frequent n-grams, of how far each is from its place in the profile, a missing
one counting as the profile's whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, tidy
from .sql import crc32

TOP = 300  # n-grams of a profile, and of a document
BITS = 21  # of a code point
CHUNK = 1 << 20  # characters counted at once in training
UND = "und"
#: Below this score a text is like none of the learned languages.
LEAST_SCORE = 0.2


def letter_table() -> np.ndarray:
    """For every code point its lower-case form if it is a letter, else 1, the mark of a word's end."""
    out = np.ones(0x110000, np.int32)
    for k in range(0x110000):
        if (c := chr(k)).isalpha():
            out[k] = ord(low) if len(low := c.lower()) == 1 else k
    return out


def grams(text: str, letters: np.ndarray) -> np.ndarray:
    """The codes of all n-grams of a text; n-grams never reach over a word's end."""
    s = np.ones(len(text) + 2, np.int64)
    s[1:-1] = letters[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    end = s == 1
    keep = ~end
    keep[1:] |= keep[:-1]
    keep[0] = True
    s, end = s[keep], end[keep]
    if len(s) < 2:
        return s[:0]
    two = (s[:-1] << BITS) | s[1:]
    three = ((two[:-1] << BITS) | s[2:])[~end[1:-1]]
    return np.concatenate([s[~end], two, three])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """Return (lang, code, place), place from 0, from all rows with a language and a text.  Equal counts: smaller code first."""
    letters = docs.sparkSession.sparkContext.broadcast(letter_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[str, tuple[list[str], int]] = {}
            sums: dict[str, list] = {}

            def count(lang: str) -> None:
                texts, _ = waiting.pop(lang)
                sums.setdefault(lang, []).append(counted(grams("\n".join(texts), letters.value)))  # noqa: B023

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts, size = waiting.get(lang, ([], 0))
                texts.append(text)
                waiting[lang] = (texts, size + len(text))
                if size + len(text) > CHUNK:
                    count(lang)
            for lang in list(waiting):
                count(lang)
            for lang, parts in sums.items():
                codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([x for _, x in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    known = in_batches(docs).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = known.mapInArrow(tidy(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("nth", place).filter(F.col("nth") <= top).select("lang", "code", (F.col("nth") - 1).alias("place"))


def identify(docs: DataFrame, learned: DataFrame, keep: list[str], text_col: str = "text", top: int = TOP) -> DataFrame:
    """Return keep, lang_pred and score for every row.

    learned: the table of profiles(), which holds top rows a language.  lang_pred is the nearest language, the first by name among equals, or `und`
    if the text is null or has no letter, or nothing was learned.  score is 1 for a distance of nothing and
    0 for the greatest possible; `und` has 0.  Repeated rows give repeated rows.
    """
    rows = learned.collect()  # top rows a language
    langs = sorted({r.lang for r in rows})
    codes = np.array(sorted({r.code for r in rows}), np.int64)
    places = np.full((len(codes) + 1, len(langs)), -1, np.int64)
    for r in rows:
        places[np.searchsorted(codes, r.code), langs.index(r.lang)] = r.place
    letters = docs.sparkSession.sparkContext.broadcast(letter_table())

    def judge(text: str | None) -> tuple[str, float]:
        own, n = counted(grams(text or "", letters.value))
        if not len(own) or not langs:
            return UND, 0.0
        own = own[np.argsort(-n, kind="stable")[:top]]
        at = np.searchsorted(codes, own)
        at[np.append(codes, -1)[at] != own] = len(codes)
        there = places[at]
        far = np.where(there < 0, top, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        best = int(far.argmin())
        return langs[best], float(1 - far[best] / (len(own) * top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*keep, "lang_pred", "score"])

    rows = in_batches(docs).select(*keep, F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op4_query(docs: DataFrame) -> DataFrame:
    """Predictions for every document by profiles of those not held out."""
    docs = docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    learned = profiles(docs.filter(~F.col("held_out")))
    return identify(docs, learned, ["doc_id", "held_out"])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, text, coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 4 = 2, false) AS held_out FROM documents),
w AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM d) GROUP BY r, word),
p AS (SELECT word, [CAST(1 AS BIGINT)] || list_transform(string_split(word, ''), lambda c: CAST(ord(c) AS BIGINT)) || [CAST(1 AS BIGINT)] AS p FROM (SELECT DISTINCT word FROM w)),
g AS (SELECT word, unnest(p[2:len(p) - 1] || list_transform(range(1, len(p)), lambda k: p[k] * {1 << BITS} + p[k + 1]) || list_transform(range(1, len(p) - 1), lambda k: p[k] * {1 << 2 * BITS} + p[k + 1] * {1 << BITS} + p[k + 2])) AS code FROM p),
c AS (SELECT r, code, sum(n) AS n FROM w JOIN g USING (word) GROUP BY r, code),
o AS (SELECT r, code, row_number() OVER (PARTITION BY r ORDER BY n DESC, code) - 1 AS own FROM c QUALIFY own < {TOP}),
t AS (SELECT lang, code, sum(n) AS n FROM c JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code),
l AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS place FROM t QUALIFY place < {TOP}),
f AS (SELECT r, k.lang, sum(coalesce(abs(place - own), {TOP})) AS far, count(*) AS n FROM o CROSS JOIN (SELECT DISTINCT lang FROM l) k LEFT JOIN l ON l.lang = k.lang AND l.code = o.code GROUP BY r, k.lang),
b AS (SELECT r, lang, 1 - CAST(far AS DOUBLE) / (n * {TOP}) AS score FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, '{UND}') AS lang_pred, coalesce(score, 0.0) AS score FROM d LEFT JOIN b USING (r)
"""
