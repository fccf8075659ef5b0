"""Removal of repeated word windows against a table of all windows."""

import random
import time

import numpy as np
import pytest
from basewise.llm import chunks, window_dedup
from pyspark.sql import functions as F


def brute(rows, length):
    """rows: (id, text); each row's words, removed spans and kept words."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    order = [(1 << 63) - 1 if i is None else i for i, _ in words]
    least = {}
    for at, (_, w) in zip(order, words, strict=True):
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            least[key] = min(at, least.get(key, at))
    out = []
    for at, (i, w) in zip(order, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < at:
                gone[k : k + length] = [True] * length
        edges = [k for k in range(len(w) + 1) if (gone[k] if k < len(w) else False) != (gone[k - 1] if k else False)]
        out.append((i, len(w), list(zip(edges[::2], edges[1::2], strict=True)), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def cases():
    """Overlapping passages, copies, long and empty texts, repeated and null ids, and words apart by unusual white space."""
    rng = random.Random(7)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 30))) for _ in range(12)]
    rows = [(k, " ".join(rng.choice(passages) for _ in range(rng.randrange(0, 9)))) for k in range(60)]
    rows += [(k, passages[0]) for k in range(100, 140)] + [(5, passages[1]), (5, passages[1]), (None, passages[2] + " x"), (None, "x " + passages[2]), (None, passages[2])]
    rows += [(200, None), (201, ""), (202, "a"), (203, "a b c \x1c d\x0be\x0cf" * 9), (204, "é ü " * 400), (205, "z " + "é ü " * 300)]
    return rows


def check(spark, rows, length, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit(1), "at": F.lit("x"), "spans": F.lit(2), "id": F.lit(3)})
    got = sorted((r.id is None, r.id or 0, r.n_words, [tuple(s) for s in r.spans], bytes(r.kept)) for r in window_dedup.remove_repeats(docs, length=length, **how).collect())
    want = sorted((i is None, i or 0, n, s, k) for i, n, s, k in brute(rows, length))
    assert got == want
    assert sum(len(s) for *_, s, _ in want) > 10


@pytest.mark.parametrize("length", [1, 2, 5, 13])
def test_all_windows(spark, length):
    check(spark, cases(), length)


def test_pieces_small_chunks_and_few_remembered_words(spark, monkeypatch):
    monkeypatch.setattr(window_dedup, "PIECE", 16)
    monkeypatch.setattr(window_dedup, "REMEMBERED", 3)
    check(spark, cases(), 5, chunk=64, bucket=7)


def test_equal_first_hashes(spark, monkeypatch):
    """With a base of 1 many first hashes agree, so that the second ones decide."""
    monkeypatch.setattr(window_dedup, "BASES", (1, window_dedup.BASES[1]))
    check(spark, cases(), 5)


def test_nothing_to_do(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert window_dedup.op11_query(none).count() == 0
    few = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in window_dedup.op11_query(few).collect()) == [(0, 2, 0), (1, 0, 0), (2, 0, 0)]


def test_distinct_keys():
    """A chunk's different keys are found in about the time of sorting them; np.unique took some 80 times as long."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1_000):
        x = rng.integers(0, 300, n).astype(np.uint64) << np.uint64(55)
        assert chunks.distinct(x).tolist() == sorted(set(x.tolist())) and chunks.distinct(x).dtype == np.uint64
    keys, took = rng.integers(0, 1 << 46, 1_000_000).astype(np.uint64), []
    for run in (np.sort, chunks.distinct):
        began = time.process_time()
        run(keys)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.1
