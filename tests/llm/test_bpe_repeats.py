"""Rows that repeat, share an id or have none, words longer than the table has room for, and the bounds of the table of frequent words."""

import hashlib

import numpy as np
import pytest
from basewise.llm import bpe_words


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, id int, ids string, hash string, decoded string")


@pytest.mark.parametrize(("frequent", "parts"), [(bpe_words.FREQUENT, 16), (0, 16), (3, 2)])
def test_repeats_and_long_words(spark, monkeypatch, frequent, parts):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe_words, "PARTS", parts)
    own = Tokenizer.from_file(bpe_words.default_path())
    token = "q7" * 3_000
    texts = [None, "", "the same line", f"before {token} behind", token, "zyxwv " * 500, "Ünï 日本 the"]
    rows = [(i, t, 1, None, "x", None) for t in texts for i in (None, None, None, 4, 4, 5)] * 3
    want = []
    for i, t, *_ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe_words.encode(rows_of(spark, rows).repartition(5), bpe_words.default_path(), frequent=frequent, digest=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = bpe_words.op10_query(spark, rows_of(spark, []))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and df.count() == 0


def test_frequent_words_are_bounded(spark):
    """A long word at the top leaves its room to others, and neither bound is passed."""
    words = spark.createDataFrame([("x" * 1_000, 5_000), ("a", 900), ("bb", 800), ("y" * 90, 800), ("c", 7), ("d", 7), ("e", 7)], "word string, n long")
    names = lambda **how: {r.word[:1] for r in bpe_words._frequent(words, **how).collect()}
    assert names(most=100) == set("xabycde")
    assert names(most=100, room=50) == set("abcde")
    assert names(most=3, room=50) == set("ab")
    assert names(most=0) == set()
