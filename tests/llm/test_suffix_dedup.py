"""Substring dedup against a table of all windows."""

import hashlib
import random

import pytest
from basewise.llm import suffix_dedup
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(rows, length):
    """rows: distinct (order, bytes); the spans of each."""
    first, out = {}, {}
    for key, text in sorted(rows):
        runs = []
        for k in range(len(text) - length + 1):
            if first.setdefault(text[k : k + length], (key, k)) != (key, k):
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        out[key] = [tuple(r) for r in runs]
    return out


@pytest.mark.parametrize("how", [{}, {"merged": 1}, {"merged": 3, "held": 0}])
def test_documents(spark, how):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    long = "a" * 5_000 + "ab" * 1_000
    odd = [(5_000_000, None), (5_000_001, ""), (5_000_002, "x" * 99), (5_000_003, "x" * 100), (5_000_004, "x" * 300), (5_000_005, long), (5_000_006, "é" * 200), (5_000_007, "z" + "é" * 60)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns({"doc": F.lit(1), "part": F.lit(1), "h": F.lit("x"), "spans": F.lit(2)})
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    want = brute(texts.items(), 100)
    got = {r.id: r for r in suffix_dedup.remove_repeats(docs, digest=True, **how).collect()}
    assert got.keys() == texts.keys() and sum(map(len, want.values())) > 100
    for i, text in texts.items():
        kept, at = b"", 0
        for a, b in want[i]:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        assert tuple(got[i])[1:] == (len(text), len(text) - len(kept), len(want[i]), hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("how", [{}, {"merged": 1, "held": 0}])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_small_alphabets(spark, monkeypatch, how, letters):
    """Short lengths, low-complexity texts, pieces smaller than texts, repeated rows and null ids."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    r = random.Random(len(letters))
    pool = ["".join(r.choices(letters, k=r.randint(5, 60))) for _ in range(12)]
    rows = [(k // 2 if k % 9 else None, "".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for k in range(120)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    keyed = docs.select(F.coalesce("doc_id", F.lit(suffix_dedup.NO_ID)).alias("i"), F.xxhash64(F.col("text").cast("binary")).alias("p"), "text").collect()
    want = brute({((x.i, x.p), x.text.encode()) for x in keyed}, 20)
    got = suffix_dedup.remove_repeats(docs, length=20, gram=7, **how).collect()
    said = sorted((-1 if x.id is None else x.id, [tuple(s) for s in x.spans], bytes(x.kept)) for x in got)
    expect = []
    for x in keyed:
        spans, text = want[x.i, x.p], x.text.encode()
        gone = {k for a, b in spans for k in range(a, b)}
        expect.append((-1 if x.i == suffix_dedup.NO_ID else x.i, spans, bytes(c for k, c in enumerate(text) if k not in gone)))
    assert said == sorted(expect)


def test_empty(spark):
    assert suffix_dedup.op9_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
