"""Windows of both strands, cut with numpy, against those of expressions."""

import random
from collections import Counter

import pytest
from basewise.operators import strands, windowing


def rows(df):
    return Counter(map(tuple, df.select("kmer", "taxid", "cnt").collect()))


def made(seed=3):
    pick = random.Random(seed)
    seqs = ["".join(pick.choice("ACGT") for _ in range(pick.choice((0, 3, 11, 12, 13, 40, 41, 300)))) for _ in range(60)]
    odd = ["ACGTNACGTTGCAACGTN" * 3, "acgtACGTACGTAACC", "ACGTACGTACGTACGT", "AAAAAAAAAAAAAAAAAAAA", "ACGTTGCAACGTTGCA", "ÄCGTACGTACGTACGÄ", None, "", "NNNNNNNNNNNNNNNN"]
    return [(i % 5, s) for i, s in enumerate(seqs + odd)] + [(None, "ACGGTACCATTGACAGGAT")]


@pytest.mark.parametrize("low,high", [(1, 1), (4, 4), (5, 5), (12, 12), (40, 40), (70, 70), (10, 14), (3, 6)])
@pytest.mark.parametrize("mode", ["compat", "strict", None])
def test_counts_agree_with_expressions(spark, monkeypatch, low, high, mode):
    monkeypatch.setattr(strands, "SLICE", 64)  # many slices, with windows that reach over their ends
    df = spark.createDataFrame(made(), "taxid int, seq string")
    want = windowing.count_db(windowing.windows(df, low, high), mode)
    cutter = strands._Cutter(low, high, mode, None)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in made()], pa.int32()), pa.array([s for _, s in made()], pa.string())], names=["taxid", "seq"])
    assert sum(b.num_rows for b in cutter.cut(batch)) == windowing.windows(df, low, high).count()
    assert rows(strands.counted(df, low, high, mode)) == rows(want)


@pytest.mark.parametrize("low,high,d", [(12, 12, 0), (12, 12, 1), (10, 14, 1), (40, 40, 2)])
def test_seeds_keep_what_a_search_finds(spark, low, high, d):
    pick = random.Random(5)
    df = spark.createDataFrame([(i, "".join(pick.choice("ACGT") for _ in range(120))) for i in range(40)], "taxid int, seq string")
    search = windowing.windows(df.limit(2), low, high)
    whole, kept = strands.counted(df, low, high), strands.counted(df, low, high, seeds=strands.seeds(search, d))
    near = {"".join(x) for r in search.collect() for x in [r["kmer"]]}
    differ = lambda a, b: sum(x != y for x, y in zip(a, b, strict=False))
    hits = {r: n for r, n in rows(whole).items() if any(len(r[0]) >= len(q) and differ(r[0], q) <= d for q in near)}
    found = rows(kept)
    assert hits and all(found[r] == n for r, n in hits.items()) and sum(found.values()) < sum(rows(whole).values())
