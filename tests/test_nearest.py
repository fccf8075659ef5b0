"""Nearest matches by balls and by split blocks, against comparing every pair."""

import random

import pytest
from basewise.functions import bases
from basewise.operators import match
from pyspark.sql import functions as F


def rc(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def actg(x):
    return x.translate(str.maketrans("ACTG", "0123"))


def brute(search, db, d, best, dedup):
    out = []
    for q in sorted(set(search)):
        cut = {}
        for kmer, taxid, cnt in db:
            if len(kmer) >= len(q):
                key = kmer[: len(q)], taxid
                cut[key] = cut.get(key, 0) + cnt
        near = {m: sum(a != b for a, b in zip(q, m, strict=True)) for m, _ in cut}
        near = {m: n for m, n in near.items() if n <= d}
        if dedup:
            near = {m: n for m, n in near.items() if rc(m) not in near or (n, actg(m)) <= (near[rc(m)], actg(rc(m)))}
        if best and near:
            near = {m: n for m, n in near.items() if n == min(near.values())}
        out += [(q, m, near[m], t, c) for (m, t), c in cut.items() if m in near]
    return sorted(out)


def made(rng, n, low, high, letters="ACGT"):
    """K-mers of which many are near each other."""
    roots = ["".join(rng.choice(letters) for _ in range(high)) for _ in range(6)]
    out = []
    for _ in range(n):
        x = list(rng.choice(roots))
        for _ in range(rng.randrange(4)):
            x[rng.randrange(high)] = rng.choice("ACGT")
        out.append("".join(x)[: rng.randrange(low, high + 1)])
    return out


def run(spark, search, db, d, **how):
    rows = match.nearest(spark.createDataFrame([(x,) for x in search], "kmer string"), spark.createDataFrame(db, "kmer string, taxid int, cnt long"), d, **how)
    return sorted((r.kmer, r.match_kmer, r.dist, r.taxid, r.cnt) for r in rows.collect())


@pytest.mark.parametrize("how", ["ball", "blocks"])
@pytest.mark.parametrize(("low", "high", "d"), [(6, 6, 0), (6, 6, 2), (15, 18, 1), (32, 32, 2), (9, 12, 3)])
def test_every_pair(spark, how, low, high, d):
    rng = random.Random(high * 10 + d)
    search, db = made(rng, 25, low, high), [(x, rng.randrange(3), rng.randrange(1, 5)) for x in made(rng, 120, high, high) + made(rng, 40, low, high)]
    db += [(rc(x), 9, 1) for x, *_ in db[:20]]
    for best, dedup in ((False, False), (True, True), (False, True)):
        assert run(spark, search, db, d, best=best, dedup_rc=dedup, how=how, held=(low, high)) == brute(search, db, d, best, dedup)


@pytest.mark.parametrize("k", [33, 40, 70])
def test_more_than_one_word(spark, k):
    rng = random.Random(k)
    search, db = made(rng, 12, k, k), [(x, rng.randrange(3), 1) for x in made(rng, 60, k, k)]
    assert run(spark, search, db, 2, dedup_rc=False) == brute(search, db, 2, False, False)
    a, b = "A" * k, "C" + "A" * (k - 2) + "G"
    assert spark.range(1).select(bases.words_distance(bases.packed_words(F.lit(a)), bases.packed_words(F.lit(b)))).first()[0] == 2


def test_a_hot_block_is_cut(spark):
    """Nearly all k-mers share a block of A; with few pairs a task the block goes to many."""
    rng = random.Random(2)
    db = [("A" * 8 + "".join(rng.choice("ACGT") for _ in range(4)), rng.randrange(4), 1) for _ in range(400)]
    search = [x for x, *_ in db[:30]] + ["A" * 12]
    want = brute(search, db, 2, False, False)
    assert run(spark, search, db, 2, dedup_rc=False, how="blocks", pairs=50) == want == run(spark, search, db, 2, dedup_rc=False, how="blocks")
    assert run(spark, search, db, 2, dedup_rc=False, how="ball") == want


def test_what_costs_less():
    assert match.ball_size(12, 1) == 37 and match.ball_size(12, 2) == 631 and match.ball_size(2, 5) == 16
    assert match.cheaper({12: 30_000}, 2, 3_000_000) == "ball"
    assert match.cheaper({32: 1_000_000}, 2, 1_000_000) == "blocks"
    assert match.cheaper({40: 5}, 1) == "blocks"
    assert match.cheaper({12: 10, 14: 10}, 1) == "ball"


def test_lengths_outside_the_database(spark):
    db = spark.createDataFrame([("ACGT", 1, 1), ("ACGTAC", 1, 1)], "kmer string, taxid int, cnt long")
    for kmer in ("ACG", "ACGTACG"):
        own = spark.createDataFrame([(kmer,)], "kmer string")
        for held in (None, (4, 6)):
            with pytest.raises(ValueError):
                match.nearest(own, db, 1, held=held)
            with pytest.raises(ValueError):
                match.exact(own, db, len(kmer), held=held)
    assert match.nearest(spark.createDataFrame([], "kmer string"), db, 1).count() == 0
    with pytest.raises(ValueError):
        match.nearest(db, db, -1)
