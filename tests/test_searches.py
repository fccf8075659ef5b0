"""How searches and sets are planned and what they leave out, one test for each finding of round 4."""

import random

import pytest
from basewise.functions import bases
from basewise.operators import analytics, formats, match, stored, strands, windowing
from pyspark.sql import functions as F


def seqs(spark, n=30, size=90, seed=11):
    pick = random.Random(seed)
    return spark.createDataFrame([(1000 + i % 7, "".join(pick.choice("ACGT") for _ in range(size))) for i in range(n)], "taxid int, seq string")


@pytest.fixture(scope="module")
def small(spark):
    """Windows of two reads, one of them taken from a reference and changed, and the references."""
    refs = seqs(spark)
    first = refs.first()["seq"]
    reads = spark.createDataFrame([(1, first[:40] + "A" + first[41:]), (2, "ACCTGATTGACCA" * 2)], "read int, seq string")
    return windowing.read_db(windowing.windows(reads, 12)).cache(), refs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def differ(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def turned(k):
    return k[::-1].translate(str.maketrans(*bases.PAIRS))


# F1
def test_matches_are_collected_where_they_lie(spark, small):
    q, refs = small
    found = analytics.collect_by_read(q, match.nearest(q, strands.counted(refs, 12, 12), 1, held=(12, 12), by="taxid"))
    assert found.count() and "hashpartitioning(read" not in plan(found)


# F2
def test_a_kmer_and_its_reverse_complement_are_shuffled_as_one(spark):
    import pyarrow as pa

    rows = seqs(spark).collect()
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows], pa.schema([("taxid", pa.int32()), ("seq", pa.string())]))
    kmers = [k for b in strands._Cutter(12, 12, "compat", None).cut(batch) for k in b.column("kmer").to_pylist()]
    assert len(kmers) == sum(len(r["seq"]) - 11 for r in rows)
    assert all(k == k[::-1] or k.translate(strands.RANK) <= turned(k).translate(strands.RANK) for k in kmers)


# F3, F4
def test_lca_by_distance_needs_no_sorted_groups(spark):
    tree = spark.createDataFrame([(1, [1]), (11, [1, 11]), (12, [1, 12]), (111, [1, 11, 111]), (112, [1, 11, 112])], "taxid int, path array<int>")
    rows = [("A", 0, 111), ("A", 1, 112), ("A", 2, 12), ("C", 0, 111), ("C", 1, 999), ("G", 1, 999), ("T", 1, 12), ("T", 1, 11)]
    found = analytics.lca_by_distance(spark.createDataFrame(rows, "kmer string, dist int, taxid int"), tree)
    assert "SortAggregate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("A", 0, 111), ("A", 1, 11), ("A", 2, 1), ("C", 0, 111), ("T", 1, 1)]


# F5, F9
@pytest.mark.parametrize("d", [0, 1])
def test_only_searched_prefixes_move(spark, d):
    refs = seqs(spark)
    search = windowing.windows(refs.limit(1).select("seq"), 10, 14).select("kmer").limit(100)
    db = strands.counted(refs, 10, 14, seeds=strands.seeds(search, d))
    near, there = match.near_and_there(search, db, d, dedup_rc=False, held=(10, 14))
    wanted = [r[0] for r in search.distinct().collect()]
    got = {r[0] for r in there.select("match_kmer").distinct().collect()}
    assert got and all(any(len(w) == len(g) and differ(w, g) <= d for w in wanted) for g in got)
    whole = match.nearest(search, windowing.count_db(windowing.windows(refs, 10, 14)), d, dedup_rc=False, held=(10, 14), how="blocks")
    assert sorted(map(tuple, there.join(near, "match_kmer").select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))


# F7
def test_differences_need_no_taxa(spark, small):
    q, refs = small
    db = strands.counted(refs, 12, 12)
    pairs = match.near_pairs(q, db.select("kmer").distinct(), 1).select("kmer", "match_kmer", "diff")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, match.nearest(q, db, 1, held=(12, 12)).select("kmer", "match_kmer", "diff").distinct().collect()))


# F8
def test_taxa_of_a_kmer_are_counted_before_it_is_matched(spark, small):
    q, refs = small
    db = strands.counted(refs, 12, 12)
    pairs = match.near_pairs(q, db.groupBy("kmer").agg(F.count("*").alias("taxa")), 2).select("kmer", "match_kmer", "dist", "taxa")
    want = match.nearest(q, db, 2, held=(12, 12), how="blocks").groupBy("kmer", "match_kmer", "dist").agg(F.count("*").alias("taxa"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect())) != []


# F10
def test_long_kmers_that_share_a_block_only_stay_behind(spark):
    refs = seqs(spark, size=60)
    k = refs.first()["seq"][:40]
    near, far = k[:20] + ("A" if k[20] != "A" else "C") + k[21:], k[:15] + turned(k)[15:]
    assert differ(k, far) > 2
    rows = spark.createDataFrame([(1, near), (2, turned(near)), (3, far), (4, turned(far))], "taxid int, seq string")
    kept = strands.counted(rows, 40, 40, seeds=strands.seeds(spark.createDataFrame([(k,)], "kmer string"), 2))
    assert {(r["kmer"], r["taxid"]) for r in kept.collect()} == {(x, t) for x in (near, turned(near)) for t in (1, 2)}


# F11
def test_text_of_parts_is_the_text_of_matches(spark, small):
    q, refs = small
    db = strands.counted(refs, 12, 12)
    parts = match.near_and_there(q, db, 1, held=(12, 12))
    assert sorted(formats.results_text_of(*parts, q).collect()) == sorted(formats.results_text(match.nearest(q, db, 1, held=(12, 12)), q).collect()) != []


# F14, F15, F18
@pytest.mark.parametrize("d", [0, 1])
def test_only_what_is_searched_is_counted(spark, small, d):
    q, refs = small
    wanted = {r[0] for r in q.select("kmer").distinct().collect()}
    kept = {r[0] for r in strands.counted(refs, 12, 12, seeds=strands.seeds(q, d)).collect()}
    assert kept and all(any(min(differ(w, k), differ(w, turned(k))) <= d for w in wanted) for k in kept)


# F6
def test_a_merge_moves_the_stored_rows_once(spark, monkeypatch):
    db = strands.counted(seqs(spark, n=6), 12, 12)
    path = stored.fresh(spark, "database")
    stored.save(db, path, stored.Meta(12, 12, 6, "counts", True), folders=4, files=2)
    frame, calls = type(db), []
    true = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: calls.append(a) or true(self, *a))
    stored.merge_into(spark, path, db)
    assert len(calls) == 2  # the added rows, and both together
    got = stored.load(spark, path)[0].select("kmer", "taxid", "cnt")
    assert sorted(map(tuple, got.collect())) == sorted((k, t, 2 * n) for k, t, n in db.collect())


# F16, F17
def test_taxon_sets_are_told_apart_where_their_kmers_lie(spark):
    db = spark.createDataFrame([("A", 1), ("A", 2), ("A", 2), ("C", 2), ("C", 1), ("G", 1)], "kmer string, taxid int")
    found = analytics.taxon_sets(db)
    import re

    assert not re.search(r"hashpartitioning\(kmer#\d+, taxid", plan(found))
    assert sorted(map(tuple, found.collect())) == [("A", 1, 2, 2), ("A", 2, 2, 2), ("G", 1, 1, 1)]
