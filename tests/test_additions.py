"""Parameter files, stored sequences, read names, length checks, long walks and chunked windows."""

import pytest
from basewise.operators import analytics, match, stored, taxonomy, windowing
from basewise.sources import readers
from pyspark.sql import functions as F


def put(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder}/{name}"


def test_parameter_files(spark, tmp_path):
    assert sorted(r.taxid for r in readers.taxon_list(spark, put(tmp_path, "x", "5\n\n 7 \nword\n")).collect()) == [5, 7]
    assert readers.taxon_pair(spark, put(tmp_path, "pair", "8\n9\n")) == (8, 9)
    with pytest.raises(ValueError):
        readers.taxon_pair(spark, put(tmp_path, "one", "8\n"))
    assert {r.taxid: r.p for r in readers.probability_table(spark, put(tmp_path, "p", "5\t0.5\n5\t0.25\nx\t1\n6\t1\n")).collect()} == {5: 0.25, 6: 1.0}


def test_part_files(spark, tmp_path):
    put(tmp_path, "f.1", "a")
    put(tmp_path, "f.2", "b")
    put(tmp_path, "f.4", "c")
    put(tmp_path, "g", "d")
    base = f"file://{tmp_path}"
    assert readers.part_files(spark, f"{base}/f") == [f"{base}/f.1", f"{base}/f.2"]
    assert readers.part_files(spark, f"{base}/g") == [f"{base}/g"]
    with pytest.raises(FileNotFoundError):
        readers.part_files(spark, f"{base}/h")


def test_fastq_of_several_lines(spark, tmp_path):
    path = put(tmp_path, "m.fq", "@a\nACGT\nAC\n+\nII@I\nII\n@b\nGG\n+b\n@@\n@c\nTT\n+\nII\n")
    got = [(r.name, r.seq, r.qual) for r in readers.fastq(spark, path).orderBy("line").collect()]
    assert [x[:2] for x in got] == [("a", "ACGTAC"), ("b", "GG"), ("c", "TT")] and got[0][2] == "II@III" and got[2][2] == "II"


def test_sequences(spark, tmp_path):
    ids = spark.createDataFrame([("x", 5, 0), ("x", 6, 1)], "seq_id string, taxid int, line long")
    assert [tuple(r) for r in readers.mapped_fasta(spark, put(tmp_path, "a.fa", ">x\nACG\nT\n>y\nGG\n"), ids).collect()] == [(6, "ACGT")]
    seqs = spark.createDataFrame([("AB0107", 1, "AC"), ("AB0142", 2, "GG"), ("none", 3, "TT")], "acc string, taxid int, seq string")
    readers.save_sequences(seqs, f"file://{tmp_path}/stored")
    kept = readers.stored_sequences(spark, f"file://{tmp_path}/stored", 7, 42)
    assert sorted((r.taxid, r["index"]) for r in kept.collect()) == [(1, 7), (2, 42)]


def test_read_names(spark):
    rows = [(0, "a", "ACGT"), (1, "b", "NNAN"), (2, "c", "GGG"), (3, "c", "TTT")]
    numbered = windowing.reads_with_windows(spark.createDataFrame(rows, "line long, name string, seq string"), 3)
    assert sorted((r.read, r.line) for r in numbered.collect()) == [(0, 0), (1, 2), (1, 3)]
    assert sorted((r.read, r.name) for r in windowing.read_names(numbered).collect()) == [(0, "a"), (1, "c")]


def test_lengths_must_fit(spark):
    db = stored.Meta(5, 8, 3, "counts", True)
    stored.check_lengths(stored.Meta(5, 7, 3, "reads", False), db)
    for low, high in ((4, 7), (5, 9)):
        with pytest.raises(ValueError):
            stored.check_lengths(stored.Meta(low, high, 3, "reads", False), db)
    short = spark.createDataFrame([("ACG", 1, 1)], "kmer string, taxid int, cnt long")
    with pytest.raises(ValueError):
        match.nearest(spark.createDataFrame([("ACGT",)], "kmer string"), short, 1)


def test_long_walks(spark):
    deep = spark.createDataFrame([(k, k - 1 if k > 1 else -1, "x") for k in range(1, 101)], "taxid int, parent int, rank string")
    paths = {r.taxid: list(r.path) for r in taxonomy.lineage(deep).collect()}
    assert paths[100] == list(range(1, 101)) and paths[1] == [1] and len(paths) == 100
    with pytest.raises(ValueError):
        taxonomy.lineage(spark.createDataFrame([(1, 2, "x"), (2, 1, "x")], "taxid int, parent int, rank string"))
    assert sorted((r.taxid, r.child) for r in taxonomy.children(deep).filter("taxid < 3").collect()) == [(1, 2), (2, 3)]


def test_scanner_windows_over_chunks(spark, monkeypatch):
    """The same windows whatever the chunks."""
    rows = spark.createDataFrame([(1, "ACGTNACGTACGTTNNACGGTACCA"), (2, "AC"), (3, None), (4, "NNN")], "id int, seq string")
    got = []
    for chunk in (4096, 4, 5):
        monkeypatch.setattr(windowing, "CHUNK", chunk)
        got.append(sorted(tuple(r) for r in windowing.scanner_windows(rows, 2, 4).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) > 20


def test_draws_have_the_expectation_of_all_outcomes(spark):
    """Monte Carlo counts against the sum over every subset of a kmer's taxa."""
    tree = spark.createDataFrame([(1, [1]), (10, [1, 10]), (20, [1, 20]), (11, [1, 10, 11]), (12, [1, 10, 12])], "taxid int, path array<int>")
    db = spark.createDataFrame([("AC", 11), ("AC", 12), ("GG", 11), ("GG", 20)], "kmer string, taxid int")
    chance = {11: 0.5, 12: 0.25, 20: 0.75}
    p = spark.createDataFrame(list(chance.items()), "taxid int, p double")
    got = {r.taxid: r.lca for r in analytics.taxa_counts_monte_carlo(db, p, tree, draws=4000, mode="strict").collect()}
    want = {10: 0.125, 12: 0.125, 11: 0.375 + 0.125, 1: 0.375, 20: 0.375}
    assert all(abs(got[t] - want[t]) < 0.05 for t in want), got
    flipped = {r.taxid: r.lca for r in analytics.taxa_counts_monte_carlo(db, p.withColumn("p", 1 - F.col("p")), tree, draws=4000, mode="compat").collect()}
    assert all(abs(flipped[t] - want[t]) < 0.05 for t in want), flipped
    with pytest.raises(ValueError):
        analytics.taxa_counts_monte_carlo(db, p, tree, mode="other")


def test_patterns_as_a_table(spark):
    db = spark.createDataFrame([("AA", 1), ("AA", 2), ("AC", 1), ("AG", 2), ("AG", 3), ("AT", 1), ("AT", 2), ("CC", 3)], "kmer string, taxid int")
    patterns = [("one", [1], [], True), ("both", [1, 2, 1], [], False), ("not", [2], [3], True), ("alone", [1], [], False), ("rest", [], [1, 2], True), ("all", [], [], True), ("none", [], [], False), ("unknown", [9], [], True), ("clash", [1], [1], True)]
    got = {r.pattern: r.n for r in analytics.pattern_counts(db, patterns).collect()}
    assert got == {"one": 3, "both": 2, "not": 2, "alone": 1, "rest": 1, "all": 5, "none": 0, "unknown": 0, "clash": 0}
    nothing = {r.pattern: r.n for r in analytics.pattern_counts(db.limit(0), patterns).collect()}
    assert set(nothing.values()) == {0} and len(nothing) == len(patterns)


def test_taxon_sets(spark):
    db = spark.createDataFrame([("AA", 1), ("AA", 2), ("AC", 2), ("AC", 1), ("AG", 2), ("AG", 2)], "kmer string, taxid int")
    assert sorted(tuple(r) for r in analytics.taxon_sets(db).collect()) == [("AA", 1, 2, 2), ("AA", 2, 2, 2), ("AG", 2, 1, 1)]
