"""Hand values, sources, stored databases, text forms and streams."""

import gzip

import pytest
from basewise.functions import bases
from basewise.operators import analytics, formats, match, stored, taxonomy, windowing
from basewise.sources import readers
from basewise.streaming.matching import count_stream, match_stream
from pyspark.sql import functions as F


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, bases.key(lit("ACTG"), 4), bases.key(lit("GGGGGG"), 6), bases.key(lit("AC"), 4), bases.reverse_complement(lit("ACTG"))) == (27, 4095, None, "CAGT")
    assert one(spark, *[bases.is_own_rc(lit(x), m) for m in ("compat", "strict") for x in ("ACCA", "ACGT", "ACA")]) == (True, False, False, False, True, False)
    diff = bases.differences(lit("ACTGACTG"), lit("ACTTACTT"))
    assert one(spark, bases.difference_text(diff), bases.apply_differences(lit("ACTGACTG"), bases.parse_differences(lit("3T7T"))), bases.difference_text(bases.differences(lit("AC"), lit("AC")))) == ("3T7T", "ACTTACTT", "-")
    assert one(spark, bases.dust_score(lit("ACACACAC")), bases.passes_dust(lit("ACACACAC"), 1), bases.passes_dust(lit("ACACACAC"), 0)) == (12, True, False)
    assert one(spark, bases.passes_runs(lit("ACCCCT"), 4), bases.passes_runs(lit("ACCCT"), 4), bases.passes_runs(lit("AAAA"), 1)) == (False, True, True)
    a, b = "ACTG" * 8, "GCTG" + "ACTG" * 6 + "ACTA"
    assert one(spark, bases.distance(bases.packed(lit(a)), bases.packed(lit(b)))) == (2,)
    assert one(spark, F.size(bases.close_keys(lit(0), 6, 1)), F.size(bases.close_keys(lit(77), 6, 2))) == (19, 154)
    with pytest.raises(ValueError):
        bases.is_own_rc(lit("A"), "other")


def found(df):
    return sorted(tuple(r) for r in df.select("pos", "kmer").collect())


def test_windows(spark):
    seqs = lambda x: spark.createDataFrame([(1, x), (2, None), (3, "")], "id int, seq string")
    assert found(windowing.windows(seqs("ACGTA"), 3, 4)) == [(0, "ACGT"), (1, "CGTA"), (2, "GTA")]
    assert found(windowing.scanner_windows(seqs("ACGNTACG"), 2, 3)) == [(0, "ACG"), (4, "TA"), (4, "TAC"), (5, "ACG"), (6, "CG")]
    assert found(windowing.scanner_windows(seqs("ACGTNACGT"), 3, 4)) == [(0, "ACGT"), (5, "ACG"), (5, "ACGT"), (6, "CGT")]
    assert [r.seq for r in windowing.runs(seqs("acgnTACG")).collect()] == ["ACG", "TACG"]
    with pytest.raises(ValueError):
        windowing.windows(seqs("A"), 3, 2)


def test_stored(spark, tmp_path):
    db = windowing.count_db(spark.createDataFrame([(7, "ACGTAC"), (8, "ACGTAC"), (8, "GGGTTT")], "taxid int, kmer string"))
    meta = stored.Meta(6, 6, 4, "counts", True)
    for n in ("a", "b"):
        stored.save(db, f"file://{tmp_path}/{n}", meta)
    stored.save(db, f"file://{tmp_path}/c", stored.Meta(6, 6, 4, "counts", False))
    back, told = stored.load(spark, f"file://{tmp_path}/a")
    assert told == meta and back.select("kmer", "taxid", "cnt").exceptAll(db).count() == 0 and back.count() == db.count()
    twice, _ = stored.load(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b", searched=True)
    assert twice.exceptAll(db.withColumn("cnt", F.col("cnt") * 2)).count() == 0
    assert stored.key_range(back, told, 4, 255, 255).count() == db.filter("kmer like 'GGGG%'").count()
    for paths, searched in ((("a", "c"), False), (("c",), True)):
        with pytest.raises(ValueError):
            stored.load(spark, *[f"file://{tmp_path}/{p}" for p in paths], searched=searched)


def test_classify_and_closer(spark):
    rows = [(1, 0, 7), (1, 1, 7), (1, 1, 8), (2, 0, 7), (2, 1, 8), (3, 0, 7), (3, 1, 8), (3, 1, 9), (4, 0, 7), (4, 0, 8)]
    collected = spark.createDataFrame([(*r, 0, 1) for r in rows], "read int, pos int, taxid int, dist int, cnt long")
    assert [tuple(r) for r in analytics.classify(collected).collect()] == [(1, 7)]
    near = spark.createDataFrame([("AC", 5, 0), ("AC", 5, 1)], "kmer string, taxid int, dist int")
    assert [tuple(r) for r in analytics.closer_counts(near, 5, 6).collect()] == [(0, None, 1)]


def test_sampled(spark):
    def uniq(pairs, mode):
        db = spark.createDataFrame([("AC", t) for t, _ in pairs], "kmer string, taxid int")
        return {r.taxid: round(r.uniq, 9) for r in analytics.taxa_counts_sampled(db, spark.createDataFrame(pairs, "taxid int, p double"), mode).collect()}

    assert uniq([(1, 0.5), (2, 0.25)], "compat") == {1: 0.375, 2: 0.125}
    assert uniq([(1, 1.0), (2, 0.25)], "compat")[1] == 0.25 and uniq([(1, 1.0), (2, 0.25)], "strict")[1] == 0.75


def test_taxonomy(spark, tmp_path):
    (tmp_path / "nodes").write_text("".join(f"{a}\t|\t{b}\t|\t{r}\t|\t\t|\t0\t|\n" for a, b, r in [(1, 1, "root"), (10, 1, "region"), (100, 10, "nation"), (101, 10, "nation"), (1000, 100, "species"), (1001, 101, "species"), (1002, 100, "species")]))
    (tmp_path / "names").write_text("1000\t|\tfish\t|\t\t|\tscientific name\t|\n1000\t|\tother\t|\t\t|\tsynonym\t|\n")
    (tmp_path / "merged").write_text("5\t|\t1000\t|\n")
    (tmp_path / "deleted").write_text("6\t|\n")
    taxa, merged, deleted = readers.taxonomy_dump(spark, *[f"file://{tmp_path}/{n}" for n in ("nodes", "names", "merged", "deleted")])
    tree = taxonomy.lineage(taxa, merged)
    assert {r.taxid: list(r.path) for r in tree.collect()}[5] == [1, 10, 100, 1000]
    ids = spark.createDataFrame([(5,), (6,), (9,), (10,)], "taxid int")
    assert {r.taxid: (r.resolved, r.status) for r in taxonomy.status(ids, taxa, merged, deleted).collect()} == {5: (1000, "known"), 6: (6, "deleted"), 9: (9, "unknown"), 10: (10, "known")}
    near = spark.createDataFrame([("AC", 1000, 0), ("AC", 1002, 0), ("AC", 1001, 1), ("GG", 1000, 0), ("GG", 9, 1)], "kmer string, taxid int, dist int")
    assert sorted(tuple(r) for r in analytics.lca_by_distance(near, tree).collect()) == [("AC", 0, 100), ("AC", 1, 10), ("GG", 0, 1000)]
    assert [r.name for r in taxa.filter("taxid = 1000").collect()] == ["fish"]


def test_sources(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    assert sorted(tuple(r) for r in readers.fasta(spark, put("a.fa", ">x.1 some > text\nACG\nTTn\n>y\nGG")).collect()) == [("x.1", "ACGTTn"), ("y", "GG")]
    assert sorted(tuple(r) for r in readers.fasta_runs(spark, f"file://{tmp_path}/a.fa").collect()) == [("x", "ACGTT"), ("y", "GG")]
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\n@+II\n@r2\nGG\n+r2\n+@\n@r2\nCC\n+\nII")
    got = readers.fastq(spark, f"file://{tmp_path}/b.fq.gz").orderBy("line").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == [("r1 x", "ACGT", "@+II"), ("r2", "GG", "+@"), ("r2", "CC", "II")]
    assert [r.read for r in windowing.numbered_reads(readers.fastq(spark, f"file://{tmp_path}/b.fq.gz")).orderBy("line").collect()] == [0, 1, 1]
    assert [tuple(r) for r in readers.tagged(spark, put("o", "5\tacg\n6 TT\n")).collect()] == [(5, "ACG"), (6, "TT")]
    assert [tuple(r) for r in readers.preprocessed(spark, put("p", "5 ~ ACG\n")).collect()] == [(5, "ACG")]
    ids = readers.id_map(spark, put("m", "head\tacc\ttaxid\nz\tx.1\t5\nz\tx.1\t6\n"), skip=1)
    assert [(r.acc, r.taxid) for r in match.accession_taxids(spark.createDataFrame([("x",), ("q",)], "acc string"), ids).collect()] == [("x", 6)]
    assert readers.patterns(["12 !34 + #name", "7"]) == [("name", [12], [34], True), ("7", [7], [], False)]


def test_texts(spark, tmp_path):
    reads = spark.createDataFrame([("ACGT", 1, 0), ("ACGT", 2, 5)], "kmer string, read int, pos int")
    db = spark.createDataFrame([("ACGT", 7, 3), ("ACGA", 8, 1), ("ACGA", 9, 2)], "kmer string, taxid int, cnt long")
    m = match.nearest(reads, db, 1, dedup_rc=False)
    lines = formats.results_text(m, reads)
    assert [r.value for r in lines.collect()] == ["ACGT\t1:0|2:5\t-|7x3 3A|8x1|9x2"] and formats.results_kind(lines) == "reads"
    formats.write_text(lines, f"file://{tmp_path}/t")
    back = formats.parse_results(formats.read_text(spark, f"file://{tmp_path}/t"))
    assert sorted((r.match_kmer, r.dist, r.taxid, r.cnt) for r in back.collect()) == [("ACGA", 1, 8, 1), ("ACGA", 1, 9, 2), ("ACGT", 0, 7, 3)]
    text = formats.counts_text(db, pad=6)
    assert sorted(r.value for r in text.collect()) == ["ACGA--\t8:1 9:2", "ACGT--\t7:3"] and formats.parse_counts(text).exceptAll(db).count() == 0
    assert [r.value for r in formats.collected_text(analytics.collect_by_read(reads.limit(1), m)).collect()] == ["1:0\t0:7x3 1:8x1|9x2"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "ACGTA", 0), (2, "GGGGG", 0)], "read int, seq string, at long").selectExpr("read", "seq", "timestamp_seconds(at) as at").write.parquet(f"file://{tmp_path}/in")
    db = spark.createDataFrame([("ACGT", 7, 3)], "kmer string, taxid int, cnt long")
    stream = spark.readStream.schema("read int, seq string, at timestamp").parquet(f"file://{tmp_path}/in")
    for df, name, mode in ((match_stream(stream.drop("at"), db, 4), "found", "append"), (count_stream(stream, db, 4, "at"), "counted", "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.read, r.pos, r.taxid) for r in spark.table("found").collect()] == [(1, 0, 7)]
    assert [(r.taxid, r.n) for r in spark.table("counted").collect()] == [(7, 1)]
