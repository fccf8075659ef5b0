"""Records in file order whatever the splits, result texts, and reads called from a stream."""

import random

import pytest
from basewise.operators import analytics, formats, match, windowing
from basewise.sources import readers
from basewise.streaming.matching import classify_stream
from pyspark.sql import functions as F


def records(seed, n):
    """n records as (name, seq, qual) and their text, of one line or several, some qualities with @ or + at a line's start."""
    r = random.Random(seed)
    out, text = [], ""
    for k in range(n):
        size = r.choice([1, 4, 9, 30])
        seq = "".join(r.choices("ACGTN", k=size))
        qual = "".join(r.choices("I@#", k=size))
        lines = [qual] if k % 3 else [qual[i : i + 3] for i in range(0, size, 3)]
        text += f"@r{k} x\n" + ("\n".join(seq[i : i + 5] for i in range(0, size, 5)) if k % 2 else seq) + "\n+\n" + "\n".join(lines) + "\n"
        out.append((f"r{k} x", seq, qual))
    return out, text


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_fastq_splits(spark, tmp_path, ending):
    want = []
    for k, n in enumerate((40, 3, 90)):
        rows, text = records(k, n)
        want += rows
        (tmp_path / f"{k}.fq").write_bytes(text.replace("\n", ending).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (64, 257, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for block in (2, 1 << 17):
                got = readers.fastq(spark, f"file://{tmp_path}/*.fq", block).orderBy("line").collect()
                assert [r.line for r in got] == list(range(len(want)))
                assert [(r.name, r.seq, r.qual) for r in got] == want, (size, block)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_id_map_of_several_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.tsv").write_text("9\tx\t9\n" + "".join(f"z\t{name}{i}.1\t{i}\n" for i in range(50)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.id_map(spark, f"file://{tmp_path}/*.tsv", skip=1).collect()
            assert sorted((r.acc, r.taxid) for r in got) == sorted((f"{name}{i}", i) for name in "ab" for i in range(50)), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_taxonomy_instance(spark, tmp_path):
    for name, text in (("n", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n"), ("m", "2\t|\tTwo\t|\t\t|\tscientific name\t|\n"), ("o", "7\t|\t2\t|\n"), ("g", "8\t|\n"), ("all", "n\nm\no\ng\n"), ("few", "n\nm\n")):
        (tmp_path / name).write_text(text)
    taxa, merged, deleted = readers.taxonomy_instance(spark, f"file://{tmp_path}/all")
    assert sorted((r.taxid, r.parent, r.name) for r in taxa.collect()) == [(1, -1, None), (2, 1, "Two")]
    assert [tuple(r) for r in merged.collect()] == [(7, 2)] and [r.taxid for r in deleted.collect()] == [8]
    with pytest.raises(ValueError):
        readers.taxonomy_instance(spark, f"file://{tmp_path}/few")


def test_result_lines(spark):
    reads = spark.createDataFrame([("ACGT", 2, 5), ("ACGT", 1, 0)], "kmer string, read int, pos int")
    lcas = spark.createDataFrame([("ACGT", 1, 10), ("ACGT", 0, 7)], "kmer string, dist int, lca int")
    lines = formats.lca_text(lcas, reads)
    assert [r.value for r in lines.collect()] == ["ACGT\t1:0|2:5\t0:7|1:10"]
    assert sorted((r.kmer, r.places, r.dist, r.lca) for r in formats.parse_lcas(lines).collect()) == [("ACGT", "1:0|2:5", 0, 7), ("ACGT", "1:0|2:5", 1, 10)]
    called = formats.called_text(spark.createDataFrame([(3, 7)], "read int, taxid int"))
    assert [r.value for r in called.collect()] == ["3\t7"] and [tuple(r) for r in formats.parse_called(called).collect()] == [(3, 7)]


def test_stream_calls_as_a_batch(spark, tmp_path):
    r = random.Random(5)
    kmers = ["".join(x) for x in {tuple(r.choices("ACGT", k=4)) for _ in range(150)}]
    db = spark.createDataFrame([(k, t, 1) for k in kmers for t in r.sample(range(1, 5), r.choice([1, 2, 3, 4, 4]))], "kmer string, taxid int, cnt long")
    rows = [(read, part, "".join(r.choices("ACGT", k=r.choice([4, 5, 6])))) for read in range(200) for part in range(r.choice([1, 2, 3]))]
    for part in range(3):  # mates come in different batches, the first ones twice
        own = [(read, seq, 60 * part) for read, p, seq in rows if p == part or (part == 1 and p == 0)]
        spark.createDataFrame(own, "read int, seq string, at long").coalesce(1).write.parquet(f"file://{tmp_path}/in/{part}")
    spark.createDataFrame([(-1, "ACGTACGT", 100_000), (None, "ACGT", 5)], "read int, seq string, at long").coalesce(1).write.parquet(f"file://{tmp_path}/in/3")
    stream = spark.readStream.schema("read int, seq string, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    called = classify_stream(stream.withColumn("at", F.timestamp_seconds("at")), db, 4, "at", "1 minute", 120)
    called.writeStream.format("memory").queryName("called").outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    reads = spark.createDataFrame([(read, 1000 * part, seq) for read, part, seq in rows], "read int, base int, seq string")
    places = windowing.windows(reads, 4).select("kmer", "read", (F.col("base") + F.col("pos")).alias("pos"))
    found = match.exact(places, db, 4).select("kmer", F.lit(0).alias("dist"), "taxid", "cnt")
    want = sorted(tuple(x) for x in analytics.classify(analytics.collect_by_read(places, found)).collect())
    got = sorted((x.read, x.taxid) for x in spark.table("called").collect() if x.read >= 0)
    assert len(want) > 10 and got == want
