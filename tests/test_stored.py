"""Stored databases: folders that are read, joins without moving the stored side, and merges."""

import pytest
from basewise.operators import match, stored, windowing
from pyspark.sql import functions as F

META = stored.Meta(6, 6, 4, "counts", True)


@pytest.fixture(scope="module")
def db(spark):
    seqs = spark.range(300).select((F.col("id") % 7).cast("int").alias("taxid"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 20), "0123456789abcdef", "ACTGACTGACTGACTG").alias("seq"))
    hot = spark.range(50).select(F.col("id").cast("int").alias("taxid"), F.lit("AAAAAAAA").alias("seq"))
    return windowing.count_db(windowing.windows(seqs.unionByName(hot), 6))


def rows(df):
    return sorted(tuple(r) for r in df.select("kmer", "taxid", "cnt").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_range_reads_its_folders(spark, db, tmp_path):
    path = f"file://{tmp_path}/db"
    stored.save(db, path, META, folders=16, files=4)
    back, meta = stored.load(spark, path, searched=True)
    assert rows(back) == rows(db)
    for n, low, high in ((4, 16, 31), (2, 3, 5), (6, 100, 299), (4, 0, 255)):
        part = stored.key_range(back, meta, n, low, high)
        assert rows(part) == rows(windowing.key_range(db, n, low, high))
        read = {p.split("bucket=")[1].split("/")[0] for p in part.inputFiles()}
        assert "PartitionFilters: [isnotnull(bucket" in plan(part)
        assert part.select("bucket").distinct().count() <= (high - low) * 16 // 4**n + 2 and read


def test_the_stored_side_of_a_join_stays(spark, db, tmp_path):
    path = f"file://{tmp_path}/db"
    stored.save(db, path, META, folders=4, files=8)
    back, meta = stored.load(spark, path)
    reads = db.select("kmer").distinct().sample(0.5, seed=1).checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = match.exact(reads, back, 6, held=meta.lengths)
        assert plan(joined).count("Exchange hashpartitioning(kmer") <= 1 and "Exchange" not in plan(joined).split("FileScan parquet")[0].split("Join")[-1].split("Exchange hashpartitioning(kmer")[0]
        assert rows(joined) == rows(match.exact(reads, db, 6))
        scan = [x for x in plan(joined).split("\n") if "FileScan" in x]
        assert len(scan) == 1 and "Bucketed: true" in scan[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_common_keys_are_spread(spark, db, tmp_path):
    """K-mers of one key stand in several files."""
    path = f"file://{tmp_path}/db"
    common = spark.range(2000).select(F.concat(F.lit("AAAA"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 4), "0123456789abcdef", "ACTGACTGACTGACTG")).alias("kmer"), F.lit(1).alias("taxid"), F.lit(1).cast("long").alias("cnt")).distinct()
    stored.save(common, path, stored.Meta(8, 8, 4, "counts", True), folders=16, files=4)
    back, _ = stored.load(spark, path)
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_merges_touch_their_folders_only(spark, db, tmp_path):
    path = f"file://{tmp_path}/db"
    stored.save(db, path, META, folders=16, files=2)
    before = {f: (tmp_path / "db" / "data" / f).stat().st_ino for f in (p.name for p in (tmp_path / "db" / "data").iterdir()) if f.startswith("bucket=")}
    delta = spark.createDataFrame([("AAAAAA", 1, 5), ("AAAAAC", 77, 1), ("GGGGGG", 3, 2)], "kmer string, taxid int, cnt long")
    assert stored.merge_into(spark, path, delta) == [0, 15]
    after = {f: (tmp_path / "db" / "data" / f).stat().st_ino for f in before}
    assert {f for f in before if before[f] != after[f]} <= {"bucket=0", "bucket=15"}
    back, _ = stored.load(spark, path)
    assert rows(back) == rows(windowing.merge_dbs(db, delta))
    assert stored.merge_into(spark, path, delta.limit(0)) == []
    assert rows(stored.load(spark, path)[0]) == rows(windowing.merge_dbs(db, delta))
    with pytest.raises(ValueError):
        stored.merge_into(spark, path, spark.createDataFrame([("ACGTACG", 1, 1)], "kmer string, taxid int, cnt long"))
    with pytest.raises(ValueError):
        stored.save(db, f"file://{tmp_path}/short", stored.Meta(3, 6, 4, "counts", True))
