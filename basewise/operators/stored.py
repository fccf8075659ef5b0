"""Databases in a shared folder, and intermediate results that are used more than once.

A stored database is a Parquet table in folders by ranges of the key and, in each, files by hash of the kmer.  So a range of keys reads its folders only, a join
on kmer finds the stored side where it is and shuffles the other one alone, and the k-mers of a common key are spread over all files of its folder.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.functions import bases

from .windowing import merge_dbs

FOLDERS, FILES = 64, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one where none is named, on a cluster a RuntimeError then."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return named or f"file://{tempfile.mkdtemp(prefix='basewise-')}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and with its lineage cut, where the session names a checkpoint folder; else df itself, which is computed at every use."""
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        return df
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """As settled, of more rows: compressed, as Parquet files in the shared folder."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        return df
    path = fresh(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Meta:
    """What is stored beside a database; how it is laid out tells no databases apart."""

    min_k: int
    max_k: int
    key_len: int
    kind: str
    rc: bool
    folders: int = field(default=FOLDERS, compare=False)
    files: int = field(default=FILES, compare=False)
    columns: str = field(default="", compare=False)

    @property
    def lengths(self) -> tuple[int, int]:
        return self.min_k, self.max_k


def check_lengths(search: Meta, db: Meta) -> None:
    """ValueError unless the lengths that are searched for lie in the database's range."""
    if search.min_k < db.min_k or search.max_k > db.max_k:
        raise ValueError(f"lengths {search.min_k} to {search.max_k} are searched, the database holds {db.min_k} to {db.max_k}")


def _keyed(db: DataFrame, meta: Meta) -> DataFrame:
    """db with its keys and folders."""
    return db.withColumn("key", bases.key("kmer", meta.key_len)).withColumn("bucket", F.floor(F.col("key").cast("long") * meta.folders / 4**meta.key_len).cast("int"))


def _placed(db: DataFrame, meta: Meta) -> DataFrame:
    """db with its keys and folders, dealt by hash of the kmer as its files are."""
    return _keyed(db, meta).repartition(meta.files, "kmer")


def save(db: DataFrame, path: str, meta: Meta, folders: int = FOLDERS, files: int = FILES) -> None:
    """Store db, and its metadata beside it.  K-mers shorter than the key have no key and are refused."""
    if meta.min_k < meta.key_len:
        raise ValueError(f"keys of {meta.key_len} bases need k-mers of as many")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in db.schema)
    meta = replace(meta, folders=folders, files=files, columns=columns)
    name = f"basewise_{uuid.uuid4().hex}"
    _placed(db, meta).write.partitionBy("bucket").bucketBy(files, "kmer").sortBy("key", "kmer").option("path", f"{path}/data").saveAsTable(name)
    db.sparkSession.sql(f"DROP TABLE {name}")  # the files stay, they are outside the warehouse
    db.sparkSession.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.text(f"{path}/meta")


def told(spark: SparkSession, path: str) -> Meta:
    return Meta(**json.loads(spark.read.text(f"{path}/meta").first()[0]))


def _table(spark: SparkSession, path: str, meta: Meta) -> str:
    """The name of a table over a stored database's files, which the session makes known anew."""
    name = "basewise_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({meta.columns}, key INT, bucket INT) USING parquet PARTITIONED BY (bucket) CLUSTERED BY (kmer) SORTED BY (key, kmer) INTO {meta.files} BUCKETS LOCATION '{path}/data'")
    spark.catalog.recoverPartitions(name)
    return name


def load(spark: SparkSession, *paths: str, searched: bool = False) -> tuple[DataFrame, Meta]:
    """Read one or more databases and merge them.  ValueError if they don't fit together, or if one without both strands is to be searched."""
    metas = [told(spark, p) for p in paths]
    if len(set(metas)) != 1:
        raise ValueError(f"databases differ: {metas}")
    if searched and not metas[0].rc:
        raise ValueError("a database that is searched holds both strands")
    dbs = [spark.table(_table(spark, p, m)) for p, m in zip(paths, metas, strict=True)]
    if len(dbs) == 1:
        return dbs[0], metas[0]
    if metas[0].kind == "counts":
        return merge_dbs(*[d.select("kmer", "taxid", "cnt") for d in dbs]), metas[0]
    out = dbs[0]
    for d in dbs[1:]:
        out = out.unionByName(d)
    return out.select("kmer", "read", "pos").distinct(), metas[0]


def key_range(db: DataFrame, meta: Meta, n: int, low: int, high: int) -> DataFrame:
    """Rows of a loaded database whose key of n bases is in [low, high], read from the folders of that range only."""
    fewer = meta.key_len - n
    first, last = (low * 4**fewer, (high + 1) * 4**fewer - 1) if fewer >= 0 else (low // 4**-fewer, high // 4**-fewer)
    rows = db.filter(F.col("bucket").between(first * meta.folders // 4**meta.key_len, last * meta.folders // 4**meta.key_len)).filter(F.col("key").between(first, last))
    return rows if fewer >= 0 else rows.filter(bases.key("kmer", n).between(low, high))


def merge_into(spark: SparkSession, path: str, delta: DataFrame) -> list[int]:
    """Add the rows (kmer, taxid, cnt) of delta to a stored count database; return the folders that were touched.

    Only folders in which delta has keys are read, merged and replaced; each is written beside the others and takes its place when the whole write is committed.
    """
    meta = told(spark, path)
    if meta.kind != "counts":
        raise ValueError("only counts can be added to")
    new = settled(_placed(delta.select("kmer", "taxid", "cnt"), meta))
    outside = new.filter((F.length("kmer") < meta.min_k) | (F.length("kmer") > meta.max_k))
    if not outside.isEmpty():
        raise ValueError(f"the database holds lengths {meta.min_k} to {meta.max_k}")
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # meta.folders at most
    name = _table(spark, path, meta)
    columns = ["kmer", "taxid", "cnt", "key", "bucket"]
    old = spark.table(name).filter(F.col("bucket").isin(touched)).select(*columns)
    merged = fresh(spark, "merged")
    order = [c.split(" ")[0] for c in meta.columns.split(", ")]
    met = old.unionByName(new.select(*columns)).repartition(meta.files, "kmer")  # moved once, as the files are dealt
    sums = met.groupBy("kmer", "taxid").agg(F.sum("cnt").alias("cnt"), F.max("key").alias("key"), F.max("bucket").alias("bucket"))
    sums.select(*order, "key", "bucket").write.parquet(merged)  # whole before any folder is replaced
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # a table's inserts know no option for it
    try:
        spark.read.parquet(merged).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    return touched
