"""Sequence files and parameter files as DataFrames; compressed files are read by their endings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewise.operators import windowing
from basewise.operators.stored import settled


def fasta(spark: SparkSession, path: str, id_ends: str = "[ \t]") -> DataFrame:
    """(seq_id, seq) with multi-line records joined; id_ends is where an id ends."""
    records = spark.read.text(path, lineSep="\n>").filter("length(value) > 0")
    head = F.regexp_replace(F.split("value", "\r?\n", 2)[0], "^>", "")
    body = F.regexp_replace(F.coalesce(F.get(F.split("value", "\r?\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    return records.select(F.split(head, id_ends, 2)[0].alias("seq_id"), body.alias("seq")).filter("length(seq_id) > 0")


def fasta_runs(spark: SparkSession, path: str) -> DataFrame:
    """(acc, seq) for each run of valid bases; the id ends at a dot, space or tab."""
    return windowing.runs(fasta(spark, path, "[. \t]")).withColumnRenamed("seq_id", "acc")


#: Records of a split that are put in order together.
BLOCK = 1 << 17


def _placed(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(value, file, start, at): lines with the file, the first byte of their split and a number that rises within a split, so that (file, start, at) is their order in the files whatever the splits."""
    lines = spark.read.text(path, lineSep=separator)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def fastq(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> DataFrame:
    """(line, name, seq, qual) of one file or several; line numbers the records from 0 in the order of files (by path) and bytes, whatever the splits.

    Sequences and qualities may run over several lines.  A record starts at a line `@...`; its sequence ends at the line `+...`, its quality where
    it is as long as the sequence.  Texts between two `@` at a line's start that have no such `+` belong to the quality before them, also where that
    stands in the split before.  No task orders more than `block` records; one row for each block tells where its numbers start.
    """
    parts = _placed(spark, path, "\n@").withColumn("block", F.floor(F.col("at") / block))
    value = F.regexp_replace("value", "\r?\n?$", "")
    parts = parts.select("file", "start", "block", "at", F.split(value, "\r?\n").alias("p"))
    lines = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    plus = F.array_position(F.transform(lines, lambda x: x.startswith("+")), True).cast("int")
    seq = F.when(plus > 0, F.array_join(F.slice(lines, 1, F.greatest(plus - 1, F.lit(0))), ""))
    qual = F.when(plus > 0, F.array_join(F.slice(lines, plus + 1, F.size(lines)), "")).otherwise(F.concat(F.lit("@"), F.array_join("p", "")))
    read = parts.select("file", "start", "block", "at", F.col("p")[0].alias("name"), seq.alias("seq"), qual.alias("qual"))
    place = ["file", "start", "block"]
    own = F.count("seq").over(Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # records of a block by their number in it; 0 is what the block holds of the record before it
    given = F.struct("at", F.struct("name", "seq").alias("head"), "qual")
    records = read.withColumn("own", own).groupBy(*place, "own").agg(F.array_sort(F.collect_list(given)).alias("parts"))
    records = settled(records.select(*place, "own", F.col("parts")[0]["head"].alias("head"), F.col("parts")["qual"].alias("quals")))
    counts = records.groupBy(*place).agg(F.max("own").alias("n"), F.max(F.when(F.col("own") == 0, F.col("quals"))).alias("rest"))
    order = Window.orderBy(*place)  # one row for each block
    bases = counts.withColumn("base", F.sum("n").over(order) - F.col("n")).withColumn("opens", F.coalesce(F.lag("file").over(order) != F.col("file"), F.lit(True)))
    rest = bases.filter("rest is not null").groupBy("file", F.col("base").alias("line")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "block", "rest"))), lambda x: x["rest"])).alias("rest"))
    whole = records.filter("own > 0").join(bases.select(*place, "base", "opens"), place)
    name = F.when(F.col("opens") & (F.col("own") == 1), F.regexp_replace("head.name", "^@", "")).otherwise(F.col("head.name"))  # a file's first mark has no line end before it
    whole = whole.select("file", (F.col("base") + F.col("own")).alias("line"), name.alias("name"), F.col("head.seq").alias("seq"), "quals")
    whole = whole.join(rest, ["file", "line"], "left")
    size = F.length("seq")
    quals = F.concat("quals", F.coalesce("rest", F.array().cast("array<string>")))
    text = F.aggregate(quals, F.struct(F.lit("").alias("text"), F.lit(False).alias("begun")), lambda a, x: F.struct(F.when(~a["begun"] | (F.length(a["text"]) < size), F.concat(a["text"], x)).otherwise(a["text"]).alias("text"), F.lit(True).alias("begun")))["text"]
    return whole.filter(size > 0).select((F.col("line") - 1).alias("line"), "name", "seq", text.alias("qual"))


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, seq) from lines `taxid<TAB or space>SEQ`."""
    p = F.split("value", "[\t ]", 2)
    return spark.read.text(path).select(p[0].cast("int").alias("taxid"), F.upper(p[1]).alias("seq"))


def preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, seq) from lines `taxid ~ SEQ`."""
    p = F.split("value", " ~ ", 2)
    return spark.read.text(path).select(p[0].cast("int").alias("taxid"), p[1].alias("seq"))


def id_map(spark: SparkSession, path: str, acc: int = 2, taxid: int = 3, skip: int = 0) -> DataFrame:
    """(acc, taxid, line) from a table with columns counted from 1; acc ends at its dot; the first `skip` lines of a file go."""
    rows = _placed(spark, path).select("value", "file", "start", F.col("at").alias("line"))
    if skip:  # a file's first split tells where its lines begin; the others hold none to leave out
        first = rows.filter("start = 0").groupBy("file").agg(F.min("line").alias("first"))
        rows = rows.join(first, "file", "left").filter((F.col("start") > 0) | (F.col("line") >= F.col("first") + skip))
    p = F.split("value", "\t")
    return rows.select(F.substring_index(p[acc - 1], ".", 1).alias("acc"), F.try_to_number(p[taxid - 1], F.lit("999999999")).cast("int").alias("taxid"), "line").filter("taxid is not null")


def taxonomy_dump(spark: SparkSession, nodes: str, names: str | None = None, merged: str | None = None, deleted: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(taxa, merged, deleted) from dump files; the node that is its own parent is the root, with parent -1."""

    def fields(path: str) -> DataFrame:
        return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))

    taxa = fields(nodes).select(F.col("f")[0].cast("int").alias("taxid"), F.col("f")[1].cast("int").alias("parent"), F.col("f")[2].alias("rank"), F.get("f", F.lit(4)).cast("int").alias("division"))
    taxa = taxa.withColumn("parent", F.when(F.col("parent") == F.col("taxid"), -1).otherwise(F.col("parent")))
    if names:
        said = fields(names).filter(F.get("f", F.lit(3)) == "scientific name").select(F.col("f")[0].cast("int").alias("taxid"), F.col("f")[1].alias("name"))
        taxa = taxa.join(said, "taxid", "left")
    old = fields(merged).select(F.col("f")[0].cast("int").alias("old"), F.col("f")[1].cast("int").alias("new")) if merged else spark.createDataFrame([], "old int, new int")
    gone = fields(deleted).select(F.col("f")[0].cast("int").alias("taxid")) if deleted else spark.createDataFrame([], "taxid int")
    return taxa, old, gone


def taxonomy_instance(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """taxonomy_dump of the four files that an instance file names, one a line and beside it: nodes, names, merged, deleted; ValueError if it names fewer."""
    named = [r[0].strip() for r in spark.read.text(path).limit(4).collect()]
    if len(named) < 4 or not all(named):
        raise ValueError(f"{path} has to name four files: nodes, names, merged, deleted")
    folder = path.rstrip("/").rpartition("/")[0]
    return taxonomy_dump(spark, *(f"{folder}/{name}" if folder else name for name in named))


def patterns(lines: list[str]) -> list[tuple[str, list[int], list[int], bool]]:
    """Patterns from lines like `12 !34 + #name`: present, absent, whether others may be there, and a name."""
    out = []
    for line in lines:
        tokens = line.split("#", 1)[0].split()
        name = line.split("#", 1)[1].strip() if "#" in line else line.strip()
        out.append((name, [int(t) for t in tokens if t.isdigit()], [int(t[1:]) for t in tokens if t.startswith("!")], "+" in tokens))
    return out


def taxon_list(spark: SparkSession, path: str) -> DataFrame:
    """(taxid) from a file of one id a line, as for exclusion lists; empty lines and what is no number go."""
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("taxid")).filter("taxid is not null")


def taxon_pair(spark: SparkSession, path: str) -> tuple[int, int]:
    """The two ids of a file of two lines."""
    rows = taxon_list(spark, path).limit(2).collect()
    if len(rows) < 2:
        raise ValueError(f"{path} holds no two taxa")
    return rows[0][0], rows[1][0]


def probability_table(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, p) from lines `taxid<TAB>p`; of a repeated id the last line counts."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(p[0].try_cast("int").alias("taxid"), F.get(p, F.lit(1)).try_cast("double").alias("p"), F.monotonically_increasing_id().alias("line"))
    return rows.filter("taxid is not null and p is not null").groupBy("taxid").agg(F.max_by("p", "line").alias("p"))


def part_files(spark: SparkSession, path: str) -> list[str]:
    """path if there is such a file or folder, else path.1, path.2 and so on as far as they go; FileNotFoundError if there is none."""
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: system.exists(spark._jvm.org.apache.hadoop.fs.Path(name))
    if there(path):
        return [path]
    found = []
    while there(f"{path}.{len(found) + 1}"):
        found.append(f"{path}.{len(found) + 1}")
    if not found:
        raise FileNotFoundError(path)
    return found


def mapped_fasta(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(taxid, seq) of records whose id is in ids (seq_id, taxid, line); of a repeated id the last line counts, records without one go."""
    last = ids.groupBy("seq_id").agg(F.max_by("taxid", "line").alias("taxid"))
    return fasta(spark, path).join(last, "seq_id").select("taxid", "seq")


def save_sequences(seqs: DataFrame, path: str) -> None:
    """Write (acc, taxid, seq) as Parquet in one folder for each of the 100 numbers that the last two digits of accessions make; without digits, 0."""
    index = F.coalesce(F.regexp_extract("acc", "([0-9]{1,2})[^0-9]*$", 1).try_cast("int"), F.lit(0))
    seqs.withColumn("index", index).repartition("index", F.pmod(F.xxhash64("acc"), F.lit(16))).write.partitionBy("index").parquet(path)


def stored_sequences(spark: SparkSession, path: str, low: int = 0, high: int = 99) -> DataFrame:
    """(acc, taxid, seq, index) of the folders from low to high, both included; others are not read."""
    return spark.read.parquet(path).filter(F.col("index").between(low, high))


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df over at least as many partitions as there are cores; one whose files make as many splits already is not moved.

    For small inputs of few splits ahead of work that makes many rows of each.
    """
    spark = df.sparkSession
    cores = parts or spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
