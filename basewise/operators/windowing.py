"""Windows over sequences, and databases of k-mers in long form: (kmer, taxid, cnt) and (kmer, read, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewise.functions import bases


#: Starts of windows that are cut from one piece of a sequence.
CHUNK = 4096


def runs(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each run of valid bases, upper-cased; lines without one give none."""
    parts = F.regexp_extract_all(F.col(seq), F.lit("([ACGTacgt]+)"), F.lit(1))
    return df.withColumn(seq, F.explode(parts)).withColumn(seq, F.upper(seq))


def windows(df: DataFrame, min_k: int, max_k: int | None = None, seq: str = "seq") -> DataFrame:
    """Add pos and kmer: one window of max_k bases from each start, shorter ones to min_k at the end.  Null and short sequences give none.

    Sequences are cut into chunks of CHUNK starts first, each with the bases that its last windows reach into; so the work
    is linear in the length, and no array is longer than a chunk or larger than its sequence.
    """
    max_k = max_k or min_k
    if not 0 < min_k <= max_k:
        raise ValueError("0 < min_k <= max_k is needed")
    kept = [c for c in df.columns if c != seq]
    ahead = lambda text, low, high, take="": F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{low},{high}}})){take}"), F.lit(1))
    parts = df.select(*kept, F.posexplode(ahead(seq, min_k, CHUNK + max_k - 1, f".{{1,{CHUNK}}}")).alias("__chunk", "__part"))
    each = parts.select(*kept, "__chunk", F.posexplode(ahead("__part", min_k, max_k)).alias("__at", "kmer")).filter(F.col("__at") < CHUNK)
    return each.select(*kept, (F.col("__chunk") * CHUNK + F.col("__at")).alias("pos"), "kmer")


def scanner_windows(df: DataFrame, min_k: int, max_k: int, seq: str = "seq") -> DataFrame:
    """Windows as a one-pass scanner gives them over invalid bases: where a full window is not valid, all its valid suffixes from min_k on; the same at the end.

    Sequences are cut into chunks of CHUNK ends first, each with the bases before that its windows reach back to, so no array is longer than a chunk.
    """
    kept = [c for c in df.columns if c != seq]
    n, valid = F.length(seq), lambda k: k.rlike("^[ACGTacgt]+$")
    firsts = F.when(n >= min_k, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    chunks = df.select(*kept, seq, n.alias("__n"), F.explode(firsts).alias("__c"))
    begin = F.greatest(F.col("__c") * CHUNK - max_k, F.lit(0))
    chunks = chunks.select(*kept, "__n", "__c", begin.alias("__b"), F.substr(F.col(seq), begin + 1, (F.col("__c") + 1) * CHUNK - begin).alias("__s"))
    cut = lambda end, size: F.struct((end - size).alias("pos"), F.substr(F.col("__s"), end - size - F.col("__b") + 1, size).alias("kmer"))
    none = F.array().cast("array<struct<pos:int,kmer:string>>")

    def shorter(end: Column, most: Column) -> Column:
        return F.when(most >= min_k, F.transform(F.sequence(F.lit(min_k), F.greatest(most, F.lit(min_k))), lambda k: cut(end, k))).otherwise(none)

    def at(end: Column) -> Column:
        full = cut(end, F.lit(max_k))
        return F.when(valid(full["kmer"]), F.array(full)).when(end > min_k, shorter(end, F.lit(max_k - 1))).otherwise(none)

    low, high = F.greatest(F.col("__c") * CHUNK + 1, F.lit(max_k)), F.least((F.col("__c") + 1) * CHUNK, F.col("__n"))
    ends = F.when(low <= high, F.flatten(F.transform(F.sequence(low, F.greatest(low, high)), at))).otherwise(none)
    last = F.when(((F.col("__c") + 1) * CHUNK >= F.col("__n")), shorter(F.col("__n"), F.least(F.col("__n"), F.lit(max_k - 1)))).otherwise(none)
    found = F.filter(F.concat(ends, last), lambda w: valid(w["kmer"]))
    return chunks.select(*kept, F.explode(found).alias("w")).select(*kept, "w.pos", F.upper("w.kmer").alias("kmer"))


def standard(df: DataFrame, kmer: str = "kmer") -> DataFrame:
    """The rows whose kmer is not behind its reverse complement."""
    return df.filter(bases.is_standard(kmer))


def both_strands(df: DataFrame, mode: str = "compat", kmer: str = "kmer") -> DataFrame:
    """Each kmer and its reverse complement; those that are their own (by mode) once."""
    both = F.when(bases.is_own_rc(kmer, mode), F.array(kmer)).otherwise(F.array(F.col(kmer), bases.reverse_complement(kmer)))
    return df.withColumn(kmer, F.explode(both))


def count_db(df: DataFrame, mode: str | None = "compat") -> DataFrame:
    """(kmer, taxid, cnt) from rows (taxid, kmer); mode of both_strands, null for one strand."""
    return (both_strands(df, mode) if mode else df).groupBy("kmer", "taxid").agg(F.count("*").alias("cnt"))


def read_db(df: DataFrame) -> DataFrame:
    """(kmer, read, pos) without repeats."""
    return df.select("kmer", "read", "pos").distinct()


def merge_dbs(*dbs: DataFrame) -> DataFrame:
    out = dbs[0]
    for db in dbs[1:]:
        out = out.unionByName(db)
    return out.groupBy("kmer", "taxid").agg(F.sum("cnt").alias("cnt"))


def restrict(db: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """Rows of min_k bases at least, cut to max_k; counts of k-mers that become equal are summed."""
    return db.filter(F.length("kmer") >= min_k).withColumn("kmer", F.substring("kmer", 1, max_k)).groupBy("kmer", "taxid").agg(F.sum("cnt").alias("cnt"))


def key_range(db: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """Rows whose key of n bases is in [low, high]; of a stored database, stored.key_range reads the range's folders only."""
    return db.filter(bases.key("kmer", n).between(low, high))


def numbered_reads(df: DataFrame, order: str = "line", name: str = "name") -> DataFrame:
    """Number reads in file order: a new number where the name differs from the row before.

    Names are compared within blocks of 1,000,000 lines first, so that no task orders all reads.
    """
    block = F.floor(F.col(order) / 1_000_000)
    within = Window.partitionBy("__block").orderBy(order)
    rows = df.withColumn("__block", block)
    lasts = rows.groupBy("__block").agg(F.max_by(name, order).alias("__last"), F.min_by(name, order).alias("__first"))
    marked = rows.withColumn("__new", F.coalesce((F.col(name) != F.lag(name).over(within)).cast("long"), F.lit(0)))
    counts = marked.groupBy("__block").agg(F.sum("__new").alias("__n")).join(lasts, "__block")
    by_block = Window.orderBy("__block")  # one row for each block of a million
    starts = counts.withColumn("__open", F.coalesce((F.col("__first") != F.lag("__last").over(by_block)).cast("long"), F.lit(1)))
    starts = starts.withColumn("__base", F.sum(F.col("__open") + F.col("__n")).over(by_block) - F.col("__n") - 1).select("__block", "__base")
    run = F.sum("__new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(starts, "__block").withColumn("read", (F.col("__base") + run).cast("int")).drop("__block", "__new", "__base")


def reads_with_windows(df: DataFrame, min_k: int, order: str = "line", name: str = "name", seq: str = "seq") -> DataFrame:
    """numbered_reads of the rows that hold a run of min_k valid bases; the others get no number."""
    return numbered_reads(df.filter(F.col(seq).rlike(f"[ACGTacgt]{{{min_k}}}")), order, name)


def read_names(numbered: DataFrame, name: str = "name") -> DataFrame:
    """(read, name): the name of every numbered read."""
    return numbered.groupBy("read").agg(F.first(name).alias("name"))


def sizes(db: DataFrame) -> DataFrame:
    """(n, min_k, max_k): the number of rows and the lengths of their shortest and longest kmer."""
    return db.agg(F.count("*").alias("n"), F.min(F.length("kmer")).alias("min_k"), F.max(F.length("kmer")).alias("max_k"))


def key_range_restricted(db: DataFrame, n: int, low: int, high: int, min_k: int, max_k: int) -> DataFrame:
    """restrict over the rows of key_range, so that only those are read and grouped."""
    return restrict(key_range(db, n, low, high), min_k, max_k)


def key_bounds(db: DataFrame, n: int) -> DataFrame:
    k = bases.key("kmer", n)
    return db.agg(F.min(k).alias("min_key"), F.max(k).alias("max_key"))


def histogram(df: DataFrame, k: int) -> DataFrame:
    """(key, n) for all 4^k keys, those without k-mers too."""
    counts = df.filter(F.length("kmer") >= k).groupBy(bases.key("kmer", k).alias("key")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(4**k).select(F.col("id").cast("int").alias("key")).join(counts, "key", "left").fillna(0, ["n"])
