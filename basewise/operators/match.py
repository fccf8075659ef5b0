"""Joins of k-mers with a database: exact, and within a number of differences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewise.functions import bases

from .stored import kept, settled
from .windowing import restrict


#: Pairs of a block that one task compares, and the number of db k-mers that is assumed where none is given, at most.
PAIRS = 1 << 22
#: Probes that are sent to every task, at most.
FEW = 1 << 20
ASSUMED = 1_000_000_000
#: (min, max) lengths of the k-mers of a database, as its metadata tells them.
Lengths = tuple[int, int]


def check(low: int | None, high: int | None, db: DataFrame, held: Lengths | None) -> None:
    """ValueError unless the searched lengths low to high lie in those of db, which are read from it where held does not tell them."""
    if low is None:
        return
    held = held or tuple(db.agg(F.min(F.length("kmer")), F.max(F.length("kmer"))).first())
    if held[0] is not None and (low < held[0] or high > held[1]):
        raise ValueError(f"lengths {low} to {high} are searched, the database holds {held[0]} to {held[1]}")


def exact(search: DataFrame, db: DataFrame, k: int, held: Lengths | None = None) -> DataFrame:
    """(kmer, taxid, cnt) for the distinct k-mers of search, of length k, that stand in db cut to k; ValueError if k is outside db's lengths.

    Counts are summed after the join, on its partitioning, so rows of db move once and those without a match are not summed.
    """
    check(k, k, db, held)
    if held == (k, k):  # as it stands, so that a stored database keeps its place
        cut = db.select("kmer", "taxid", "cnt")
    else:
        cut = db.filter(F.length("kmer") >= k).select(F.substring("kmer", 1, k).alias("kmer"), "taxid", "cnt")
    return cut.join(search.select("kmer").distinct(), "kmer").groupBy("kmer", "taxid").agg(F.sum("cnt").alias("cnt"))


def prefixes(db: DataFrame, lengths: list[int]) -> DataFrame:
    """(len, kmer, taxid, cnt): db cut to each of the lengths, counts of k-mers that become equal summed.

    Rows meet by the shortest prefix, once; there the longest are summed first and every shorter prefix is derived from these sums, without another shuffle or scan of db.
    """
    low, high = min(lengths), max(lengths)
    if low == high:
        return restrict(db, low, low).select(F.lit(low).alias("len"), "kmer", "taxid", "cnt")
    cut = db.filter(F.length("kmer") >= low).select(F.substring("kmer", 1, low).alias("stem"), F.substring("kmer", 1, high).alias("kmer"), "taxid", "cnt")
    longest = cut.repartition("stem").groupBy("stem", "kmer", "taxid").agg(F.sum("cnt").alias("cnt"))
    wanted = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("kmer"))
    each = longest.select("stem", F.explode(wanted).alias("len"), "kmer", "taxid", "cnt").withColumn("kmer", F.substr("kmer", F.lit(1), F.col("len")))
    return each.groupBy("stem", "len", "kmer", "taxid").agg(F.sum("cnt").alias("cnt")).drop("stem")


def ball_size(k: int, d: int) -> int:
    """How many k-mers of length k differ from one in d places at most."""
    return sum(math.comb(k, i) * 3**i for i in range(min(k, d) + 1))


def cheaper(counts: dict[int, int], d: int, size: int | None = None) -> str:
    """ball or blocks, whichever moves and compares fewer rows for so many searched k-mers of each length; size: k-mers of the database, if known.

    Balls: every searched k-mer becomes as many probes as its ball holds, and the database moves once.  Blocks: both sides move d + 1 times, and the pairs of
    equal blocks are compared; longer blocks are equal less often.  Balls are of packed k-mers, so of 32 bases at most.
    """
    if not counts or max(counts) > 32:
        return "blocks"
    ball = blocks = 0
    for k, n in counts.items():
        there = min(4**k, ASSUMED if size is None else size)
        ball += n * ball_size(k, d) + there
        blocks += (d + 1) * (n + there + n * there / 4 ** (k / (d + 1)))
    return "ball" if ball <= blocks else "blocks"


def _ball(wanted: DataFrame, d: int) -> DataFrame:
    """(len, y, kmer, dist): the packed k-mers y within d differences of each kmer; wanted: (len, kmer).

    A round changes one more place, behind the last one that was changed, or none any more, so each y is made once.
    """
    spare = F.when(F.col("len") > 16, 64 - 2 * F.col("len")).otherwise(0)  # bits behind the last base
    out = wanted.select("len", "kmer", bases.packed("kmer").alias("y"), F.lit(0).alias("next"), F.lit(0).alias("dist"))
    for _ in range(d):
        turns = F.when(F.col("next") < F.col("len"), F.sequence(3 * F.col("next"), 3 * F.col("len") - 1)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn("turn", F.explode(F.concat(F.array(F.lit(-1)), turns)))
        place = F.floor(F.col("turn") / 3).cast("int")
        mask = F.call_function("shiftleft", (F.col("turn") % 3 + 1).cast("long"), 2 * place + spare)
        stays = F.col("turn") < 0
        out = out.select("len", "kmer", F.when(stays, F.col("y")).otherwise(F.col("y").bitwiseXOR(mask)).alias("y"), F.when(stays, F.col("len")).otherwise(place + 1).alias("next"), (F.col("dist") + (~stays).cast("int")).alias("dist"))
    return out.select("len", "y", "kmer", "dist")


def _by_blocks(wanted: DataFrame, there: DataFrame, d: int, long: bool, pairs: int) -> DataFrame:
    """(kmer, match_kmer, dist): pairs within d differences, which agree in one of d + 1 blocks, on which they are joined.

    A pair that agrees in several is kept by the first of them.  A block whose two sides make over `pairs` pairs is cut: there's
    k-mers are dealt to parts by hash, the searched ones go to every part.
    """
    n = d + 1

    def blocks(kmer: str) -> F.Column:
        bound = lambda k: F.floor(F.lit(k) * F.length(kmer) / n).cast("int")
        return F.array(*[F.struct(F.lit(k).alias("no"), F.substr(F.col(kmer), bound(k) + 1, bound(k + 1) - bound(k)).alias("part")) for k in range(n)])

    pack, distance = (bases.packed_words, bases.words_distance) if long else (bases.packed, bases.distance)
    on = ["len", "no", "part"]
    left = wanted.select("len", "kmer", pack("kmer").alias("x"), F.explode(blocks("kmer")).alias("b")).select("len", "b.no", "b.part", "kmer", "x")
    right = there.select("len", "match_kmer").distinct().select("len", "match_kmer", pack("match_kmer").alias("y"), F.explode(blocks("match_kmer")).alias("b")).select("len", "b.no", "b.part", "match_kmer", "y")
    hot = left.groupBy(*on).agg(F.count("*").alias("nl")).join(right.groupBy(*on).agg(F.count("*").alias("nr")), on)
    hot = hot.withColumn("cuts", F.ceil(F.col("nl") * F.col("nr") / pairs).cast("int")).filter("cuts > 1").select(*on, "cuts")
    cuts = F.coalesce("cuts", F.lit(1))
    left = left.join(hot, on, "left").select(*on, "kmer", "x", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"))
    right = right.join(hot, on, "left").select(*on, "match_kmer", "y", F.pmod(F.xxhash64("match_kmer"), cuts).cast("int").alias("cut"))
    found = left.join(right, [*on, "cut"]).withColumn("dist", distance(F.col("x"), F.col("y")).cast("int")).filter(F.col("dist") <= d)
    mine, theirs = blocks("kmer"), blocks("match_kmer")
    for k in range(d):
        found = found.filter(~((F.col("no") > k) & (mine[k]["part"] == theirs[k]["part"])))
    return found.select("kmer", "match_kmer", "dist")


def _chosen(near: DataFrame, best: bool, dedup_rc: bool) -> DataFrame:
    """near (kmer, match_kmer, dist, ...), each pair once, by the rules of nearest, with diff."""
    if best:  # first, since a match goes for its reverse complement only if that is as near
        near = near.withColumn("least", F.min("dist").over(Window.partitionBy("kmer"))).filter("dist = least").drop("least")
    if dedup_rc:
        first = F.struct("dist", bases.actg("match_kmer"))
        near = near.withColumn("first", F.min(first).over(Window.partitionBy("kmer", bases.canonical("match_kmer")))).filter(F.col("first") == first).drop("first")
    return near.withColumn("diff", bases.difference_text(bases.differences("kmer", "match_kmer")))


def _probes(wanted: DataFrame, d: int) -> DataFrame:
    """(kmer, match_kmer, dist): all k-mers within d differences of each; in as many tasks as shuffles have: few rows become many."""
    dealt = wanted.repartition(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kmer")
    return _ball(dealt, d).select("kmer", bases.unpacked("y", F.col("len")).alias("match_kmer"), "dist")


def near_pairs(search: DataFrame, known: DataFrame, max_diff: int, best: bool = False, dedup_rc: bool = True) -> DataFrame:
    """(kmer, match_kmer, dist, diff, ...): the pairs of nearest from probes, of k-mers up to 32 bases; known has a row (kmer, ...) for each different kmer of a database, whose other columns stay."""
    wanted = search.select("kmer").distinct().select(F.length("kmer").alias("len"), "kmer")
    return _chosen(_probes(wanted, max_diff).join(known.withColumnRenamed("kmer", "match_kmer"), "match_kmer"), best, dedup_rc)


def nearest(
    search: DataFrame, db: DataFrame, max_diff: int, best: bool = False, dedup_rc: bool = True, held: Lengths | None = None, size: int | None = None, how: str | None = None, pairs: int = PAIRS, by: str = "match_kmer"
) -> DataFrame:
    """(kmer, match_kmer, dist, diff, taxid, cnt): for each kmer of search, db k-mers cut to its length that differ in max_diff places at most.

    best keeps the nearest only; dedup_rc keeps, of a match and its reverse complement, the nearer one, then the one first in base order.  Both, and differences, are
    judged on pairs of k-mers, before they meet the taxa.
    held: the lengths of db, size: the number of its k-mers, as far as known.  how: ball (probes of all k-mers within max_diff, joined with db) or blocks (pigeonhole), by default
    what costs less.  by: match_kmer or taxid, by which rows lie together if the probes are few enough to be sent to every task.  K-mers may have any length.
    ValueError if lengths are searched that db does not hold.
    """
    parts = near_and_there(search, db, max_diff, best, dedup_rc, held, size, how, pairs, by)
    if parts is None:
        return db.sparkSession.createDataFrame([], "kmer string, match_kmer string, dist int, diff string, taxid int, cnt long")
    return parts[1].join(parts[0], "match_kmer").select("kmer", "match_kmer", "dist", "diff", "taxid", "cnt")


def near_and_there(
    search: DataFrame, db: DataFrame, max_diff: int, best: bool = False, dedup_rc: bool = True, held: Lengths | None = None, size: int | None = None, how: str | None = None, pairs: int = PAIRS, by: str = "match_kmer"
) -> tuple[DataFrame, DataFrame] | None:
    """The pairs (kmer, match_kmer, dist, diff) of nearest, and (match_kmer, taxid, cnt) with the rows of all their match_kmer; None where nothing is searched."""
    if max_diff < 0:
        raise ValueError("max_diff is 0 or more")
    wanted = search.select("kmer").distinct().select(F.length("kmer").alias("len"), "kmer")
    counts = {r[0]: r[1] for r in wanted.groupBy("len").count().collect()}  # 127 at most
    if not counts:
        return None
    check(min(counts), max(counts), db, held)
    ball, chosen = (how or cheaper(counts, max_diff, size)) == "ball", best or dedup_rc
    if not ball:
        there = settled(prefixes(db, sorted(counts)).withColumnRenamed("kmer", "match_kmer"))
        return _chosen(_by_blocks(wanted, there, max_diff, max(counts) > 32, pairs), best, dedup_rc), there
    probes = _probes(wanted, max_diff)
    if sum(n * ball_size(k, max_diff) for k, n in counts.items()) > FEW:
        there = prefixes(db, sorted(counts)).withColumnRenamed("kmer", "match_kmer")
        there = kept(there) if chosen else there
        return _chosen(probes.join(there.select("match_kmer").distinct(), "match_kmer") if chosen else probes, best, dedup_rc), there
    lengths = F.filter(F.array(*map(F.lit, sorted(counts))), lambda n: n <= F.length("kmer"))
    there = db.select(F.explode(lengths).alias("n"), "kmer", "taxid", "cnt").select(F.substr("kmer", F.lit(1), F.col("n")).alias("match_kmer"), "taxid", "cnt")
    there = there.join(F.broadcast(probes.select("match_kmer").distinct()), "match_kmer", "left_semi")  # before rows move
    there = kept(there) if chosen else there
    near = _chosen(probes.join(there.select("match_kmer").distinct(), "match_kmer") if chosen else probes, best, dedup_rc)
    return F.broadcast(near), there.repartition(by).groupBy("match_kmer", "taxid").agg(F.sum("cnt").alias("cnt"))


def accession_taxids(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """seqs (acc, ...) with taxid from ids (acc, taxid, line); of repeated accessions the last line counts; unmapped ones go."""
    last = ids.groupBy("acc").agg(F.max_by("taxid", "line").alias("taxid"))
    return seqs.join(last, "acc")


def limit(matches: DataFrame, taxa: DataFrame) -> DataFrame:
    """matches without the listed taxa."""
    return matches.join(taxa.select("taxid").distinct(), "taxid", "left_anti")


def limit_below(matches: DataFrame, taxa: DataFrame, lineage: DataFrame) -> DataFrame:
    """matches without taxa that are listed or have a listed ancestor; unknown taxa stay unless they are listed."""
    under = lineage.select("taxid", F.explode("path").alias("a")).join(taxa.select(F.col("taxid").alias("a")).distinct(), "a", "left_semi").select("taxid")
    return limit(matches, under.unionByName(taxa.select("taxid")))
