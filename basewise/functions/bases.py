"""Scalar functions on base strings as Column expressions.

Bases are ordered A < C < T < G wherever an order matters; the complement pairs are A-T and C-G.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases in order, and the complement of each of ACGT.
ORDER = "ACTG"
PAIRS = ("ACGT", "TGCA")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def actg(c: Column | str) -> Column:
    """A text that sorts as the bases do."""
    return F.translate(col(c), ORDER, "0123")


def reverse_complement(c: Column | str) -> Column:
    return F.translate(F.reverse(col(c)), *PAIRS)


def key(c: Column | str, n: int) -> Column:
    """The first n bases as an int; null where there are fewer."""
    c = col(c)
    return F.when(F.length(c) >= n, F.conv(actg(F.substring(c, 1, n)), 4, 10).cast("int"))


def is_own_rc(c: Column | str, mode: str = "compat") -> Column:
    """compat: palindromes as text, of even length; strict: equal to the reverse complement."""
    c = col(c)
    if mode == "strict":
        return c == reverse_complement(c)
    if mode != "compat":
        raise ValueError(f"unknown mode {mode}")
    return (F.length(c) % 2 == 0) & (c == F.reverse(c))


def is_standard(c: Column | str) -> Column:
    """Whether a kmer is not behind its reverse complement."""
    return actg(c) <= actg(reverse_complement(c))


def canonical(c: Column | str) -> Column:
    return F.when(is_standard(c), col(c)).otherwise(reverse_complement(c))


def packed(c: Column | str) -> Column:
    """Up to 32 bases as a long of two bits each, in the bases' order."""
    c = actg(c)
    head, tail = F.substring(c, 1, 16), F.substring(c, 17, 16)
    return F.when(F.length(c) <= 16, F.conv(c, 4, 10).cast("long")).otherwise(F.shiftleft(F.conv(head, 4, 10).cast("long"), 32).bitwiseOR(F.conv(F.rpad(tail, 16, "0"), 4, 10).cast("long")))


def unpacked(c: Column | str, n: Column) -> Column:
    """The kmer of n bases, up to 32, of a long as packed gives it."""
    digits = F.conv(col(c).cast("string"), 10, 4)
    return F.translate(F.when(n <= 16, F.lpad(digits, n, "0")).otherwise(F.substr(F.lpad(digits, 32, "0"), F.lit(1), n)), "0123", ORDER)


def distance(a: Column, b: Column) -> Column:
    """The number of places at which two packed k-mers of one length differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def packed_words(c: Column | str) -> Column:
    """A kmer of any length as an array of longs, 32 bases each."""
    c = col(c)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.length(c) / 32).cast("int") - 1), lambda i: packed(F.substr(c, i * 32 + 1, F.lit(32))))


def words_distance(a: Column, b: Column) -> Column:
    """The number of places at which two k-mers of one length, as arrays of packed words, differ."""
    return F.aggregate(F.zip_with(a, b, distance), F.lit(0), lambda n, d: n + d)


def differences(a: Column | str, b: Column | str) -> Column:
    """Where b differs from a, over a's length: an array of (pos, base)."""
    a, b = col(a), col(b)
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.length(a) - 1, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.substr(b, i + 1, F.lit(1)).alias("base")))
    return F.filter(each, lambda d: F.substr(a, d["pos"] + 1, F.lit(1)) != d["base"])


def difference_text(diff: Column) -> Column:
    """Differences as in `3A17G`; none is `-`."""
    return F.when(F.size(diff) == 0, "-").otherwise(F.array_join(F.transform(diff, lambda d: F.concat(d["pos"].cast("string"), d["base"])), ""))


def parse_differences(c: Column | str) -> Column:
    parts = F.regexp_extract_all(col(c), F.lit("([0-9]+[ACGT])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "([0-9]+)", 1).cast("int").alias("pos"), F.right(p, F.lit(1)).alias("base")))


def apply_differences(a: Column | str, diff: Column) -> Column:
    return F.aggregate(diff, col(a), lambda k, d: F.overlay(k, d["base"], d["pos"] + 1, F.lit(1)))


def close_keys(c: Column, n: int, most: int) -> Column:
    """The sorted keys of n bases within `most` differences of key c."""
    turns = F.transform(F.sequence(F.lit(0), F.lit(4 * n - 1)), lambda k: F.struct((F.floor(k / 4) * 2).cast("int").alias("at"), (k % 4).cast("int").alias("base")))
    found = F.array(c)
    for _ in range(most):
        found = F.array_distinct(F.flatten(F.transform(found, lambda x: F.transform(turns, lambda s: _with_base(x, s)))))
    return F.sort_array(found)


def _with_base(x: Column, s: Column) -> Column:
    mask = F.call_function("shiftleft", F.lit(3), s["at"])
    return x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(F.call_function("shiftleft", s["base"], s["at"]))


def dust_score(c: Column | str) -> Column:
    """The sum of n (n - 1) over a kmer's different triplets, each standing n times."""
    c = col(c)
    triplets = F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    counts = F.transform(F.array_distinct(triplets), lambda u: F.size(F.filter(triplets, lambda t: t == u)))
    return F.aggregate(counts, F.lit(0), lambda a, n: a + n * (n - 1))


def passes_dust(c: Column | str, threshold: float) -> Column:
    return dust_score(c) < threshold * F.length(col(c)) * 2


def passes_runs(c: Column | str, n: int) -> Column:
    """Whether no base runs to n; n of 1 or less lets all pass."""
    return ~col(c).rlike("|".join(f"{b}{{{n}}}" for b in ORDER)) if n >= 2 else F.lit(True)
