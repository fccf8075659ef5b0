"""Merkle manifest of a dataset by an associative monoid of sparse forests.

A forest holds nodes keyed by level and index that no parent covers yet, for groups whose numbers of leaves are known.  Adding two forests joins their nodes and, wherever a
run of siblings is complete, puts their parent in its place; the order of additions does not matter.  Leaves are range-partitioned, so each partition's forest
holds a few nodes for each level; rounds of a tree reduction add the forests of neighbouring partitions, and keep what they add, which is all that proofs need from other partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stash
from .sql import crc32

ARITY = 3
#: Leaves in a partition on average, and neighbouring forests that are added at a time.
PART = 16_384
FAN = 16
NODE = pa.struct([("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string())])
STEP = "array<struct<at: int, others: array<string>>>"
STEP_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
#: (level, index) to digest, for one group.
Forest = dict[tuple[int, int], str]


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int, arity: int) -> list[int]:
    """How many nodes each level has over n leaves, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def add(forest: Forest, sizes: list[int], arity: int) -> Forest:
    """Put parents in the place of complete sibling runs, lowest level first; return the forest that is left."""
    return added(forest, sizes, arity)[0]


def added(forest: Forest, sizes: list[int], arity: int) -> tuple[Forest, Forest]:
    """add, and the nodes that were made and covered on the way."""
    out, covered = dict(forest), {}
    for level in range(len(sizes) - 1):
        for run in sorted({i // arity for at, i in out if at == level}):
            own = [(level, i) for i in range(run * arity, min((run + 1) * arity, sizes[level]))]
            if all(k in out for k in own):
                covered |= {k: out.pop(k) for k in own}
                out[level + 1, run] = digest([covered[k] for k in own])
    return out, {k: d for k, d in covered.items() if k not in forest}


def local(leaves: list[str], start: int, sizes: list[int], arity: int, known: Forest | None = None) -> tuple[list[tuple[int, list[str]]], Forest]:
    """(rows, open): of consecutive leaves from index start, for each level the first index and digests of nodes over them alone; and the nodes no parent of these covers.

    known: nodes from elsewhere; with them rows reach over all ancestors of the leaves.
    """
    rows, left, known = [(start, leaves)], {}, known or {}
    for level in range(len(sizes) - 1):
        first, own = rows[-1]
        stop = first + len(own)
        get = lambda i, f=first, o=own, e=stop, v=level: o[i - f] if f <= i < e else known.get((v, i))
        made, begin = [], None
        for run in range(first // arity, (stop - 1) // arity + 1 if own else first // arity):
            kids = [get(i) for i in range(run * arity, min((run + 1) * arity, sizes[level]))]
            if None in kids:
                left |= {(level, i): get(i) for i in range(run * arity, min((run + 1) * arity, sizes[level])) if first <= i < stop}
            else:
                begin = run if begin is None else begin
                made.append(digest(kids))
        rows.append((begin or 0, made))
    if rows[-1][1]:
        left[len(sizes) - 1, 0] = rows[-1][1][0]
    return rows, left


def proofs(leaves: list[str], start: int, n: int, arity: int, known: Forest, up: list[dict]) -> list[list[dict]]:
    """For each leaf the steps to the root: its place among its run, and the digests of the run's others; up follows."""
    sizes = levels(n, arity)
    rows, _ = local(leaves, start, sizes, arity, known)
    paths: list[list[dict]] = [up] * len(rows[-1][1])
    for level in range(len(sizes) - 2, -1, -1):
        (first, own), above = rows[level], rows[level + 1][0]
        below = []
        for k in range(len(own)):
            run, place = divmod(first + k, arity)
            others = [own[i - first] if 0 <= i - first < len(own) else known[level, i] for i in range(run * arity, min((run + 1) * arity, sizes[level])) if i != first + k]
            below.append([{"at": place, "others": others}, *paths[run - above]])
        paths = below
    return paths


def _placed(leaves: DataFrame, part: int) -> DataFrame:
    """leaves (grp, id, leaf, ...) in partitions of about `part` neighbours in the order of grp, id and leaf, with the partition's number; equal leaves are dealt to several partitions."""
    n = max(1, math.ceil(leaves.count() / part))
    ordered = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, "grp", F.col("id").asc_nulls_first(), "leaf", "tie")
    return stash(ordered.sortWithinPartitions("grp", F.col("id").asc_nulls_first(), "leaf", "tie").withColumn("part", F.spark_partition_id()), "merkle-leaves")


def _extents(placed: DataFrame) -> DataFrame:
    """(part, grp, start, cnt, n): which leaves of a group a partition holds, and how many the group has."""
    own = placed.groupBy("part", "grp").agg(F.count("*").alias("cnt"))
    by = Window.partitionBy("grp")  # one row for each partition that the group reaches
    run = F.sum("cnt").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    return stash(own.select("part", "grp", (run - F.col("cnt")).alias("start"), "cnt", F.sum("cnt").over(by).alias("n")), "merkle-extents")


#: A node of a forest; top: it is its group's root; covered: its parent is in the forest.
FRAGMENT = "slot long, grp string, n long, level int, at long, digest string, top boolean, covered boolean"
FRAGMENT_TYPES = pa.schema([("slot", pa.int64()), ("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("top", pa.bool_()), ("covered", pa.bool_())])


def _nodes(slot: int, grp: str, n: int, forest: Forest, arity: int, covered: bool = False) -> list[tuple]:
    top = len(levels(n, arity)) - 1
    return [(slot, grp, n, level, at, d, level == top, covered) for (level, at), d in forest.items()]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(FRAGMENT_TYPES), FRAGMENT_TYPES.types, strict=True)], schema=FRAGMENT_TYPES)


def _fragments(placed: DataFrame, extents: DataFrame, arity: int) -> DataFrame:
    """Each partition's forest."""

    def run(leaves: pa.Table, own: pa.Table) -> pa.Table:
        rows, all_leaves, at = [], leaves.sort_by([("grp", "ascending"), ("place", "ascending")])["leaf"].to_pylist(), 0
        for e in own.sort_by("grp").to_pylist():
            _, left = local(all_leaves[at : at + e["cnt"]], e["start"], levels(e["n"], arity), arity)
            at += e["cnt"]
            rows += _nodes(e["part"], e["grp"], e["n"], left, arity)
        return _table(rows)

    return placed.groupBy("part").cogroup(extents.groupBy("part")).applyInArrow(run, FRAGMENT)


def _reduced(fragments: DataFrame, parts: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """(roots, nodes): a row (grp, digest) for each group; and the nodes of all rounds for groups of several partitions, which is what proofs need from elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        forests: dict[tuple[str, int], Forest] = {}
        for r in table.to_pylist():
            forests.setdefault((r["grp"], r["n"]), {})[r["level"], r["at"]] = r["digest"]
        slot = table["slot"][0].as_py()
        return _table([x for (g, n), f in forests.items() for own, covered in zip(added(f, levels(n, arity), arity), (False, True), strict=True) for x in _nodes(slot, g, n, own, arity, covered)])

    now = stash(fragments, "merkle-forest")
    roots, nodes = now.filter("top").select("grp", "digest"), now.filter("not top").select("grp", "level", "at", "digest")
    while parts > 1:
        parts = -(-parts // FAN)
        now = stash(now.filter("not top and not covered").withColumn("slot", F.floor(F.col("slot") / FAN)).groupBy("slot").applyInArrow(run, FRAGMENT), "merkle-forest")
        roots = roots.unionByName(now.filter("top").select("grp", "digest"))
        nodes = nodes.unionByName(now.filter("not top").select("grp", "level", "at", "digest"))
    return roots, nodes.distinct()


def _wanted(extents: DataFrame, nodes: DataFrame, arity: int) -> DataFrame:
    """(part, grp, known): the nodes that proofs in a partition may need from elsewhere: at each level the runs over its first and its last leaf; at most 2 x arity a level."""
    level = F.explode(F.sequence(F.lit(0), F.ceil(F.log(float(arity), F.col("n"))).cast("int"))).alias("level")
    apart = extents.filter("cnt < n").select("part", "grp", "start", (F.col("start") + F.col("cnt") - 1).alias("last"), level)
    span = F.pow(F.lit(float(arity)), F.col("level") + 1)
    run = F.explode(F.array_distinct(F.array(F.floor(F.col("start") / span), F.floor(F.col("last") / span)))).alias("run")
    asked = apart.select("part", "grp", "level", run).select("part", "grp", "level", F.explode(F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda k: F.col("run") * arity + k)).alias("at"))
    return asked.join(nodes, ["grp", "level", "at"]).groupBy("part", "grp").agg(F.collect_list(F.struct("level", "at", "digest")).alias("known"))


def paths(leaves: DataFrame, arity: int = ARITY, part: int = PART, above: bool = True) -> DataFrame:
    """leaves (grp, id, leaf, and others) with path, subroot and root.

    grp is a text, not null, and orders the groups; leaves are ordered by id, null first, then by leaf.  The subroots of groups, in order, are the leaves of a last tree (unless above is false: then root is the subroot).
    """
    placed = _placed(leaves, part)
    extents = _extents(placed)
    parts = (placed.agg(F.max("part")).first()[0] or 0) + 1
    by = Window.partitionBy("part").orderBy("grp", F.col("id").asc_nulls_first(), "leaf", "tie")  # PART rows on average
    placed = placed.withColumn("place", F.row_number().over(by)).drop("tie")
    roots, nodes = _reduced(_fragments(placed.select("part", "grp", "place", "leaf"), extents, arity), parts, arity)
    roots = stash(roots, "merkle-roots")
    if above:
        tops = paths(roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("digest").alias("leaf")), arity, part, above=False)
        ups = stash(tops.select(F.col("id").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("up")), "merkle-tops")
    else:
        ups = roots.select("grp", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(STEP).alias("up"))
    known = _wanted(extents, nodes, arity)
    info = stash(extents.join(ups, "grp").join(known, ["part", "grp"], "left"), "merkle-extents")
    kept = [c for c in leaves.columns if c != "grp"]
    out = pa.schema([("path", STEP_TYPE), ("subroot", pa.string()), ("root", pa.string())])

    def run(table: pa.Table, own: pa.Table) -> pa.Table:
        table, at, made = table.sort_by([("grp", "ascending"), ("place", "ascending")]), 0, [[], [], []]
        digests = table["leaf"].to_pylist()
        for e in own.sort_by("grp").to_pylist():
            known = {(x["level"], x["at"]): x["digest"] for x in e["known"] or ()}
            made[0] += proofs(digests[at : at + e["cnt"]], e["start"], e["n"], arity, known, e["up"])
            made[1] += [e["subroot"]] * e["cnt"]
            made[2] += [e["root"]] * e["cnt"]
            at += e["cnt"]
        added = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(made, out.types, strict=True)], schema=out)
        for name, column in zip(added.column_names, added.columns, strict=True):
            table = table.append_column(name, column)
        return table.select([*kept, *out.names])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema if f.name != "grp")
    return placed.groupBy("part").cogroup(info.groupBy("part")).applyInArrow(run, f"{types}, path {STEP}, subroot string, root string")


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the digests of a path lead to."""
    joined = lambda h, s: F.concat(F.array_join(F.slice(s["others"], F.lit(1), s["at"]), ""), h, F.array_join(F.slice(s["others"], s["at"] + 1, F.size(s["others"])), ""))
    return F.aggregate(path, start, lambda h, s: F.sha2(joined(h, s), 256))


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", extra: dict[str, Column] | None = None, arity: int = ARITY, part: int = PART) -> DataFrame:
    """Return (id, leaf, path, subroot, root) for every row, and a column for each of extra, which is computed from the row.

    A leaf is the digest of the columns' fields.  Leaves of a group ascend by id, null first, rows of one id by leaf; groups are ordered by name, null first, then by UTF-8 bytes.
    path: for each level up to the root the leaf's place among its siblings and the digests of the others.  Rows that repeat all columns are leaves
    of their own.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))
    rows = docs.select(group.alias("grp"), F.col(id_col).alias("id"), leaf(*(F.col(c) for c in columns)).alias("leaf"), *(c.alias(f"x_{name}") for name, c in (extra or {}).items()))
    with scratch(docs.sparkSession):
        out = stash(paths(stash(rows, "merkle-rows"), arity, part), "merkle-manifest", kept=True)
    return out.select("id", "leaf", "path", "subroot", "root", *(F.col(f"x_{name}").alias(name) for name in extra or ()))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_query(docs: DataFrame) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, COLUMNS, extra={"other": leaf(*(F.col(c) for c in COLUMNS[:-1]), tampered)})
    siblings = F.array_join(F.flatten(F.transform("path", lambda s: s["others"])), "")
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("other"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """Trees by a recursive query over levels; crc32 bit by bit; siblings and folded leaves by one more recursion up the levels."""
    text = "text"
    leaf_of = lambda t: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*COLUMNS[:-1], t]) + ")"
    crc = crc32("CAST(doc_id AS VARCHAR)")
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, coalesce('s' || source, 'n') AS g, doc_id, {leaf_of(text)} AS leaf, {leaf_of("CASE WHEN " + crc + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM documents),
l AS (SELECT r, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, leaf FROM d),
t AS (SELECT g, 0 AS v, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM l
  UNION ALL SELECT g, v + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY g, v, i // 3),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM t WHERE n = 1),
u AS (SELECT 0 AS v, i, h, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL SELECT v + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY v, i // 3),
b AS MATERIALIZED (SELECT g, v, i // 3 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL UNION ALL SELECT '' AS g, v, i // 3, list(h ORDER BY i) FROM u WHERE n > 1 GROUP BY ALL),
w AS (SELECT r, l.g, s.i AS j, 0 AS v, l.i, false AS top, '' AS p, other AS h, t.n FROM l JOIN d USING (r) JOIN s ON l.g = s.g JOIN (SELECT g, any_value(n) AS n FROM t WHERE v = 0 GROUP BY g) t ON l.g = t.g
  UNION ALL SELECT r, w.g, j, CASE WHEN w.n = 1 THEN 0 ELSE w.v + 1 END, CASE WHEN w.n = 1 THEN j ELSE w.i // 3 END, w.n = 1 OR top,
    CASE WHEN w.n = 1 THEN p ELSE p || array_to_string(hs[:w.i % 3], '') || array_to_string(hs[w.i % 3 + 2:], '') END,
    CASE WHEN w.n = 1 THEN h ELSE sha256(array_to_string(hs[:w.i % 3], '') || h || array_to_string(hs[w.i % 3 + 2:], '')) END,
    CASE WHEN w.n = 1 THEN (SELECT count(*) FROM s) ELSE (w.n + 2) // 3 END
  FROM w LEFT JOIN b ON b.g = CASE WHEN top THEN '' ELSE w.g END AND b.v = w.v AND b.run = w.i // 3 AND w.n > 1 WHERE NOT (top AND w.n = 1))
SELECT doc_id, leaf, s.h AS subroot, z.h AS root, sha256(p) AS proof_sha256, w.h AS folded_root, w.h = z.h AS verified
FROM w JOIN d USING (r) JOIN s ON s.g = d.g JOIN (SELECT h FROM u WHERE n = 1) z ON true WHERE top AND w.n = 1
"""


ORACLE = _sql()
