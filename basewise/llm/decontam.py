"""Benchmark decontamination over a distributed positional inverted index of the training text.

The index stores a posting (term, row, pos) for every word of every text; a term's list lies over all parts, in the order of rows and positions, so no
list is long in one part and a build holds no part whole.  It does not depend on a benchmark and serves any number of them: the lists of all
terms that a step needs are read by one scan of the term column, joined with these terms.

A window of a test item is found by intersecting lists: the list of its rarest term gives the places where it may start; a place stays when, for
every other word of the window, the word's list, shifted by its offset in the window, holds it too.  The next rarest words come first, one
by one; what is left then is intersected with all remaining lists at once.

Everything here is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, lower_az, scratch, stash

WINDOW = 10
PROBES = 3  # terms of a window whose lists are intersected one by one, and that a proximity match needs
BROADCAST = 200_000  # rows of test terms, windows or places that are broadcast at most; more are shuffled
TOTAL = "\x01"  # a term of the index that stands once, behind a text's last word; no word is this


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.filter(F.split(lower_az(F.coalesce(F.col(text_col), F.lit(""))), NON_WORD), lambda w: w != "")
    return items.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).filter("size(words) > 0")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Return (wid, words, items): the distinct windows of all items with the items that hold each."""
    words = item_words(items, id_col, text_col)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    each = words.select("item", F.explode(F.array_distinct(F.transform(starts, lambda k: F.slice("words", k, size)))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64(F.concat_ws(" ", "words")).alias("wid"), "words", "items")


def _hinted(df: DataFrame, rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST else df


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of a row's id and text; rows with both equal have the same hits."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text_col)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return the stored index: (term, row, pos, doc_id, key), a posting for every word of every text.

    row tells rows apart, also those that share an id or hold the same text; pos counts words from 0.  A posting of TOTAL has the text's number of
    words as pos, its doc_id, and row_key as key; these two are null elsewhere.  Null and empty texts have only that posting.
    """
    ws = F.array_append(F.split(F.coalesce(F.col(text_col), F.lit("")), NON_WORD), TOTAL)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), ws.alias("ws"))
    first = F.when(F.col("ws")[0] == "", 1).otherwise(0)  # a split leaves an empty word before a text's leading separators, and one behind the last
    last = F.when((F.size("ws") > 2) & (F.element_at("ws", -2) == ""), 1).otherwise(0)
    each = rows.select("row", "doc_id", "key", first.alias("first"), last.alias("last"), F.posexplode("ws").alias("at", "w")).filter("w <> ''")
    total = F.col("w") == TOTAL
    term = F.when(F.lower("w") == F.col("w"), F.col("w")).otherwise(lower_az("w"))
    pos = F.col("at") - F.col("first") - F.when(total, F.col("last")).otherwise(0)
    postings = each.select(term.alias("term"), "row", pos.cast("int").alias("pos"), F.when(total, F.col("doc_id")).alias("doc_id"), F.when(total, F.col("key")).alias("key"))
    return stash(postings, "decontam-index")


def _lists(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (term, row, pos) of terms."""
    return index.select("term", "row", "pos").join(_hinted(terms.select("term").distinct()), "term", "left_semi")


def probes(wins: DataFrame, index: DataFrame) -> DataFrame:
    """Return (wid, probes): per window (n, offset, term) of all its words, n being the length of the term's list; the rarest first; equal ones by offset."""
    each = wins.select("wid", F.posexplode("words").alias("offset", "term"))
    terms = stash(each.select("term").distinct(), "decontam-terms")
    counts = index.select("term").join(_hinted(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = each.join(_hinted(stash(counts, "decontam-counts")), "term", "left").groupBy("wid")
    return ranked.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("probes"))


def phrase_matches(index: DataFrame, probed: DataFrame, steps: int = PROBES) -> DataFrame:
    """Return (row, wid, start, size) of every place where a window's words stand in order.

    index: (term, row, pos); probed: (wid, probes).  A window with a word that stands nowhere has no place.
    """
    wins = stash(probed.filter(F.col("probes")[0]["n"] > 0).select("wid", F.size("probes").alias("size"), "probes"), "decontam-sought")
    first = wins.select("wid", F.col("probes")[0]["term"].alias("term"), F.col("probes")[0]["offset"].alias("offset"))
    found = _lists(index, first).join(_hinted(first), "term").filter("pos >= offset").select("row", "wid", (F.col("pos") - F.col("offset")).alias("start"))
    for k in range(1, steps):
        found = stash(found, "decontam-places")
        probe = wins.filter(F.col("size") > k).select("wid", F.col("probes")[k]["term"].alias("term"), F.col("probes")[k]["offset"].alias("offset"))
        short = wins.filter(F.col("size") <= k).select("wid")
        want = found.join(_hinted(probe), "wid").select("row", "wid", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
        met = _lists(index, probe).join(_hinted(want, found.count()), ["row", "term", "pos"]).select("row", "wid", "start")
        found = met.unionByName(found.join(_hinted(short), "wid", "left_semi"))
    found = stash(found, "decontam-places")
    rest = wins.select("wid", "size", F.explode(F.slice("probes", steps + 1, 1 << 30)).alias("p")).select("wid", "size", "p.offset", "p.term")
    want = found.join(_hinted(rest), "wid").select("row", "wid", "start", "size", "term", (F.col("start") + F.col("offset")).alias("pos"))
    want = stash(want, "decontam-wanted")
    met = _lists(index, rest).join(_hinted(want), ["row", "term", "pos"]).groupBy("row", "wid", "start", "size").agg(F.count("*").alias("met")).filter(F.col("met") == F.col("size") - steps)
    short = found.join(_hinted(wins.filter(F.col("size") <= steps).select("wid", "size")), "wid")
    return met.select("row", "wid", "start", "size").unionByName(short.select("row", "wid", "start", "size"))


def proximity_matches(index: DataFrame, probed: DataFrame, slop: int) -> DataFrame:
    """Return (row, wid) where a window's rarest terms all stand, each at most slop words from its place beside the rarest.

    Positions are joined by blocks of slop + 1 words, so a term's list is never paired whole with another's.
    """
    block = slop + 1
    wins = stash(probed.filter(F.col("probes")[0]["n"] > 0).select("wid", F.slice("probes", 1, PROBES).alias("probes")), "decontam-near-sought")
    first = wins.select("wid", "probes", F.col("probes")[0]["term"].alias("term"))
    near = _lists(index, first).join(_hinted(first), "term").select("row", "wid", "probes", (F.col("pos") - F.col("probes")[0]["offset"]).alias("start"))
    for k in range(1, PROBES):
        near = stash(near, "decontam-near")
        short = F.size("probes") <= k
        want = near.filter(~short).withColumns({"term": F.col("probes")[k]["term"], "want": F.col("start") + F.col("probes")[k]["offset"]})
        want = want.withColumn("block", F.explode(F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda x: F.floor(F.col("want") / block) + x)))
        there = _lists(index, wins.filter(~short).select(F.col("probes")[k]["term"].alias("term"))).withColumn("block", F.floor(F.col("pos") / block))
        met = want.join(there, ["row", "term", "block"]).filter(F.abs(F.col("pos") - F.col("want")) <= slop)
        near = met.select("row", "wid", "probes", "start").distinct().unionByName(near.filter(short))
    return near.select("row", "wid").distinct()


def search(index: DataFrame, items: DataFrame, slop: int | None = 2, size: int = WINDOW, item_id: str = "item_id", item_text: str = "text", by_row: bool = False) -> DataFrame:
    """Return (doc_id, n_words, n_hit, items, near_items) for every document of an index; see decontaminate."""
    wins = stash(windows(items, item_id, item_text, size), "decontam-windows")
    probed = stash(probes(wins, index), "decontam-probes")
    texts = stash(index.filter(F.col("term") == TOTAL).select("row", "key", "doc_id", F.col("pos").cast("long").alias("n_words")), "decontam-texts")
    keys = ["doc_id", "key"] if by_row else ["doc_id"]
    owners = texts.select("row", *keys)
    hits = stash(phrase_matches(index, probed).join(owners, "row"), "decontam-hits")

    runs = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("runs"))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("runs", empty, lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(r["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], r["stop"]).alias("upto")))
    n_hit = runs.select(*keys, covered["n"].cast("long").alias("n_hit"))

    def item_sets(found: DataFrame, name: str) -> DataFrame:
        each = found.select(*keys, "wid").distinct().join(_hinted(wins.select("wid", "items")), "wid").select(*keys, F.explode("items").alias("item"))
        return each.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias(name))

    parts = [n_hit, item_sets(hits, "items")]
    none = F.array().cast("array<string>")
    if slop is not None:
        parts.append(item_sets(proximity_matches(index, probed, slop).join(owners, "row"), "near_items"))
    n_words = texts.groupBy(*keys).agg(F.max("n_words").alias("n_words"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    out = reduce(lambda a, b: a.join(b.withColumnsRenamed({k: f"__{k}" for k in keys}), same, "left").drop(*[f"__{k}" for k in keys]), parts, n_words)
    near = F.coalesce("near_items", none) if slop is not None else none
    return out.select("doc_id", *([F.col("key").alias("row")] if by_row else []), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), near.alias("near_items"))


def decontaminate(docs: DataFrame, items: DataFrame, slop: int | None = 2, size: int = WINDOW, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", by_row: bool = False) -> DataFrame:
    """Return (doc_id, n_words, n_hit, items, near_items) for every document.

    n_hit: words inside any occurrence of any window; items: the sorted item ids (as strings) with occurring windows;
    near_items: those with a proximity match (null slop: none).  Null and empty texts have no words;
    items without words have no windows.  Rows that share a doc_id, null included, are one document: hits are pooled and n_words is the
    largest; by_row keeps their texts apart and returns row (row_key of each) behind doc_id.  Empty tables give no rows, or rows without hits; other
    columns are ignored.
    """
    with scratch(docs.sparkSession):
        return stash(search(build_index(docs, doc_id, text_col), items, slop, size, item_id, item_text, by_row), "decontam-found", kept=True)


def op6_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate(docs, items, slop=None)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with proximity matches: the items met, comma-joined."""
    return decontaminate(docs, items).filter("size(near_items) > 0").select("doc_id", F.array_join("near_items", ",").alias("items"))


#: For op6_query: every n-gram of every document against every window.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM b WHERE len(ws) > 0)),
g AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS (SELECT doc_id, item, g.n, k FROM g JOIN w ON g.g = w.g AND g.n = w.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
