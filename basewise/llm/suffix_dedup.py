"""Exact substring dedup by merging sparse Burrows-Wheeler transforms.

Every window of LENGTH bytes has one anchor: the leftmost of its least hashed GRAM-byte strings.  Equal windows have equal anchors at
equal distance, so only the suffixes at anchors need an order.  For each anchor its context is kept: all windows that it
stands for.

1. Every shard (a task's documents) takes its anchors; Spark counts the anchors' hashes, and what stands once goes.
2. Equal contexts are one class.  All but a class's first member are repeats as a whole.
3. Where an anchor has several classes, the suffixes of all shards at it are merged: their interleave, in no order at first, is refined one symbol
   at a time from the right, each round a stable distribution of the interleave by the symbol that precedes
   (the transform's column); the common prefix of neighbours follows from the round before by range minima.  No suffixes are
   compared or sorted.  Neighbours that share LENGTH bytes form the repeated intervals, in which all but the first are repeats.

Anchors with more than MERGED classes, as at the edges of a passage that a third of all documents hold, are not merged in one
task: there each window's digest is grouped by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stash, utf8

LENGTH = 100
GRAM = 36
PIECE = 1 << 20  # bytes looked at together, at most
MERGED = 4_096  # classes of an anchor that are merged in one task, at most
TASK = 60_000  # contexts merged in one task, about
HELD = 2_000_000  # undecided anchors that are broadcast at most; more meet their documents by a shuffled join
MOST_BITS = 1 << 30  # of the filter of repeated anchors; a fuller filter only lets more single anchors by
KEEP = 1 << 20  # anchors that a task holds before it gives them on
NO_ID = 0x7FFFFFFFFFFFFFFF  # stands for a null id, which comes last

_MUL = 0x9E3779B97F4A7C15
PLACE = "doc long, part long, start int"


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    y = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    y[: len(x)] = x
    y = y.reshape(-1, width)
    ahead, back = np.minimum.accumulate(y, 1).ravel(), np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Finds the anchors of texts."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up, self.down = _powers(_MUL, 2 * PIECE + length), _powers(pow(_MUL, -1, 1 << 64), 2 * PIECE + length)

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts put together up to PIECE bytes or a little more, with each part's text, its offset there, and its end."""
        parts, size = [], 0
        for k, text in enumerate(texts):
            for at in range(0, len(text) - self.length + 1, PIECE):
                part = text[at : at + PIECE + self.length - 1]
                if size + len(part) > PIECE + self.length and parts:
                    yield self._joined(parts)
                    parts, size = [], 0
                parts.append((k, at, part))
                size += len(part)
        if parts:
            yield self._joined(parts)

    def _joined(self, parts: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        return b"".join(p for _, _, p in parts), np.array([k for k, _, _ in parts]), np.array([a for _, a, _ in parts]), np.cumsum([len(p) for _, _, p in parts])

    def __call__(self, whole: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per anchor: its hash, the part it stands in, the first window's start, the number of windows, the anchor's distance from that start."""
        t = np.frombuffer(whole, np.uint8)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * self.down[: len(t)])])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.up[: len(t) - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 22) - 1)
        least = (_sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), self.length - self.gram + 1) & low).astype(np.int64)
        part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(least)]
        fine = np.flatnonzero(np.arange(len(least)) + self.length <= ends[part])
        at = least[fine]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[fine][1:] != part[fine][:-1])])) if len(at) else at
        return h[at[new]], part[fine[new]], fine[new], np.diff(np.append(new, len(at))), at[new] - fine[new]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _later(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal keys: the index of one with the least place, and of all whose place is greater."""
    order = np.lexsort([*place[::-1], *keys[::-1]])
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]) if len(order) else np.zeros(0, bool)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return order[new], order[np.any([p[order] != p[head] for p in place], axis=0)] if len(order) else order


def _runs(doc: np.ndarray, part: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """The intervals put together where they meet."""
    order = np.lexsort([start, part, doc])
    doc, part, start, stop = doc[order], part[order], start[order], stop[order]
    if not len(doc):
        return [doc, part, start, stop]
    own = np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])
    far = np.maximum.accumulate(stop + (np.cumsum(own) << 33)) - (np.cumsum(own) << 33)
    new = own | np.concatenate([[True], start[1:] > far[:-1]])
    first = np.flatnonzero(new)
    return [doc[first], part[first], start[first], np.maximum.reduceat(stop, first)]


def merge_intervals(rows: list[bytes], anchor: np.ndarray, place: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """Merge the suffixes of rows aligned at their anchors; for each distance before the anchor, the rows whose window there stands earlier too.

    rows: contexts; anchor: the anchor's offset in each; place: the order of rows, equal for equal places.
    """
    n, most = len(rows), int(anchor.max())
    width = most + length
    columns = np.zeros((width, n), np.uint16)  # 0: outside of a context, equal to nothing
    for k, row in enumerate(rows):
        at = most - int(anchor[k])
        columns[at : at + len(row), k] = np.frombuffer(row, np.uint8)[: width - at].astype(np.uint16) + 1
    interleave, common = np.arange(n), np.zeros(n, np.int64)
    for p in range(width - 1, -1, -1):
        before = columns[p][interleave]
        step = np.argsort(before, kind="stable")
        symbol = before[step]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
        shared = np.zeros(n, np.int64)
        if len(same):
            ranges = np.empty(2 * len(same), np.int64)
            ranges[::2], ranges[1::2] = step[same - 1] + 1, step[same] + 1
            shared[same] = np.minimum.reduceat(np.append(common, width), ranges)[::2] + 1
        interleave, common = interleave[step], shared
        if p <= most:
            opens = common < length
            first = np.minimum.reduceat(place[interleave], np.flatnonzero(opens))[np.cumsum(opens) - 1]
            yield interleave[place[interleave] > first], most - p


def _table(arrays: list[np.ndarray], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names)


SPAN = ["doc", "part", "start", "stop"]
SPAN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _nulled(spans: list[np.ndarray], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """Spans with nulls in the columns behind them."""
    return pa.RecordBatch.from_arrays([*(pa.array(a, t) for a, t in zip(spans, SPAN_TYPES, strict=True)), *(pa.nulls(len(spans[0]), t) for t in types[4:])], names)


def _repeated(docs: DataFrame, length: int, gram: int) -> tuple[np.ndarray, int]:
    """A filter that every anchor's hash passes that stands more than once: its words of 64 bits and the shift of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, size = Anchors(length, gram), [], 0
        for batch in batches:
            for whole, _, _, ends in find.pieces(batch.column(2).to_pylist()):
                held.append(find(whole, ends)[0])
                size += len(held[-1])
                if size > KEEP:
                    yield _table([_signed(x) if k == 0 else x for k, x in enumerate(np.unique(np.concatenate(held), return_counts=True))], ["h", "n"], [pa.int64(), pa.int64()])
                    held, size = [], 0
        if held:
            yield _table([_signed(x) if k == 0 else x for k, x in enumerate(np.unique(np.concatenate(held), return_counts=True))], ["h", "n"], [pa.int64(), pa.int64()])

    counts = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    counts = stash(counts, "suffix-repeated")
    shift = 64 - min(MOST_BITS.bit_length() - 1, max(16, (16 * counts.count()).bit_length()))
    bit = F.shiftrightunsigned("h", shift)
    words = counts.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {shift}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << max(0, 58 - shift), np.uint64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table, shift


def _contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Return (doc, part, start, stop, h, class, n, anchor): contexts that may recur, one of each class from every task; and, with null h, what these repeat."""
    table, shift = _repeated(docs, length, gram)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names, types = [*SPAN, "h", "class", "n", "anchor"], [*SPAN_TYPES, pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def given(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc, part, start, h, kind, n, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        first, later = _later([h, kind], [doc, part, start])
        yield _table([x[first] for x in (doc, part, start, start + n + length - 1, h, kind, n, anchor)], names, types)
        spans = _runs(doc[later], part[later], start[later], start[later] + n[later] + length - 1)
        yield _nulled(spans, names, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, size = Anchors(length, gram), [], 0
        for batch in batches:
            docs_, parts_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for whole, own, offset, ends in find.pieces(batch.column(2).to_pylist()):
                h, at, start, n, anchor = find(whole, ends)
                bit = h >> np.uint64(shift)
                fine = np.flatnonzero((shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                h, at, start, n, anchor = h[fine], at[fine], start[fine], n[fine], anchor[fine]
                kind = np.fromiter((xxhash.xxh3_64_intdigest(whole[a : a + k + length - 1], d) for a, k, d in zip(start.tolist(), n.tolist(), anchor.tolist(), strict=True)), np.uint64, len(h))
                begin = start - (ends - np.diff(ends, prepend=0))[at] + offset[at]
                held.append([docs_[own[at]], parts_[own[at]], begin, _signed(h), _signed(kind), n, anchor])
                size += len(h)
                if size > KEEP:
                    yield from given(held)
                    held, size = [], 0
        if held:
            yield from given(held)

    return docs.mapInArrow(run, f"{PLACE}, stop int, h long, class long, n int, anchor int")


def _order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with nth, 1 for one of the rows with the least place among those with its keys, and later, whether its place is greater; a key has few rows, one from each task at most."""
    place, by = F.struct("doc", "part", "start"), Window.partitionBy(*keys).orderBy("doc", "part", "start")
    return rows.withColumns({"nth": F.row_number().over(by), "later": place > F.first(place).over(by)})


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, merged: int = MERGED, held: int = HELD) -> DataFrame:
    """Return (doc, part, start, stop): spans of bytes covered by strings of length bytes that start earlier too; they may overlap.

    docs: (doc, part, text), text as bytes; texts are ordered by (doc, part), and rows that share both are one.
    """
    contexts = stash(_contexts(docs, length, gram), "suffix-contexts")
    spans = [contexts.filter("h is null").select(*SPAN)]
    classes = contexts.filter("h is not null")
    ranked = _order(classes, ["h", "class"]).filter("later or nth = 1")
    ranked = stash(ranked.select("doc", "part", "start", "n", F.when(~F.col("later"), F.col("h")).alias("h"), F.when(~F.col("later"), F.col("anchor")).alias("anchor")), "suffix-classes")
    spans.append(ranked.filter("h is null").select("doc", "part", "start", (F.col("start") + F.col("n") + length - 1).alias("stop")))

    firsts = ranked.filter("h is not null")
    several = firsts.groupBy("h").agg(F.count("*").alias("classes")).filter("classes > 1")
    open_ = stash(firsts.join(several, "h").select("h", "doc", "part", "start", "n", "anchor", (F.col("classes") > merged).alias("hot")), "suffix-open")
    total = open_.count()
    by_doc = open_.groupBy("doc", "part").agg(F.collect_list(F.struct("h", "start", "n", "anchor", "hot")).alias("open"))
    by_doc = F.broadcast(by_doc) if total <= held else by_doc

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, part, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(doc, part, x["start"], x["h"], x["anchor"], x["hot"], text[x["start"] : x["start"] + x["n"] + length - 1]) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()], strict=True)], ["doc", "part", "start", "h", "anchor", "hot", "bytes"])

    cuts = docs.join(by_doc, ["doc", "part"]).select("doc", "part", "text", "open").mapInArrow(cut, f"{PLACE}, h long, anchor int, hot boolean, bytes binary")
    cuts = stash(cuts, "suffix-cuts")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if every is None:
            return
        doc, part, start, anchor = (every.column(c).to_numpy().astype(np.int64) for c in ("doc", "part", "start", "anchor"))
        keys = [doc, part, start + anchor]
        order = np.lexsort(keys[::-1])
        place = np.empty(len(doc), np.int64)
        place[order] = np.cumsum(np.concatenate([[False], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]))
        found = [(rows, start[rows] + anchor[rows] - back) for rows, back in merge_intervals(every.column("bytes").to_pylist(), anchor, place, length)]
        rows, at = np.concatenate([r for r, _ in found]), np.concatenate([a for _, a in found])
        yield _table(_runs(doc[rows], part[rows], at, at + length), SPAN, SPAN_TYPES)

    tasks = max(1, -(-total // TASK))
    spans.append(cuts.filter("not hot").repartition(tasks, "h").select("doc", "part", "start", "anchor", "bytes").mapInArrow(merge, f"{PLACE}, stop int"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, part, start = [], [], [], []
            for d, p, s, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(len(text) - length + 1):
                    key.append(xxhash.xxh3_128_digest(text[k : k + length]))
                    doc.append(d)
                    part.append(p)
                    start.append(s + k)
            if not key:
                continue
            halves = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
            place = [np.array(x, np.int64) for x in (doc, part, start)]
            first, later = _later([halves[:, 0].copy(), halves[:, 1].copy()], place)
            names, types = [*SPAN, "k1", "k2"], [*SPAN_TYPES, pa.int64(), pa.int64()]
            yield _table([*(x[first] for x in place), place[2][first] + length, halves[first, 0], halves[first, 1]], names, types)
            yield _nulled(_runs(*(x[later] for x in place), place[2][later] + length), names, types)

    hot = stash(cuts.filter("hot").select("doc", "part", "start", "bytes").mapInArrow(windows, f"{PLACE}, stop int, k1 long, k2 long"), "suffix-windows")
    spans.append(hot.filter("k1 is null").select(*SPAN))
    keyed = hot.filter("k1 is not null")
    spans.append(_order(keyed, ["k1", "k2"]).filter("later").select(*SPAN))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with doc, part and text: the id, a null one last, and, where ids repeat, a hash of the text to tell texts of one id apart."""
    rows = docs.withColumns({"doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "bytes": utf8(text_col)})
    repeated = not rows.groupBy("doc").count().filter("count > 1").isEmpty()
    return rows.select("doc", (F.xxhash64("bytes") if repeated else F.lit(0).cast("long")).alias("part"), F.col("bytes").alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, digest: bool = False, merged: int = MERGED, held: int = HELD) -> DataFrame:
    """Return (id, n_bytes, spans, kept) for every row, or with digest (id, n_bytes, n_removed, n_spans, kept_sha256).

    spans: maximal runs (start, stop) of removed bytes, in order; kept: the other bytes.  A null text is empty.  Null ids come after all others.
    Rows that share an id but not a text are documents of their own, in the order of a hash of the text; rows
    that repeat id and text are one document and get the same result each.  Other columns are ignored; an empty table gives no rows.
    """
    rows = numbered(docs, id_col, text_col)
    with scratch(docs.sparkSession):
        spans = stash(repeated_spans(rows, length, gram, merged, held), "suffix-spans", kept=True)
    by_doc = spans.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "n_bytes long, spans array<struct<start: int, stop: int>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((x["start"], x["stop"]) for x in found or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                cuts = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if runs else text
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) if digest else (len(text), [{"start": a, "stop": b} for a, b in runs], kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["n_bytes", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(types))], ["doc", *names])

    judged = rows.join(by_doc, ["doc", "part"], "left").select("doc", "text", "spans").mapInArrow(run, f"doc long, {kind}")
    return judged.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "id")


def op9_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).withColumnRenamed("id", "doc_id")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, i, b[i:i + {LENGTH - 1}] AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d)),
f AS (SELECT k, min(struct_pack(r := r, i := i)) AS least FROM s GROUP BY k HAVING count(*) > 1),
e AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s JOIN f USING (k) WHERE struct_pack(r := r, i := i) > least),
u AS (SELECT r, i, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
x AS (SELECT r, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM u GROUP BY r, run),
y AS (SELECT r, count(*) AS n, sum(z - a + 1) AS size, list(a ORDER BY a) || [CAST(9223372036854775807 AS BIGINT)] AS a, [CAST(0 AS BIGINT)] || list(z ORDER BY a) AS z FROM x GROUP BY r),
k AS (SELECT r, string_agg(hex(b[z[j] + 1:least(a[j] - 1, octet_length(b))]), '' ORDER BY j) AS kept FROM (SELECT r, b, a, z, unnest(range(1, len(a) + 1)) AS j FROM d JOIN y USING (r)) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(size, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN y USING (r) LEFT JOIN k USING (r)
"""
