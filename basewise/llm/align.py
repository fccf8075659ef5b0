"""Alignment of two tokenizers over the same bytes.

Texts are cut into units before spaces between white space and other characters, where both tokenizers always end a token; so a unit is encoded once for a few MB of text, however often it stands there.
The ends of both tokenizers' tokens are bits over the bytes of all units: AND gives the shared cuts, and ranks by popcount turn a byte into a token's number, from which groups
and overlapping pairs expand.  How many documents hold a pair is asked of buckets by the first tokenizer's id, once for each chunk of documents.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BLOB, CHUNK, LEAST, blobs, pack, steps, unpack
from .common import in_batches, scratch, stash, tidy, utf8

UNIT = re.compile(r"(?<=\S)(?= \s*\S)")
#: The characters that \s stands for.
WHITE = [*map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680)), *map(chr, range(0x2000, 0x200B)), *map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
#: Blobs of a bucket that are added in one group; units that are encoded at a time.
FAN = 256
BATCH = 1 << 15
#: The most a token id may be, plus one, so that a pair is one number.
IDS = 1 << 24
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: What a chunk gives: a row for each document, with its links, or for each bucket, with its pairs.
MADE = "chunk long, bucket int, n int, data binary, id long, n_a long, n_b long, n_groups long, n_links long, groups string"
MADE_TYPES = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups", pa.string())])
RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
RESULT_TYPES = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "n_best", "count_sum")), ("groups", pa.string())])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the other bytes for letters from U+0100 on, in order."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in same} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in same)}


def split(text: str) -> list[str]:
    """The units of a text without their first space, which every unit begins with."""
    if text[0] == " " or text[-1] in WHITE or any(c + " " in text for c in WHITE):
        return [u[1:] for u in UNIT.split(" " + text)]
    return text.split(" ")


class Tokenizers:
    """Both tokenizers, loaded once in a task, and the bytes of their tokens.

    The first is read from its file's vocabulary into the rank encoder of tiktoken, which takes a third of the time; ValueError if ids do not follow the order of merges, since ranks would then mean something else.
    """

    def __init__(self, paths: tuple[str, str]) -> None:
        self.paths = paths

    def load(self) -> Tokenizers:
        if not hasattr(self, "a"):
            import public_tokenizers
            from sentencepiece import SentencePieceProcessor
            from tiktoken import Encoding

            with open(self.paths[0], encoding="utf-8") as f:
                spec = json.load(f)
            letters, model = byte_of_letter(), spec["model"]
            vocab, added = model["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
            merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            kind = spec["pre_tokenizer"]
            if merged != sorted(merged) or spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
                raise ValueError("a byte-level tokenizer whose ids follow its merges is needed")
            ranks = {bytes(letters[x] for x in piece): k for piece, k in vocab.items() if piece not in added}
            self.a = Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.b = SentencePieceProcessor(model_file=self.paths[1])
            self.bytes_a = [b""] * (max(*vocab.values(), *added.values()) + 1)
            for piece, k in ranks.items():
                self.bytes_a[k] = piece
            self.bytes_b = [bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in range(self.b.get_piece_size())]
            self.sizes = [np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b)]
            self.names = [[str(k) for k in range(len(own))] for own in (self.bytes_a, self.bytes_b)]
        return self

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of units, which are given without the space that they begin with; the second tokenizer puts that there itself."""
        return [self.a.encode_ordinary(" " + u) for u in units], self.b.encode(units, num_threads=1)


class Ends:
    """Bits at the bytes that end a token, with ranks."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @classmethod
    def of(cls, ends: np.ndarray, size: int) -> Ends:
        bits = np.zeros(size, np.uint8)
        bits[ends - 1] = 1
        return cls(np.packbits(bits, bitorder="little"))

    def __and__(self, other: Ends) -> Ends:
        return Ends(self.packed & other.packed)

    def select(self) -> np.ndarray:
        """The byte offsets of all ends, in order."""
        return np.flatnonzero(np.unpackbits(self.packed, bitorder="little")) + 1

    def rank(self, offset: np.ndarray) -> np.ndarray:
        """How many tokens end at or before each byte offset."""
        byte, bit = offset >> 3, (offset & 7).astype(np.uint8)
        there = np.concatenate([self.packed, np.zeros(1, np.uint8)])[byte]
        return self.before[byte] + np.bitwise_count(there & ((np.uint8(1) << bit) - np.uint8(1)))


def expand(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): for each row the values begin, begin + 1, ... , `count` of them."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


class Units:
    """Different units, with what the two tokenizers make of each: validity, counts, links and the text of groups."""

    def __init__(self, units: list[str], tools: Tokenizers) -> None:
        parts = [self._made(units[k : k + BATCH], tools) for k in range(0, len(units), BATCH)] or [self._made([], tools)]
        self.good, *self.counts, pairs = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:-1])
        self.texts = [t for p in parts for t in p[-1]]
        self.at = np.concatenate([[0], np.cumsum(self.counts[3])])
        self.names, self.pair = np.unique(pairs, return_inverse=True)

    @staticmethod
    def _made(units: list[str], tools: Tokenizers) -> tuple:
        """(good, tokens of A, tokens of B, groups, links, pairs, texts) of a batch."""
        ids = tools.encode(units)
        good = np.ones(len(units), bool)
        whole = "".join([" " + u for u in units]).encode()
        for own, known in zip(ids, (tools.bytes_a, tools.bytes_b), strict=True):
            if b"".join(map(known.__getitem__, chain.from_iterable(own))) != whole:
                good &= [b"".join(map(known.__getitem__, x)) == (" " + u).encode() for x, u in zip(own, units, strict=True)]
        if not good.all():
            ids = tuple([x if ok else [] for x, ok in zip(own, good.tolist(), strict=True)] for own in ids)
        n_a, n_b = (np.fromiter(map(len, own), np.int64, len(own)) for own in ids)
        flat = [np.fromiter(chain.from_iterable(own), np.int64, int(n.sum())) for own, n in zip(ids, (n_a, n_b), strict=True)]
        stops = [np.cumsum(s[f]) for s, f in zip(tools.sizes, flat, strict=True)]
        ends = [Ends.of(e, int(stops[0][-1]) if len(stops[0]) else 0) for e in stops]
        # shared cuts, and how many tokens of each side lie before them
        cuts = (ends[0] & ends[1]).select()
        upto = [e.rank(cuts) for e in ends]
        # a token of the first meets tokens of the second from the one that its first byte is in to the one that its last byte is in
        begins = stops[0] - tools.sizes[0][flat[0]]
        first, last = ends[1].rank(begins), ends[1].rank(stops[0] - 1)
        one, two = expand(first, last - first + 1)
        unit = np.repeat(np.arange(len(units)), n_a)
        of_cut = unit[upto[0] - 1]
        names = [list(map(n.__getitem__, f.tolist())) for n, f in zip(tools.names, flat, strict=True)]
        a = b = 0
        groups: list[list[str]] = [[] for _ in units]
        for k, x, y in zip(of_cut.tolist(), upto[0].tolist(), upto[1].tolist(), strict=True):
            groups[k].append(f"{','.join(names[0][a:x])}|{','.join(names[1][b:y])}")
            a, b = x, y
        n = len(units)
        return good, n_a, n_b, np.bincount(of_cut, minlength=n), np.bincount(unit[one], minlength=n), flat[0][one] * IDS + flat[1][two], [";".join(g) for g in groups]


class Numbers(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def chunk_rows(ids: list, texts: list[bytes], chunk: int, buckets: int, tools: Tokenizers, digest: bool) -> Iterator[pa.RecordBatch]:
    """The rows of MADE for the documents of a chunk."""
    numbers, own = Numbers(), []
    for raw in texts:
        try:
            parts = split(raw.decode()) if raw else []
        except UnicodeDecodeError:
            parts = []
        own.append(np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts)))
    units = Units(list(numbers), tools.load())
    own = [x if units.good[x].all() else x[:0] for x in own]
    doc, unit = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.zeros(0, np.int64), *own])
    sums = [np.bincount(doc, c[unit], len(own)).astype(np.int64) for c in units.counts]
    row, link = expand(units.at[unit], units.counts[3][unit])
    # each document's different pairs, and how often it has each; pairs that only units of rejected texts hold have no number
    width = max(1, len(units.names))
    each, times = np.unique(doc[row] * width + units.pair[link], return_counts=True)
    doc, pair = np.divmod(each, width)
    n = np.bincount(pair, minlength=len(units.names))
    number = np.cumsum(n > 0) - 1
    pairs, n, begins = units.names[n > 0], n[n > 0], np.searchsorted(doc, np.arange(len(own) + 1))
    pair, times = number[pair].astype(np.int32), times.astype(np.int32)
    where = pairs // IDS % buckets
    by = np.argsort(where, kind="stable")
    asked = blobs(0, where[by], pairs[by], n[by])
    for k, batch in enumerate(asked.to_batches()):
        size = len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * size, pa.int64()), *(batch.column(c) for c in range(1, 4)), *(pa.nulls(size, t) for t in MADE_TYPES.types[4:])], schema=MADE_TYPES)
    for low in range(0, len(own), 256):
        part = range(low, min(low + 256, len(own)))
        said = [";".join(map(units.texts.__getitem__, own[k].tolist())) for k in part]
        said = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said] if digest else said
        data = [pack(steps(pair[begins[k] : begins[k + 1]]), times[begins[k] : begins[k + 1]]) for k in part]
        sizes = [int(begins[k + 1] - begins[k]) for k in part]
        columns = [[chunk] * len(part), [None] * len(part), sizes, data, [ids[k] for k in part], *(s[low : part.stop] for s in sums), said]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, MADE_TYPES.types, strict=True)], schema=MADE_TYPES)


def align(docs: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """Return (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row.

    paths: files of a byte-level BPE tokenizer (A, given a space and the text) and of a piece tokenizer with byte fallback (B, given the text).  groups: the ids
    between shared cuts, `a1,a2|b1;a3|b2`, or with digest its SHA-256.  A link is a pair of occurrences whose byte ranges overlap; its count is the number of rows of docs that hold its pair of ids linked;
    n_best are links with the highest count among their A id's pairs, ties included.  A null or empty text, and one whose tokens do not give the bytes of space and text
    back, has no tokens: zeros and an empty groups.  Rows that repeat id and text count as often as they stand there.  Ids may be null, other columns are ignored whatever
    their names, and an empty table gives no rows.
    """
    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets, tools = min(max(LEAST, math.ceil(size / chunk)), 1 << 15), Tokenizers(paths)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= chunk:
                    yield from chunk_rows(ids, texts, number, buckets, tools, digest)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield from chunk_rows(ids, texts, number, buckets, tools, digest)

    def summed(table: pa.Table) -> pa.Table:
        """The blobs of a bucket added up, as one."""
        parts = [unpack(d, n, np.int64, np.int64) for n, d in zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True)]
        names, to = np.unique(np.concatenate([np.cumsum(p) for p, _ in parts]), return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, to, np.concatenate([n for _, n in parts]))
        return blobs(table["chunk"][0].as_py(), np.full(len(names), table["bucket"][0].as_py()), names, total)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each blob its pairs, their counts in the corpus, and whether these are the highest of their A ids."""
        for batch in batches:
            out = []
            for n, data, m, known in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                pairs = np.cumsum(unpack(data, n, np.int64, np.int64)[0])
                names, total = unpack(known, m, np.int64, np.int64)
                names = np.cumsum(names)
                starts = np.flatnonzero(np.diff(names // IDS, prepend=-1))
                most = np.repeat(np.maximum.reduceat(total, starts), np.diff(starts, append=len(names)))
                to = np.searchsorted(names, pairs)
                out.append(pack(steps(pairs), total[to], (total == most)[to]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["chunk", "n", "data"])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return RESULT_TYPES.empty_table()
        told = [unpack(d, n, np.int64, np.int64, np.bool_) for n, d in zip(answers["n"].to_pylist(), answers["data"].to_pylist(), strict=True)]
        by = np.argsort(np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p) for p, _, _ in told)]))
        known = [np.concatenate([np.zeros(0, np.int64), *x])[by] for x in ([b.astype(np.int64) for _, _, b in told], [n for _, n, _ in told])]
        sums = []
        for n, data in zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True):
            pair, times = unpack(data, n, np.int32, np.int32)
            pair = np.cumsum(pair)
            sums.append([int((x[pair] * times).sum()) for x in known])
        found = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)]
        return pa.Table.from_arrays([table["id"], *(table[c] for c in COUNTS), *found, table["groups"]], schema=RESULT_TYPES)

    with scratch(docs.sparkSession):
        made = stash(rows.mapInArrow(tidy(ask), MADE), "align-made")
        asked = made.filter("bucket is not null").select("chunk", "bucket", "n", "data")
        # a task has as many chunks as its share of texts; forests of sums go by the task first, then by neighbours
        totals, left = asked.withColumn("chunk", F.shiftright("chunk", 32).cast("int")), (made.agg(F.max(F.shiftright("chunk", 32))).first()[0] or 0) + 1
        while True:
            totals = totals.groupBy("chunk", "bucket").applyInArrow(summed, BLOB)
            if left == 1:
                break
            left = -(-left // FAN)
            totals = totals.withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("int"))
        totals = totals.select("bucket", F.col("n").alias("m"), F.col("data").alias("known"))
        answers = asked.join(totals, "bucket").select("chunk", "n", "data", "m", "known").mapInArrow(answer, "chunk long, n int, data binary")
        of_docs = made.filter("bucket is null").select("chunk", "n", "data", "id", *COUNTS, "groups")
        return stash(of_docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, RESULT), "align", kept=True)


def op13_query(docs: DataFrame) -> DataFrame:
    return align(docs, default_paths(), digest=True).withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})
