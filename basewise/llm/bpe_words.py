"""BPE encoding and decoding over distinct words.

Documents are split into the tokenizer's words by its own rules.  The most frequent words make a table of bounded size: each is encoded once, and
what its ids decode to comes by a join of every id with its piece; ids and pieces come back by broadcast.  Each rarer word is dealt by Spark to one
task, in sorted order, encoded there once, and its ids go back to the places in its documents by a join; their pieces are looked up in the same
id-to-piece table, broadcast, as it has as many rows as the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, scratch, stash, tidy

#: White space of the tokenizer's regular expressions, and its word pattern for Latin letters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f]+"
#: Chunks that need no more than that: ASCII, Latin letters that composing and lower-casing treat one by one, dashes and quotation marks.
LATIN = r"[\x21-\x7e\xc0-\u012f\u0131-\u017f\u2013\u2014\u2018-\u201e]+"
MARK = "\0"  # before an added token's own string
FREQUENT = 250_000  # words in the broadcast table at most
FREQUENT_BYTES = 24 << 20  # and bytes of them
LEAST = 2  # occurrences in some part of a task's texts that a frequent word has
FLUSH = 200_000  # chunks that a task counts at a time
GATHERED = 8 << 20  # bytes of texts whose distinct chunks are looked up together
KNOWN = 100_000  # chunks that a task remembers
LONG_WORD = 64  # characters; longer words go to PARTS tasks each, since counts do not bound those that the table has no room for
PARTS = 16
NO_ID = 0x7FFFFFFFFFFFFFFF  # stands for a null id

_spaces = re.compile(f"[{SPACE}]+")
_no_space = re.compile("[\x1c-\x1f]")  # str.split takes these for white space


def chunks(text: str) -> list[str]:
    """The parts of a text between white space, as the tokenizer knows it; no word reaches over it."""
    if _no_space.search(text):
        return [x for x in _spaces.split(text) if x]
    return text.split()


class Splitter:
    """Splits a chunk into words, in the byte letters of the tokenizer's vocabulary, by the tokenizer's own normalizer and pre-tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        if own.normalizer is None or own.pre_tokenizer is None or [w for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(" Ab  c\n"))] != ["ab", "c"]:
            raise ValueError("a tokenizer is needed that lower-cases and whose words hold no white space")
        self.normal, self.parts = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.latin, self.words = re.compile(LATIN).fullmatch, re.compile(LATIN_WORD).findall
        wide = [c for c in map(chr, (*range(0xC0, 0x180), *range(0x2013, 0x201F))) if self.latin(c)]
        self.spelled = str.maketrans({c: "".join(w for w, _ in self.parts(c)) for c in wide})
        added = sorted(_added(path), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.begins = {x[0] for x in added}
        self.apart = not any(map(str.isalpha, self.begins))  # letters alone are no added token

    def __call__(self, chunk: str) -> list[str]:
        if chunk.isascii() and self.apart:  # most chunks: letters, or letters and one more character
            if chunk.isalpha():
                return [chunk.lower()]
            if (head := chunk[:-1]).isalpha() and "!" <= (last := chunk[-1]) <= "~" and last not in self.begins:
                return [head.lower(), last]
        if self.added and not self.begins.isdisjoint(chunk) and (parts := self.added.split(chunk))[1:]:
            return [w for k, part in enumerate(parts) for w in ([MARK + part] if k % 2 else self._plain(part))]
        return self._plain(chunk)

    def _plain(self, chunk: str) -> list[str]:
        if self.latin(chunk):
            words = [low] if (low := chunk.lower()).isalpha() else self.words(low)
            return words if low.isascii() else [w.translate(self.spelled) for w in words]
        return [w for w, _ in self.parts(self.normal(chunk))]


def _added(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def pieces(path: str) -> list[str]:
    """The piece of every id."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, k in vocab.items():
        out[k] = piece
    return out


def word_counts(docs: DataFrame, path: str, text_col: str = "text", least: int = 1) -> DataFrame:
    """Return (word, n): how often each distinct word stands in all texts.

    least: words that stand less often in all of the parts of a task's texts that are counted together are left out, and
    more may be that stand there only in chunks that do not recur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(path), Counter()

        def flushed() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for part, n in seen.items():
                if n > 1 or least == 1:
                    for chunk in (part,) if part.isascii() else chunks(part):
                        for word in split(chunk):
                            words[word] += n
            seen.clear()
            kept = [(w, n) for w, n in words.items() if n >= least]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in _gathered(batches):
            distinct, at, _ = _dealt(pc.fill_null(batch.column(0), ""))
            for chunk, n in zip(distinct, np.bincount(at, minlength=len(distinct)).tolist(), strict=True):
                if chunk:
                    seen[chunk] += n
            if len(seen) > FLUSH:
                yield flushed()
        yield flushed()

    return in_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WordEncoder:
    """Encodes single words, given in byte letters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would hold memory
        from tokenizers import Tokenizer

        self.added = _added(path)
        self.model = Tokenizer(Tokenizer.from_file(path).model)  # words are normalized and split by now

    def __call__(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        own = [[self.added[w[1:]]] if w[:1] == MARK else None for w in words]
        return [a or e.ids for a, e in zip(own, self.model.encode_batch(words, add_special_tokens=False), strict=True)]


def _piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece_id, piece), as many rows as the vocabulary has."""
    return F.broadcast(spark.createDataFrame(list(enumerate(pieces(path))), "piece_id int, piece string"))


def encoded_words(words: DataFrame, path: str, kept: bool = False) -> DataFrame:
    """Return (word, n, ids, said) for distinct words (word, n): the ids, and what they decode to, by a join of each id with its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(encoder(batch.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "n", "ids"])

    coded = words.select("word", "n").mapInArrow(tidy(run), "word string, n long, ids array<int>")
    each = coded.select("word", "n", F.posexplode_outer("ids").alias("pos", "piece_id"))
    spoken = each.join(_piece_table(words.sparkSession, path), "piece_id", "left").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "piece_id", "piece"))).alias("p"))
    spoken = spoken.select("word", "n", F.filter("p.piece_id", lambda x: x.isNotNull()).alias("ids"), F.array_join("p.piece", " ").alias("said"))
    return stash(spoken, "bpe-table", kept)


def _frequent(words: DataFrame, most: int, room: int = FREQUENT_BYTES) -> DataFrame:
    """The most frequent words, at most `most` and of room bytes together; counts from 1,024 on and lengths are told apart by their power of two only.

    Of equal counts shorter words come first; words that have no room leave it to less frequent ones.
    """
    level = F.when(F.col("n") < 1_024, F.col("n")).otherwise(1_014 + F.floor(F.log2("n"))).cast("int")
    length = F.ceil(F.log2(F.octet_length("word") + F.lit(1))).cast("int")
    ranked = words.withColumns({"level": level, "length": length})
    by = ranked.groupBy("level", "length").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).collect()  # 1,077 levels of 32 lengths at most
    taken = []
    for lev, longest, n, size in sorted(by, key=lambda r: (-r.level, r.length)):
        if n > most:
            break
        if size <= room:
            most, room = most - n, room - size
            taken.append((lev, longest))
    return ranked.join(F.broadcast(words.sparkSession.createDataFrame(taken, "level int, length int")), ["level", "length"]).select("word", "n")


def _dealt(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct, at, ends): the distinct chunks of all texts, which of them each chunk is, in the texts' order, and where each text's chunks end.

    Chunks are cut at ASCII white space here, so one with other letters may hold several of the tokenizer's; empty ones stand where a text begins or ends with white space.
    """
    parts = pc.ascii_split_whitespace(texts)
    ends = np.asarray(parts.offsets)[1:] - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()  # one string, cut again: a value at a time takes longer
    return whole.split(" ") if len(coded) else [], np.asarray(coded.indices), ends


def _cut(values: pa.LargeBinaryArray, at: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The values at these places one after the other, cut where each text's places end."""
    whole = values.take(pa.array(at, pa.int64()))
    offsets, data = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1), whole.buffers()[2]
    stops = offsets[np.concatenate([[0], ends])].tolist()
    return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(stops, stops[1:], strict=False)]


class Places:
    """Turns texts into word codes of four bytes: a frequent word's number, or, for the k-th of a text's distinct rare words in sorted order, the table's length + k."""

    def __init__(self, code_of: dict[str, bytes], path: str):
        self.split, self.code_of = Splitter(path), code_of
        self.known = dict(code_of)  # the codes of chunks of frequent words

    def _words(self, chunk: str) -> list[str]:
        return self.split(chunk) if chunk.isascii() else [w for x in chunks(chunk) for w in self.split(x)]

    def _learn(self, distinct: list[str]) -> tuple[list[bytes | None], dict[int, list[str]]]:
        """The codes of distinct chunks, and the words of those with rare words, which have no codes; chunks of frequent words become known."""
        if len(self.known) > KNOWN + len(self.code_of):
            self.known = dict(self.code_of)
        found, rare, known, get, apart = list(map(self.known.get, distinct)), {}, self.known, self.code_of.get, self.split.apart
        for k in [k for k, x in enumerate(found) if x is None]:
            chunk = distinct[k]
            if apart and chunk.isascii() and chunk.isalpha():  # as the splitter has it, without two calls
                words = [chunk.lower()]
                code = get(words[0])
            else:
                words = self._words(chunk)
                codes = list(map(get, words))
                code = None if None in codes else b"".join(codes)
            if code is None:
                rare[k] = words
            else:
                known[chunk] = found[k] = code
        return found, rare

    def _open(self, rare: dict[int, list[str]], at: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks with rare words stand, and where each text's part of these ends; n: distinct chunks."""
        is_rare = np.zeros(n, bool)
        is_rare[list(rare)] = True
        places = np.flatnonzero(is_rare[at])
        return places, np.searchsorted(places, ends)

    def rare(self, texts: pa.Array) -> list[list[str]]:
        """The distinct rare words of each text, sorted."""
        distinct, at, ends = _dealt(texts)
        _, rare = self._learn(distinct)
        rare = {k: [w for w in words if w not in self.code_of] for k, words in rare.items()}
        places, stops = self._open(rare, at, ends, len(distinct))
        held, out, begin = at[places].tolist(), [], 0
        for stop in stops.tolist():
            out.append(sorted({w for k in held[begin:stop] for w in rare[k]}))
            begin = stop
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The codes of each text."""
        distinct, at, ends = _dealt(texts)
        codes, rare = self._learn(distinct)
        places, stops = self._open(rare, at, ends, len(distinct))
        held, begin, first = at[places].tolist(), 0, len(self.code_of)
        at = at.astype(np.int64)
        new = []
        for stop in stops.tolist():
            if own := held[begin:stop]:
                code = {w: (first + k).to_bytes(4, "little") for k, w in enumerate(sorted({w for k in set(own) for w in rare[k] if w not in self.code_of}))}
                for k in own:
                    new.append(len(codes))
                    codes.append(b"".join([code[w] if w in code else self.code_of[w] for w in rare[k]]))
            begin = stop
        at[places] = new
        return _cut(pa.array(codes, pa.large_binary()), at, ends)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that little of them is Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in groups of about GATHERED bytes, so that each distinct chunk of a group is looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= GATHERED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Packer:
    """Codes in few bytes: their four bytes apart, compressed."""

    def __init__(self):
        self.squeeze, self.expand = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

    def pack(self, codes: bytes) -> bytes:
        return self.squeeze(np.frombuffer(codes, np.uint8).reshape(-1, 4).T.tobytes()) if codes else b""

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(self.expand(packed), np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64) if packed else np.zeros(0, np.int64)


def _tables(words: DataFrame, path: str) -> tuple[Broadcast[dict[str, bytes]], Broadcast[tuple[pa.Array, pa.Array, list[str]]]]:
    """Broadcasts: the code of each of the words (word, n, ids, said); and for each code the ids and what they decode to, a space behind it, with the piece of every id."""
    context, common = words.sparkSession.sparkContext, words.orderBy(F.desc("n"), "word").toArrow()
    codes = context.broadcast({w: k.to_bytes(4, "little") for k, w in enumerate(common.column("word").to_pylist())})
    ids = pa.array([np.array(x, "<u4").tobytes() for x in common.column("ids").to_pylist()], pa.large_binary())
    said = pa.array([f"{x} ".encode() for x in common.column("said").to_pylist()], pa.large_binary())
    return codes, context.broadcast((ids, said, pieces(path)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, digest: bool = False, decoded: bool = False) -> DataFrame:
    """Return (id, ids) for every row, with decoded (id, ids, decoded), or with digest (id, n_tokens, ids_sha256, decoded_sha256).

    ids are those of the tokenizer in the file path, as array<int>.  Null and empty texts have none.
    A row is returned for each row, repeated ones and null ids too; other columns are ignored; an empty table gives no rows.  At most `frequent` words
    are broadcast; the rest come back by a join, whatever their number.  Words may be of any length.
    """
    spark = docs.sparkSession
    with scratch(spark):  # at its end the driver's copies of the tables are given back
        codes, table = _tables(encoded_words(_frequent(stash(word_counts(docs, path, text_col, LEAST), "bpe-counts"), frequent), path), path)
    rows = in_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = Places(codes.value, path), set()
        for batch in _gathered(batches):
            fresh = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                fresh.append(row not in seen)  # rows that repeat share their rare words
                seen.add(row)
            own = iter(place.rare(batch.column(2).filter(pa.array(fresh, pa.bool_()))))
            found = [next(own) if new else [] for new in fresh]
            if len(seen) > KNOWN:
                seen.clear()
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for x in found for k in range(len(x))], pa.int32()), pa.array([w for x in found for w in x], pa.string())], ["id", "hash", "k", "word"])

    def encode_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word, so each distinct word is encoded once and only the last is remembered."""
        encoder, last, ids = WordEncoder(path), None, b""
        for batch in _small(batches):
            words = batch.column(3).to_pylist()
            new = [w for w, before in zip(words, [last, *words], strict=False) if w != before]
            fresh = iter(encoder(new))
            out = []
            for w in words:
                if w != last:
                    last, ids = w, np.array(next(fresh), "<u4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["id", "hash", "k", "ids"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pack = Places(codes.value, path), Packer().pack
        for batch in _gathered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(map(pack, place(batch.column(2)))), pa.binary())], ["id", "hash", "codes"])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string" if decoded else "ids array<int>"
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"][: 1 + decoded]
    types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()][: 1 + decoded]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, said_of, piece_of = table.value
        n, unpack = len(ids_of), Packer().unpack
        for batch in _small(batches):
            pool, at = [], []
            for codes_, own, ids in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
                now = unpack(codes_)
                if own:
                    rare = np.empty(max(own) + 1, np.int64)
                    rare[own] = np.arange(n + len(pool), n + len(pool) + len(own))
                    pool += ids
                    now = np.where(now < n, now, rare[np.maximum(now, n) - n])
                at.append(now)
            ends, at = np.cumsum(list(map(len, at)), dtype=np.int64), np.concatenate([*at, np.zeros(0, np.int64)])
            whole = _cut(pa.concat_arrays([ids_of, pa.array(pool, pa.large_binary())]), at, ends)
            if not (digest or decoded):
                out = [(np.frombuffer(x, "<i4"),) for x in whole]
            else:
                spoken = [(" ".join(piece_of[i] for i in np.frombuffer(x, "<u4").tolist()) + " ").encode() for x in pool]
                texts = [x[:-1] for x in _cut(pa.concat_arrays([said_of, pa.array(spoken, pa.large_binary())]), at, ends)]
                out = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t).hexdigest()) if digest else (np.frombuffer(x, "<i4"), t.decode()) for x, t in zip(whole, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(types))], ["id", *fields])

    found = rows.mapInArrow(tidy(rare_words), "id long, hash long, k int, word string")
    found = found.repartition("word", F.when(F.length("word") > LONG_WORD, F.pmod(F.xxhash64("id", "hash"), F.lit(PARTS)))).sortWithinPartitions("word")
    found = found.mapInArrow(tidy(encode_rare), "id long, hash long, k int, ids binary").groupBy("id", "hash").agg(F.collect_set(F.struct("k", "ids")).alias("rare"))  # repeated rows of other tasks are met here
    joined = rows.mapInArrow(tidy(placed), "id long, hash long, codes binary").join(found, ["id", "hash"], "left")
    filled = joined.select("id", "codes", F.col("rare.k").alias("own"), F.col("rare.ids").alias("ids")).mapInArrow(tidy(fill), f"id long, {kind}")
    return filled.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Return (id, text): the pieces of ids joined by spaces, by a join of every id with its piece.

    Ids without a piece are left out, as the tokenizer does.  Null and empty ids give an empty text.  Rows that share id_col
    are decoded apart.
    """
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    rows = stash(rows, "bpe-ids")
    parts = rows.select("row", F.posexplode("ids").alias("pos", "piece_id")).join(_piece_table(encoded.sparkSession, path), "piece_id")
    texts = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p")).select("row", F.array_join("p.piece", " ").alias("text"))
    return rows.join(texts, "row", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_query(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digests of ids and decoded text of every document."""
    return encode(docs, path or default_path(), digest=True).withColumnRenamed("id", "doc_id")
