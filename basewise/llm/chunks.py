"""Documents dealt to chunks that ask the whole corpus about what they hold.

An operator hashes or counts what stands in a chunk (a few MB of text), sends it in packed
blobs to buckets of the value space, and gets from each bucket a blob back that says what holds for the corpus.  Spark
moves chunks and blobs, by grouping on chunk and bucket; every group is bounded by a constant, as the numbers of chunks and
buckets follow the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, utf8

#: Bytes of text in a chunk on average; the least number of chunks and of buckets, for even tasks.
CHUNK = 16 << 20
LEAST = 64
#: What a null id counts as in the order of documents: it comes after every other.
NO_ID = (1 << 63) - 1
#: The columns of a blob on its way between a chunk and a bucket.
BLOB = "chunk int, bucket int, n int, data binary"
BLOB_TYPES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK) -> tuple[DataFrame, int, int]:
    """((chunk, id, at, text) of docs, the number of chunks, the bytes of all texts).

    at is the id, a null one last; text is its bytes, null empty.  A row's chunk follows from its id and text alone, so it is the same
    whenever it is computed; copies of a text under different ids are spread, and so are different texts of one id.
    """
    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(LEAST, math.ceil(size / chunk))
    at = F.coalesce("id", F.lit(NO_ID))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("chunk"), "id", at.alias("at"), "text"), n, size


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes, each split into planes of equal significance, so that high bytes that hardly change take no room."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, *types: type) -> list[np.ndarray]:
    """The columns of pack."""
    sizes = [np.dtype(t).itemsize for t in types]
    raw, at, out = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8), 0, []
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted column, the first value first; np.cumsum gives the column back."""
    return np.diff(x, prepend=x.dtype.type(0))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x, sorted; np.unique looks integers up in a hash table, which took some 80 times as long for millions of hashes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def blobs(chunk: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One blob for each bucket of rows that are sorted by bucket; the first column, sorted within each, goes as steps."""
    names, begins, sizes = np.unique(bucket, return_index=True, return_counts=True)
    data = [pack(steps(columns[0][a : a + n]), *(c[a : a + n] for c in columns[1:])) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
    rows = [pa.array([chunk] * len(names), pa.int32()), pa.array(names.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(data, pa.binary())]
    return pa.Table.from_arrays(rows, schema=BLOB_TYPES)


def opened(table: pa.Table, *types: type) -> list[list[np.ndarray]]:
    """The columns of every blob of a table."""
    out = []
    for n, data in zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True):
        first, *others = unpack(data, n, *types)
        out.append([np.cumsum(first, dtype=types[0]), *others])
    return out
