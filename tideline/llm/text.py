"""Words, hashes and shingles of Arrow text columns, vectorised with numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of an operator holds at a time; its vectors take some thirteen times as much.
STEP_BYTES = 2 << 20
#: Texts that one step holds: short ones take more memory in vectors than in bytes.
STEP_ROWS = 2048
#: Spark's settings for what a task holds of long texts, as Spark has them and as they are here; a user's own stay.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),  # of a batch between the JVM and Python, held by both
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),  # rows, whose texts lie in one growing array
}

Batches = Iterator[pa.RecordBatch]


def free() -> None:
    """Give memory that nothing uses back to the system: workers live on, and the next stage's need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def bounded(spark: SparkSession) -> None:
    for name, (usual, here) in BOUNDS.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, here)


def in_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df`` through ``run`` in Arrow batches of bounded bytes; a task's memory is given back at its end."""
    bounded(df.sparkSession)

    def freed(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            free()

    return df.mapInArrow(freed, schema)


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and about ``size`` bytes of text (a longer text stands alone)."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths.astype(np.int64)) // size
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.arange(1, len(part)) % rows == 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of lower-cased (A-Z) texts; null is empty.

    Returns the codes of all words in order, the distinct words, and the
    offsets of each text in the codes.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, offsets


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair of 64-bit hashes."""
    with np.errstate(over="ignore"):
        return mix(left * _MUL + right)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``width``-word shingles of each text as sorted 64-bit hashes.

    With fewer words the whole sequence is one shingle; without words the set
    is empty.  Returns all hashes and the offsets of each text in them.
    """
    codes, distinct, offsets = words(texts)
    h = hash_words(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    n = np.diff(offsets)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), counts)
    first = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
    length = np.minimum(n[doc], width)
    out = mix(length.astype(np.uint64))
    for k in range(width):
        inside = length > k
        if inside.all():
            out = combine(out, h[first + k]) if len(out) else out
        else:
            out[inside] = combine(out[inside], h[first[inside] + k])
    order = np.lexsort((out, doc)) if len(n) > 1 else np.argsort(out)
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))
