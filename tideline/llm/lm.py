"""Interpolated modified Kneser-Ney n-gram model, counted in Spark.

Words are counted first and numbered, the frequent ones with small numbers.
n-grams are then dealt by their last word but one: a bucket so holds all that
follows a context and all that comes before a shorter n-gram, and makes every
order down to two by itself.  Only the n-grams of words too frequent for one
bucket are spread by all their words, and their sums meet in a second shuffle.
Each bucket writes sorted hash arrays into the shared folder, which the workers
that score texts map into memory.  Lower orders hold continuation counts
(distinct left neighbours).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm import text as tx

#: Longest n-grams: two words of context.
ORDER = 3
#: Tokens for each bucket of n-grams, and words for each bucket of words: what a task holds at a time, whatever the corpus.
BUCKET_TOKENS, BUCKET_WORDS = 1 << 21, 1 << 18
LEAST_BUCKETS = 64
#: A word of more tokens than this has its n-grams spread over all buckets.
HOT_TOKENS = 1 << 21
#: n-grams that a task gathers before it sends them on.
HELD = 1 << 20
#: So many of the most frequent words are numbered by rank, which shortens what is sent; 12 bytes each.
RANKED = 1 << 16
#: Files that a worker keeps mapped at a time.
MAPPED = 4096
#: Keys that share an index entry of an array; with 32 more bits of each key, a key that was never counted is found with chance 4e-9.
GROUP_BITS = 4

END = np.uint64(2)
#: Numbers of the mark before a text's first word, and of a word that was never counted.
BEGIN_ID, UNKNOWN_ID = 0, 1


class Model(NamedTuple):
    """What scoring needs besides the arrays at ``uri``."""

    uri: str
    order: int
    buckets: int
    word_buckets: int
    hot: int  # tokens from which a word's n-grams are spread
    tokens: int  # N: training tokens
    types: int  # V: distinct training tokens
    discounts: list[list[float]]  # by order: D1, D2, D3+
    totals: int  # distinct n-grams of order two: the continuation total
    mass: float  # share of the continuation total that is left after the discounts


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, each text's words and then its end by number in them, and the offsets of the texts."""
    codes, distinct, offsets = tx.words(texts)
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.full(at[-1], len(distinct), np.int64)
    body = np.ones(len(out), bool)
    body[at[1:] - 1] = False
    out[body] = codes
    return np.append(tx.hash_words(distinct), END), out, at


def _previous(numbers: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = order - 1 .. 1 the token k places before each token (the begin mark before a text's first)."""
    out = [numbers]
    for _ in range(1, order):
        before = np.empty_like(numbers)
        before[1:] = out[0][:-1]
        before[at[:-1]] = BEGIN_ID
        out.insert(0, before)
    return out[:-1]


def _sequence(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the word numbers of each row, in order."""
    out = tx.mix(columns[0].astype(np.uint64) + np.uint64(len(columns)))
    for c in columns[1:]:
        out = tx.combine(out, c.astype(np.uint64))
    return out


def _spread(key: np.ndarray, buckets: int) -> np.ndarray:
    return (tx.mix(key) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and its rows, in their order."""
    order = np.argsort(bucket.astype("<u2") if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns; small word numbers go in pairs."""
    if columns[0].itemsize == 4:
        odd = len(columns) % 2
        first, rest = columns[:odd], columns[odd:]
        columns = [*first, *(a.astype(np.uint64) << np.uint64(32) | b for a, b in zip(rest[::2], rest[1::2], strict=True))]
    return np.lexsort(columns[::-1])


def _bucket_of(columns: list[np.ndarray], hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of n-grams: by the last word but one, or from ``buckets`` on by all words where that one is hot."""
    return np.where(hot, buckets + _spread(_sequence(columns), buckets), _spread(_sequence(columns[-2:-1]), buckets))


# --- blobs: sorted rows of word numbers and counts, coded by steps and bytes ----


def _planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, all first ones before all second ones: small values then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.itemsize).T.tobytes()


def _by_middle(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns as they are sorted and sent: the last word but one first."""
    return [columns[-2], *columns[:-2], columns[-1]] if len(columns) > 1 else columns


def _pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted rows: all columns but the last of several as steps from the row before, then the counts."""
    steps = max(len(columns) - 1, 1)
    differences = [np.diff(c.astype("<i8"), prepend=0) for c in columns[:steps]]
    parts = [*(d << 1 ^ d >> 63 for d in differences), *(c.astype("<i8") for c in columns[steps:]), *counts.astype("<i8").reshape(len(counts), -1).T]
    return zstandard.compress(b"".join([np.array([len(counts)], "<i8").tobytes(), *map(_planes, parts)]), 1)


def _unpack(raw: bytes, columns: int, sums: int, kind: str) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    parts = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * 8, 8 + k * n * 8).reshape(8, n).T).view("<i8")[:, 0] for k in range(columns + sums)]
    steps = max(columns - 1, 1)
    words = [np.cumsum((z >> 1) ^ -(z & 1)) for z in parts[:steps]] + parts[steps:columns]
    return [*(w.astype(kind) for w in words), np.stack(parts[columns:], axis=1)]


def _group(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal rows taken together, their counts added: sorted by key; the columns, the counts and the keys."""
    key = _sequence(columns)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first) if len(key) else counts, key[first]


def _send(columns: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One blob of sorted rows for each bucket."""
    columns = _by_middle(columns)
    at = _order(columns)
    columns, counts = [c[at] for c in columns], counts[at]
    for b, rows in _by_bucket(bucket[at]):
        yield b, _pack([c[rows] for c in columns], counts[rows])


# --- arrays ---------------------------------------------------------------------


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest type that holds all its values."""
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if x.max(initial=0) <= np.iinfo(t).max))


def write_table(uri: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Sorted distinct 64-bit ``keys`` and the row of numbers of each.

    The file holds an index by the first bits of the keys, the 32 bits after
    them, a number for each key's row, and the distinct rows.
    """
    values = values.reshape(len(keys), -1)
    code = values[:, 0].astype(np.uint64)
    for c in values.T[1:]:
        code = tx.combine(code, c.astype(np.uint64))
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    bits = max(len(keys).bit_length() - GROUP_BITS, 1)
    index = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4")
    low = (keys << np.uint64(bits) >> np.uint64(32)).astype("<u4")
    number = _narrow(number)
    head = np.array([len(keys), bits, number.itemsize, len(first), values.shape[1]], "<i8")
    store.write_array(uri, np.concatenate([np.ascontiguousarray(x).view(np.uint8).ravel() for x in (head, values[first].astype("<i8"), index, low, number)]))


class Table:
    """A table written by ``write_table``, mapped."""

    def __init__(self, raw: np.ndarray) -> None:
        n, self.bits, size, rows, width = (int(x) for x in raw[:40].view("<i8"))
        at = 40 + rows * width * 8
        self.rows = raw[40:at].view("<i8").reshape(rows, width)
        end = at + ((1 << self.bits) + 1) * 4
        self.index, self.low, self.number = raw[at:end].view("<u4"), raw[end : end + 4 * n].view("<u4"), raw[end + 4 * n :].view(f"<u{size}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ``keys`` are there, and the rows of those."""
        part = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        low = (keys << np.uint64(self.bits) >> np.uint64(32)).astype("<u4")
        a, end = self.index[part].astype(np.int64), self.index[part + 1].astype(np.int64)
        b = end.copy()
        while (a < b).any():
            middle = (a + b) >> 1
            less = (self.low[np.minimum(middle, len(self.low) - 1)] < low) & (a < b)
            a, b = np.where(less, middle + 1, a), np.where(less, b, np.minimum(middle, b))
        at = np.minimum(a, len(self.low) - 1)
        hit = (a < end) & (self.low[at] == low)
        return hit, self.rows[self.number[at[hit]]]


class _Arrays:
    """The model's arrays: mapped at first use, the MAPPED used last kept."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}

    def _map(self, name: str, read: Callable):
        """What ``read`` makes of a file, or None where a bucket got nothing."""
        if name in self.open:
            self.open[name] = self.open.pop(name)
            return self.open[name]
        while len(self.open) >= MAPPED:
            del self.open[next(iter(self.open))]
        try:
            self.open[name] = read(store.map_array(f"{self.model.uri}/{name}", "u1"))
        except FileNotFoundError:
            self.open[name] = None
        return self.open[name]

    def look_up(self, name: Callable[[int], str], keys: np.ndarray, bucket: np.ndarray, width: int = 1) -> np.ndarray:
        """The rows of ``keys`` in the table that ``name`` gives their bucket; zeros where there is none."""
        out = np.zeros((len(keys), width), np.int64)
        for b, rows in _by_bucket(bucket):
            if (table := self._map(name(b), Table)) is not None:
                hit, values = table.find(keys[rows])
                out[rows[hit]] = values
        return out

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and number of each distinct word."""
        bucket = _word_bucket(hashes, self.model.word_buckets)
        out = np.zeros((2, len(hashes)), np.int64)
        out[1] = UNKNOWN_ID
        for b, rows in _by_bucket(bucket):
            if (held := self._map(f"words.{b}", _split_words)) is not None:
                key, count, number = held
                k = np.minimum(np.searchsorted(key, hashes[rows]), len(key) - 1)
                hit = key[k] == hashes[rows]
                out[0, rows[hit]], out[1, rows[hit]] = count[k[hit]], number[k[hit]]
        return out[0], out[1]


def _split_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and numbers of a bucket of words."""
    n, a, b = (int(x) for x in raw[:24].view("<i8"))
    cut = np.cumsum([24, 8 * n, a * n, b * n])
    return raw[cut[0] : cut[1]].view("<u8"), raw[cut[1] : cut[2]].view(f"<u{a}"), raw[cut[2] : cut[3]].view(f"<u{b}")


def _word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32) & np.uint64(buckets - 1)).astype(np.int64)


# --- training -------------------------------------------------------------------


def _power(n: float, least: int = 1) -> int:
    """The least power of two that is not under ``n`` and ``least``."""
    return 1 << max(int(np.ceil(np.log2(max(n, 1)))), least.bit_length() - 1)


def _count_words(rows: DataFrame, uri: str, owner: str) -> tuple[int, int, int]:
    """Write the words' arrays (hash, count, number); tokens, types and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in (s for b in batches for s in tx.steps(b)):
            distinct, of, _ = _tokens(batch.column("text"))
            held.append((distinct, np.bincount(of, minlength=len(distinct))))
            if sum(len(h) for h, _ in held) > HELD:
                yield sums(held)
                held = []
        if held:
            yield sums(held)

    def sums(held: list) -> pa.RecordBatch:
        h, of = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(of, np.concatenate([x[1] for x in held]), len(h)).astype(np.int64)
        return pa.record_batch([pa.array(h[n > 0].view(np.int64)), pa.array(n[n > 0])], ["h", "n"])

    words = store.table(tx.in_batches(rows, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words", owner)
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = _power(types / BUCKET_WORDS, LEAST_BUCKETS // 2)
    top = words.where(F.col("n") * RANKED >= tokens).orderBy(F.desc("n"), "h").limit(RANKED).select("h").collect()
    ranked = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(ranked)
    ranked, rank = ranked[order], order + UNKNOWN_ID + 1
    bucket = F.shiftrightunsigned("h", 32).bitwiseAND(buckets - 1).cast("int")
    sizes = {r.b: r["count"] for r in words.groupBy(bucket.alias("b")).count().collect()}  # one row a bucket
    base = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[b] for b in sorted(sizes))])[:-1].tolist(), strict=True))

    def write(group: pa.Table) -> pa.Table:
        b = group.column("b")[0].as_py()
        h, n = group.column("h").to_numpy().view(np.uint64), group.column("n").to_numpy()
        order = np.argsort(h)
        h, n = h[order], n[order]
        number = base[b] + np.arange(len(h)) + len(ranked) + UNKNOWN_ID + 1
        if len(ranked):
            at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
            number = np.where(ranked[at] == h, rank[at], number)
        n, number = _narrow(n), _narrow(number)
        head = np.array([len(h), n.itemsize, number.itemsize], "<i8")
        store.write_array(f"{uri}/words.{b}", np.concatenate([x.view(np.uint8) for x in (head, h, n, number)]))
        tx.free()
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    words.select("h", "n", bucket.alias("b")).groupBy("b").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return int(tokens), int(types), buckets


_OUT = "bucket long, raw binary, stats array<long>"


def _result(out: list[tuple]) -> pa.Table:
    bucket, raw, stats = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "raw": pa.array(raw, pa.binary()), "stats": pa.array(stats, pa.list_(pa.int64()))})


def _context_stats(context: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per context: its total, and how many of its n-grams count 1, 2, and 3 or more."""
    return _group(context, np.stack([counts, counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, hot: int | None = None, buckets: int | None = None, owner: str = "op") -> Model:
    """Count all rows of ``docs`` (null: empty) and write the model's arrays.

    ``order`` is at least two.  Arrays by bucket: ``words``; for each order n
    from two ``n`` (count) and ``context-n`` (total, and the numbers of n-grams
    that count one, two, and more), ``hot-`` before the name for n-grams of hot
    words; ``left`` (continuation count) by word.
    """
    if order < 2:
        raise ValueError("an n-gram model here has an order of two or more")
    spark = docs.sparkSession
    # each query's shuffle files go at its end; what a later query needs stands in tables
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        return _train(docs, text_col, order, hot or HOT_TOKENS, buckets, owner)
    finally:
        spark.conf.set(cleanup, before)


def _train(docs: DataFrame, text_col: str, order: int, hot: int, buckets: int | None, owner: str) -> Model:
    uri = store.new_path(docs.sparkSession, "model", owner)
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    tokens, types, word_buckets = _count_words(rows, uri, owner)
    buckets = buckets or _power(tokens / BUCKET_TOKENS, LEAST_BUCKETS)
    kind = "<u4" if types + RANKED < 1 << 31 else "<i8"
    words_only = Model(uri, order, buckets, word_buckets, hot, tokens, types, [], 0, 0.0)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _Arrays(words_only)
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*(h[0] for h in held), strict=True)]
            bucket = _bucket_of(columns, np.concatenate([h[1] for h in held]), buckets)
            held.clear()
            columns = _by_middle(columns)
            at = _order(columns)
            columns = [c[at] for c in columns]
            new = np.ones(len(at), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])  # equal n-grams have one bucket
            first = np.flatnonzero(new)
            counts = np.diff(first, append=len(at))
            columns = [c[first] for c in columns]
            for b, rows in _by_bucket(bucket[at[first]]):
                raw = _pack([c[rows] for c in columns], counts[rows])
                yield pa.record_batch([pa.array([b], pa.int64()), pa.array([raw], pa.binary())], ["bucket", "raw"])

        for batch in (s for b in batches for s in tx.steps(b)):
            distinct, of, at = _tokens(batch.column("text"))
            count, number = arrays.words(distinct)
            ids, is_hot = number.astype(kind)[of], (count > hot)[of]
            columns = [*_previous(ids, at, order), ids]
            before = np.zeros(len(ids), bool)  # whether the last word but one is hot; the begin mark is as frequent as the end
            before[1:] = is_hot[:-1]
            before[at[:-1]] = count[of[at[1:] - 1]] > hot
            held.append((columns, before))
            if sum(len(h[1]) for h in held) > HELD:
                yield from send()
        if held:
            yield from send()

    level = tx.in_batches(rows, grams, "bucket long, raw binary")
    stats: dict[int, np.ndarray] = {n: np.zeros(5, np.int64) for n in range(1, order + 1)}
    ends: list[DataFrame] = []  # what goes to the words' buckets
    def words_of(number: np.ndarray, sums: np.ndarray, base: int) -> list[tuple]:
        return [(*x, None) for x in _send([number], sums, base + _spread(_sequence([number]), word_buckets))]

    def merger(n: int) -> Callable[[pa.Table], pa.Table]:
        # buckets, in spans of B: n-grams of cold words, of hot words, hot contexts; then words: their left neighbours, and what follows them
        def merge(group: pa.Table) -> pa.Table:
            b = group.column("bucket")[0].as_py()
            out: list[tuple] = []
            if b >= 2 * buckets:  # contexts of n + 1 words
                _, sums, keys = _merge(group.column("raw"), n, 4, kind)
                write_table(f"{uri}/hot-context-{n + 1}.{b - 2 * buckets}", keys, sums)
            else:
                columns, counts, keys = _merge(group.column("raw"), n, 1, kind)
                cold, name = b < buckets, "" if b < buckets else "hot-"
                for k in range(n, 1, -1):
                    write_table(f"{uri}/{name}{k}.{b % buckets}", keys, counts)
                    out.append((-k, None, [*((counts == c).sum() for c in (1, 2, 3, 4)), len(counts)]))
                    values, sums, heads = _context_stats(columns[:-1], counts)
                    if k == 2:
                        out += words_of(values[0], sums, 3 * buckets + word_buckets)
                    elif cold:
                        write_table(f"{uri}/context-{k}.{b}", heads, sums)
                    else:
                        out += [(*x, None) for x in _send(values, sums, 2 * buckets + _spread(heads, buckets))]
                    del values, sums, heads
                    if k == 2:  # distinct left neighbours of each word
                        (last,), left, _ = _group(columns[1:], np.ones(len(counts), np.int64))
                        out += words_of(last, left, 3 * buckets)
                    else:  # and of each shorter n-gram
                        columns, counts, keys = _group(columns[1:], np.ones(len(counts), np.int64))
                        if not cold:
                            out += [(*x, None) for x in _send(columns, counts, buckets + _spread(keys, buckets))]
                            break
            tx.free()
            return _result(out)

        return merge

    for n in range(order, 1, -1):
        made = store.table(level.groupBy("bucket").applyInArrow(merger(n), _OUT), f"order-{n}", owner)
        for r in made.where("bucket < 0").groupBy("bucket").agg(F.array(*(F.sum(F.col("stats")[k]) for k in range(5))).alias("s")).collect():
            stats[-r.bucket] += np.array(r.s)
        ends.append(made.where(F.col("bucket") >= 3 * buckets).select("bucket", "raw"))
        level = made.where((F.col("bucket") >= buckets) & (F.col("bucket") < 3 * buckets)).select("bucket", "raw")

    def by_word(group: pa.Table) -> pa.Table:
        b = group.column("bucket")[0].as_py() - 3 * buckets
        if b >= word_buckets:
            _, sums, keys = _merge(group.column("raw"), 1, 4, kind)
            write_table(f"{uri}/context-2.{b - word_buckets}", keys, sums)
            return _result([])
        _, left, keys = _merge(group.column("raw"), 1, 1, kind)
        write_table(f"{uri}/left.{b}", keys, left)
        return _result([(-1, None, [*((left == c).sum() for c in (1, 2, 3, 4)), len(left)])])

    last = ends[0]
    for e in ends[1:]:
        last = last.unionAll(e)
    sums = last.groupBy("bucket").applyInArrow(by_word, _OUT).agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(5))).first()
    stats[1] += np.array([x or 0 for x in sums])
    discounts = [_discounts(stats[n][:4].tolist()) if n else [0.0] * 3 for n in range(order + 1)]
    n1, n2, _, _, n_words = stats[1]
    totals = int(stats[2][4])
    removed = float(np.dot([n1, n2, n_words - n1 - n2], discounts[1]))
    return words_only._replace(discounts=discounts, totals=totals, mass=1.0 - removed / totals if totals else 0.0)


def _merge(blobs: pa.ChunkedArray, columns: int, sums: int, kind: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    parts = [_unpack(b.as_buffer().to_pybytes(), columns, sums, kind) for b in blobs]
    *words, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    return _group([*words[1:-1], words[0], words[-1]] if columns > 2 else words, counts if sums > 1 else counts[:, 0])


def _discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts of counts; plain values where the corpus is too small."""
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


# --- scoring --------------------------------------------------------------------


def score_tokens(distinct: np.ndarray, of: np.ndarray, at: np.ndarray, arrays: _Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its training count, and log10 of its probability after the tokens before it."""
    m = arrays.model
    counts, ids = arrays.words(distinct)
    key = _sequence([ids])
    left = arrays.look_up("left.{}".format, key, _spread(key, m.word_buckets))[:, 0]
    # order one: continuation counts, interpolated with a uniform share for each type and the unknown word
    p = (_used(left, m.discounts[1]) / max(m.totals, 1) + (1.0 - m.mass) / (m.types + 1))[of]
    begin = _sequence([np.array([BEGIN_ID])])
    heads = arrays.look_up("context-2.{}".format, np.append(key, begin), _spread(np.append(key, begin), m.word_buckets), 4)
    words, hot = ids[of], (counts > m.hot)[of]
    cold = _spread(np.append(key, begin), m.buckets)  # the bucket of what follows each word
    last = _previous(of, at, 2)[0]  # the word before by its number here; the begin mark is the last
    last[at[:-1]] = len(ids)
    before = np.zeros(len(of), bool)
    before[1:] = hot[:-1]
    before[at[:-1]] = hot[at[1:] - 1]
    bucket, previous = cold[last], _previous(words, at, m.order)
    for n in range(2, m.order + 1):
        columns = [*previous[m.order - n :], words]
        c = _find(arrays, str(n), columns, before, bucket)[:, 0]
        sums = heads[last] if n == 2 else _find(arrays, f"context-{n}", columns[:-1], before, bucket, 4)
        d = m.discounts[n]
        seen = sums[:, 0] > 0
        whole = np.maximum(sums[:, 0], 1)
        back_off = np.where(seen, (sums[:, 1:] @ np.array(d)) / whole, 1.0)
        p = np.where(seen, _used(c, d) / whole, 0.0) + back_off * p
    return counts[of], np.log10(p)


def _find(arrays: _Arrays, name: str, columns: list[np.ndarray], hot: np.ndarray, bucket: np.ndarray, width: int = 1) -> np.ndarray:
    """The rows of n-grams: of cold words by ``bucket``, of hot ones by all words; zeros where one is not known."""
    buckets = arrays.model.buckets
    out = np.zeros((len(hot), width), np.int64)
    known = np.flatnonzero(np.logical_and.reduce([c != UNKNOWN_ID for c in columns]))
    keys = _sequence([c[known] for c in columns])
    where = np.where(hot[known], buckets + _spread(keys, buckets), bucket[known])
    out[known] = arrays.look_up(lambda b: f"{name}.{b}" if b < buckets else f"hot-{name}.{b - buckets}", keys, where, width)
    return out


def _used(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` with n_tokens, n_known, base_score and score (log10) of every whole text.

    A null or empty text is its end alone.  Ids, extra columns and repeated rows
    stay as they are; an empty table gives no rows; a model of nothing gives the
    uniform probability of an unknown word.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    more = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _Arrays(model)
        for batch in (s for b in batches for s in tx.steps(b, "_text")):
            *tokens, at = _tokens(batch.column("_text"))
            count, logp = score_tokens(*tokens, at, arrays)
            base = np.log10((count + 1) / (model.tokens + model.types + 1))
            sums = [np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), base, logp)]
            yield pa.record_batch([*(batch.column(k) for k in range(len(names))), pa.array(np.diff(at)), *(pa.array(s) for s in sums)], [*names, *more])

    return tx.in_batches(rows, run, f"{rows.drop('_text').schema.toDDL()}, n_tokens long, n_known long, base_score double, score double")
