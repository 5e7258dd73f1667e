"""Quality selection by importance resampling.

Two hashed n-gram models, one of target text and one of all text, give each
document the logarithm of its importance.  Adding Gumbel noise and taking the
largest keys samples documents without replacement in proportion to importance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm import text as tx

#: Hash buckets of words and word pairs.
BUCKETS = 10_000
#: At most so many labelled documents are the target, taken by hash of the id.
TARGET_ROWS = 20_000
#: Share of all documents that is sampled.
SHARE = 0.5
_SMOOTH = 1.0


class Model(NamedTuple):
    ratio: np.ndarray  # log(target / raw) by bucket
    target_rows: int


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the number of the text of each."""
    codes, distinct, offsets = tx.words(texts)
    h = tx.hash_words(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = tx.combine(h[:-1], h[1:])[doc[1:] == doc[:-1]] if len(h) > 1 else np.empty(0, np.uint64)
    pair_doc = doc[1:][doc[1:] == doc[:-1]] if len(h) > 1 else np.empty(0, np.int64)
    slots = np.concatenate([tx.mix(h) % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64)
    return slots, np.concatenate([doc, pair_doc])


def fit(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the n-grams of all ``docs`` and of those whose id is in ``target`` (one id column).

    The raw model counts every document; the target at most TARGET_ROWS.
    """
    name = target.columns[0]
    ids = target.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS)
    held = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.id for r in ids.collect()], np.int64)))  # 8 * TARGET_ROWS bytes at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, n = held.value, np.zeros((2, BUCKETS), np.int64), 0
        for batch in (s for b in batches for s in tx.steps(b)):
            slots, doc = gram_buckets(batch.column("text"))
            mine = np.array([x is not None for x in batch.column("id").to_pylist()]) & np.isin(batch.column("id").fill_null(0).to_numpy(), known)
            n += int(mine.sum())
            sums[0] += np.bincount(slots, minlength=BUCKETS)
            sums[1] += np.bincount(slots[mine[doc]], minlength=BUCKETS)
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["sums", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, BUCKETS), np.int64), 0
        for batch in batches:
            for raw, k in zip(batch.column("sums"), batch.column("n").to_pylist(), strict=True):
                sums, n = sums + np.frombuffer(raw.as_buffer(), np.int64).reshape(2, -1), n + k
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["sums", "n"])

    schema = "sums binary, n long"
    # one vector from each task; a few tasks add them up, so the driver gets eight
    parts = tx.in_batches(tx.in_batches(rows, count, schema).repartition(8), add, schema).collect()
    sums = sum((np.frombuffer(r.sums, np.int64).reshape(2, -1) for r in parts), np.zeros((2, BUCKETS), np.int64))
    p = (sums + _SMOOTH) / (sums + _SMOOTH).sum(axis=1, keepdims=True)
    return Model(np.log(p[1] / p[0]), sum(r.n for r in parts))


def weigh(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` with n_grams and log_weight, the logarithm of each text's importance (0 for a null or empty text)."""
    held = docs.sparkSession.sparkContext.broadcast(model.ratio)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in tx.steps(b, "_text")):
            slots, doc = gram_buckets(batch.column("_text"))
            n = np.bincount(doc, minlength=batch.num_rows)
            w = np.bincount(doc, held.value[slots], batch.num_rows)
            yield pa.record_batch([*(batch.column(k) for k in range(len(names))), pa.array(n.astype(np.int64)), pa.array(w.astype(np.float64))], [*names, "n_grams", "log_weight"])

    return tx.in_batches(rows, run, f"{rows.drop('_text').schema.toDDL()}, n_grams long, log_weight double")


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", owner: str = "op") -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, key (with Gumbel noise), rank (from 1) and selected.

    Exactly ``floor(share * rows)`` documents, those of the largest keys, are
    selected.  The noise is hashed from the id and the seed, so a rerun selects
    the same.  Null texts weigh nothing; a null id draws its noise like any
    other; ties are ranked by id; an empty target or table raises nothing.
    """
    model = fit(docs, target, id_col, text_col)
    # a table: the sort reads the weights twice, for its ranges and for itself
    rows = store.table(weigh(docs, model, [F.col(id_col).cast("long").alias("doc_id")], text_col), "weights", owner)
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = rows.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    # a global order: each row's number in its range partition, and the rows of the partitions before
    ordered = store.table(keyed.orderBy(F.desc("key"), "doc_id").withColumn("_at", F.monotonically_increasing_id()), "ordered", owner)
    part = F.shiftright("_at", 33).cast("int")
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = store.table(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n"), "sizes", owner)
    total, parts = base.agg(F.sum("_n"), F.count(F.lit(1))).first()
    ranked = ordered.withColumn("_part", part).join(store.bounded_broadcast(base.drop("_n"), parts, 500_000), "_part")
    rank = (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("rank")
    out = ranked.select("doc_id", "n_grams", "log_weight", "key", rank)
    return out.withColumn("selected", F.col("rank") <= int(share * (total or 0)))
