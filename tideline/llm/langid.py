"""Language identification by nearest centroids of character n-gram vectors.

A text is a normalised TF-IDF vector of hashed n-grams of its letters.  Each
language is learned as several clustered centroids; a text gets the language of
the centroid nearest by cosine, and is rejected if even that is too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm import text as tx

#: Dimensions of the hashed n-gram space and the n-gram lengths in UTF-8 bytes.
DIMENSIONS = 4096
ORDERS = (1, 2, 3)
#: The classifier is fitted on at most this many labelled rows in all, the same number from each language, taken by hash of the id.
SAMPLE_ROWS = 4000
CENTROIDS = 4
#: A text is rejected if its cosine is under this share of the median of texts of its length, and under this share of what
#: all but one in a hundred of them have.
REJECT_SHARE, REJECT_LEAST = 0.4, 0.8
#: Words of the spans cut out of one in so many sampled texts, from which is learned what short texts have.
SPANS, SPAN_OF = (1, 2, 3, 5, 8), 4
_STEP, _ROWS = 1 << 20, 256  # of one step: its vectors are rows * DIMENSIONS longs

# bytes: letters as they are, bytes of other alphabets too, all else a space
_CLASS = np.full(256, 32, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIMENSIONS), normalised
    owner: np.ndarray  # language number of each centroid
    least: np.ndarray  # cosine under which a text is rejected, by log2 of its number of n-grams


def count_grams(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts of each text: (texts, DIMENSIONS)."""
    lowered = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    at = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    raw = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    sizes = np.diff(at)
    x = _CLASS[raw].astype(np.uint32)
    # a run of spaces counts once, so that layout says nothing
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    out = np.zeros(len(sizes) * DIMENSIONS, np.int64)
    code = np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        with np.errstate(over="ignore"):
            code = (code[: len(x) - n + 1] if n == 1 else code[:-1]) * np.uint32(257) + x[n - 1 :]
            if n in ORDERS:
                slot = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
        if n in ORDERS:
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            if n == 1:
                inside &= x != 32
            cell = doc[: len(doc) - n + 1] * DIMENSIONS + slot
            out += np.bincount(cell[inside], minlength=len(out))
    return out.reshape(len(sizes), DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors (logarithmic TF)."""
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; at most ``k`` normalised centroids."""
    seeds = [v.mean(axis=0)]
    for _ in range(min(k, len(v)) - 1):
        seeds.append(v[np.argmin((v @ np.stack(seeds).T).max(axis=1))])
    c = np.stack(seeds)
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].mean(axis=0) for j in range(len(c)) if (near == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + counts.sum(axis=1)).astype(np.int64).clip(0, 31)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", owner: str = "op") -> Model:
    """Learn from the rows where ``train`` holds, text has a letter and the language is not null.

    Document frequencies cover all of these rows; the centroids a bounded sample.
    With no such row the model knows no language.
    """
    labelled = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    languages = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()}
    each = max(1, min(1000, SAMPLE_ROWS // max(1, len(languages))))
    # the least hashes of each language; those under a bound that leaves a few more than wanted, so that no task sorts a language
    limits = pa.table({"lang": pa.array(languages, pa.string()), "bound": pa.array([(each + 5 * each**0.5 + 20) / n for n in languages.values()], pa.float64())})  # at most SAMPLE_ROWS rows
    bounds = docs.sparkSession.createDataFrame(limits)  # from Arrow: a list of rows would start Python workers of another kind, which stay
    h = F.shiftrightunsigned(F.xxhash64("id"), 11)
    few = labelled.select("id", "lang", h.alias("h")).join(F.broadcast(bounds), "lang").where(F.col("h") / float(1 << 53) < F.col("bound"))
    ids = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("k") <= each)
    chosen = {(r.id, r.lang) for r in ids.select("id", "lang").limit(each * max(1, len(languages))).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in (s for b in batches for s in tx.steps(b, size=_STEP, rows=_ROWS)):
            lettered = _lettered(batch.column("text"))
            counts = count_grams(batch.column("text"))[lettered]
            df += (counts > 0).sum(axis=0)
            n += len(counts)
            keys = [k for k, ok in zip(zip(*(batch.column(c).to_pylist() for c in ("id", "lang")), strict=True), lettered, strict=True) if ok]
            taken = [k for k, key in enumerate(keys) if key in chosen]
            if taken:
                texts = batch.column("text").filter(pa.array(lettered)).take(pa.array(taken))
                spans = count_grams(pa.array([s for t in texts.to_pylist() if (s := _span(t))], pa.string()))
                for which, of in ((1, counts[taken]), (2, spans)):
                    yield _rows([keys[k][1] for k in taken] if which == 1 else [""] * len(of), [x.tobytes() for x in np.minimum(of, 65535).astype("<u2")], [which] * len(of))
        yield _rows([None], [df.astype("<i8").tobytes()], [n])

    def _rows(lang: list, raw: list, n: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(raw, pa.binary()), pa.array(n, pa.int64())], ["lang", "raw", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for raw, k in zip(batch.column("raw"), batch.column("n").to_pylist(), strict=True):
                df, n = df + np.frombuffer(raw.as_buffer(), "<i8"), n + k
        yield _rows([None], [df.tobytes()], [n])

    schema = "lang string, raw binary, n long"
    parts = store.table(tx.in_batches(labelled, run, schema), "language-parts", owner)
    df, n, by_lang, short = np.zeros(DIMENSIONS, np.int64), 0, {}, []
    for r in tx.in_batches(parts.where("lang is null").repartition(8), add, schema).collect():  # one vector of each task
        df, n = df + np.frombuffer(r.raw, "<i8"), n + r.n
    for r in parts.where("lang is not null").toLocalIterator():  # the bounded sample
        if r.n == 2:
            short.append(np.frombuffer(r.raw, "<u2"))
        elif len(by_lang.setdefault(r.lang, [])) < each:
            by_lang[r.lang].append(np.frombuffer(r.raw, "<u2"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    idf[df >= 0.999 * max(n, 1)] *= 0.25  # in nearly every text: says little
    names, centroids, owner, samples = sorted(by_lang), [], [], []
    for j, name in enumerate(names):
        counts = np.stack(by_lang.pop(name))
        c = cluster(vectors(counts, idf), CENTROIDS)
        centroids.append(c)
        owner += [j] * len(c)
        samples.append(counts)
    if not names:
        return Model([], idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros(32))
    centroids, counts = np.concatenate(centroids).astype(np.float32), [*samples, *([np.stack(short)] if short else [])]
    best = np.concatenate([(vectors(c[a : a + 256], idf) @ centroids.T).max(axis=1) for c in counts for a in range(0, len(c), 256)])
    classes = np.concatenate([_length_class(c) for c in counts])
    of = [best[classes == c] for c in range(32)]
    least = np.array([min(REJECT_SHARE * np.median(x), REJECT_LEAST * np.quantile(x, 0.01)) if len(x) >= 8 else np.nan for x in of])
    known = np.flatnonzero(~np.isnan(least))
    least = np.interp(np.arange(32), known, least[known]) if len(known) else np.zeros(32)
    if len(known):  # fewer letters than the shortest spans have: nothing to expect
        least[: known[0]] = 0
    return Model(names, idf, centroids, np.array(owner), least)


def _span(text: str) -> str | None:
    """A few words from somewhere in one of SPAN_OF texts; which, how many and where follows from the text."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    if h % SPAN_OF:
        return None
    words, n = text.split(), SPANS[h // SPAN_OF % len(SPANS)]
    at = h // 64 % max(1, len(words) - n + 1)
    return " ".join(words[at : at + n])


def _lettered(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text; `und` without a letter."""
    lettered = _lettered(texts)
    if not model.languages or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    counts = count_grams(texts)
    cosine = vectors(counts, model.idf) @ model.centroids.T
    near = cosine.argmax(axis=1)
    score = np.where(lettered, cosine[np.arange(len(near)), near].clip(0, 1), 0.0).astype(np.float64)
    names = [model.languages[model.owner[k]] if ok else "und" for k, ok in zip(near, lettered, strict=True)]
    return names, score, ~lettered | (score < model.least[_length_class(counts)])


def identify(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` with lang_pred, score (0 to 1) and rejected for every row of ``docs``.

    A null text or one without a letter is `und`, score 0 and rejected; equal
    texts get equal answers; with nothing learned every text is `und`.  Rows,
    ids and repeated rows stay as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # at most SAMPLE_ROWS centroids
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    schema = f"{rows.drop('_text').schema.toDDL()}, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in tx.steps(b, "_text", _STEP, _ROWS)):
            lang, score, rejected = predict(batch.column("_text"), held.value)
            yield pa.record_batch([*(batch.column(k) for k in range(len(names))), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    return tx.in_batches(rows, run, schema)


def keep_recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that ``identify`` rejects; all columns stay, whatever their names.

    Null and empty texts and those without a letter go; ids do not matter and
    repeated rows are judged alike; an empty table stays empty.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    found = identify(plain, model, [F.col(c) for c in plain.columns], f"c{names.index(text_col)}")
    return found.where(~F.col("rejected")).select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n
