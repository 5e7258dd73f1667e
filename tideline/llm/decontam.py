"""Benchmark decontamination: size-partitioned MinHash containment, native functions only.

Test items are parted by size.  Each class keeps as many minimum hash values of
an item's shingles as make a miss impossible: a document that holds three
quarters of the shingles must hold some of them.  Documents that do are checked
on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm import text as tx

WIDTH = 5
#: Percent of an item's distinct shingles that a contaminated document holds.
CONTAINMENT = 75
#: Up to so many sketch values (28 bytes each) are broadcast to the documents' shingles; beyond, they meet by one shuffle.
BROADCAST_VALUES = 500_000
#: Up to so many candidate ids are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case words parted by ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _starts(w: Column, width: int) -> Column:
    """Positions of the shingles; with fewer words than WIDTH there is one, at 0, with fewer than another width none."""
    none = F.size(w) < (1 if width == WIDTH else width)
    return F.when(none, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Words beyond the end are null, which leaves the hash as it is."""
    return F.transform(_starts(w, width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))


def shingle_texts(w: Column, widths: tuple[int, ...] = (WIDTH,)) -> Column:
    def of(width: int) -> Column:
        return F.transform(_starts(w, width), lambda i: F.array_join(F.slice(w, i + 1, F.lit(width)), " "))

    return F.array_distinct(F.concat(*map(of, widths)))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row per item: item_id, key, its shingles, their number, and its size class."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    rows = rows.withColumn("w", words(F.col("text"))).where(F.size("w") > 0).select("item_id", F.sha2("text", 256).alias("key"), "w", shingle_texts(F.col("w")).alias("shingles"))
    return rows.withColumn("n", F.size("shingles")).withColumn("class", F.floor(F.log2("n") + 1e-9).cast("int"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", owner: str = "op") -> DataFrame:
    """Pairs of a document and an item it contains.

    Returns doc_id, item_id, n_item (distinct shingles of five words; an item of
    fewer words is one shingle, found wherever a text has these words in a row),
    n_shared and containment, for every pair with 100 * n_shared >= 75 * n_item.
    Null, empty and blank texts match nothing.  Rows that repeat an id count as
    one document and the best of them is returned; a null id is an id like any
    other.  Whole texts of any length are searched.
    """
    tx.bounded(docs.sparkSession)
    items = store.table(_items(benchmark, item_col, item_text_col), "items", owner)
    top = (F.lit(2) * F.pow(F.lit(2), F.col("class"))).cast("int") - 1  # the largest size of the class
    # a document may lack at most floor((100 - CONTAINMENT) * n / 100) shingles, so one more value than that leaves a hit
    kept = F.least(F.floor(top * (100 - CONTAINMENT) / 100).cast("int") + 1, F.col("n"))
    hashed = items.withColumn("minima", F.slice(F.array_sort(F.array_distinct(shingle_hashes(F.col("w")))), 1, kept))
    need = F.greatest(F.lit(1), F.size("minima") - F.floor(F.col("n") * (100 - CONTAINMENT) / 100).cast("int"))
    sketch = hashed.select("item_id", "key", need.alias("need"), F.floor(F.pow(F.lit(2), F.col("class")) * CONTAINMENT / 100).alias("least"), F.explode_outer("minima").alias("h"))
    sketch = store.table(sketch, "sketch", owner)
    # items of fewer words than a shingle: at most WIDTH - 1 lengths, whose shingles documents get as well
    short = sorted(r[0] for r in items.where(F.size("w") < WIDTH).select(F.size("w")).distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    worded = rows.select("doc_id", words(F.col("text")).alias("w"))  # a column of its own, so that texts are split once
    shingled = worded.select("doc_id", F.size("w").alias("size"), (F.concat(*(shingle_hashes(F.col("w"), n) for n in (WIDTH, *short))) if short else shingle_hashes(F.col("w"))).alias("hs"))
    # the outer form: for the inner one Spark infers a filter on the array, and would build the array twice
    exploded = shingled.select("doc_id", "size", F.explode_outer("hs").alias("h"))
    hits = exploded.join(store.bounded_broadcast(sketch, sketch.count(), BROADCAST_VALUES), "h").where(F.col("size") >= F.col("least"))
    counted = hits.groupBy("doc_id", "item_id", "key", "need", "h").agg(F.lit(1).alias("_one")).groupBy("doc_id", "item_id", "key", "need").agg(F.count(F.lit(1)).alias("hits"))
    pairs = store.table(counted.where(F.col("hits") >= F.col("need")).select("doc_id", "item_id", "key"), "candidates", owner)
    ids = pairs.select(F.col("doc_id").alias("_id")).distinct()
    hint = store.bounded_broadcast(ids, ids.count(), BROADCAST_IDS)
    checked = rows.join(hint, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingle_texts(F.col("w"), (WIDTH, *short)).alias("own"))
    at = pairs.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item"), F.col("key").alias("_key"))
    pair = checked.join(at, F.col("doc_id").eqNullSafe(F.col("_id"))).join(items.select("item_id", "key", "shingles", "n"), (F.col("_item").eqNullSafe(F.col("item_id"))) & (F.col("_key") == F.col("key")))
    shared = pair.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared"))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc(F.col("n_shared") / F.col("n_item")), F.desc("n_item"))
    exact = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * CONTAINMENT).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return exact.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared").cast("double") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "op") -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay.

    Null, empty and blank texts stay; rows that repeat an id are one document and
    go or stay together, a null id being an id like any other; an empty table
    stays empty, and with an empty benchmark every row stays.
    """
    found = store.table(find(docs, benchmark, id_col, text_col, owner=owner).select(F.col("doc_id").alias("_contaminated")).distinct(), "contaminated", owner)
    hint = store.bounded_broadcast(found, found.count(), BROADCAST_IDS)
    return docs.join(hint, docs[id_col].eqNullSafe(hint["_contaminated"]), "left_anti")
