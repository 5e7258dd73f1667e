"""Near-duplicate detection by min-max hashing.

Each permutation of a document's shingles keeps its minimum and its maximum, so
half the hash evaluations fill a signature.  Bands of the signature propose
pairs, the full shingle sets confirm them, and connected components group them.

Distinct sets are the nodes: rows with the same set are copies, whatever their
ids.  No link is given up to bound a group: in every bucket all members are
checked against one of them, and then all that are still in different components
are compared with each other, block by block.  What may be missed is stated at
BANDS and LEAST_AGREEMENT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm import text as tx

#: Words of a shingle, and percent of the union that linked sets share.
WIDTH, SIMILARITY = 5, 75
#: Values of a band and bands.  Two sets at the threshold share no band with probability (1 - 0.75 ** 5) ** 48 < 3e-6
#: if minimum and maximum are independent; for sets of four shingles, where they are not, it is 5e-5.
BAND, BANDS = 5, 48
#: Pairs whose signatures agree less than this are not compared: six standard deviations under the threshold, a chance of 1e-9 a pair.
LEAST_AGREEMENT = 0.58
#: Orders by which buckets choose their first document, so that a document of a large group meets several of its members.
LEADS = (0, 0x5A5A5A5A5A5A5A5A, 0x2DD2B44B69961EE1, 0x7333C3C3A5A59669)
#: Bytes of sets, and members, of a block when the rest of a bucket is compared; two blocks meet in a task.
BLOCK_BYTES, BLOCK = 8 << 20, 1000
#: Up to so many candidate ids (8 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240607)
_TIMES = _rng.integers(1, 1 << 63, BAND * BANDS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BAND * BANDS // 2, dtype=np.uint64)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each set under each permutation: (sets, BAND * BANDS); sets must not be empty."""
    out = np.empty((len(offsets) - 1, BAND * BANDS), np.uint64)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 32_768, "right")) - 1)
        x, at = hashes[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        for k in range(len(_TIMES)):
            y = (x ^ _XOR[k]) * _TIMES[k]
            out[a:b, 2 * k] = np.minimum.reduceat(y, at)
            out[a:b, 2 * k + 1] = np.maximum.reduceat(y, at)
        a = b
    return out


def digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each sorted set in two longs; zeros for an empty one."""
    out, full = np.zeros((2, len(offsets) - 1), np.uint64), np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[0, full] = np.add.reduceat(tx.mix(hashes), offsets[full])
        out[1, full] = np.bitwise_xor.reduceat(tx.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def _sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n, the set's digest (h1, h2), band hashes, and the low byte of every signature value."""
    schema = "doc_id long, n long, h1 long, h2 long, bands array<long>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in tx.steps(b)):
            hashes, offsets = tx.shingle_sets(batch.column("text"), WIDTH)
            n = np.diff(offsets)
            full = np.flatnonzero(n > 0)
            sig = signatures(hashes, np.concatenate([offsets[full], offsets[-1:]])) if len(full) else np.empty((0, BAND * BANDS), np.uint64)
            bands = np.empty((len(full), BANDS), np.uint64)
            for j in range(BANDS):
                b = np.full(len(full), j, np.uint64)
                for k in range(BAND):
                    b = tx.combine(b, sig[:, j * BAND + k])
                bands[:, j] = b
            at = np.zeros(len(n) + 1, np.int32)
            at[1:] = np.cumsum(n > 0)
            lists = pa.ListArray.from_arrays(pa.array(at * BANDS), pa.array(bands.ravel().view(np.int64)))
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at * (BAND * BANDS)), pa.py_buffer((sig & np.uint64(255)).astype(np.uint8).ravel())])
            yield pa.record_batch([batch.column("doc_id"), pa.array(n.astype(np.int64)), *map(pa.array, digests(hashes, offsets)), lists, raw], ["doc_id", "n", "h1", "h2", "bands", "sig"])

    return tx.in_batches(docs, run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """node and set (sorted shingle hashes) of the nodes in ``wanted`` (one column), read from the rows that stand for them."""
    of = store.table(nodes.join(wanted.withColumnRenamed(wanted.columns[0], "node"), "node", "left_semi").select("node", "rep", "h1", "h2"), "wanted", owner)
    ids = of.select(F.col("rep").alias("_id")).distinct()
    n_nodes = of.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in tx.steps(b)):
            hashes, offsets = tx.shingle_sets(batch.column("text"), WIDTH)
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(hashes)])
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, digests(hashes, offsets)), raw], ["rep", "h1", "h2", "set"])

    rows = docs.join(store.bounded_broadcast(ids, n_nodes, BROADCAST_IDS), docs["doc_id"] == F.col("_id"), "left_semi")
    own = tx.in_batches(rows, run, "rep long, h1 long, h2 long, set binary").join(store.bounded_broadcast(of, n_nodes, BROADCAST_IDS), ["rep", "h1", "h2"]).select("node", "set")
    return own


def _once(sets: DataFrame, repeated: bool) -> DataFrame:
    """One row a node; only where rows repeat both id and set are there more."""
    return sets.dropDuplicates(["node"]) if repeated else sets


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, repeated: bool, owner: str) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough, as a table."""
    wanted = pairs.select("a").unionAll(pairs.select("b")).distinct()
    own = store.table(_once(_sets(docs, nodes, wanted, owner), repeated), "sets", owner)
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 >= SIMILARITY * max(len(x), len(y)):
                    z = np.concatenate([x, y])
                    z.sort(kind="stable")
                    shared = int((z[1:] == z[:-1]).sum())
                    keep[k] = 100 * shared >= SIMILARITY * (len(x) + len(y) - shared)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return store.table(tx.in_batches(both, check, "a long, b long").distinct(), "links", owner)


def components(edges: DataFrame, owner: str = "op") -> DataFrame:
    """node and component (its smallest node) of every node of the ``edges`` (a, b).

    Alternating large and small stars; each round's edges are written to the
    shared folder, so a lost executor costs no earlier round.
    """
    seen, now = None, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = now.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = now.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
        now = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = store.table(now, "edges", owner)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: bool, owner: str) -> DataFrame:
    """Links (a, b) between a bucket's members of different components, on their full sets.

    Blocks hold the members' signatures and sets.  One link from a node to each
    other component of a block is enough: the component's others hang on it.
    """
    rows = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    # the component of a bucket's first node stands for its largest; only what differs from it is compared with all
    mixed = rows.groupBy("bucket").agg(F.min("c").alias("first"), F.max("c").alias("_last"), F.min_by("c", "node").alias("main")).where(F.col("first") != F.col("_last")).select("bucket", "main")
    rows = store.table(rows.join(mixed, "bucket"), "mixed", owner)
    own = _once(_sets(docs, nodes, rows.select("node").distinct(), owner), repeated).join(nodes.select("node", "sig"), "node")
    own = store.table(own, "mixed-sets", owner)
    odd = F.col("c") != F.col("main")
    sizes = rows.join(own.select("node", F.octet_length("set").alias("_b")), "node").groupBy("bucket").agg(
        *(F.ceil(F.greatest(F.sum(F.when(c, F.col("_b"))) / BLOCK_BYTES, F.count_if(c) / BLOCK)).alias(n) for c, n in ((F.lit(True), "_n"), (odd, "_m")))
    )
    rows = rows.join(sizes, "bucket").join(own, "node").withColumn("_h", F.abs(F.xxhash64("node") % 1_000_003))
    held = ["node", "c", "main", "sig", "set"]
    # a bucket of one block is one group, each member in it once
    single = F.col("_n") == 1
    one = rows.where(single).select("bucket", F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(2).alias("side"), *held)
    left = rows.where(~single & odd).select("bucket", (F.col("_h") % F.col("_m")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("j"), F.lit(0).alias("side"), *held)
    right = rows.where(~single).select("bucket", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("i"), (F.col("_h") % F.col("_n")).alias("j"), F.lit(1).alias("side"), *held)

    def compare(group: pa.Table) -> pa.Table:
        side, ids, c = (group.column(x).to_numpy(zero_copy_only=False) for x in ("side", "node", "c"))
        main = group.column("main")[0].as_py() if len(c) else 0
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(c), -1)
        raw = group.column("set").to_pylist()
        size = np.array([len(r) // 8 for r in raw])
        a, b = [], []
        there = np.flatnonzero(side > 0)
        for k in np.flatnonzero((side == 0) | ((side == 2) & (c != main))):
            # a pair of two odd members is taken once, by its smaller node; sizes too unlike rule a pair out
            fit = (np.minimum(size[there], size[k]) * 100 >= SIMILARITY * np.maximum(size[there], size[k])) & (c[there] != c[k])
            near = there[fit & ((c[there] == main) | (ids[there] > ids[k]))]
            near = near[(sig[near] == sig[k]).mean(axis=1) >= LEAST_AGREEMENT] if len(near) else near
            if not len(near):
                continue
            own = np.frombuffer(raw[k], "<u8")
            pool = np.frombuffer(b"".join(raw[j] for j in near), "<u8")
            at = np.minimum(np.searchsorted(own, pool), len(own) - 1)
            shared = np.add.reduceat((own[at] == pool).astype(np.int64), np.cumsum(size[near]) - size[near])
            linked = near[100 * shared >= SIMILARITY * (size[near] + size[k] - shared)]
            _, first = np.unique(c[linked], return_index=True)
            a += [ids[k]] * len(first)
            b += ids[linked[first]].tolist()
        tx.free()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = one.unionByName(left).unionByName(right).groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(docs: DataFrame, owner: str) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): doc_id, n, h1, h2, node, root, of (the least id of all that hang together)."""
    sketch = store.table(_sketch(docs).withColumn("node", F.monotonically_increasing_id()), "sketches", owner)
    full = sketch.where("n > 0 and doc_id is not null")
    # rows of one set are copies; the row with the smallest id stands for them
    first = F.min(F.struct("doc_id", "node"))
    copies = full.groupBy("n", "h1", "h2").agg(first.alias("_f"), F.count(F.lit(1)).alias("_rows"), F.count_distinct("doc_id").alias("_ids"))
    copies = store.table(copies.select("n", "h1", "h2", F.col("_f.node").alias("node"), F.col("_f.doc_id").alias("rep"), (F.col("_rows") > F.col("_ids")).alias("_repeated")), "copies", owner)
    repeated = not copies.where("_repeated").isEmpty()
    nodes = store.table(sketch.join(copies.select("node", "rep"), "node").select("node", "rep", "h1", "h2", "bands", "sig"), "nodes", owner)
    exploded = store.table(nodes.select("node", F.explode("bands").alias("bucket")), "bands", owner)
    # a lead is the least node by one of a few orders; xor with a mask gives an order that an aggregate of longs can take
    mask = F.element_at(F.array(*(F.lit(m) for m in LEADS)), (F.pmod(F.col("bucket"), F.lit(len(LEADS))) + 1).cast("int"))
    mixed = F.xxhash64("node").bitwiseXOR(mask)
    leads = exploded.groupBy("bucket").agg(F.min_by("node", mixed).alias("lead"), F.min("node").alias("_first"), F.max("node").alias("_last"))
    leads = leads.where(F.col("_first") != F.col("_last")).select("bucket", "lead")
    members = store.table(exploded.join(leads, "bucket"), "members", owner)
    pairs = members.where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    links = _confirm(store.table(pairs, "pairs", owner), docs, nodes, repeated, owner)
    labels = components(links, owner)
    rest = store.table(_rest(members.select("bucket", "node"), labels, nodes, docs, repeated, owner), "rest", owner)
    if not rest.isEmpty():
        labels = components(links.unionAll(rest), owner)
    rooted = copies.join(labels, "node", "left").select("n", "h1", "h2", "rep", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("of"))
    named = rooted.join(least, "root").drop("rep")
    own = F.col("doc_id").isNotNull()
    out = sketch.select("doc_id", "n", "h1", "h2", "node").join(named, ["n", "h1", "h2"], "left")
    return out.select("doc_id", "n", "h1", "h2", "node", F.when(own, F.col("root")).alias("root"), F.when(own, F.coalesce("of", "doc_id")).alias("of"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "op") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles >= 75 * shingles of either.
    Null, empty and blank texts have an empty set and no link.  A row without an
    id is kept and linked with nothing (component_id null).  Rows that repeat an
    id are judged row by row, each on its own text.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _classes(rows, owner).select("doc_id", F.col("n").alias("n_shingles"), F.col("of").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("of"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "op") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id; all columns stay.

    Null, empty and blank texts and rows without an id are in no group and all
    stay.  Rows that repeat an id are judged row by row: those of one set collapse
    to one, those of other texts stay.  An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = store.table(_classes(rows, owner), "classes", owner)
    grouped = found.where("root is not null")
    kept = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("_f")).select(F.col("_f.node").alias("node"))
    judged = store.table(grouped.join(kept.withColumn("_kept", F.lit(True)), "node", "left").select("doc_id", "h1", "h2", F.coalesce("_kept", F.lit(False)).alias("_kept")), "judged", owner)
    # an id goes or stays as a whole, but where it has several rows
    by_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    twice = store.table(by_id.where("_rows > 1").select(F.col("doc_id").alias("_id")), "twice", owner)
    several = twice.count()
    gone = judged.where("not _kept").select(F.col("doc_id").alias("_id"))
    if several:
        gone = gone.join(twice, "_id", "left_anti").unionAll(twice)
    gone = store.table(gone, "gone", owner)
    left = docs.join(store.bounded_broadcast(gone, gone.count(), BROADCAST_IDS), docs[id_col].cast("long") == F.col("_id"), "left_anti")
    if not several:
        return left
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at, said = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}").cast("string")
    plain = plain.join(store.bounded_broadcast(twice, several, BROADCAST_IDS), at == F.col("_id"), "left_semi").withColumns({"doc_id": at, "text": said})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in tx.steps(b)):
            hashes, offsets = tx.shingle_sets(batch.column("text"), WIDTH)
            yield pa.record_batch([*batch.columns[:-1], *map(pa.array, digests(hashes, offsets))], [*batch.schema.names[:-1], "h1", "h2"])

    marked = tx.in_batches(plain, run, f"{plain.drop('text').schema.toDDL()}, h1 long, h2 long")
    empty = marked.where("h1 = 0 and h2 = 0").drop("doc_id", "h1", "h2")
    stay = judged.where("_kept").select("doc_id", "h1", "h2")
    full = marked.where("h1 <> 0 or h2 <> 0").join(stay, ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"]).drop("doc_id", "h1", "h2")
    return left.unionAll(empty.unionAll(full).toDF(*names))
