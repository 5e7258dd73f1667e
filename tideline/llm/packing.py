"""Concatenate and cut: pack token streams into fixed windows.

Pass one tokenizes every text once and keeps the ids with each row's offset
inside its partition.  Prefix sums over the partitions' token totals turn those
offsets into global ones.  Pass two cuts at the multiples of the window; the
records of a window's boundary are the pieces that end and begin there.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm import text as tx

#: Up to so many partition totals (16 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_PARTITIONS = 500_000
#: Distinct words whose ids one Python worker remembers.
WORD_CACHE = 200_000

_loaded: dict[str, WordIds] = {}
#: Byte-level models show each byte as a letter; those of two-byte Latin letters are all shown as U+0100 + n or as themselves.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_kind(path: str, tokenizer=None) -> str:
    from tokenizers import Tokenizer

    return "<u2" if (tokenizer or Tokenizer.from_file(path)).get_vocab_size() <= 1 << 16 else "<u4"


class WordIds:
    """Ids of single words by a tokenizer file, each distinct piece encoded once per worker.

    A word of lower-case Latin letters with closing punctuation is two pieces,
    which the tokenizer's own rules also part; the first goes straight to its
    merge model.  Any other word goes through the whole tokenizer.  Ids are kept
    in ``kind``: two bytes, or four for a vocabulary beyond 65,536.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_kind(path, self.tokenizer)
        self.known: dict[str, bytes] = {}
        self.model, self.simple = self.tokenizer.model, False
        plain, odd = "thing", "étoile"
        with contextlib.suppress(Exception):  # a model without these rules takes the long way
            self.simple = all(self._letters(x) == self._whole([x])[0] for x in (plain, odd)) and self._whole([plain + ".,"])[0] == self._letters(plain) + self._whole([".,"])[0]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word if word.isascii() else "".join(_BYTE_LETTER[b] for b in word.encode()))], self.kind).tobytes()

    def _look_up(self, words: list[str], simple: bool) -> list[bytes]:
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        new = [w for w in words if w not in known]
        if new:
            known.update(zip(new, map(self._letters, new) if simple else self._whole(new), strict=True))
        return [known[w] for w in words]

    def __call__(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Pieces, and the numbers of the two pieces of each word (the second may be empty)."""
        simple = pc.and_(pc.match_substring_regex(words, "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,!?;:]*$"), self.simple)
        stem = pc.utf8_rtrim(pc.utf8_lower(words), ".,!?;:")
        tail = pc.if_else(simple, pc.replace_substring_regex(words, "^.*?([.,!?;:]*)$", "\\1"), words)
        stem, tail = pc.if_else(simple, stem, "").dictionary_encode(), tail.dictionary_encode()
        pieces = self._look_up(stem.dictionary.to_pylist(), True) + self._look_up(tail.dictionary.to_pylist(), False)
        return pieces, np.stack([stem.indices.to_numpy(zero_copy_only=False).astype(np.int64), tail.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(stem.dictionary)], axis=1)


def encode(texts: pa.Array, ids_of: WordIds, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end``, and the offsets of each text.

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its words in order.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    coded = flat.dictionary_encode()
    pieces, of_word = ids_of(coded.dictionary)
    codes = of_word[coded.indices.to_numpy(zero_copy_only=False)].ravel()
    each = np.dtype(ids_of.kind).itemsize
    sizes = np.fromiter((len(p) // each for p in pieces), np.int64, len(pieces))
    pool = np.frombuffer(b"".join(pieces), ids_of.kind)
    first = np.cumsum(sizes) - sizes
    n = sizes[codes]
    before = np.concatenate([[0], np.cumsum(n)])
    offsets = before[at * 2] + np.arange(len(at))  # an end id after each text
    out = np.full(offsets[-1], end, ids_of.kind)
    body = np.ones(len(out), bool)
    body[offsets[1:] - 1] = False
    out[body] = pool[np.repeat(first[codes] - before[:-1], n) + np.arange(before[-1])]
    return out, offsets


def tokenize(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, local (tokens of the partition before the row), n and ids (little-endian, of ``id_kind``'s size)."""
    schema = "doc_id long, part int, local long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, local = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in (s for b in batches for s in tx.steps(b)):
            ids, offsets = encode(batch.column("text"), ids_of, end)
            n = np.diff(offsets)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(local + offsets[:-1]), pa.array(n), raw], ["doc_id", "part", "local", "n", "ids"])
            local += int(offsets[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(tx.in_batches, run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", owner: str = "op", with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a packed sequence of ``window`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and (``with_ids``) ids (array<int>).  A null or empty text is its end id alone.  Rows that
    repeat an id are documents of their own; a null id stays null; an empty
    table gives no rows.  Only the last sequence has padding.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = id_kind(tokenizer)
    rows = store.table(tokenize(docs, tokenizer, end, id_col, text_col), "tokens", owner)
    totals = rows.groupBy("part").agg(F.sum("n").alias("_total"))
    base = totals.select("part", (F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("_base"))
    base = store.table(base.select("part", F.coalesce("_base", F.lit(0)).alias("_base")), "bases", owner)
    placed = rows.join(store.bounded_broadcast(base, base.count(), BROADCAST_PARTITIONS), "part").select("doc_id", (F.col("_base") + F.col("local")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            out: list[tuple] = []
            held = 0
            for k, raw in enumerate(batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                edges = np.arange(-(at[k] % window), n[k] + window, window).clip(0, n[k])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if b > a:
                        g = int(at[k]) + a
                        out.append((k, a, b - a, zlib.crc32(ids[a:b]), int(n[k]), g // window, g % window, ids[a:b]))
                        held += b - a
                if held > 1 << 21:
                    yield rows_of(batch, out)
                    out, held = [], 0
            if out:
                yield rows_of(batch, out)

    def rows_of(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        k, start, length, crc, n, seq, off, ids = zip(*out, strict=True)
        where = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(where), pa.array(np.concatenate(ids).astype(np.int32)))] if with_ids else []
        return pa.record_batch([batch.column("doc_id").take(pa.array(k)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n, seq, off)), *lists], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return tx.in_batches(placed, cut, schema)
