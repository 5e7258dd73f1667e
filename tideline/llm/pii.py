"""Personal data: pattern spans, secrets, and terms that give protected entities away.

Pattern spans (email, ip, card, phone) and secrets (access keys, values named as
passwords or tokens, and runs of letters and digits that carry too much
information to be a word) are the protected entities.  All
words of their documents are candidates; corpus co-occurrence then tells how much
of an entity's information a word carries.  Words over the disclosure threshold
are found in all texts and, like the entities, generalised or removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
_ORDER = {k: n for n, k in enumerate((*KINDS, SECRET, TERM))}
#: A run of letters and digits is a secret if its characters carry so many bits (by their frequencies in it), so many
#: each, and at least this share of them are letters, and digits.
SECRET_BITS, SECRET_BITS_EACH, SECRET_SHARE = 56, 2.5, 1 / 8
#: Chance that words which only meet their entities by accident may have of one find among all pairs (Bonferroni).
CHANCE = 0.05
#: Rows of evidence that a task holds at a time.
HELD = 1 << 19
#: Share of an entity's information, log2(1 / P(entity)), that a word may disclose: PMI(entity, word) at most this share.
DISCLOSURE = 0.9
#: Bits of the filter of candidate words that every worker gets: a fixed size, whatever the corpus; its false hits only cost time.
FILTER_BITS = 1 << 23
#: Disclosing terms of one memory-mapped array.
ARRAY_TERMS = 1 << 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[A-Za-z0-9]{16,}")
#: How access keys of published formats start, and these formats.
_KEY_STARTS = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "AIza", "xox")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}[A-Za-z0-9])(?![A-Za-z0-9])")
#: A value that is assigned, and the end of a name that says it is a secret.
_VALUE = re.compile(r"[=:] ?[\"']?([A-Za-z0-9_+/.-]{7,}[A-Za-z0-9])")
_NAMED = re.compile(r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']? ?$")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans by start, then kind, in code points."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return _sorted(out)


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def is_secret(run: str) -> bool:
    n, digits = len(run), sum(c.isdigit() for c in run)
    bits = -sum(k * log2(k / n) for k in Counter(run).values())
    return min(digits, n - digits) >= SECRET_SHARE * n and bits >= max(SECRET_BITS, SECRET_BITS_EACH * n)


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Access keys of published formats, values said to be secrets (with a letter and a digit), and runs by their information."""
    told = [m.span(1) for m in _VALUE.finditer(text) if _NAMED.search(text, max(0, m.start() - 16), m.start()) and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]
    keys = [m.span() for m in _KEY.finditer(text)] if any(k in text for k in _KEY_STARTS) else []
    spans: list[tuple[int, int]] = []
    for a, b in sorted([*told, *keys, *(m.span() for m in _RUN.finditer(text) if is_secret(m[0]))], key=lambda s: (s[0], -s[1])):
        if not spans or b > spans[-1][1]:  # what lies in another secret is a part of it
            spans.append((a, b))
    return [(SECRET, a, b) for a, b in spans]


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def entity(kind: str, said: str) -> int:
    """One number for all spellings of an entity."""
    return _hash(kind + ":" + (said.lower() if kind == "email" else said if kind == SECRET else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", said)))


def _evidence(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, int]:
    """Hashes of the distinct words outside all spans, and the document's context: the least hash of three words in a row.

    Copies of a text have one context, and near copies mostly have.
    """
    starts, ends = [a for _, a, _ in spans], list(accumulate((b for _, _, b in spans), max))
    known: dict[str, int] = {}
    words = []
    for m in _WORD.finditer(text):
        i = bisect_left(starts, m.end()) - 1
        if i < 0 or ends[i] <= m.start():
            w = m[0].lower()
            words.append(known[w] if w in known else known.setdefault(w, _hash(w)))
    h = np.array([0, 0, *words], np.int64).view(np.uint64)
    runs = tx.combine(tx.combine(h[:-2], h[1:-1]), h[2:])[min(2, max(len(words) - 1, 0)) :]
    return np.fromiter(known.values(), np.int64, len(known)), int(runs.min().view(np.int64)) if len(runs) else 0


def _may_hold(texts: pa.Array) -> np.ndarray:
    """Which texts have a digit, an @ or the start of a key that may lack digits."""
    return pc.fill_null(pc.match_substring_regex(texts, "[0-9@]|A[KS]IA|gh[oprsu]_|AIza|xox[abprs]-"), False).to_numpy(zero_copy_only=False)


def evidence(rows: DataFrame) -> DataFrame:
    """entity, term and context of every document that holds an entity; term is null in the row that counts the entity's documents."""
    schema = pa.schema([(k, pa.int64()) for k in ("entity", "term", "context")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in tx.steps(b)):
            texts = batch.column("text").filter(pa.array(_may_hold(batch.column("text"))))
            for text in texts.to_pylist():
                if spans := _sorted(base_spans(text) + secret_spans(text)):
                    terms, context = _evidence(text, spans)
                    entities = sorted({entity(k, text[a:b]) for k, a, b in spans})
                    size = max(1, HELD // (len(terms) + 1))
                    for part in (entities[i : i + size] for i in range(0, len(entities), size)):
                        n = len(part) * (len(terms) + 1)
                        term = pa.array(np.tile(np.append(terms, 0), len(part)), mask=np.tile(np.arange(len(terms) + 1) == len(terms), len(part)))
                        yield pa.record_batch([pa.array(np.repeat(np.array(part, np.int64), len(terms) + 1)), term, pa.array(np.full(n, context, np.int64))], schema=schema)

    return tx.in_batches(rows, run, "entity long, term long, context long")


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all words in order: the hash, and the number of the text.

    Words never span white space, so each distinct piece between it is looked through once.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    found = [[_hash(w.lower()) for w in _WORD.findall(piece)] for piece in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((h for hs in found for h in hs), np.int64, int(size.sum()))
    n = size[codes]
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    first = (np.cumsum(size) - size)[codes]
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return flat[at], np.repeat(text, n)


def _term_counts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """term and the number of documents it stands in, for the terms of ``wanted`` (and a few by chance)."""
    return _counted(rows, _filter(wanted)).groupBy("term").agg(F.sum("n").alias("n_term"))


def _counted(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """term and n, documents of a task that it stands in: a row for each term that a task meets, or a few where it meets more than it may hold."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in (s for b in batches for s in tx.steps(b)):
            h, text = _words_of(batch.column("text"))
            known = held.value[h % FILTER_BITS >> 3] >> (h & 7).astype(np.uint8) & 1 > 0
            h, text = h[known], text[known]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            parts.append(np.unique(h[new], return_counts=True))
            size += len(parts[-1][0])
            if size > HELD:
                parts = [_summed(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:  # too many to sum up again and again
                    yield pa.record_batch([pa.array(x) for x in parts[0]], ["term", "n"])
                    parts, size = [], 0
        if size:
            yield pa.record_batch([pa.array(x) for x in _summed(parts)], ["term", "n"])

    return tx.in_batches(rows, run, "term long, n long")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of all parts and their sums."""
    terms, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(terms, kind="stable")
    terms, first = np.unique(terms[order], return_index=True)
    return terms, np.add.reduceat(n[order].astype(np.int64), first)


def _filter(wanted: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at the hash of each term: made of one bit field a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column("term").to_numpy(zero_copy_only=False) % FILTER_BITS] = True
        yield pa.record_batch([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in tx.in_batches(wanted.select("term").distinct().coalesce(16), run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def disclosing_terms(docs: DataFrame, owner: str = "op") -> DataFrame:
    """term (hash), entity and disclosure of each word that gives an entity away.

    Counts cover every document.  A word discloses an entity if PMI(entity, word)
    is at least DISCLOSURE times the entity's information, and if they meet in
    more contexts than by accident: the chance of so many, bounded as Hoeffding
    does it, times the number of all pairs is at most CHANCE.
    """
    rows = docs.select(F.col("text"))
    found = store.table(evidence(rows).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n_both")), "evidence", owner)
    entities = found.where("term is null").select("entity", F.col("contexts").alias("of"), F.col("n_both").alias("n_entity"))
    pairs = found.where("term is not null")
    n_pairs, total = pairs.count(), float(docs.count())

    def by_accident(n_term):
        """log of the chance that ``contexts`` or more of ``of`` draws hold a word of ``n_term`` of all documents."""
        q, p = F.col("contexts") / F.col("of"), n_term / F.lit(total)
        rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
        return F.when(q > p, -F.col("of") * (q * F.log(q / p) + rest)).otherwise(0.0)

    limit = float(np.log(CHANCE / max(n_pairs, 1)))
    # a word stands in at least the documents where it meets the entity: pairs that fail even so are out before words are counted
    pairs = store.table(pairs.join(entities, "entity").where(by_accident(F.col("n_both")) <= limit), "pairs", owner)
    if pairs.isEmpty():
        return pairs.select("term", "entity", F.lit(0.0).alias("disclosure"))
    both = pairs.join(_term_counts(rows, pairs), "term").where(by_accident(F.col("n_term")) <= limit)
    together = F.least("n_both", "n_term", "n_entity")
    pmi = F.log2(together * F.lit(total) / (F.col("n_term") * F.col("n_entity")))
    information = F.log2(F.lit(total) / F.col("n_entity"))
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    return both.select("term", "entity", share.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def find_spans(docs: DataFrame, keep: list, text_col: str = "text", owner: str = "op", redact: bool = False) -> DataFrame:
    """``keep`` with n_email, n_ip, n_card, n_phone, n_secret, n_found (all spans), base and spans for each document.

    ``base`` and ``spans`` are `kind:start:end` joined by commas, by start and
    then kind (``secret`` and ``term`` last), in code points, the end exclusive.  With
    ``redact``, ``clean`` is the text with every span replaced by its kind.  A
    null text is empty and has no span (its clean text stays null); ids, extra
    columns and repeated rows stay as they are; an empty table gives no rows.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    uri = store.new_path(docs.sparkSession, "terms.u8", owner)
    terms = store.table(disclosing_terms(texts, owner).select("term").distinct(), "terms", owner)
    parts = _write_sorted(terms, uri)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    counted = [*(f"n_{k}" for k in (*KINDS, SECRET)), "n_found"]
    more = [*counted, "base", "spans", *(["clean"] if redact else [])]
    schema = ", ".join([rows.drop("_text").schema.toDDL(), *(f"{k} {'long' if k in counted else 'string'}" for k in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [store.map_array(f"{uri}/{k}", "<i8") for k in range(parts)]
        for batch in (s for b in batches for s in tx.steps(b, "_text")):
            texts = batch.column("_text")
            digits, said = _may_hold(texts), np.zeros(len(texts), bool)
            if known:
                h, text = _words_of(texts)
                said[text[_known(h, known)]] = True
            out = []
            for text, look, told in zip(texts.to_pylist(), digits, said, strict=True):
                base = base_spans(text) if look else []
                spans = _sorted(base + secret_spans(text)) if look else base
                if told:
                    spans = _sorted(spans + _terms(text, known))
                count = [sum(s[0] == k for s in spans) for k in (*KINDS, SECRET)]
                out.append((*count, len(spans), _joined(base), _joined(spans), *([_redacted(text, spans)] if redact else [])))
            kinds = [pa.int64()] * len(counted) + [pa.string()] * (len(more) - len(counted))
            yield pa.record_batch([*(batch.column(k) for k in range(len(names))), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], [*names, *more])

    return tx.in_batches(rows, run, schema)


def _write_sorted(terms: DataFrame, uri: str) -> int:
    """The hashes of ``terms`` as sorted arrays of about ARRAY_TERMS in the shared folder; their number."""
    parts = -(-terms.count() // ARRAY_TERMS)
    if not parts:
        return 0

    def write(group: pa.Table) -> pa.Table:
        values = np.sort(group.column("term").to_numpy())
        store.write_array(f"{uri}/{values[0] % parts}", values)
        return pa.table({"n": pa.array([len(values)], pa.int64())})

    for k in range(parts):  # an array that gets no term is empty
        store.write_array(f"{uri}/{k}", np.empty(0, "<i8"))
    terms.select("term", F.pmod("term", F.lit(parts)).alias("part")).groupBy("part").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return parts


def _known(h: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Which hashes are disclosing terms."""
    hit = np.zeros(len(h), bool)
    for part, values in enumerate(known):
        mine = np.flatnonzero(h % len(known) == part)
        if len(values) and len(mine):
            hit[mine] = values[np.minimum(np.searchsorted(values, h[mine]), len(values) - 1)] == h[mine]
    return hit


def _terms(text: str, known: list[np.ndarray]) -> list[tuple[str, int, int]]:
    found = list(_WORD.finditer(text))
    h = np.fromiter((_hash(m[0].lower()) for m in found), np.int64, len(found))
    return [(TERM, *found[i].span()) for i in np.flatnonzero(_known(h, known))]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with overlapping spans taken together: entities become their kind, terms go."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], "" if kind == TERM else f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text", owner: str = "op") -> DataFrame:
    """``docs`` with personal data, secrets and disclosing terms out of the text; an ``n_chars`` column follows it.

    Every row stays, repeated ones too; null and empty texts stay as they are;
    other columns, whatever their names, are untouched; an empty table stays empty.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    keep = [F.col(f"c{k}") for k, name in enumerate(names) if name != text_col]
    found = find_spans(plain, keep, f"c{names.index(text_col)}", owner, redact=True)
    changed = F.col("spans") != ""
    columns = {n: F.col(f"c{k}") for k, n in enumerate(names)} | {text_col: F.col("clean")}
    if "n_chars" in columns and "n_chars" != text_col:
        columns["n_chars"] = F.when(changed, F.length("clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(columns["n_chars"])
    return found.select(*(columns[n].alias(n) for n in names))
