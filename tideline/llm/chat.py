"""Chat formatting by schema fingerprints.

Records of many layouts (prompt and completion, instruction and output, message
lists, rows by turn) are recognised by a hash of their nested field paths.  The
hash selects a declarative mapping to canonical turns, which one template then
renders.  Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import text as tx

START, END = "<|im_start|>", "<|im_end|>"
#: Records of more field paths are of no layout: data used as names.
MOST_PATHS = 1000


def paths(value: Any, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; list items share a path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {at + "[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}") for f in kind.fields)) if kind.fields else {at + "{}"}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(found: set[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: Declarative mappings.  ``turns`` lists (role, path) of single texts; ``each``
#: names a list with the fields of its role and text; ``rows`` names the columns
#: of a table that has one row per turn.
LAYOUTS: list[dict[str, Any]] = [
    {"paths": [".conv_id", ".turn", ".role", ".text"], "rows": ("conv_id", "turn", "role", "text")},
    {"paths": [".prompt", ".completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": [".prompt", ".response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    {"paths": [".instruction", ".output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    {"paths": [".instruction", ".input", ".output"], "turns": [("user", ("instruction", "input")), ("assistant", "output")]},
    {"paths": [".system", ".prompt", ".response"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"paths": [".messages[].role", ".messages[].content"], "each": ("messages", "role", "content")},
    {"paths": [".conversations[].from", ".conversations[].value"], "each": ("conversations", "from", "value")},
]
MAPPINGS = {fingerprint(set(x["paths"])): x for x in LAYOUTS}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def select_mapping(found: set[str], rows: bool = False) -> dict[str, Any] | None:
    """The mapping whose fingerprint is that of ``found``, or of the most of its fields if there are others beside them."""
    if len(found) > MOST_PATHS:
        return None
    fit = [x for x in LAYOUTS if ("rows" in x) == rows and fingerprint(found & set(x["paths"])) in MAPPINGS and set(x["paths"]) <= found]
    return max(fit, key=lambda x: len(x["paths"]), default=None)


def _said(value: Any) -> str:
    """A text field; None for no value, an error for what is no text."""
    if value is not None and not isinstance(value, str):
        raise TypeError("not a text")
    return (value or "").encode("utf-8", "replace").decode()  # lone surrogates can't be stored


def record_turns(record: dict[str, Any]) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of a record, or None for a layout without mapping and for one that its values don't fit."""
    try:
        if (mapping := select_mapping(paths(record))) is None:
            return None
        if "each" in mapping:
            items, role, said = mapping["each"]
            return [(ROLES.get(_said(m[role]), _said(m[role])), _said(m[said])) for m in record[items]]
        out = []
        for role, fields in mapping["turns"]:
            parts = [_said(record[f]) for f in ((fields,) if isinstance(fields, str) else fields)]
            out.append((role, "\n\n".join(p for p in parts if p)))
        return out
    except (KeyError, TypeError, AttributeError, RecursionError):  # fields that only some items have, or values of another type
        return None


def canonical_turns(df: DataFrame, json_col: str | None = None, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text from a table of any mapped layout.

    Without ``json_col`` the table's own schema is fingerprinted and must have a
    mapping of rows by turn.  With it, each row's JSON is fingerprinted; a record
    that is null, not an object, of an unknown layout, or with values that its
    layout does not fit gives one row with turn -1, role ``unmapped`` and its
    JSON, so that nothing is lost.  Either way fields beyond the mapping's are
    left out of the fingerprint.
    """
    if json_col is None:
        found = schema_paths(df.schema)
        mapping = select_mapping(found, rows=True)
        if mapping is None:
            raise ValueError(f"no mapping for a table with the fields {sorted(found)}")
        conv, turn, role, said = mapping["rows"]
        return df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(said).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, raw in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "raw")), strict=True):
                try:
                    record = json.loads(raw) if raw else None
                except (ValueError, RecursionError):
                    record = None
                turns = record_turns(record) if isinstance(record, dict) else None
                rows += [(conv, -1, "unmapped", raw or "")] if turns is None else [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text"])

    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).cast("string").alias("raw")).transform(tx.in_batches, run, "conv_id long, turn long, role string, text string")


# --- the template -----------------------------------------------------------


def escape(text: Any) -> Any:
    """A column with every ``<|`` and every escape mark made harmless: ``\\`` to ``\\\\``, ``<|`` to ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


_PLAIN = {"<\\|": "<|", "\\\\": "\\", "\\n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"<\\\||\\\\|\\n", lambda m: _PLAIN[m[0]], text)


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Each turn rendered: conv_id, turn, formatted, mask_start, mask_length, ordinal.

    A conversation's formatted text is its rows' ``formatted`` in (turn, role,
    text) order, so a conversation of any length is never one value in memory.
    The loss mask covers the escaped text of turns by ``learn`` (code points
    inside ``formatted``; length 0 elsewhere).  Null role and text are empty,
    rows with a null conv_id form one conversation, repeated rows all stay.
    """
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    masked = F.col("role") == learn
    return turns.select(
        "conv_id", "turn", F.struct("turn", "role", "text").alias("ordinal"),
        F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.when(masked, F.length(head)).otherwise(0).alias("mask_start"),
        F.when(masked, F.length(body)).otherwise(0).alias("mask_length"),
    )


def parse(formatted: str) -> tuple[str, str]:
    """Role and text read back from a rendered turn."""
    role, _, rest = formatted.removeprefix(START).partition("\n")
    return unescape(role), unescape(rest.removesuffix(END + "\n"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns: counts and hashes.

    Turns stream through each task in order; what is held is one hash state, so
    a conversation with a third of all rows needs no more memory than any other
    (a digest of a sequence is one task's work).  Null ids are one conversation,
    empty texts give turns of no text, repeated rows count, an empty table gives
    no rows.
    """
    dealt = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "ordinal")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: Any = None  # conv_id, turns, hash, loss chars, loss hash, chars

        def close() -> None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_length"))
            for conv, said, start, length in zip(*columns, strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(said)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if start:
                    loss = unescape(said[start : start + length])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(said)
            if len(done) > 10_000:
                yield out(done)
                done = []
        if now is not None:
            close()
        yield out(done)

    def out(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return tx.in_batches(dealt.select("conv_id", "formatted", "mask_start", "mask_length"), run, schema)
