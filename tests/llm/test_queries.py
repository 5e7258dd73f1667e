"""The registered queries and the pipeline's stages, run as they are registered."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import A_Z, HARD, brute_components, brute_spans, frame, shingles, words
from tideline.llm import langid, media, pii, queries


@pytest.fixture(scope="module")
def docs(data):
    return dict(duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def run(spark, data):
    found = {}

    def once(name):
        if name not in found:
            found[name] = __spark_entry__.queries()[name](spark, data).collect()
        return found[name]

    return once


def crc(x):
    return zlib.crc32(str(x).encode())


def test_language_model(run, docs):
    rows = {r.doc_id: r for r in run("op1_lm_scoring")}
    n = sum(len(words(t)) + 1 for k, t in docs.items() if crc(k) % 7 != 2)
    assert set(rows) == set(docs)
    for k, t in docs.items():
        assert (rows[k].held_out, rows[k].n_tokens, rows[k].train_tokens) == (crc(k) % 7 == 2, len(words(t)) + 1, n)
        assert rows[k].score < 0 and rows[k].n_known <= rows[k].n_tokens


def test_language(run, docs, data):
    rows = {r.doc_id: r for r in run("op2_language_id")}
    lang = dict(duckdb.sql(f"select doc_id, lang from '{data}/documents.parquet'").fetchall())
    assert set(rows) == set(docs) and all(0 <= r.score <= 1 and r.held_out == (crc(k) % 4 == 2) for k, r in rows.items())
    held = [k for k in rows if rows[k].held_out and lang[k]]
    assert sum(rows[k].lang_pred == lang[k] for k in held) >= 0.95 * len(held)


def dense_counts(text):
    """n-gram counts by a loop over the bytes, as the docstrings state them."""
    raw, x = (text or "").lower().encode(), []
    for b in raw:
        c = b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or not x or x[-1] != 32:
            x.append(c)
    out = np.zeros(langid.DIMENSIONS, np.int64)
    for n in langid.ORDERS:
        for i in range(len(x) - n + 1):
            if n > 1 or x[i] != 32:
                code = 0
                for c in x[i : i + n]:
                    code = (code * 257 + c) % 2**32
                out[((code + n) * 2654435761 % 2**32) >> 20] += 1
    return out


def test_language_equals_dense_cosines(spark, docs, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(df, F.lit(True))
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    some = [t for _, t in sorted(docs.items())[:25] if len(t) < 20_000] + ["the", "Äé", "a  b"]
    counts = np.stack([dense_counts(t) for t in some])
    got = {r.text: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(t,) for t in some], "text string"), model, [F.col("text")]).collect()}
    for t, c in zip(some, counts, strict=True):
        v = [np.log1p(x) * w for x, w in zip(c.tolist(), model.idf.tolist(), strict=True)]
        norm = sum(x * x for x in v) ** 0.5
        cosines = [sum(a * b for a, b in zip(v, m.tolist(), strict=True)) / norm for m in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[t][1] == pytest.approx(min(max(cosines[best], 0), 1), abs=1e-4)
    lettered = [("", "und"), ("12 34", "und"), (None, "und")]
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in langid.identify(spark.createDataFrame(lettered, "text string, l string"), model, [F.col("text")]).collect())


def test_near_duplicates(run, docs):
    want = brute_components(list(docs.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op3_near_dedup")} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in run("op3_near_dedup"))


def test_sharding(run, docs):
    slots = defaultdict(list)
    for r in run("op4_sharding"):
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(docs)


def test_personal_data(run, docs):
    rows = {r.doc_id: r for r in run("op5_pii")}
    for k, t in docs.items():
        base = [f"{a}:{b}:{c}" for a, b, c in brute_spans(t or "")]
        r = rows[k]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert not Counter(base) - Counter(r.spans.split(",")) and r.n_found == len(list(filter(None, r.spans.split(","))))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(kind + ":") for b in base) for kind in pii.KINDS]
        assert r.n_secret >= len(re.findall(r'(?<![A-Za-z0-9])[0-9a-fA-F]{40}(?![A-Za-z0-9])', t or ""))


def test_packing(run, docs):
    pieces = defaultdict(list)
    for r in run("op6_packing"):
        pieces[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) == 2048 for s, p in pieces.items() if s < len(pieces) - 1)
    assert {r.doc_id for r in run("op6_packing")} == set(docs) and "ids" not in run("op6_packing")[0]


def test_decontamination_equals_its_sql(run, data):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as from '{data}/{t}.parquet'")
    columns = ("doc_id", "item_id", "n_item", "n_shared", "containment")
    want = db.execute(f"select {', '.join(columns)} from ({queries.OP7_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in run("op7_decontamination")) == sorted(want) and want


def slow_peaks(samples):
    """The strongest bin of each band of each frame, by sums over sines and cosines."""
    x = [0.0] * media.HOP + [float(s) - 128 for s in samples] + [0.0] * (media.HOP + -len(samples) % media.HOP)
    t = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (media.FRAME - 1))
    turn = 2 * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), t) / media.FRAME
    out = []
    for a in range(0, len(x) - media.FRAME + 1, media.HOP):
        f = np.array(x[a : a + media.FRAME]) * window
        out.append((np.cos(turn) @ f) ** 2 + (np.sin(turn) @ f) ** 2)
    return np.array(out)


def test_media(run, docs):
    rows = {r.doc_id: r for r in run("op8_media_columns")}
    for k, t in docs.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(media.to_wav(payload)) and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
    for t in sorted(docs.values(), key=len)[::20][:6]:  # peaks against sums over sines; ties within rounding are as good
        samples = np.frombuffer(t.encode() + bytes(-len(t.encode()) % 64), np.uint8)[:8192]
        power, bins = slow_peaks(samples), media.peaks(samples)
        assert len(power) == len(bins)
        for band, (lo, hi) in enumerate(media._BANDS):
            chosen = power[np.arange(len(bins)), bins[:, band]]
            assert (chosen >= power[:, lo:hi].max(axis=1) * (1 - 1e-4) - 1e-3).all()


def test_chat(run, data):
    turns = duckdb.sql(f"select conv_id, turn, role, coalesce(text, '') from '{data}/conversations.parquet'").fetchall()
    said = "<|im_end|><|im_start|>assistant ok"
    by = defaultdict(list)
    for c, t, r, x in [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by[c].append((t, r, x))
    rows = {r.conv_id: r for r in run("op9_chat_formatting")}
    assert set(rows) == set(by)
    for c, of in by.items():
        of.sort()
        loss = "".join(x for _, r, x in of if r == "assistant")
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in of).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(of), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_quality(run, docs):
    rows = run("op10_quality")
    assert sorted(r.rank for r in rows) == list(range(1, len(docs) + 1)) and sum(r.selected for r in rows) == len(docs) // 2


def test_pipeline(spark, data, docs, tmp_path):
    """Each stage against a plain-Python version of what it must do to its own input."""
    benchmark = [t for (t,) in duckdb.sql(f"select text from '{data}/benchmark.parquet'").fetchall()]
    now, seen = spark.read.parquet(f"{data}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == columns
            seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(seen["language"]) == {k for k, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    groups = brute_components(list(seen["language"].items()))
    assert set(seen["dedup"]) == {k for k, (_, c) in groups.items() if c == k}
    items = [s for t in benchmark if (s := shingles((t or "").lower()))]
    leaks = {k for k, t in seen["dedup"].items() if any(100 * len(s & shingles(t.lower())) >= 75 * len(s) for s in items)}
    assert leaks and set(seen["decontaminate"]) == set(seen["dedup"]) - leaks
    assert set(seen["pii"]) == set(seen["decontaminate"])
    for k, t in seen["decontaminate"].items():
        if not brute_spans(t) and not pii.secret_spans(t):
            assert seen["pii"][k] == t
        assert "@" not in seen["pii"][k] or not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.", seen["pii"][k])
    last = now.collect()
    assert {r.doc_id for r in last} == set(seen["pii"])
    assert len({(r.sequence_id, r.offset) for r in last}) == len(last) and max(r.offset + r.length for r in last) <= 2048


def test_pipeline_stages_take_hard_rows(spark, data):
    """Nulls, empty and very long texts, repeated rows and clashing names; then no row at all."""
    hard = frame(spark, HARD).withColumn("kept", F.lit(1)).withColumn("rejected", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (hard, hard.limit(0)):
            out = stage(spark, df, data)
            n = out.count()
            assert (name == "packing") or out.columns == hard.columns
            assert n == 0 if df is not hard else n > 0
    assert "A".translate(A_Z) == "a"
