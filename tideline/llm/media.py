"""Media columns: texts as WAV, read by the ``wave`` module, and fingerprinted.

A fingerprint is made of pairs of spectral peaks of a short-time Fourier
transform: (anchor bin, target bin, distance in frames), coded with the
anchor's time.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx

#: The payload is padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Frames overlap by half: the window, which is zero at its ends, then weighs every sample in one of its two frames at least by half.
FRAME, HOP, RATE = 256, 128, 8000
#: Peaks are the largest bins of a frame; each pairs with the peaks of the next frames (of 768 samples).
REACH = 6
_BANDS = ((1, 16), (16, 48), (48, 129))


def to_wav(payload: bytes) -> bytes:
    """``payload`` as a mono WAV of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV, as the ``wave`` module reads them."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def frames_of(samples: np.ndarray) -> np.ndarray:
    """All samples in overlapping frames, every sample in two: silence stands before the first and fills up the last."""
    x = np.pad(samples.astype(np.float32) - 128, (HOP, HOP + -len(samples) % HOP))
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each band in each frame of the transform: (frames, bands)."""
    frames = frames_of(samples)
    out = []
    for a in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[a : a + 4096] * np.hanning(FRAME).astype(np.float32), axis=1))
        out.append(np.stack([power[:, lo:hi].argmax(axis=1) + lo for lo, hi in _BANDS], axis=1))
    return np.concatenate(out).astype(np.int64)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Peak pairs as one long each: frame << 24 | anchor bin << 16 | target bin << 8 | distance in frames."""
    p = peaks(samples)
    t = np.arange(len(p))
    out = [(t << 24 | p[:, i] << 16 | p[:, j] << 8)[:, None] for i in range(p.shape[1]) for j in range(i + 1, p.shape[1])]
    for d in range(1, REACH + 1):
        if len(p) > d:
            pair = t[:-d, None] << 24 | p[:-d] << 16 | p[d:] << 8 | d
            out.append(np.pad(pair, ((0, d), (0, 0)), constant_values=-1))
    pairs = np.concatenate(out, axis=1).ravel()
    return pairs[pairs >= 0]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, n_bytes, media (WAV), payload (read back) and fingerprint.

    A null text is empty; an empty text is 64 zero bytes.  Equal texts give
    equal values; repeated rows and null ids stay as they are; an empty table
    gives no rows.  Whole texts are used, to the last byte, in steps of bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in tx.steps(b, size=2 << 20)):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            media = [to_wav(t + bytes(-len(t) % UNIT or (0 if t else UNIT))) for t in texts]
            back = [from_wav(m) for m in media]
            prints = [fingerprint(np.frombuffer(b, np.uint8)) for b in back]
            at = np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prints)))
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), lists], ["doc_id", "n_bytes", "media", "payload", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(tx.in_batches, run, "doc_id long, n_bytes long, media binary, payload binary, fingerprint array<long>")
