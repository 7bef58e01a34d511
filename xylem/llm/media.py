"""Media columns: texts stored as 8-bit WAV sound and fingerprinted by pairs of spectral peaks.

`wav_columns` stores each text's UTF-8 bytes, filled with byte 255 to a positive multiple of 576, as the samples of a
mono WAV file, reads that file back with the wave module, and takes a short-time Fourier transform with windows of 576
samples at steps of 288.  Each frame gives its strongest bin in each of three bands; each such peak is paired with those
of the same band in the next FAN frames.  A pair is a (time, code) entry; the code packs band, both bins and the distance in time.

Nulls: a null text is the empty text, one window of byte 255.  Repeated rows get equal values, each in its own row.  An
empty table gives an empty one.  Other columns of the input are not read; clashing names cannot meet.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, small_batches

WINDOW, STEP, RATE, FAN = 576, 288, 8000, 3
BANDS = ((2, 48), (48, 144), (144, 289))
_HANN = np.hanning(WINDOW).astype(np.float32)
_SCHEMA = "{id} {type}, n_bytes long, media binary, payload_sha256 string, payload_bytes long, tail_crc32 long, n_frames long, times array<int>, codes array<long>"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(WINDOW, -(-len(raw) // WINDOW) * WINDOW) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peak_pairs(samples: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of frames, and the time and code of each pair of peaks, by time."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STEP]
    bins = np.empty((len(frames), len(BANDS)), np.int64)
    for i in range(0, len(frames), 2048):
        s = np.fft.rfft(frames[i : i + 2048] * _HANN, axis=1)
        power = s.real**2 + s.imag**2
        for b, (lo, hi) in enumerate(BANDS):
            bins[i : i + 2048, b] = lo + np.argmax(power[:, lo:hi], axis=1)
    times, codes = [], []
    for d in range(1, FAN + 1):
        if len(bins) > d:
            codes.append((((np.arange(len(BANDS)) << 9 | bins[:-d]) << 9 | bins[d:]) << 4 | d).ravel())
            times.append(np.repeat(np.arange(len(bins) - d), len(BANDS)))
    if not codes:
        return len(bins), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return len(bins), t[order], c[order]


def wav_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the WAV file and its fingerprint; see the module for the cases of odd input."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = _SCHEMA.format(id=f"`{id_col}`", type=kind.simpleString())

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i in range(0, batch.num_rows, 256):
                cols: list[list] = [[] for _ in range(8)]
                for text in batch.column(1)[i : i + 256].to_pylist():
                    media = to_wav(payload_of(text))
                    payload = from_wav(media)
                    n, t, c = peak_pairs(payload)
                    row = (len((text or "").encode("utf-8", "surrogatepass")), media, hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-32:]), n, t, c)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([ids[i : i + 256], *arrays], names=[id_col, "n_bytes", "media", "payload_sha256", "payload_bytes", "tail_crc32", "n_frames", "times", "codes"])

    return docs.select(id_col, text_col).transform(mapped, run, schema)


def op7_media_wav(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of the stored WAV and of its time-coded fingerprint."""
    out = wav_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    coded = F.concat_ws(",", F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", p["times"], p["codes"])))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "n_frames", F.size("codes"), F.md5(coded)).alias("feature"),
    )
