"""Telephony audio columns: G.711 and IMA ADPCM decoding to resampled PCM.

Mu-law and A-law bytes are expanded by 256-entry lookup tables. ADPCM blocks
are decoded by numpy in step with each other: one pass over the samples of a
block, each step a vector over all blocks of a group of rows. Files are WAV.

The query stores each text as the samples of a mu-law WAV file in a table of the
shared folder, reads that table back, decodes it, stores the samples resampled
as a PCM WAV file, and reads its features from there. Long files are decoded in
pieces, so a task holds a few times the bytes of one file and no more.

Edge cases: a null payload counts as empty; an empty one still gives a file
with no samples; a step index above 88 is read as 88; a trailing partial ADPCM
block is refused; a broken or foreign file raises ``ValueError``; a file above
2**32 bytes is refused, as WAV cannot state its size; equal texts have equal
values, and repeated rows are kept; columns other than the key and the payload
are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import map_batches, persisted

MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1
RATE, RESAMPLED = 8000, 16000
#: Bytes of a block of ADPCM: a header of 4 and 188 bytes of two samples each.
BLOCK = 192
#: Payload bytes that are decoded together.
GROUP_BYTES = 4_000_000
#: Samples that are resampled at a time.
PIECE = 1 << 20

# Fixed values of IMA ADPCM: quantiser steps and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def _adpcm_changes() -> np.ndarray:
    """Signed change of the predictor for each (step index, nibble)."""
    step, code = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel()


_CHANGES = _adpcm_changes()
_NEXT = np.clip(np.arange(89)[:, None] + INDEX_CHANGE[None, :], 0, 88).astype(np.int32).ravel()


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """int16 samples, one row for each block."""
    if len(data) % block:
        raise ValueError("not a whole number of ADPCM blocks")
    blocks = data.reshape(-1, block)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (block - 4) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    at = 1
    for pair in codes:
        for nibble in (pair & 15, pair >> 4):
            slot = index * 16 + nibble
            value += _CHANGES[slot]
            np.clip(value, -32768, 32767, out=value)
            index = _NEXT[slot]
            out[at] = value
            at += 1
    return out.T


def resample(pcm: np.ndarray, rate: int = RATE, to: int = RESAMPLED) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    parts = list(resampled(pcm, lambda x: x, rate, to))
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def resampled(raw: np.ndarray, decode: Callable[[np.ndarray], np.ndarray], rate: int = RATE, to: int = RESAMPLED) -> Iterator[np.ndarray]:
    """The same in pieces, from stored samples that ``decode`` expands piece by piece."""
    n, step = len(raw) * to // rate, PIECE
    for start in range(0, n, step):
        at = np.arange(start, min(n, start + step), dtype=np.int64) * rate
        left, part = at // to, at % to
        low, high = int(left[0]), min(int(left[-1]) + 2, len(raw))
        x = decode(raw[low:high]).astype(np.int64)
        left -= low
        right = np.minimum(left + 1, len(x) - 1)
        yield (x[left] + (x[right] - x[left]) * part // to).astype(np.int16)


def wav(data: bytes, kind: int, rate: int = RATE) -> bytes:
    """A mono WAV file; mu-law and A-law have 8 bits a sample, PCM 16."""
    bits, align = {PCM: (16, 2), ADPCM: (4, BLOCK)}.get(kind, (8, 1))
    extra = {PCM: b"", ADPCM: struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1)}.get(kind, struct.pack("<H", 0))
    if len(data) > 0xFFFF_FF00:
        raise ValueError("too long for a WAV file")
    per_s = rate * BLOCK // (2 * (BLOCK - 4) + 1) if kind == ADPCM else rate * align
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_s, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def unwav(file: bytes) -> tuple[int, int, bytes]:
    """Format, rate and sample bytes of a WAV file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, None, 0
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", file, at + 8)
        elif name == b"data":
            if kind is None or at + 8 + size > len(file):
                break
            return kind, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("broken WAV file")


def to_pcm(file: bytes) -> np.ndarray:
    """int16 samples of a WAV file of any of the kinds."""
    kind, _, data = unwav(file)
    raw = np.frombuffer(data, dtype=np.uint8)
    if kind in TABLES:
        return TABLES[kind][raw]
    if kind == ADPCM:
        return decode_adpcm(raw).ravel()
    if kind == PCM:
        return raw.view("<i2")
    raise ValueError(f"unknown WAV format {kind}")


def pcm_file(file: bytes, to: int = RESAMPLED) -> bytes:
    """A PCM WAV file with the samples of another, resampled."""
    kind, rate, data = unwav(file)
    raw = np.frombuffer(data, dtype=np.uint8)
    if kind in TABLES:
        parts = resampled(raw, TABLES[kind].__getitem__, rate, to)
    else:
        parts = resampled(to_pcm(file), lambda x: x, rate, to)
    return wav(b"".join(p.astype("<i2").tobytes() for p in parts), PCM, to)


def adpcm_crcs(payloads: list[bytes]) -> list[int]:
    """crc32 of each payload's ADPCM samples. Blocks of many payloads are decoded
    together, and those of a long one in several groups."""
    most = GROUP_BYTES // BLOCK * BLOCK
    crcs, group, held = [0] * len(payloads), [], 0

    def flush() -> None:
        out = decode_adpcm(np.frombuffer(b"".join(part for _, part in group), dtype=np.uint8))
        at = 0
        for i, part in group:
            rows = len(part) // BLOCK
            crcs[i] = zlib.crc32(np.ascontiguousarray(out[at : at + rows]), crcs[i])
            at += rows

    for i, payload in enumerate(payloads):
        for at in range(0, len(payload), most):
            part = payload[at : at + most]
            if held + len(part) > most:
                flush()
                group, held = [], 0
            group.append((i, part))
            held += len(part)
    if group:
        flush()
    return crcs


def features(file: bytes, adpcm_crc: int) -> str:
    """Whole-number features of a stored file's bytes under each codec, and of the
    PCM file that it gives."""
    raw = np.frombuffer(unwav(file)[2], dtype=np.uint8)
    said = []
    for name, kind in (("mulaw", MULAW), ("alaw", ALAW)):
        size = np.abs(TABLES[kind].astype(np.int64))
        counts = np.bincount(raw, minlength=256)  # the bytes are many, their values 256
        said.append(f"{name}={int(counts @ size) // len(raw)}/{int(size[counts > 0].max())}")
    stored = pcm_file(file)
    return ";".join([*said, f"adpcm={adpcm_crc:08x}", f"pcm16k={zlib.crc32(unwav(stored)[2]):08x}"])


def store(payloads: DataFrame, key: str, payload: str, kind: int = MULAW, to: int = RESAMPLED) -> DataFrame:
    """Decode a column of telephony samples and store it as PCM WAV files."""

    def run(batch: pa.RecordBatch):
        files = [pcm_file(wav(data or b"", kind), to) for data in batch.column(1).to_pylist()]
        yield {"key": batch.column(0), "pcm_wav": pa.array(files, pa.binary())}

    columns = (F.col(key).cast("long").alias("key"), F.col(payload).cast("binary"))
    return map_batches(payloads, columns, run, "key long, pcm_wav binary")


def recorded(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text, padded with spaces to a positive
    multiple of 192 bytes, as the samples of a mu-law WAV file."""

    def run(batch: pa.RecordBatch):
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        files = [wav(t + b" " * ((-len(t)) % BLOCK if t else BLOCK), MULAW) for t in texts]
        yield {"doc_id": batch.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(files, pa.binary())}

    columns = (F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(documents, columns, run, "doc_id long, n_bytes long, media binary")


def digests(documents: DataFrame) -> DataFrame:
    """What is read back from the table of recorded texts, file by file."""

    def run(batch: pa.RecordBatch):
        files = batch.column(2).to_pylist()
        payloads = [unwav(f)[2] for f in files]
        yield {
            "doc_id": batch.column(0),
            "n_bytes": batch.column(1),
            "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
            "media_bytes": pa.array([len(f) for f in files], pa.int64()),
            "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
            "feature": [features(f, c) for f, c in zip(files, adpcm_crcs(payloads))],
        }

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(persisted(recorded(documents)), ("doc_id", "n_bytes", "media"), run, schema)
