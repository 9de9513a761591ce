"""Byte-level BPE with reuse of content-defined chunks, and exact decoding.

A rolling hash over a text's bytes cuts it into chunks whose borders depend on
content alone, so copies and shared passages give the same chunks wherever they
stand. A worker encodes each chunk once and keeps it in a cache of bounded
bytes (README has the figures on why reuse ends at the worker). Cutting changes
tokens near a cut only. Each join is repaired: the text between an anchor on the
left (a non-space character before a space always ends a pre-token) and one on the
right is encoded again, and the window grows until its outer tokens agree with
those of both chunks, up to the whole neighbour.

Chunks are cut only for vocabularies that are checked when loaded to be plain
byte-level BPE with ids in the order of merges; with any other file the library
itself encodes and decodes whole texts.

Edge cases: a null text counts as empty, an empty one has no tokens; special
tokens in a text become their ids; texts without ASCII spaces have no anchor
and are encoded whole; ids are unaffected by batch, order or cache state; repeated
rows are kept and equal texts have equal ids; columns other than ``doc_id`` and
``text`` are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm.common import map_batches

#: Mean chunk of 2**CUT_BITS bytes, none below MIN_CHUNK; cache size in bytes.
CUT_BITS, MIN_CHUNK, CACHE_BYTES = 11, 512, 48_000_000
#: Texts all of whose characters are in this class may take the faster library;
#: other characters' classes could depend on a library's Unicode version.
_PLAIN = re.compile(r"[\t\n\r !-~¡-¬®-ɏ‐-‧€]*")
#: Fixed value: the pre-token pattern of this vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 2**32, 256, dtype=np.uint32)
_ANCHOR = np.zeros(256, dtype=bool)
_ANCHOR[0x21:0x7F] = True


def _byte_of() -> dict[str, int]:
    """The usual printable stand-ins for bytes: themselves, or 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def is_plain_byte_bpe(spec: dict) -> bool:
    """Whether a vocabulary file means what this module does: byte-level pre-tokens
    by the usual pattern, no normalizer, ids that rise with the merges, and special
    tokens that are split off as they stand."""
    model, pre, added = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or (spec.get("decoder") or {}).get("type") != "ByteLevel":
        return False
    if pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return False
    vocab, shown = model.get("vocab") or {}, set(_byte_of())
    special = {t["content"] for t in added}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges") or []]
    single = [v for k, v in vocab.items() if len(k) == 1 and k not in special]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:])) or len(single) != 256 or (merged and max(single) > merged[0]):
        return False
    return len(vocab) == len(merged) + 256 + sum(s in vocab for s in special) and all(shown.issuperset(k) for k in vocab if k not in special)


def cut_points(data: bytes) -> list[int]:
    """Chunk ends: content-defined, on character borders."""
    n = len(data)
    if n < 2 * MIN_CHUNK:
        return [n]
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):  # doubles the span of the rolling hash, 16 bytes at last
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    found = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    found = found[found < n]
    found = found[(raw[found] & 0xC0) != 0x80]
    cuts, last = [], 0
    for c in found.tolist():
        if c - last >= MIN_CHUNK and n - c >= MIN_CHUNK:
            cuts.append(c)
            last = c
    return [*cuts, n]


class Encoder:
    """One for each Python worker; kept between tasks."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._exact, self.whole_texts = path, None, not is_plain_byte_bpe(spec)
        if self.whole_texts:
            return
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.special = special
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for k, v in ranks.items():
            self.tokens[v] = k
        for k, v in special.items():
            self.tokens[v] = k.encode()
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self._split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.cache: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.held = self.hits = self.misses = 0

    def plain(self, data: bytes) -> np.ndarray:
        """Encode without cuts."""
        text = data.decode()
        if _PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def library(self) -> Tokenizer:
        if self._exact is None:
            self._exact = Tokenizer.from_file(self.path)
            self._exact.no_truncation()
            self._exact.no_padding()
        return self._exact

    def chunk(self, data: bytes) -> np.ndarray:
        key = hashlib.blake2b(data, digest_size=16).digest()
        got = self.cache.get(key)
        if got is not None:
            self.hits += 1
            self.cache.move_to_end(key)
            return got
        self.misses += 1
        got = self.plain(data)
        self.cache[key] = got
        self.held += got.nbytes + 200
        while self.held > CACHE_BYTES:
            self.held -= self.cache.popitem(last=False)[1].nbytes + 200
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.whole_texts:
            return np.array(self.library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if self._split is None or not any(s in text for s in self.special):
            return self._segment(text.encode())
        parts = [
            np.array([self.special[p]], np.uint32) if p in self.special else self._segment(p.encode())
            for p in self._split.split(text)
            if p
        ]
        return np.concatenate(parts)

    def _segment(self, data: bytes) -> np.ndarray:
        ends = cut_points(data)
        if len(ends) == 1:
            return self.chunk(data)
        raw = np.frombuffer(data, dtype=np.uint8)
        anchors = np.flatnonzero((raw[1:] == 0x20) & _ANCHOR[raw[:-1]]) + 1
        out: list[np.ndarray] = []
        start, kept = 0, 0  # start of the present chunk; bytes whose tokens are final
        ids = self.chunk(data[: ends[0]])
        at = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        for end, after in zip(ends, ends[1:]):
            right = self.chunk(data[end:after])
            right_at = end + np.concatenate(([0], np.cumsum(self.lengths[right])))
            left_to, right_from, middle = self._repair(data, anchors, ids, at, right, right_at, max(start, kept), end, after)
            out.append(ids[np.searchsorted(at, kept) : np.searchsorted(at, left_to)])
            if right_from < after:
                out.append(middle)
                ids, at = right, right_at
                start, kept = end, right_from
            else:  # no agreement inside the neighbour: both become one chunk
                ids, at = middle, left_to + np.concatenate(([0], np.cumsum(self.lengths[middle])))
                start, kept = left_to, left_to
        out.append(ids[np.searchsorted(at, kept) :])
        return np.concatenate(out)

    def _repair(self, data, anchors, left, left_at, right, right_at, low, end, high):
        """(p, q, ids of data[p:q]) such that tokens left of p and right of q stand."""
        i = np.searchsorted(anchors, end)
        j = np.searchsorted(anchors, end, side="right")
        reach = 1
        while True:
            p = anchors[i - reach] if i - reach >= 0 and anchors[i - reach] > low else low
            p0 = anchors[i - reach - 1] if i - reach - 1 >= 0 and anchors[i - reach - 1] > low else low
            q = anchors[j + reach - 1] if j + reach - 1 < len(anchors) and anchors[j + reach - 1] < high else high
            q1 = anchors[j + reach] if j + reach < len(anchors) and anchors[j + reach] < high else high
            again = self.plain(data[p0:q1])
            at = p0 + np.concatenate(([0], np.cumsum(self.lengths[again])))
            a, b = np.searchsorted(at, p), np.searchsorted(at, q)
            whole_left, whole_right = p == low, q == high
            same_left = whole_left or (
                at[a] == p and np.array_equal(again[:a], left[np.searchsorted(left_at, p0) : np.searchsorted(left_at, p)])
            )
            same_right = whole_right or (
                at[b] == q
                and np.array_equal(again[b:], right[np.searchsorted(right_at, q) : np.searchsorted(right_at, q1)])
                and q1 < high
            )
            if same_left and same_right:
                return p, q, again[a:b]
            reach *= 2

    def decode(self, ids: np.ndarray) -> str:
        if self.whole_texts:
            return self.library().decode(ids.tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()]).decode("utf-8", "replace")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def run(batch: pa.RecordBatch):
        coder, n, ids_sha, text_sha = Encoder.of(path), [], [], []
        for text in batch.column(1).to_pylist():
            ids = coder.encode(text or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
        yield {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    columns = (F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return map_batches(documents, columns, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, token ids and the digests of every row; each row is decoded again
    and must give its text."""

    def run(batch: pa.RecordBatch):
        coder = Encoder.of(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [coder.encode(t) for t in texts]
        decoded = [coder.decode(i) for i in ids]
        if decoded != texts:
            raise ValueError("a decoded text differs")
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        yield {
            "doc_id": batch.column(0), "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
            "token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))),
            "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
        }

    columns = (F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string"
    return map_batches(documents, columns, run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ``token_ids``; null ids give an empty text."""

    def run(batch: pa.RecordBatch):
        coder = Encoder.of(path)
        texts = [coder.decode(np.array(i or [], dtype=np.int64)) for i in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "text": pa.array(texts, pa.string())}

    return map_batches(encoded, ("doc_id", "token_ids"), run, "doc_id long, text string")
