"""Removal of repeated passages by relative factoring of documents.

The reference is the whole corpus, indexed in blocks by anchors. In every run
of 35 words (a window) the 8-word gram with the smallest hash is the window's
anchor, so equal windows have equal anchors at equal offsets, and windows of one
anchor lie side by side. An index block is the set of anchors that hash to it; it
holds, for each anchor, the distinct contexts (hashes of its windows) and how
often each occurs. A document is looked up in the blocks of its anchors and parsed
greedily from left to right: a factor starts at the first window that occurs
elsewhere and is extended word by word as long as the next window does too; the
parse goes on behind it. Factors of a window or more are the duplicate spans. All
windows that straddle a factor's borders have been looked up too, not only those
a parse starts at, so no repeated window is lost between two factors.

Equal contexts of a batch are counted before they are shuffled, and positions only meet
the contexts that repeat: a passage in a third of all documents is a handful of
rows in its index block, and the join with positions can be split. A common gram
in many different surroundings would put all of them into one block: such anchors
(found in every 64th document, which decides the layout and never a result) are
filed window by window instead.

Windows are told apart by 56 bits of a hash beside the 64 bits of their anchor's,
so n different windows of one anchor are confused with a probability of about
n * n / 2**57; words themselves are not compared.

Edge cases: null, empty and short texts have no window and lose nothing; rows
that repeat (same id and text) count as occurrences of their own; rows of one
id with different texts are told apart; very long texts are read in stretches
that overlap by a window; a table's own columns are kept in a struct, so names
never clash; a table without rows gives none; a window above 70 words is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import map_batches, mix, packed, prepare, run_hashes, window_hashes, word_hashes

WINDOW, GRAM = 35, 8
_BITS = np.uint64(20)
#: Documents are factored in stretches of at most this many windows, so few that
#: the index of each gram of a stretch (there are window - gram more) fits _BITS.
STRETCH = (1 << 20) - (1 << 12)
#: Bytes of a window's hash in its anchor's index block.
_HASH_BYTES = 7
#: Anchors of about this many contexts are split, found in one document of SAMPLED;
#: the most frequent HOTTEST of them at most are named to all tasks.
HOT, SAMPLED, HOTTEST = 20_000, 64, 100_000


NONE = np.zeros(0, np.uint64)


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each anchor of a
    stretch, in order, and the 56-bit hash of each window."""
    if window - gram + 1 > 63:
        raise ValueError(f"a mask has no room for windows of {window} words")
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, none.astype(np.int64), none.astype(np.int64), none
    grams = window_hashes(words, gram)
    if len(grams) > 1 << int(_BITS):
        raise ValueError(f"a stretch has {len(grams)} grams, more than {_BITS} bits can number")
    span = window - gram + 1
    key = (grams >> _BITS << _BITS) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    at = (key & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, n))
    return grams[at[first]], first, count, window_hashes(words, window) >> np.uint64(64 - 8 * _HASH_BYTES)


Split = tuple[np.ndarray, np.ndarray, np.ndarray]


def split_hot(anchor: np.ndarray, first: np.ndarray, count: np.ndarray, windows: np.ndarray, hot: np.ndarray) -> Split:
    """The contexts with those of hot anchors as one context for each window,
    under a key of anchor and window that equal windows share."""
    if not len(hot) or not len(anchor):
        return anchor, first, count
    found = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
    if not found.any():
        return anchor, first, count
    n = count[found]
    at = np.repeat(first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    keys = mix(np.repeat(anchor[found], n) ^ mix(windows[at]))
    return np.concatenate((anchor[~found], keys)), np.concatenate((first[~found], at)), np.concatenate((count[~found], np.ones(len(at), count.dtype)))


def hot_anchors(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Anchors with very many contexts, from a share of the documents: a layout,
    without effect on results. Its size is bounded by HOTTEST."""

    def run(batch: pa.RecordBatch):
        found = []
        for text in batch.column(0).to_pylist():
            for _, words in stretches(text, window):
                anchor, first, count, windows = anchors(words, window, gram)
                if len(anchor):
                    found.append(np.stack((anchor, context_hashes(anchor, windows, first, count))))
        if found:
            anchor, n = np.unique(np.unique(np.concatenate(found, axis=1), axis=1)[0], return_counts=True)
            yield {"anchor": pa.array(anchor.view(np.int64)), "n": pa.array(n)}

    some = documents.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(SAMPLED)) == 0)
    counts = map_batches(some, ["text"], run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") * SAMPLED >= HOT).orderBy(F.desc("n"), "anchor").limit(HOTTEST).select("anchor").toArrow()
    return np.sort(top["anchor"].to_numpy().astype(np.int64).view(np.uint64))


def stretches(text: str | None, window: int) -> Iterator[tuple[int, np.ndarray]]:
    words = word_hashes((text or "").encode())
    for start in range(0, max(1, len(words) - window + 1), STRETCH):
        yield start, words[start : start + STRETCH + window - 1]


def context_hashes(anchor: np.ndarray, windows: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each anchor with its windows."""
    return mix(run_hashes(mix(windows), first, first + count) + anchor)


def contexts(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: np.ndarray = NONE) -> DataFrame:
    """(anchor, context, n): the contexts of each anchor, those of one batch of
    documents counted before they leave the task."""

    def run(batch: pa.RecordBatch):
        anchor_parts, id_parts, first_parts, count_parts, window_parts, at = [], [], [], [], [], 0
        for text in batch.column(0).to_pylist():
            for _, words in stretches(text, window):
                anchor, first, count, windows = anchors(words, window, gram)
                anchor, first, count = split_hot(anchor, first, count, windows, hot)
                if len(anchor):
                    id_parts.append(context_hashes(anchor, windows, first, count))
                    anchor_parts.append(anchor)
                    first_parts.append(first + at)
                    count_parts.append(count)
                    window_parts.append(windows)
                    at += len(windows)
        if not at:
            return
        _, one, n = np.unique(np.concatenate(id_parts), return_index=True, return_counts=True)
        first, count = np.concatenate(first_parts)[one], np.concatenate(count_parts)[one]
        ends = np.cumsum(count)
        picked = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
        windows = np.concatenate(window_parts)[picked]
        data = np.ascontiguousarray(windows.view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES])
        offsets = np.concatenate(([0], ends)).astype(np.int32) * _HASH_BYTES
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield {"anchor": pa.array(np.concatenate(anchor_parts)[one].view(np.int64)), "context": blob, "n": pa.array(n)}

    return map_batches(documents, ["text"], run, "anchor long, context binary, n long")


def _joined(fn, rows: int = 50_000):
    """Pack the small outputs of ``fn`` into larger batches."""

    def run(batch: pa.RecordBatch):
        held, n = [], 0
        for out in fn(batch):
            held.append(out)
            n += len(next(iter(out.values())))
            if n >= rows:
                yield {k: pa.concat_arrays([h[k] for h in held]) for k in held[0]}
                held, n = [], 0
        if held:
            yield {k: pa.concat_arrays([h[k] for h in held]) for k in held[0]}

    return run


def repeated(index: DataFrame) -> DataFrame:
    """(context_id, mask): which windows of a context occur at least twice.

    A partition is read in order of anchor; only the anchor at hand is held, and
    anchors met once are passed over by the batch.
    """
    prepare(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # where the anchor at hand starts
            if cut == 0 and last == anchor[-1]:
                held.append(batch)
                continue
            if last is not None or cut:
                yield from solve([*held, batch.slice(0, cut)])
            held, last = [batch.slice(cut)], anchor[-1]
        yield from solve(held)

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        anchor, n = rows["anchor"].to_numpy(), rows["n"].to_numpy()
        same = np.concatenate(([False], anchor[1:] == anchor[:-1], [False]))
        keep = same[1:] | same[:-1] | (n > 1)
        if not keep.any():
            return
        kept = rows["context"].combine_chunks().filter(pa.array(keep))
        kept = kept.chunk(0) if isinstance(kept, pa.ChunkedArray) else kept
        anchor, n = anchor[keep].view(np.uint64), n[keep]
        blob = b"".join(kept.to_pylist())
        count = np.array(pa.compute.binary_length(kept)) // _HASH_BYTES
        raw = np.zeros((len(blob) // _HASH_BYTES, 8), np.uint8)
        raw[:, :_HASH_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, _HASH_BYTES)
        windows = raw.view(np.uint64).ravel()
        first = np.cumsum(count) - count
        key = windows * np.uint64(0x9E3779B97F4A7C15) + np.repeat(mix(anchor), count)
        _, inverse = np.unique(key, return_inverse=True)
        often = np.bincount(inverse, np.repeat(n, count))[inverse] >= 2
        place = (np.arange(len(windows)) - np.repeat(first, count)).astype(np.int64)
        mask = np.bitwise_or.reduceat(np.where(often, np.int64(1) << place, 0), first)
        hit = mask != 0
        ids, one = np.unique(context_hashes(anchor, windows, first, count)[hit].view(np.int64), return_index=True)
        yield pa.RecordBatch.from_pydict({"context_id": pa.array(ids), "mask": pa.array(mask[hit][one])})

    return index.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "context_id long, mask long")


def positions(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: np.ndarray = NONE) -> DataFrame:
    """(context_id, _id, _text, first): where each context stands."""

    def run(batch: pa.RecordBatch):
        for text, own, hashed in zip(*(c.to_pylist() for c in batch.columns)):
            for start, words in stretches(text, window):
                anchor, first, count, windows = anchors(words, window, gram)
                anchor, first, count = split_hot(anchor, first, count, windows, hot)
                if len(anchor):
                    ids = context_hashes(anchor, windows, first, count).view(np.int64)
                    yield {
                        "context_id": pa.array(ids), "_id": pa.array(np.full(len(ids), own)),
                        "_text": pa.array(np.full(len(ids), hashed)), "first": pa.array((first + start).astype(np.int32)),
                    }

    return map_batches(rows, ["text", "_id", "_text"], _joined(run), "context_id long, _id long, _text long, first int")


def factors(n: int, spans: list[dict] | None, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) words of the factors of a text of n words, by a greedy parse:
    each is the longest from where it starts, and the next one starts behind the
    last window of it."""
    often = np.zeros(max(0, n - window + 1) + 2, np.int8)  # with an end mark on both sides
    for span in spans or ():
        bits = np.array([span["mask"]], np.int64).view(np.uint8)
        at = span["first"] + np.flatnonzero(np.unpackbits(bits, bitorder="little"))
        often[at + 1] = 1
    edge = np.diff(often)
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + window - 1).tolist()))


def covered(n: int, spans: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    """Which of n words the factors cover."""
    gone = np.zeros(n, bool)
    for start, end in factors(n, spans, window):
        gone[start:end] = True
    return gone


def with_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every row as ``row`` with ``spans``, its repeated windows (null: none)."""
    hot = hot_anchors(documents, window, gram)
    masks = repeated(contexts(documents, window, gram, hot))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = packed(documents, doc_id.alias("_id"), F.xxhash64("text").alias("_text"))
    narrow = documents.select("text", doc_id.alias("_id"), F.xxhash64("text").alias("_text"))
    found = positions(narrow, window, gram, hot).join(masks, "context_id")
    spans = found.groupBy("_id", "_text").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))
    return rows.join(spans, ["_id", "_text"], "left").select("row", "spans")


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def run(batch: pa.RecordBatch):
        n, removed, sha = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode().split()
            gone = covered(len(words), spans, window)
            n.append(len(words))
            removed.append(int(gone.sum()))
            kept = words if not removed[-1] else [words[i] for i in np.flatnonzero(~gone)]
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": sha}

    rows = with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return map_batches(rows, ["row.doc_id", "row.text", "spans"], run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The table with the words of repeated windows taken out of ``text``;
    rows that lose nothing keep their text as it is."""
    prepare(documents.sparkSession)
    names = documents.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    words = texts[i].encode().split()
                    texts[i] = b" ".join(words[j] for j in np.flatnonzero(~covered(len(words), spans, window))).decode()
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return with_spans(documents, window).select("row.*", "spans").mapInArrow(run, documents.schema)
