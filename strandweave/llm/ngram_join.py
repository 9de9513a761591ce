"""Exact n-gram Jaccard join with prefix trees, and its connected components.

A document is the set of its word n-grams under one global order: rare grams by
hash, then frequent grams by rising document frequency. Documents with equal
sets are one node from then on.

1. Two sets that are similar enough share a gram in the first few of each (the
   prefix). Prefix grams are dealt out once, and a node stays in a gram's group
   only if another one there is of such a size, and has the gram at such a place,
   that enough of both sets is left to share from that gram on.
2. Within a group, two sets whose sizes or signatures rule a link out are not
   paired. A signature counts a set's grams in buckets; two sets differ in at
   least as many grams as their signatures do, so nothing is lost. What is left
   links the nodes of a candidate component.
3. Whole sets meet inside candidate components only, in a trie that is traversed
   once for each set: grams shared by many sets are compared once for all of
   them, and a subtree is left as soon as its partial overlap and remaining
   lengths rule it out. True links give the components. Nodes already connected
   are not compared again, so a group of copies costs links, not pairs.

The frequency order changes cost, never results. A group or candidate component
too large for one task is cut in tiles, each pair of which meets in one cell.

Edge cases: without words a set is empty, linked with nothing, and its own
component; fewer words than n form one gram; null texts are empty; rows that
repeat an id with other text are nodes of their own; a null id never names a
component that has another member.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import discard, map_batches, mix, packed, persisted, prepare, window_hashes, word_hashes
from strandweave.llm.components import components

#: A gram in this share of documents is ordered by frequency; how many at most.
FREQUENT, ORDERED = 1e-3, 1 << 18
#: Grams, or bytes of signatures, of one tile at most, about; and sets of one.
CELL, SETS = 8_000_000, 8_192
#: Prefix grams looked at together; nodes of a gram that are compared by place.
CHUNK, COMPARED = 1 << 16, 64
_HEAVY = np.uint64(1 << 63)


# ---- sets ------------------------------------------------------------------


def grams(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct gram hashes."""
    words = word_hashes((text or "").encode(), lower=True)
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else words


def frequent(documents: DataFrame, size: int, share: float = FREQUENT, most: int = ORDERED) -> np.ndarray:
    """Hashes of the most frequent grams, rarest first. Grams met once in a batch
    are not sent, and at most ``most`` are kept: this is only an order."""

    def run(batch: pa.RecordBatch):
        sets = [grams(t, size) for t in batch.column(0).to_pylist()]
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n > 1
        yield {"gram": pa.array(found[often].view(np.int64)), "n": pa.array(n[often])}

    n = documents.count()
    counts = map_batches(documents, ["text"], run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= max(2, share * n)).orderBy(F.desc("n"), "gram").limit(most).collect()
    return np.array([r.gram for r in reversed(top)], dtype=np.int64).view(np.uint64)


class Order:
    """Maps gram hashes to keys whose numeric order is the global order."""

    def __init__(self, heavy: np.ndarray):
        by_hash = np.argsort(heavy)
        self.heavy, self.rank = heavy[by_hash], by_hash.astype(np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        out = grams >> np.uint64(1)
        if len(self.heavy) and len(grams):
            at = np.minimum(np.searchsorted(self.heavy, grams), len(self.heavy) - 1)
            hit = self.heavy[at] == grams
            out[hit] = _HEAVY | (self.rank[at[hit]] << np.uint64(40)) | (grams[hit] & np.uint64((1 << 40) - 1))
        return np.sort(out)


def key_of(keys: np.ndarray) -> int:
    """The identity of a set."""
    return int(mix(np.array([mix(keys).sum() ^ mix(keys + np.uint64(77)).sum() + np.uint64(len(keys))], np.uint64)).view(np.int64)[0])


def needed(total: int, percent: int) -> int:
    """Smallest overlap of two sets of ``total`` elements that links them."""
    return -(-percent * total // (100 + percent))


def most_apart(total: int, percent: int) -> int:
    """In how many elements two linked sets of ``total`` elements or fewer differ
    at most. The bound for one total has its parity, so it falls between some
    totals and the next; the greatest is that of ``total`` or of the one before."""
    return max(t - 2 * needed(t, percent) for t in (total, total - 1))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


# ---- the trie --------------------------------------------------------------


class _Branch:
    __slots__ = ("run", "children", "entries", "low", "high", "parent")

    def __init__(self, run: np.ndarray, parent: "_Branch | None" = None):
        self.run, self.children, self.entries, self.parent = run, [], [], parent
        self.low, self.high = 1 << 62, 0


class Trie:
    """A radix tree over ordered sets, and bitmaps of their grams' parities.

    Two sets differ in at least as many grams as their bitmaps differ in bits.
    So for one set the bitmaps name, in one vector operation, the sets of other
    components that can be linked at all, and the traversal enters only branches
    that lead to those.
    """

    def __init__(self, keys: list[np.ndarray], percent: int, tiles: np.ndarray | None = None):
        self.keys, self.sizes, self.percent, self.tiles = keys, [len(k) for k in keys], percent, tiles
        self.root_of = np.arange(len(keys))
        self.home: list[_Branch] = [None] * len(keys)  # type: ignore[list-item]
        order = sorted(range(len(keys)), key=lambda i: keys[i].astype(">u8").tobytes())
        self.root = _Branch(np.zeros(0, np.uint64))
        self._grow(self.root, order)
        bits = 1 << min(20, max(10, (4 * max(self.sizes, default=1)).bit_length()))
        self.parity = np.zeros((len(keys), bits // 64), np.uint64)
        for i, k in enumerate(keys):
            odd = np.bincount((mix(k) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            self.parity[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)

    def _grow(self, branch: _Branch, order: list[int]) -> None:
        stack = [(branch, 0, 0, len(order))]
        while stack:
            branch, depth, lo, hi = stack.pop()
            for i in order[lo:hi]:
                branch.low, branch.high = min(branch.low, self.sizes[i]), max(branch.high, self.sizes[i])
            while lo < hi and len(self.keys[order[lo]]) == depth:
                branch.entries.append(order[lo])
                self.home[order[lo]] = branch
                lo += 1
            while lo < hi:
                first = self.keys[order[lo]]
                end = lo + 1
                while end < hi and self.keys[order[end]][depth] == first[depth]:
                    end += 1
                last = self.keys[order[end - 1]]
                most = min(len(first), len(last)) - depth
                differ = np.flatnonzero(first[depth : depth + most] != last[depth : depth + most])
                length = int(differ[0]) if len(differ) else most
                child = _Branch(first[depth : depth + length], branch)
                branch.children.append(child)
                stack.append((child, depth + length, lo, end))
                lo = end

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs that connect all linked sets; none inside a component."""
        sizes = np.array(self.sizes)
        order = np.argsort(sizes, kind="stable")
        ranked = sizes[order]
        for at, x in enumerate(order):
            end = np.searchsorted(ranked, 100 * sizes[x] // self.percent, side="right")
            others = order[at + 1 : end]  # larger sets; smaller ones have looked at x
            others = others[self.root_of[others] != self.root_of[x]]
            if self.tiles is not None:  # sets of one tile have met in its own cell
                others = others[self.tiles[others] != self.tiles[x]]
            near = []
            for part in (others[i : i + 4096] for i in range(0, len(others), 4096)):
                differ = np.bitwise_count(self.parity[part] ^ self.parity[x]).sum(axis=1, dtype=np.int64)
                total = sizes[x] + sizes[part]
                near += part[differ <= total - 2 * -(-self.percent * total // (100 + self.percent))].tolist()
            if near:
                yield from self._probe(int(x), set(near))

    def _probe(self, x: int, allowed: set[int]) -> Iterator[tuple[int, int]]:
        live: set[int] = set()
        for y in allowed:
            branch = self.home[y]
            while branch is not None and id(branch) not in live:
                live.add(id(branch))
                branch = branch.parent
        keys, size = self.keys[x], self.sizes[x]
        low, high = size, 100 * size // self.percent
        stack = [(child, 0, 0) for child in self.root.children]
        while stack:
            branch, depth, hits = stack.pop()
            if id(branch) not in live:
                continue
            run = branch.run
            at = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
            hits += int(np.count_nonzero(keys[at] == run))
            depth += len(run)
            past = int(np.searchsorted(keys, run[-1], side="right"))
            missed = past + depth - 2 * hits
            left, low_left, high_left = size - past, max(branch.low, low) - depth, min(branch.high, high) - depth
            gap = max(0, low_left - left, left - high_left)
            if missed + gap > most_apart(size + min(branch.high, high), self.percent):
                continue
            for y in branch.entries:
                if y in allowed and self.root_of[x] != self.root_of[y] and hits >= needed(size + self.sizes[y], self.percent):
                    self.root_of[self.root_of == self.root_of[y]] = self.root_of[x]
                    yield x, y
            stack += [(child, depth, hits) for child in branch.children]


class Signatures:
    """Sets of one group by their sizes and bucket counts."""

    def __init__(self, sizes: list[int], counts: list[np.ndarray], percent: int, tiles: np.ndarray | None = None):
        self.sizes, self.counts, self.percent, self.tiles = np.array(sizes), counts, percent, tiles

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs that connect all sets that may be linked."""
        order = np.argsort(self.sizes, kind="stable")
        sizes, percent = self.sizes[order], self.percent
        tiles = None if self.tiles is None else self.tiles[order]
        widths = np.array([len(self.counts[i]) for i in order])
        stacks = {w: np.stack([self.counts[i] for i in order[widths == w]]).astype(np.int32) for w in np.unique(widths)}
        row = np.zeros(len(order), np.int64)
        for w in stacks:
            row[widths == w] = np.arange((widths == w).sum())
        root = np.arange(len(order))
        for x in range(len(order)):
            end = np.searchsorted(sizes, 100 * sizes[x] // percent, side="right")
            others = np.arange(x + 1, end)
            others = others[root[others] != root[x]]
            if tiles is not None:
                others = others[tiles[others] != tiles[x]]
            own = stacks[widths[x]][row[x]]
            for w in np.unique(widths[others]):
                at = others[widths[others] == w]
                differ = np.abs(stacks[w][row[at]].reshape(len(at), len(own), -1).sum(axis=2) - own).sum(axis=1)
                total = sizes[x] + sizes[at]
                for y in at[differ <= total - 2 * -(-percent * total // (100 + percent))]:
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                        yield int(order[x]), int(order[y])


def signature(keys: np.ndarray) -> np.ndarray:
    """Counts of a set in 2**k buckets, about 24 grams to a bucket; larger sets
    have more, and neighbouring buckets add up to those of smaller sets."""
    bits = int(signature_length(np.array([len(keys)]))[0] // 2).bit_length() - 1
    return np.bincount((mix(keys) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def signature_length(sizes: np.ndarray) -> np.ndarray:
    """Bytes of the signatures of sets of these sizes."""
    return 2 << np.maximum(5, np.frexp(sizes // 24)[1].astype(np.int64))


# ---- the join --------------------------------------------------------------


def _cells(rows: DataFrame, total: str, n: str) -> DataFrame:
    """Rows with the cells (``_i``, ``_j``) of their group's grid of tiles, and
    their own tile ``_t``."""
    tiles = F.greatest(F.lit(1), F.ceil(F.col(total) / CELL), F.ceil(F.col(n) / SETS)).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    rows = rows.withColumn("_t", own).withColumn("_u", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return rows.withColumns({"_i": F.least("_t", "_u"), "_j": F.greatest("_t", "_u")}).drop("_u", total, n)


def _tiles_of(cell: pa.Table) -> np.ndarray | None:
    """The rows' tiles where two tiles meet; none in a tile's own cell."""
    return cell["_t"].to_numpy() if cell["_i"][0] != cell["_j"][0] else None


def _by_cell(rows: DataFrame, key: str, solve: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) from every cell with two rows or more; one cell is held at
    a time, and runs of lone rows are skipped by the batch."""
    keys = [key, "_i", "_j"]
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            new = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
            starts = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                cell = tuple(cells[:, a])
                if cell != last:
                    yield from flush(held)
                    held, last = [], cell
                held.append(batch.slice(a, b - a))
        yield from flush(held)

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts) > 1:
            edges = solve(pa.Table.from_batches(parts))
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ordered = rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "a long, b long")


def _candidate_edges(rows: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Candidate edges among the nodes of each shared gram."""

    def solve(cell: pa.Table) -> list[tuple[int, int]]:
        nodes = cell["node"].to_pylist()
        counts = [np.frombuffer(c, np.uint16) for c in cell["signature"].to_pylist()]
        return [(nodes[x], nodes[y]) for x, y in Signatures(cell["size"].to_pylist(), counts, percent, _tiles_of(cell)).links()]

    held = rows.join(signatures, "node")
    return _by_cell(_cells(held, "_total", "_n"), "gram", solve)


def sets(documents: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, size, key, prefix, signature) of every row."""

    def run(batch: pa.RecordBatch):
        n, nodes, prefixes, signatures = [], [], [], []
        for text in batch.column(1).to_pylist():
            keys = order.keys(grams(text, size))
            n.append(len(keys))
            nodes.append(key_of(keys) if len(keys) else None)
            signatures.append(signature(keys).tobytes())
            prefixes.append(keys[: prefix_length(len(keys), percent)].view(np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, prefixes)]).astype(np.int32))
        yield {
            "doc_id": batch.column(0), "text_hash": batch.column(2), "size": pa.array(n, pa.int64()), "key": pa.array(nodes, pa.int64()),
            "prefix": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes))),
            "signature": pa.array(signatures, pa.binary()),
        }

    columns = (F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return map_batches(documents, columns, run, "doc_id long, text_hash long, size long, key long, prefix array<long>, signature binary")


def meetable(gram: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which rows (a set's size, and the gram's place in it) may be linked with
    another of their gram. The first gram that two sets share is followed by all
    others, so no more is left in either than they share. Rows in falling or rising
    order of grams; where a gram has many, all of them may."""
    order = np.lexsort((size, gram))
    gram, size, left = gram[order], size[order], (size - place)[order]
    may = np.zeros(len(gram), bool)
    for by in range(1, min(COMPARED, len(gram) - 1) + 1):
        at = np.flatnonzero(gram[by:] == gram[:-by])
        if not len(at):
            break
        total = size[at] + size[at + by]
        at = at[np.minimum(left[at], left[at + by]) >= -(-percent * total // (100 + percent))]
        may[at] = may[at + by] = True
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    counts = np.diff([*starts, len(gram)])
    may |= np.repeat(counts > COMPARED + 1, counts)
    out = np.empty(len(may), bool)
    out[order] = may
    return out


def meeting(nodes: DataFrame, percent: int) -> DataFrame:
    """(gram, node, pos, _len) of the prefix grams by which nodes may be linked.
    A gram of more rows than a chunk keeps all of them; one chunk is held at a time."""
    prepare(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, hot = 0, None  # rows held; the gram whose first rows went out unseen

        def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            gram, places = rows["gram"].to_numpy(), rows["_at"].to_numpy()
            stays = meetable(gram, places >> 32, places & 0xFFFFFFFF, percent)
            if hot is not None:
                stays |= gram == hot
            if stays.any():
                gram, node, at = gram[stays], rows["node"].to_numpy()[stays], places[stays]
                columns = [pa.array(x) for x in (gram, node, (at & 0xFFFFFFFF).astype(np.int32), signature_length(at >> 32).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "node", "pos", "_len"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK:
                rows = pa.Table.from_batches(held)
                gram = rows["gram"].to_numpy()
                end = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                if not end:
                    hot, end = gram[-1], n
                yield from kept(rows.slice(0, end))
                held = rows.slice(end).to_batches()
                n -= end
        if n:
            yield from kept(pa.Table.from_batches(held))

    at = F.shiftleft("size", 32).bitwiseOR(F.col("pos").cast("long")).alias("_at")
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "gram")).select("gram", "node", at)
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "gram long, node long, pos int, _len int")


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of every node that may link with another.

    The first grams of each prefix go first; the others are only looked at
    where they are shared across the components found by then.
    """
    signatures = nodes.select("node", "size", "signature")
    exploded = persisted(meeting(nodes, percent))
    # of grams that the very same nodes share one stays
    nodes_hash = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"_h{i}") for i in (0, 1)]
    groups = exploded.groupBy("gram").agg(F.count("*").alias("_n"), F.sum("_len").alias("_total"), F.min("pos").alias("_first"), *nodes_hash)
    same = groups.filter("_n > 1").groupBy("_n", "_h0", "_h1").agg(F.min(F.struct("gram", "_total", "_first")).alias("g"))
    rows = persisted(exploded.join(same.select("_n", "g.*"), "gram"))
    discard(exploded)
    first = _candidate_edges(rows.filter("pos < 3").select("gram", "node", "_total", "_n"), signatures, percent)
    first = persisted(first)
    found = components(first)
    labelled = rows.select("gram", "node", "_total", "_n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("gram").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("gram")
    rest = labelled.drop("root").join(mixed, "gram", "left_semi")
    second = _candidate_edges(rest, signatures, percent)
    edges = first.unionByName(second)
    return components(edges)


def distinct_sets(table: DataFrame) -> DataFrame:
    """(node, key, doc_id, size, prefix, signature): one row for each set, under
    a small number instead of its 64-bit key, which packs better."""
    one = table.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.min_by(F.struct("prefix", "signature"), "text_hash").alias("_p")
    )
    return one.select(F.monotonically_increasing_id().alias("node"), "key", "doc_id", "size", "_p.*")


def links(documents: DataFrame, nodes: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """True links (a, b) between nodes; enough to connect every component."""
    found = candidates(nodes, percent)
    totals = found.join(nodes.select("node", "key", "doc_id", "size"), "node")
    sums = totals.groupBy("root").agg(F.sum("size").alias("_total"), F.count("*").alias("_n"))
    absent = F.lit(-(2**63))  # stands for a null id
    wanted = totals.join(sums, "root").select(F.coalesce("doc_id", absent).alias("doc_id"), "node", "key", "root", "_total", "_n")
    wanted = persisted(wanted)
    # few documents are wanted as a rule: Spark's runtime filter (of bounded size,
    # and without effect on results) keeps the others' texts from the shuffle
    spark = documents.sparkSession
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1t")  # else not beyond 10 MB
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), absent).alias("doc_id"), "text")
    texts = rows.join(wanted.filter("_total > 0"), "doc_id")

    def solve(cell: pa.Table) -> list[tuple[int, int]]:
        nodes, keys, at, seen = [], [], [], set()
        for i, (node, key, text) in enumerate(zip(cell["node"].to_pylist(), cell["key"].to_pylist(), cell["text"].to_pylist())):
            own = order.keys(grams(text, size)) if node not in seen else None
            if own is not None and key_of(own) == key:  # else a row of the same id with another text
                seen.add(node)
                nodes.append(node)
                keys.append(own)
                at.append(i)
        tiles = _tiles_of(cell)
        trie = Trie(keys, percent, None if tiles is None else tiles[at])
        return [(nodes[x], nodes[y]) for x, y in trie.links()]

    return _by_cell(_cells(texts, "_total", "_n").drop("doc_id"), "root", solve)


def join(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and text_hash of every row."""
    prepare(documents.sparkSession)
    order = Order(frequent(documents, size))
    wide = persisted(sets(documents, order, size, percent))
    nodes = persisted(distinct_sets(wide))
    table = persisted(wide.select("doc_id", "text_hash", F.col("size").alias("n_shingles"), "key"))
    discard(wide)
    roots = components(links(documents, nodes, order, size, percent))
    ids = nodes.select("node", "key", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = persisted(ids)
    discard(nodes)
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(least, "root").select("key", "component_id")
    out = table.join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


def deduplicated(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The row with the smallest id of each component, with the table's columns.
    Rows with equal id and text are one document."""
    found = join(documents, size, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    absent = F.lit(-(2**63))
    keep = found.select(F.coalesce("doc_id", absent).alias("_id"), F.col("text_hash").alias("_text")).distinct()
    rows = packed(documents, F.coalesce(F.col("doc_id").cast("long"), absent).alias("_id"), F.xxhash64("text").alias("_text"))
    return rows.join(keep, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select("row.*")
