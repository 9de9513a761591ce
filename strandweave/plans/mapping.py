"""Mapping plans: reads to a reference, mappability, and the greedy merge."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions.seq import shared_prefix
from strandweave.operators import contigs, graph
from strandweave.operators.index import MAX_BASES, Position, held, reverse_complement
from strandweave.operators.matching import Natural, matching_statistics, max_matchings, min_matchings, minimum_contexts, natural_map
from strandweave.operators.zipmap import Zip, zip_map
from strandweave.plans.runtime import materialize, prepare, running_sum


def _natural(q: str, index, p: Natural) -> tuple[list, dict[str, int]]:
    mapped = natural_map(q, index, p)
    return mapped.positions, mapped.stats


#: Named factories of mapping schemes: (query, index) -> positions and counters.
SCHEMES: dict[str, Callable] = {
    "natural": lambda **k: lambda q, index: _natural(q, index, Natural(**k)),
    "zip": lambda **k: lambda q, index: zip_map(q, index, Zip(**k)),
}
MAPPED = "read string, i int, ref string, ref_off long, text long, offset long, backwards boolean"


def collect_reference(contigs: DataFrame, key: str = "contig") -> list[tuple]:
    """(key, seq, genome) of a reference of bounded size, in key order."""
    bases = contigs.agg(F.sum(F.length("seq"))).first()[0] or 0
    if bases > MAX_BASES:
        raise ValueError(f"{bases} bases are too many to send to every task; use relational_statistics")
    return [(r[0], r[1], r[2]) for r in contigs.select(key, "seq", "genome").orderBy(key).collect()]


def index_arguments(reference: list[tuple], mask: list | None = None, canon: dict[Position, Position] | None = None) -> tuple:
    """A key of what an index is made from, and the arguments to make it."""
    arguments = ([r[1] for r in reference], [r[2] for r in reference], mask, canon)
    return hashlib.sha256(repr((*arguments[:3], sorted((canon or {}).items()))).encode()).hexdigest(), *arguments


def tasks(spark: SparkSession) -> int:
    """Tasks for rows that are few bytes and much work: a count that is given is kept."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(reads: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of reads (the last one ``seq``), dealt by sequence over all cores,
    equal ones behind each other. A file of reads may be a single task, and what a
    kernel finds for a read holds for its copies. A stream keeps its partitions."""
    rows = reads.select(*columns)
    if reads.isStreaming:
        return rows
    return rows.repartition(tasks(reads.sparkSession), "seq").sortWithinPartitions("seq")


def copies(reads: list[str]) -> Iterator[tuple[str, int]]:
    """(read, how many) of runs of equal reads."""
    return ((q, sum(1 for _ in same)) for q, same in groupby(reads))


def once[T](found: Callable[[str], T]) -> Callable[[str], T]:
    """``found`` of a read, kept until another read comes."""
    last: list = [None, None]

    def get(q: str) -> T:
        if last[0] != q:
            last[:] = q, found(q)
        return last[1]

    return get


def map_counters(
    reads: DataFrame, reference: list[tuple], scheme: str = "natural", mask: list | None = None,
    canon: dict[Position, Position] | None = None, **parameters,
) -> DataFrame:
    """(stat, value): what a scheme counts while it maps: bases mapped, credited,
    conflicted, unmapped and the like. Copies of a read are counted before they are
    dealt (in a stream, as they come), and counters are summed in each task."""
    prepare(reads.sparkSession)
    made = index_arguments(reference, mask, canon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, mapper, total = held(*made), SCHEMES[scheme](**parameters), Counter()
        counted = once(lambda q: mapper(q, index)[1])
        for batch in batches:
            every = batch.column(0).to_pylist()
            for q, n in zip(every, batch.column(1).to_pylist()) if batch.num_columns > 1 else copies(every):
                if q and "N" not in q.upper():
                    total.update({stat: n * value for stat, value in counted(q).items()})
        yield pa.RecordBatch.from_pydict({"stat": pa.array(list(total), pa.string()), "value": pa.array(list(total.values()), pa.int64())})

    own = reads.select("seq") if reads.isStreaming else reads.groupBy("seq").agg(F.count("*").alias("n")).repartition(tasks(reads.sparkSession), "seq")
    return own.mapInArrow(run, "stat string, value long").groupBy("stat").agg(F.sum("value").alias("value"))


def map_reads(
    reads: DataFrame, reference: list[tuple], scheme: str = "natural", mask: list | None = None,
    canon: dict[Position, Position] | None = None, **parameters,
) -> DataFrame:
    """One row for each base of each read (read, seq): its reference position on
    the forward strand (1-based), or nulls.

    The checked-size reference goes to each task once; reads are dealt by sequence,
    and copies are mapped once. A mapped base that differs raises.
    """
    prepare(reads.sparkSession)
    names = [str(r[0]) for r in reference]
    made = index_arguments(reference, mask, canon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(*made)
        mapper = SCHEMES[scheme](**parameters)

        def mapped(q: str) -> list[pa.Array]:
            out: list[list] = [[] for _ in range(5)]
            for i, p in enumerate(mapper(q, index)[0]):
                row: tuple = (None,) * 5
                if p is not None:
                    text, offset = p
                    if not canon and index.texts[text][offset] != q[i].upper():
                        raise ValueError(f"{q}: base {i} differs from where it is mapped")
                    forward = offset if not text & 1 else index.length(text) - offset - 1
                    row = (names[text // 2], forward + 1, text, offset, bool(text & 1))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return [pa.array(range(len(q)), pa.int32()), *(pa.array(c, k) for c, k in zip(out, kinds))]

        found = once(mapped)
        for batch in batches:
            own, rows = [], []
            for name, q in zip(batch.column(0), batch.column(1).to_pylist()):
                if q and "N" not in q.upper():
                    rows.append(found(q))
                    own.append(pa.repeat(name, len(q)))
            if rows:
                columns = [pa.concat_arrays(own), *(pa.concat_arrays(c) for c in zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, names=["read", "i", "ref", "ref_off", "text", "offset", "backwards"])

    return dealt(reads, F.col("read").cast("string"), F.col("seq").cast("string")).mapInArrow(run, MAPPED)


def matchings(reads: DataFrame, reference: list[tuple], shortest: bool) -> DataFrame:
    """(read, start, length, text, offset): unique matches that extend neither
    way, or (``shortest``) with no shorter one inside."""
    prepare(reads.sparkSession)
    made = index_arguments(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(*made)
        pick = min_matchings if shortest else max_matchings
        found = once(lambda q: [(m.start, m.length, *m.at) for m in pick(matching_statistics(q.upper(), index))])
        for batch in batches:
            rows = [(name, *m) for name, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in found(q or "")]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["read", "start", "length", "text", "offset"])

    schema = "read string, start int, length int, text long, offset long"
    return dealt(reads, F.col("read").cast("string"), F.col("seq").cast("string")).mapInArrow(run, schema)


#: Letters of a text that are taken apart at a time.
PIECE = 4096
#: Letters of a piece whose suffixes are taken: each counts its letters from the piece's start.
SHORT = 128


def beside_reads(rows: DataFrame) -> DataFrame:
    """Suffixes (s, asks, ..) without the reference's that are nobody's two nearest.

    Rows are range-partitioned and sorted. A suffix of the reference stays if a
    suffix of a read is among the two rows before or the two after it, or if it may
    be, beyond the ends of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = np.ones(2, bool), None  # what the two rows before ask; the rows not yet decided

        def kept(table: pa.Table, after: np.ndarray) -> pa.Table:
            asks = np.concatenate([before, table["asks"].to_numpy(), after])
            n = table.num_rows
            return table.filter(pa.array(asks[:n] | asks[1 : n + 1] | asks[2 : n + 2] | asks[3 : n + 3] | asks[4 : n + 4]))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            n = held.num_rows
            if n > 2:  # the last two wait for what follows
                asks = held["asks"].to_numpy()
                yield from kept(held.slice(0, n - 2), asks[n - 2 :]).to_batches()
                before, held = np.concatenate([before, asks[: n - 2]])[-2:], held.slice(n - 2)
        if held is not None:
            yield from kept(held, np.ones(2, bool)).to_batches()

    prepare(rows.sparkSession)
    dealt_rows = rows.repartitionByRange("s").sortWithinPartitions("s", "asks")
    return dealt_rows.mapInArrow(run, rows.schema)


def relational_matches(reads: DataFrame, texts: DataFrame, seed: int = 4) -> DataFrame:
    """(read, whole, i, longest, unique, text, offset): matching statistics for any size
    of reference (text, seq), and where the longest match lies if it lies at one place;
    ``whole`` is a hash of the read, which tells reads of one name apart.

    Suffixes of reads and of texts are range-partitioned and sorted together, those
    of texts that are no read's neighbours go, and the others are numbered through;
    the nearest two on each side hold the longest and the second longest match. A
    match is no longer than a read, so no suffix is carried beyond the longest read.
    Matches of less than ``seed`` bases are left out, and no shortest unique match
    below it is given.
    """
    s = F.col("seq")
    most = max(1, reads.agg(F.coalesce(F.max(F.length(s)), F.lit(0))).first()[0])
    none = F.lit(None).cast("long")
    # long texts are cut in pieces that overlap by a read first: a suffix then comes from a short row
    cut = contigs.pieces(texts.select("text", "seq"), "text", SHORT, most - 1).repartition(tasks(reads.sparkSession), "text", "start")
    own = F.explode(F.sequence(F.lit(1), F.least(F.length(s), F.lit(SHORT))))
    ref = cut.select("text", "start", own.alias("at"), s).select(
        F.substring("seq", F.col("at"), F.lit(most)).alias("s"), F.lit(False).alias("asks"), F.lit(None).cast("string").alias("read"), none.alias("whole"), F.lit(None).cast("int").alias("i"),
        F.col("text").cast("long").alias("text"), (F.col("start") + F.col("at") - 1).alias("offset"),
    )
    ask = reads.filter(F.length(s) >= seed).select(F.col("read").cast("string"), F.xxhash64(s).alias("whole"), F.explode(F.sequence(F.lit(1), F.length(s))).alias("at"), s).select(
        F.substring("seq", F.col("at"), F.lit(most)).alias("s"), F.lit(True).alias("asks"), "read", "whole", (F.col("at") - 1).alias("i"), none.alias("text"), none.alias("offset")
    )
    near = materialize(beside_reads(ref.unionByName(ask.filter(F.length("s") >= seed))))
    table = materialize(running_sum(near, ["s", "asks"], {"n": (~F.col("asks")).cast("long")}))
    numbered = table.filter("not asks").select("n", F.struct("s", "text", "offset").alias("r"))
    out = table.filter("asks").select("s", "read", "whole", "i", "n")
    matches = []
    for name, by in (("b1", 0), ("b2", -1), ("a1", 1), ("a2", 2)):
        out = out.join(numbered.select((F.col("n") - by).alias("n"), F.col("r").alias(name)).hint("merge"), "n", "left")
        matches.append(F.struct(F.coalesce(shared_prefix("s", f"{name}.s"), F.lit(0)).alias("l"), F.col(f"{name}.text").alias("text"), F.col(f"{name}.offset").alias("offset")))
    out = out.withColumn("m", F.sort_array(F.array(*matches), asc=False)).withColumns({"longest": F.col("m")[0]["l"], "second": F.col("m")[1]["l"]})
    only = F.col("second") < F.col("longest")
    return out.filter(F.col("longest") >= seed).select(
        "read", "whole", "i", "longest", F.when(only, F.greatest(F.col("second") + 1, F.lit(seed))).alias("unique"),
        F.when(only, F.col("m")[0]["text"]).alias("text"), F.when(only, F.col("m")[0]["offset"]).alias("offset"),
    )


def relational_statistics(reads: DataFrame, texts: DataFrame, seed: int = 4) -> DataFrame:
    """(read, i, longest, unique): matching statistics for any reference size."""
    return relational_matches(reads, texts.select(F.lit(0).alias("text"), "seq"), seed).select("read", "i", "longest", "unique")


def relational_matchings(reads: DataFrame, texts: DataFrame) -> DataFrame:
    """(read, start, length, text, offset): unique matches that extend neither way,
    as ``matchings`` has them, for any size of reference (text, seq)."""
    found = relational_matches(reads.withColumn("seq", F.upper("seq")), texts.withColumn("seq", F.upper("seq")), 1)
    before = F.max("longest").over(Window.partitionBy("read", "whole").orderBy("i").rangeBetween(-1, -1))
    # a base without any match has no row, and no longer match starts there
    found = found.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("unique").isNotNull() & (F.col("_before") <= F.col("longest")))
    return found.select("read", F.col("i").alias("start"), F.col("longest").alias("length"), "text", "offset")


SIDES = "read string, i int, base string, `left` string, `both` string, `right` string"


def map_sides(reads: DataFrame, reference: list[tuple], least: int = 0) -> DataFrame:
    """(read, i, base, left, both, right): for each base the side (a base's number
    among all, L or R) that the context to its left, to its right, or both single
    out. A context must be unique and have ``least`` bases or more."""
    prepare(reads.sparkSession)
    made = index_arguments(reference)
    starts = [0]
    for r in reference:
        starts.append(starts[-1] + len(r[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(*made)

        def ahead(q: str) -> list[Position | None]:
            return [at if unique is not None and longest >= least else None for longest, unique, at in matching_statistics(q, index)]

        def side(at: Position | None, name: str) -> tuple[int, str] | None:
            if at is None:
                return None
            text, offset = at
            if text & 1:
                return starts[text // 2] + index.length(text) - offset - 1, "LR"[name == "L"]
            return starts[text // 2] + offset, name

        shown = lambda s: None if s is None else f"{s[0]}{s[1]}"

        def sides(text: str) -> list[pa.Array]:
            q, rows = text.upper(), []
            behind = [None if x is None else index.flip(x) for x in reversed(ahead(reverse_complement(q)))]
            for i, (x, y) in enumerate(zip(behind, ahead(q))):
                left, right = side(x, "L"), side(y, "R")
                both = left if right is None else (right[0], "LR"[right[1] == "L"]) if left is None else left if left[0] == right[0] and left[1] != right[1] else None
                rows.append((i, q[i], shown(left), shown(both), shown(right)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            return [pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.string()] * 4))]

        found = once(sides)
        for batch in batches:
            got = [(name, found(q or "")) for name, q in zip(batch.column(0), batch.column(1).to_pylist())]
            if got:
                columns = [pa.concat_arrays([pa.repeat(name, len(rows[0])) for name, rows in got]), *(pa.concat_arrays(c) for c in zip(*(rows for _, rows in got)))]
                yield pa.RecordBatch.from_arrays(columns, names=["read", "i", "base", "left", "both", "right"])

    return dealt(reads, F.col("read").cast("string"), "seq").mapInArrow(run, SIDES)


def evaluate_mapability(contigs: DataFrame, reference: list[tuple], min_edit_bound: int = 0) -> DataFrame:
    """(contig, base, length): the shortest context that maps each base."""
    prepare(contigs.sparkSession)
    made = index_arguments(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(*made)
        for batch in batches:
            for name, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = minimum_contexts(q, index, min_edit_bound)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.int32())],
                    names=["contig", "base", "length"],
                )

    return contigs.select(F.col("contig").cast("string"), "seq").mapInArrow(run, "contig string, base int, length int")


# ---- the greedy merge -------------------------------------------------------------


def canonical(merges: DataFrame) -> DataFrame:
    """(base, canon, reversed): each merged base's block, as its least base."""
    return graph.oriented_components(merges).select(F.col("node").alias("base"), F.col("component").alias("canon"), "reversed")


def merge_greedy(spark: SparkSession, contigs: DataFrame, scheme: str = "natural", **parameters) -> tuple[DataFrame, DataFrame]:
    """Merge genomes one after the other: (merges, coverage).

    ``contigs``: contig (0..), seq, genome (0..). Genome g is mapped to the view of
    genomes before it, its bases join the blocks they map to, and canonical
    positions are worked out again. Genomes depend on each other in order; the
    contigs of one are mapped in parallel, and merges are materialised a round.
    """
    reference = collect_reference(contigs)
    lengths = [len(r[1]) for r in reference]
    starts = [sum(lengths[:i]) for i in range(len(lengths))]
    genomes = sorted({r[2] for r in reference})
    merges = spark.createDataFrame([], "a long, b long, opposite boolean")
    report = []
    start_of = spark.createDataFrame(list(zip(range(len(starts)), starts, lengths)), "contig long, cum long, len long")
    for n, genome in enumerate(genomes[1:], 1):
        canon = _canon_map(merges, starts, lengths)
        own = contigs.filter(F.col("genome") == genome).select(F.col("contig").cast("string").alias("read"), "seq")
        mapped = map_reads(own, reference, scheme, mask=genomes[:n], canon=canon or None, **parameters).filter("text is not null")
        a = mapped.withColumn("contig", F.col("read").cast("long")).join(F.broadcast(start_of), "contig")
        a = a.select((F.col("cum") + F.col("i")).alias("a"), F.shiftright("text", 1).alias("contig"), "text", "offset")
        b = a.join(F.broadcast(start_of), "contig")
        backwards = F.col("text") % 2 == 1
        at = F.when(backwards, F.col("len") - 1 - F.col("offset")).otherwise(F.col("offset"))
        new = materialize(b.select("a", (F.col("cum") + at).alias("b"), backwards.alias("opposite")))
        total = sum(len(r[1]) for r in reference if r[2] == genome)
        report.append((genome, new.select("a").distinct().count(), total))
        merges = materialize(merges.unionByName(new))
    coverage = spark.createDataFrame(report, "genome long, aligned long, bases long")
    return merges, coverage.withColumn("coverage", F.col("aligned") / F.col("bases"))


def _canon_map(merges: DataFrame, starts: list[int], lengths: list[int]) -> dict[Position, Position]:
    """Canonical positions of merged bases on both strands; as large as the
    reference at most, whose size is checked."""
    from bisect import bisect_right

    out: dict[Position, Position] = {}

    def position(base: int) -> tuple[int, int]:
        c = bisect_right(starts, base) - 1
        return c, base - starts[c]

    for r in canonical(merges).collect():
        (c, o), (d, p) = position(r.base), position(r.canon)
        forward, backward = (2 * d, p), (2 * d + 1, lengths[d] - 1 - p)
        if r.reversed:
            forward, backward = backward, forward
        out[2 * c, o], out[2 * c + 1, lengths[c] - 1 - o] = forward, backward
    return out


def scheme_plans(**grid: list) -> list[tuple[str, dict]]:
    """Names and arguments of a grid of schemes, e.g. map_type and bounds."""
    from itertools import product

    names = sorted(grid)
    return [("".join(f"{k.title().replace('_', '')}{v}" for k, v in zip(names, values)), dict(zip(names, values))) for values in product(*(grid[k] for k in names))]


def parameters_of(scheme: str) -> dict:
    return asdict({"natural": Natural(), "zip": Zip()}[scheme])
