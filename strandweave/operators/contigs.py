"""Contigs, strands, shredding and coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import seq
from strandweave.plans.runtime import prepare


def mask_to_bases(text, unknown: str = "N"):
    """Upper-case sequence with every character that is no base as N."""
    return F.upper(F.regexp_replace(seq.col(text), "[^ACGTacgt]", unknown))


def split_contigs(scaffolds: DataFrame, key: str = "name", sequence: str = "seq") -> DataFrame:
    """(key, part, start, length, seq): maximal runs without N; start is 0-based.

    Pieces alternate between N runs and contigs, so a start is the running
    length of the pieces before. Scaffolds are dealt by key before they are
    taken apart: the short rows move, the many pieces don't.
    """
    pieces = F.regexp_extract_all(F.upper(F.col(sequence)), F.lit("(N+|[^N]+)"), F.lit(1))
    rows = scaffolds.repartition(key).select(key, F.posexplode(pieces).alias("_p", "seq"))
    w = Window.partitionBy(key).orderBy("_p")
    contig = ~F.startswith("seq", F.lit("N"))
    rows = rows.withColumns({
        "length": F.length("seq").cast("long"), "start": F.sum(F.length("seq")).over(w) - F.length("seq"),
        "part": F.sum(contig.cast("int")).over(w) - 1,
    })
    return rows.filter(contig).select(key, F.col("part").cast("int").alias("part"), "start", "length", "seq")


def contig_values(scaffolds: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, part, seq) of the contigs, without coordinates: linear in length."""
    found = F.regexp_extract_all(F.col(sequence), F.lit("[ACGT]+"), F.lit(0))
    return scaffolds.select(key, F.posexplode(found).alias("part", "seq"))


def double_strand(contigs: DataFrame, contig: str = "contig", sequence: str = "seq") -> DataFrame:
    """Two texts a contig: 2c forward, 2c + 1 reverse complement."""
    both = F.array(
        F.struct(F.lit(0).alias("s"), F.col(sequence).alias("q")),
        F.struct(F.lit(1).alias("s"), seq.reverse_complement(sequence).alias("q")),
    )
    rest = [c for c in contigs.columns if c != sequence]
    rows = contigs.select(*rest, F.explode(both).alias("_b"))
    return rows.select(
        (F.shiftleft(F.col(contig).cast("long"), 1) + F.col("_b.s")).alias("text"), *rest,
        (F.col("_b.s") == 1).alias("reverse"), F.col("_b.q").alias("seq"),
    )


def shred(sequences: DataFrame, key: str = "name", sequence: str = "seq", size: int = 200, spacing: int = 100) -> DataFrame:
    """Fixed windows every ``spacing``; short tails and windows with N go."""
    s = F.col(sequence)
    starts = F.when(F.length(s) >= size, F.sequence(F.lit(0), F.greatest(F.length(s) - size, F.lit(0)), F.lit(spacing)))
    rows = sequences.select(F.col(key), s.alias("_s"), F.explode(starts).alias("start"))
    rows = rows.withColumn("read", F.substring("_s", F.col("start") + 1, F.lit(size))).filter(~F.contains("read", F.lit("N")))
    name = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), (F.col("start") + size).cast("string"))
    return rows.select(name.alias("read_name"), key, "start", "read")


def noisy(reads: DataFrame, sequence: str = "read", rate: float = 0.01, seed: int = 1) -> DataFrame:
    """Substitute each base with the given probability (seeded)."""
    step = F.transform(
        seq.letters(sequence),
        lambda b: F.when(F.rand(seed) < rate, F.translate(b, "ACGT", "CGTA")).otherwise(b),
    )
    return reads.withColumn(sequence, F.array_join(step, ""))


def seeded(key: str, seed: int):
    """A number from 0 to 2**32 - 1 that depends on a key and a seed alone."""
    return F.conv(F.left(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.lit(8)), 16, 10).cast("long")


def random_substrings(sequences: DataFrame, key: str, n: int, seed: int = 1, sequence: str = "seq") -> DataFrame:
    """(key, start, piece): a piece of n letters from a seeded place in each
    sequence; shorter ones give none. The same seed gives the same pieces."""
    s = F.col(sequence)
    start = seeded(key, seed) % (F.length(s) - n + 1)
    rows = sequences.filter(F.length(s) >= n).select(F.col(key), start.cast("int").alias("start"), s.alias("_s"))
    return rows.select(key, "start", F.substring("_s", F.col("start") + 1, F.lit(n)).alias("piece"))


def random_bases(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """(key, base): one of four letters, by key and seed."""
    return rows.select(F.col(key), F.substring(F.lit("ACGT"), (seeded(key, seed) % 4 + 1).cast("int"), F.lit(1)).alias("base"))


def reversed_reads(reads: DataFrame, sequence: str = "seq", quality: str | None = None) -> DataFrame:
    """Every read read backwards (not complemented), its qualities too."""
    return reads.withColumns({c: F.reverse(F.col(c)) for c in (sequence, quality) if c})


def read_lengths(reads: DataFrame, key: str = "name", sequence: str = "seq") -> DataFrame:
    """(key, length): all that is kept of reads whose bases are not needed."""
    return reads.select(key, F.length(sequence).cast("long").alias("length"))


def reads_by_id(reads: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    return reads.join(wanted.select(key).distinct(), key, "left_semi")


def drop_ambiguous(reads: DataFrame, sequence: str = "seq") -> DataFrame:
    return reads.filter(~F.contains(F.upper(F.col(sequence)), F.lit("N")))


def cumulative_starts(contigs: DataFrame, contig: str = "contig", length: str = "length", within: str = "genome") -> DataFrame:
    """Running start of each contig in its genome: base ids count from it."""
    w = Window.partitionBy(within).orderBy(contig)
    return contigs.withColumn("cum_len", F.sum(length).over(w) - F.col(length))


def metadata(contigs: DataFrame) -> DataFrame:
    """Per genome: contigs, contig range, bases, both-strand and index lengths."""
    return contigs.groupBy("genome").agg(
        F.count("*").alias("contigs"), F.min("contig").alias("first_contig"), (F.max("contig") + 1).alias("end_contig"),
        F.sum("length").alias("bases"), (2 * F.sum("length")).alias("total_length"),
        (2 * F.sum(F.col("length") + 1)).alias("rows"),
    )


#: Letters that are cut into pieces before they are handed on.
LETTERS = 4_000_000


def pieces(rows: DataFrame, key: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, start, seq): sequences in pieces of ``size`` letters, each with up to
    ``overlap`` more that the next ones start with. They are slices, as cheap at the
    end of a long sequence as at its start; ``substring`` counts from the start."""
    kind = rows.schema[key].dataType.simpleString()
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            letters = 0

            def flush() -> pa.RecordBatch:
                columns = list(zip(*held))
                return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=[key, "start", "seq"])

            for name, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = s.as_py() or ""
                for start in range(0, len(s), size):
                    held.append((name, start, s[start : start + size + overlap]))
                    letters += len(held[-1][2])
                    if letters > LETTERS:
                        yield flush()
                        held, letters = [], 0
            if held:
                yield flush()

    return rows.select(key, "seq").mapInArrow(run, f"`{key}` {kind}, start long, seq string")
