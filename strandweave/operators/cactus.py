"""Merging star-tree alignments (c2h and FASTA pairs) on a shared event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.graph import oriented_components
from strandweave.plans.runtime import global_index


def renamed(segments: DataFrame, number: int, suffix: str = "", merge_on: str | None = None) -> DataFrame:
    """A file's segments under names of their own: events other than the shared
    one get the suffix, bottom events the file's number too."""
    own = F.when(F.col("event") == merge_on, F.col("event")).otherwise(F.concat("event", F.lit(suffix)))
    return segments.withColumns({
        "event": F.when(F.col("is_bottom"), F.concat(own, F.lit(f"-{number}"))).otherwise(own), "file": F.lit(number),
    })


def sequence_numbers(segments: DataFrame) -> DataFrame:
    """(event, sequence, number): numbered within an event by first occurrence."""
    first = segments.groupBy("event", "sequence").agg(F.min(F.struct("file", "line")).alias("first"))
    w = Window.partitionBy("event").orderBy("first")
    return first.withColumn("number", F.row_number().over(w) - 1).select("event", "sequence", "number")


def merge(files: list[DataFrame], suffixes: list[str], merge_on: str) -> tuple[DataFrame, DataFrame]:
    """(segments with sequence numbers, merges of bases (a, b, opposite)).

    A top segment's bases are one with those of the bottom segment of its block;
    the shared event's sequences are the same bases in every file. A base is the
    number of its sequence among all, and its offset in the low 32 bits.
    """
    rows = reduce(DataFrame.unionByName, [renamed(f, i, s, merge_on) for i, (f, s) in enumerate(zip(files, suffixes))])
    numbered = rows.join(sequence_numbers(rows), ["event", "sequence"])
    ids = global_index(rows.select("event", "sequence").distinct(), ["event", "sequence"], "_id")
    placed = numbered.join(ids, ["event", "sequence"]).withColumn("base", F.shiftleft("_id", 32) + F.col("start"))
    bottom = placed.filter("is_bottom").select("file", "block", F.col("base").alias("b"), F.col("length").alias("n"))
    top = placed.filter("not is_bottom and block is not null").select("file", "block", F.col("base").alias("a"), "orientation")
    pairs = top.join(bottom, ["file", "block"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.col("a") + F.when(F.col("orientation"), F.col("k")).otherwise(F.col("n") - 1 - F.col("k"))
    return numbered, pairs.select(at.alias("a"), (F.col("b") + F.col("k")).alias("b"), (~F.col("orientation")).alias("opposite"))


def blocks(merges: DataFrame) -> DataFrame:
    return oriented_components(merges)


def first_by_name(records: list[DataFrame]) -> DataFrame:
    """FASTA records of all files, the first of each name."""
    rows = reduce(DataFrame.unionByName, [r.select("name", "seq").withColumn("_f", F.lit(i)) for i, r in enumerate(records)])
    return rows.groupBy("name").agg(F.min_by("seq", "_f").alias("seq"))
