"""Views: a suffix table under a mask of genomes and ranges of merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.intervals import as_of
from strandweave.plans.runtime import global_index, running_sum


def running_count(rows: DataFrame, index: str, flag: Column, name: str) -> DataFrame:
    """Flags set up to and with each row."""
    return running_sum(rows, [index], {name: flag.cast("long")})


def masked(table: DataFrame, genomes: list) -> DataFrame:
    return table.withColumn("in_mask", F.col("genome").isin(genomes))


def merged_runs(view: DataFrame, canon: str = "canon") -> DataFrame:
    """(rank, range_no): masked rows in order, a new range wherever the canonical
    position changes; the first masked row always starts one."""
    rows = global_index(view.filter("in_mask").select("rank", F.col(canon).alias("canon")), ["rank"], "i")
    before = rows.select((F.col("i") + 1).alias("i"), F.col("canon").alias("prev"))
    marked = rows.join(before, "i", "left").withColumn("new", F.col("prev").isNull() | (F.col("prev") != F.col("canon")))
    return running_count(marked, "i", F.col("new"), "n").select("rank", "canon", (F.col("n") - 1).alias("range_no"))


def interval_summary(view: DataFrame, intervals: DataFrame, bin_size: int = 4096) -> DataFrame:
    """For each (id, lo, hi): masked rows, ranges touched, and whether the
    interval is empty, unique (one range) or ambiguous. The bins of rows that an
    interval touches are the key of the join."""
    bins = F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size)))
    rows = view.filter("in_mask").select("rank", "range_no", F.floor(F.col("rank") / bin_size).alias("_b"))
    asked = intervals.select("id", "lo", "hi", bins.alias("_b")).alias("q")
    inside = asked.join(rows.alias("r"), (F.col("q._b") == F.col("r._b")) & F.col("rank").between(F.col("lo"), F.col("hi")), "left")
    found = inside.groupBy("id", "lo", "hi").agg(
        F.count("rank").alias("masked_rows"), F.count_distinct("range_no").alias("ranges"),
        F.min("range_no").alias("first_range"), F.max("range_no").alias("last_range"),
    )
    state = F.when(F.col("masked_rows") == 0, "empty").when(F.col("ranges") == 1, "unique").otherwise("ambiguous")
    return found.withColumn("state", state)


def range_bounds(view: DataFrame) -> DataFrame:
    return view.groupBy("range_no").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))


def range_position(view: DataFrame) -> DataFrame:
    """(range_no, position): the canonical position, else the first masked row's."""
    first = F.min_by(F.struct("text", "offset"), F.when(F.col("in_mask"), F.col("rank")))
    return view.groupBy("range_no").agg(F.coalesce(F.max("canon"), first).alias("position"))


def position_ranges(ranges: DataFrame) -> DataFrame:
    """Inverse: all ranges tied to a canonical position."""
    return ranges.groupBy("canon").agg(F.array_sort(F.collect_set("range_no")).alias("ranges"))


def new_ranges(wider: DataFrame, narrower: DataFrame) -> DataFrame:
    return wider.select("range_no").exceptAll(narrower.select("range_no")).distinct()


def approximate_ranges(view: DataFrame, intervals: DataFrame) -> DataFrame:
    """Over-estimate of the ranges in an interval, from its ends alone."""
    ends = view.select("rank", "range_no")
    lo, hi = ends.select(F.col("rank").alias("lo"), F.col("range_no").alias("a")), ends.select(F.col("rank").alias("hi"), F.col("range_no").alias("b"))
    return intervals.join(lo, "lo").join(hi, "hi").select("id", (F.col("b") - F.col("a") + 1).alias("n"))


def union_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR of two bit columns (i, bit)."""
    both = a.select("i", "bit").unionByName(b.select("i", "bit"))
    return both.groupBy("i").agg(F.bool_or("bit").alias("bit"))


def ranks_and_selects(bits: DataFrame) -> DataFrame:
    """(i, bit, rank, at_least): set bits up to i, and up to i but not with it."""
    out = running_count(bits, "i", F.col("bit"), "rank")
    return out.withColumn("rank_before", F.col("rank") - F.col("bit").cast("long"))


def select(bits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, i): where the k-th set bit stands, k from 0; null past the last."""
    on = global_index(bits.filter("bit").select("i"), ["i"], "k")
    return wanted.select("k").join(on, "k", "left")


def value_before(bits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(at, i): the last set bit at or before each place; null if there is none."""
    on = bits.filter("bit").select(F.col("i").alias("start"), F.lit("").alias("value"))
    return as_of(wanted.select("at"), on, [], "at", "start", "value").select("at", F.col("match_key").alias("i"))


def value_after(bits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(at, i): the first set bit at or after each place; null if there is none."""
    on = bits.filter("bit").select(F.col("i").alias("start"), F.lit("").alias("value"))
    return as_of(wanted.select("at"), on, [], "at", "start", "value", "forward").select("at", F.col("match_key").alias("i"))


def bit_runs(bits: DataFrame) -> DataFrame:
    """(start, length) of runs of set bits."""
    on = global_index(bits.filter("bit").select("i"), ["i"], "n")
    return on.groupBy((F.col("i") - F.col("n")).alias("_g")).agg(F.min("i").alias("start"), F.count("*").alias("length")).drop("_g")
