"""The suffix table: ranks, BWT, LCP, masks and row-level index access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import seq
from strandweave.plans.runtime import global_index, global_lag, running_sum


def suffixes(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(text, offset, suffix, bwt) of every suffix, the empty one included;
    ``$`` ends a suffix and precedes a whole text in the BWT."""
    s = F.col("seq")
    rows = texts.select("text", *(keep or []), s, F.explode(F.sequence(F.lit(0), F.length(s))).alias("offset"))
    before = F.when(F.col("offset") == 0, "$").otherwise(F.substring(s, F.col("offset"), F.lit(1)))
    return rows.select(
        "text", *(keep or []), F.col("offset").cast("long").alias("offset"),
        F.concat(F.substring(s, F.col("offset") + 1, F.length(s)), F.lit("$")).alias("suffix"), before.alias("bwt"),
    )


def ranked(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The suffix array: suffixes with their rank; ties go by text.

    A range-partitioned sort, so suffixes of any number of texts are ranked
    without one task holding them all; meant for texts of read or contig length
    (a suffix is carried whole).
    """
    return global_index(suffixes(texts, keep), ["suffix", "text"], "rank")


def with_lcp(table: DataFrame) -> DataFrame:
    """Longest common prefix with the suffix one rank before (0 for the first).
    ``$`` never matches: the suffixes of different texts end differently."""
    both = global_lag(table, "rank", ["suffix"])
    plain = F.expr("substring(suffix, 1, length(suffix) - 1)")
    before = F.expr("substring(prev_suffix, 1, length(prev_suffix) - 1)")
    return both.withColumn("lcp", F.coalesce(seq.shared_prefix(before, plain), F.lit(0))).drop("prev_suffix")


def previous_next_smaller(values: DataFrame, index: str = "rank", value: str = "lcp") -> DataFrame:
    """psv and nsv: nearest rows before and after with a smaller value (0 and
    the row count by default).

    Smaller values never lie beyond a row with a value below all in between, so
    a monotonic stack over each block of rows leaves only block minima to look
    at: blocks are solved in parallel, and open rows take the first block (from
    the nearest) with a smaller minimum, then the row in it.
    """
    width = 4096
    rows = values.select(F.col(index).alias("i"), F.col(value).cast("long").alias("v"), F.floor(F.col(index) / width).alias("b"))

    def run(key: tuple, block: pa.Table) -> pa.Table:
        order = np.argsort(block["i"].to_numpy())
        i, v = block["i"].to_numpy()[order], block["v"].to_numpy()[order]
        prev, nxt = np.full(len(i), -1), np.full(len(i), -1)
        stack: list[int] = []
        for j in range(len(i)):
            while stack and v[stack[-1]] > v[j]:
                nxt[stack.pop()] = i[j]
            below = stack[-1] if stack and v[stack[-1]] < v[j] else None
            if below is None and stack:  # an equal value: what is smaller than it is smaller than this
                prev[j] = prev[stack[-1]]
            elif below is not None:
                prev[j] = i[below]
            stack.append(j)
        return pa.table({"i": i, "v": v, "b": block["b"].to_numpy()[order], "p": prev, "n": nxt})

    solved = rows.groupBy("b").applyInArrow(lambda t: run((), t), "i long, v long, b long, p long, n long")
    minima = solved.groupBy("b").agg(F.min("v").alias("m"))
    size = solved.count()

    def outside(side: str) -> DataFrame:
        open_rows = solved.filter(F.col(side) == -1).select("i", "v", "b")
        near = nearest_block(open_rows.select("b", "v").distinct(), minima, side == "p", -(-size // width))
        inside = near.join(solved.select(F.col("b").alias("b2"), F.col("v").alias("w"), F.col("i").alias("j")), "b2").filter("w < v")
        found = inside.groupBy("b", "v").agg((F.max("j") if side == "p" else F.min("j")).alias("j"))
        return open_rows.join(found, ["b", "v"], "left").select("i", F.coalesce("j", F.lit(0 if side == "p" else size)).alias(f"{side}2"))

    out = solved.join(outside("p"), "i", "left").join(outside("n"), "i", "left")
    return out.select(
        F.col("i").alias(index), F.col("v").alias(value),
        F.when(F.col("p") >= 0, F.col("p")).otherwise(F.col("p2")).alias("psv"),
        F.when(F.col("n") >= 0, F.col("n")).otherwise(F.col("n2")).alias("nsv"),
    )


def nearest_block(asked: DataFrame, minima: DataFrame, before: bool, blocks: int, fan: int = 64) -> DataFrame:
    """(b, v, b2) for each asked (b, v): the nearest block before (or after) b
    whose minimum (b, m) is below v; none, no row.

    A tree of minima of ``fan`` children each is climbed from the block until a
    sibling on the wanted side has a smaller minimum, and descended from there to
    the nearest child that does. Every step is a join on a tree node, in which a
    row meets ``fan`` others at most.
    """
    levels = [minima.select(F.col("b").alias("t"), "m")]
    while fan ** len(levels) < blocks:
        levels.append(levels[-1].groupBy(F.floor(F.col("t") / fan).alias("t")).agg(F.min("m").alias("m")))
    best = F.max("t") if before else F.min("t")
    out, rest = None, asked.withColumn("at", F.col("b"))
    for depth, nodes in enumerate(levels):
        children = nodes.withColumn("up", F.floor(F.col("t") / fan))
        side = F.col("t") < F.col("at") if before else F.col("t") > F.col("at")
        met = rest.withColumn("up", F.floor(F.col("at") / fan)).join(children, "up").filter(side & (F.col("m") < F.col("v")))
        found = met.groupBy("b", "v").agg(best.alias("at"))
        rest = rest.join(found.select("b", "v"), ["b", "v"], "left_anti").withColumn("at", F.floor(F.col("at") / fan))
        for below in reversed(levels[:depth]):
            down = found.join(below.withColumn("at", F.floor(F.col("t") / fan)), "at").filter(F.col("m") < F.col("v"))
            found = down.groupBy("b", "v").agg(best.alias("at"))
        found = found.withColumnRenamed("at", "b2")
        out = found if out is None else out.unionByName(found)
    return out


def lf(table: DataFrame) -> DataFrame:
    """(rank, lf): C[c] + occ(c, rank) - 1. For rows of a base this is the row of
    the suffix one place to the left; ``$`` rows are ranked among themselves."""
    left = table.select("text", (F.col("offset") + 1).alias("offset"), F.col("rank").alias("lf"))
    bases = table.filter("bwt <> '$'").join(left, ["text", "offset"]).select("rank", "lf")
    ends = global_index(table.filter("bwt = '$'").select("rank"), ["rank"], "lf").select("rank", "lf")
    return bases.unionByName(ends)


def occurrence_counts(table: DataFrame) -> DataFrame:
    """(rank, a, c, g, t): BWT letters up to and with each row."""
    marks = table.select("rank", "bwt")
    return running_sum(marks, ["rank"], {x.lower(): (F.col("bwt") == x).cast("long") for x in "ACGT"}).drop("bwt")


def locate(table: DataFrame, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, text, offset) of every occurrence, through prefixes of suffixes
    of the patterns' lengths."""
    lengths = [r[0] for r in patterns.select(F.length(pattern)).distinct().collect()]
    out = None
    for k in sorted(n for n in lengths if n):
        heads = table.select("text", "offset", F.left("suffix", F.lit(k)).alias(pattern))
        part = heads.join(patterns.filter(F.length(pattern) == k).distinct(), pattern)
        out = part if out is None else out.unionByName(part)
    return out


def invalid_rows(table: DataFrame) -> DataFrame:
    """Rows of a suffix array that are out of order: none, if it is valid."""
    both = global_lag(table, "rank", ["suffix", "text"])
    return both.filter((F.col("prev_suffix") > F.col("suffix")) | ((F.col("prev_suffix") == F.col("suffix")) & (F.col("prev_text") > F.col("text"))))


def kasai(text: str, order: np.ndarray) -> np.ndarray:
    """LCP array of one text and its suffix array, in linear time."""
    n = len(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out, h = np.zeros(n, dtype=np.int64), 0
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < len(text) and j + h < len(text) and text[i + h] == text[j + h]:
                h += 1
            out[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def remove_texts(table: DataFrame, texts: DataFrame) -> DataFrame:
    """The index without some texts, ranks closed up again."""
    return global_index(table.drop("rank").join(texts.select("text"), "text", "left_anti"), ["suffix", "text"], "rank")


def merge_indices(a: DataFrame, b: DataFrame) -> DataFrame:
    """One index from two over different texts."""
    return global_index(a.drop("rank").unionByName(b.drop("rank")), ["suffix", "text"], "rank")


# ---- texts behind the table ----------------------------------------------------


def contig_ends(table: DataFrame) -> DataFrame:
    """(contig, rank) of the empty suffix at each contig's forward end."""
    ends = table.filter((F.col("suffix") == "$") & (F.col("text") % 2 == 0))
    return ends.select(F.shiftright("text", 1).alias("contig"), "rank")


def inverse(table: DataFrame) -> DataFrame:
    """(text, offset, rank): where each suffix stands in the order."""
    return table.select("text", "offset", "rank")


def extracted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, offset, n, piece): so many letters of a text from an offset on."""
    asked = wanted.select("text", "offset", "n").join(texts.select("text", "seq"), "text")
    return asked.select("text", "offset", "n", F.expr("substring(seq, cast(offset as int) + 1, cast(n as int))").alias("piece"))


def display(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(contig, at, base): the forward letter at a contig's 1-based offset."""
    forward = texts.filter(F.col("text") % 2 == 0).select(F.shiftright("text", 1).alias("contig"), "seq")
    asked = wanted.select("contig", "at").join(forward, "contig")
    return asked.select("contig", "at", F.expr("substring(seq, cast(at as int), 1)").alias("base"))


def display_contigs(texts: DataFrame) -> DataFrame:
    """(contig, seq): whole contigs, from their forward texts."""
    return texts.filter(F.col("text") % 2 == 0).select(F.shiftright("text", 1).alias("contig"), "seq")


def display_positions(contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, offset, base) read from forward contigs (contig, seq) alone: on a
    reverse text the complement of the letter across."""
    asked = wanted.select("text", "offset").withColumn("contig", F.shiftright("text", 1)).join(contigs.select("contig", "seq"), "contig")
    ahead = F.expr("substring(seq, cast(offset as int) + 1, 1)")
    across = seq.complement(F.expr("substring(seq, length(seq) - cast(offset as int), 1)"))
    return asked.select("text", "offset", F.when(F.col("text") % 2 == 0, ahead).otherwise(across).alias("base"))
