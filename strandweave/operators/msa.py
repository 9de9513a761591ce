"""Multiple alignments as rows: reverse, merge on a shared reference, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import seq


def columns(rows: DataFrame) -> DataFrame:
    """(msa, column, name, start, strand, base, at) of aligned rows (msa, name,
    start, strand, text): ``at`` is the base's coordinate, null for a gap."""
    cells = rows.select("msa", "name", "start", "strand", F.posexplode(seq.letters("text")).alias("column", "base"))
    w = Window.partitionBy("msa", "name", "start").orderBy("column")
    seen = F.sum((F.col("base") != "-").cast("int")).over(w)
    return cells.withColumn("at", F.when(F.col("base") != "-", F.col("start") + F.col("strand") * (seen - 1)))


def reverse(rows: DataFrame) -> DataFrame:
    """Every alignment read on the other strand."""
    length = F.length(F.replace("text", F.lit("-"), F.lit("")))
    return rows.withColumns({
        "text": seq.reverse_complement("text"), "start": F.col("start") + F.col("strand") * (length - 1), "strand": -F.col("strand"),
    })


def mismatches(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Columns of each alignment where two of its rows differ, gaps included."""
    c = columns(rows)
    x, y = (c.filter(F.col("name") == n).select("msa", "column", F.col("base").alias(v)) for n, v in ((a, "x"), (b, "y")))
    return x.join(y, ["msa", "column"]).groupBy("msa").agg(F.count_if(F.col("x") != F.col("y")).alias("mismatches"))


def merge_on_reference(left: DataFrame, right: DataFrame, reference: str) -> DataFrame:
    """(slot, name, base): two alignments as one, column by column of the shared
    reference. What stands between two reference bases keeps its side's order,
    the left alignment's first; bases outside the other's span stay as they are.
    """

    def placed(rows: DataFrame, side: int) -> DataFrame:
        c = columns(rows)
        ref = c.filter(F.col("name") == reference).select("msa", "column", F.col("at").alias("ref_at"))
        c = c.join(ref, ["msa", "column"], "left")
        w = Window.partitionBy("msa", "name", "start").orderBy("column").rowsBetween(Window.unboundedPreceding, 0)
        anchor = F.last("ref_at", ignorenulls=True).over(w)
        between = F.when(F.col("ref_at").isNotNull(), F.lit(0)).otherwise(1)
        return c.select(
            F.coalesce(anchor, F.lit(-1)).alias("anchor"), between.alias("between"), F.when(between == 1, side).otherwise(0).alias("side"),
            F.when(between == 1, F.col("column")).otherwise(0).alias("inner"), "name", "base",
        )

    both = placed(left, 0).unionByName(placed(right, 1)).filter("base <> '-'").distinct()
    return both.select(F.struct("anchor", "between", "side", "inner").alias("slot"), "name", "base")


def rendered(slots: DataFrame) -> DataFrame:
    """(name, text): merged slots as gapped rows again."""
    names = slots.select("name").distinct()
    grid = slots.select("slot").distinct().join(F.broadcast(names), F.lit(True))
    cells = grid.join(slots, ["slot", "name"], "left").withColumn("base", F.coalesce("base", F.lit("-")))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "base"))), lambda x: x["base"]), "")
    return cells.groupBy("name").agg(row.alias("text"))


def match_string(texts: list[Column]) -> Column:
    """``*`` where all texts agree, else a space."""
    first = seq.letters(texts[0])
    same = F.transform(first, lambda x, i: F.forall(F.array(*[F.get(seq.letters(t), i) for t in texts[1:]]), lambda y: y == x))
    return F.array_join(F.transform(same, lambda s: F.when(s, "*").otherwise(" ")), "")


def base_index(rows: DataFrame) -> DataFrame:
    """(msa, name, column, index): which base of a row stands in a column."""
    w = Window.partitionBy("msa", "name", "start").orderBy("column")
    return columns(rows).filter("base <> '-'").withColumn("index", F.row_number().over(w) - 1).select("msa", "name", "column", "index")


def variants(rows: DataFrame, reference: str, sample: str) -> DataFrame:
    """(msa, pos, ref, alt, kind, homopolymer): differing runs of columns as VCF
    alleles; indels are extended by the base before them."""
    c = columns(rows)
    r = c.filter(F.col("name") == reference).select("msa", "column", F.col("base").alias("r"), "at")
    s = c.filter(F.col("name") == sample).select("msa", "column", F.col("base").alias("s"))
    w = Window.partitionBy("msa").orderBy("column")
    both = r.join(s, ["msa", "column"]).withColumn("differs", F.col("r") != F.col("s"))
    both = both.withColumns({
        "prev": F.lag("r").over(w), "prev_at": F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "new": (F.col("differs") & ~F.coalesce(F.lag("differs").over(w), F.lit(False))).cast("int"),
    })
    both = both.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("differs")
    text = lambda c_: F.replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", F.col(c_).alias("x")))), lambda y: y["x"]), ""), F.lit("-"), F.lit(""))
    runs = both.groupBy("msa", "g").agg(text("r").alias("ref"), text("s").alias("alt"), F.min("at").alias("at"), F.min_by("prev", "column").alias("prev"), F.min_by("prev_at", "column").alias("prev_at"))
    indel = F.length("ref") != F.length("alt")
    out = runs.withColumns({
        "pos": F.when(indel, F.col("prev_at")).otherwise(F.col("at")), "ref": F.when(indel, F.concat("prev", "ref")).otherwise(F.col("ref")),
        "alt": F.when(indel, F.concat("prev", "alt")).otherwise(F.col("alt")),
    })
    return out.select("msa", "pos", "ref", "alt", seq.vcf_class("ref", "alt").alias("kind"), seq.homopolymer_length(F.expr("substring(ref, 2)")).alias("homopolymer"))
