"""Look-ups that join: annotation, populations, approximate search, levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import seq
from strandweave.operators.intervals import as_of


def known_genes(genes: DataFrame, names: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Genes that lie in a region, with offsets from its start, and the names
    another table has for them (or none)."""
    inside = genes.filter((F.col("contig") == contig) & (F.col("start") >= start) & (F.col("end") <= end))
    moved = inside.withColumns({"start": F.col("start") - start, "end": F.col("end") - start})
    return moved.join(names, "gene_id", "left")


def population_of(reads: DataFrame, population: DataFrame) -> DataFrame:
    """(read, sample): the sample whose range of read numbers holds a read."""
    spans = population.select(F.col("start"), F.concat_ws("|", F.col("end").cast("string"), "sample").alias("value"))
    found = as_of(reads.select("read"), spans, [], "read", "start", "value")
    end = F.split_part("match", F.lit("|"), F.lit(1)).cast("long")
    sample = F.when(F.col("read") <= end, F.expr("substring(match, instr(match, '|') + 1)"))
    return found.select("read", sample.alias("sample"))


def neighbourhood(kmers: DataFrame, patterns: DataFrame, k: int, mismatches: int) -> DataFrame:
    """(pattern, kmer, mismatches): k-mers within a Hamming budget of patterns.

    By the pigeonhole principle two strings with at most m mismatches agree on
    one of m + 1 pieces, so pieces are the keys of an equi join; a pair is kept
    at the first piece it agrees on.
    """
    cuts = [k * i // (mismatches + 1) for i in range(mismatches + 2)]
    pieces = lambda c: F.array(*[F.struct(F.lit(i).alias("i"), F.substring(c, a + 1, b - a).alias("s")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    left = patterns.select("pattern", F.explode(pieces("pattern")).alias("p")).select("pattern", "p.*")
    right = kmers.select("kmer", F.explode(pieces("kmer")).alias("p")).select("kmer", "p.*")
    pairs = left.join(right, ["i", "s"]).withColumn("mismatches", seq.hamming("pattern", "kmer")).filter(F.col("mismatches") <= mismatches)
    first = reduce(
        lambda acc, i: F.when(F.substring("pattern", cuts[i] + 1, cuts[i + 1] - cuts[i]) == F.substring("kmer", cuts[i] + 1, cuts[i + 1] - cuts[i]), i).otherwise(acc),
        range(mismatches, -1, -1), F.lit(-1),
    )
    return pairs.filter(F.col("i") == first).select("pattern", "kmer", "mismatches")


def greedy_matches(found: DataFrame) -> DataFrame:
    """Of approximate matches the exact ones; mismatches only where there are none."""
    least = F.min(F.struct((F.col("mismatches") > 0).alias("inexact"))).over(Window.partitionBy("pattern"))
    return found.withColumn("_b", least).filter((F.col("mismatches") > 0) == F.col("_b.inexact")).drop("_b")


def unique_prefixes(strings: DataFrame, longest: int | None = None, mismatches: int = 0, dissimilarity: int = 1) -> DataFrame:
    """(id, n): length of the shortest prefix that no other string starts with,
    up to the whole string or ``longest``. With mismatches and a dissimilarity of
    1 or more, no other string may start with anything that differs in at most
    ``mismatches + dissimilarity - 1`` letters: then the string alone fits, and
    would still with so many more mismatches.

    Prefixes of one length are compared on pieces they must share (one of so many
    pieces more than letters may differ), so no pair is formed that shares none.
    """
    if budget := mismatches + dissimilarity - 1:
        strings = strings.filter(F.length("seq") > 0)
        top = strings.agg(F.coalesce(F.max(F.length("seq")), F.lit(0))).first()[0]
        top = top if longest is None else min(top, longest)
        alone = None
        for n in range(1, top + 1):
            heads = strings.filter(F.length("seq") >= n).select("id", F.left("seq", F.lit(n)).alias("p"))
            distinct = heads.select("p").distinct()
            near = neighbourhood(distinct.select(F.col("p").alias("kmer")), distinct.select(F.col("p").alias("pattern")), n, min(budget, n))
            crowded = near.filter("mismatches > 0").select(F.col("pattern").alias("p")).distinct()
            one = heads.groupBy("p").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").join(crowded, "p", "left_anti")
            part = one.select("id", F.lit(n).alias("n"))
            alone = part if alone is None else alone.unionByName(part)
        return strings.select("id").limit(0).withColumn("n", F.lit(0)) if alone is None else alone.groupBy("id").agg(F.min("n").alias("n"))
    most = F.length("seq") if longest is None else F.least(F.lit(longest), F.length("seq"))
    strings = strings.filter(F.length("seq") > 0)  # sequence(1, 0) would count down
    heads = strings.select("id", F.explode(F.sequence(F.lit(1), most)).alias("n"), "seq")
    heads = heads.select("id", "n", F.expr("left(seq, n)").alias("p"))
    alone = heads.groupBy("p").agg(F.count("*").alias("c"), F.min("id").alias("id"), F.min("n").alias("n")).filter("c = 1")
    return alone.groupBy("id").agg(F.min("n").alias("n"))


def map_levels(levels: list[DataFrame]) -> DataFrame:
    """Mappings of all levels of a hierarchy, one below the other."""
    return reduce(DataFrame.unionByName, [df.withColumn("level", F.lit(i)) for i, df in enumerate(levels)])


def faces(mapped: DataFrame, ranges: DataFrame, least: int = 0) -> DataFrame:
    """(read, i, coordinate, face) of bases whose range stands for a side; a
    context below ``least`` maps nowhere."""
    good = mapped.filter(F.col("context") >= least)
    return good.join(ranges.select("range_no", "coordinate", "face"), "range_no").select("read", "i", "coordinate", "face")


# ---- counts of letters ------------------------------------------------------


def letter_counts(c: Column) -> Column:
    """struct<a, c, g, t> of a sequence."""
    n = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return F.struct(*[n(x).alias(x.lower()) for x in "ACGT"])


def combine_counts(x: Column, y: Column, sign: int = 1) -> Column:
    return F.struct(*[(x[b] + sign * y[b]).alias(b) for b in "acgt"])


def largest_letter(x: Column) -> Column:
    """The most frequent letter, the first of equals; null where all are 0."""
    top = F.greatest(*[x[b] for b in "acgt"])
    return F.when(top > 0, F.when(x["a"] == top, "A").when(x["c"] == top, "C").when(x["g"] == top, "G").otherwise("T"))


def has_one_letter(x: Column) -> Column:
    return sum(((x[b] > 0).cast("int") for b in "acgt"), F.lit(0)) == 1


# ---- persistence -------------------------------------------------------------


def save_index(path: str, **tables: DataFrame) -> None:
    """An index directory: one Parquet table a part (contigs, texts, suffixes, ...)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def has_index(spark, path: str, name: str = "contigs") -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def load_index(spark, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
