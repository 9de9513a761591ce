"""K-mer counts, contexts and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import seq


def positions(texts: DataFrame, k: int, keep: list[str], sequence: str = "seq") -> DataFrame:
    """One row for each k-mer of each text, with its 0-based offset."""
    return texts.select(*keep, F.posexplode(seq.kmers(sequence, k)).alias("offset", "kmer"))


def counts(texts: DataFrame, k: int, sequence: str = "seq") -> DataFrame:
    """(kmer, n); partial counts are combined before the shuffle."""
    return texts.select(F.explode(seq.kmers(sequence, k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def dead_ends(texts: DataFrame, depth: int, sequence: str = "seq") -> DataFrame:
    """Suffixes shorter than ``depth`` (ends of texts), counted."""
    s = F.col(sequence)
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth - 1), F.length(s))), lambda n: F.right(s, n))
    return texts.filter(F.length(s) > 0).select(F.explode(tails).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))


def extensions(texts: DataFrame, k: int, sequence: str = "seq") -> DataFrame:
    """(kmer, a, c, g, t): how often each base follows a k-mer."""
    longer = texts.select(F.explode(seq.kmers(sequence, k + 1)).alias("w"))
    pairs = longer.select(F.left("w", F.lit(k)).alias("kmer"), F.right("w", F.lit(1)).alias("next"))
    return pairs.groupBy("kmer").agg(*[F.count_if(F.col("next") == b).alias(b.lower()) for b in "ACGT"])


def occurrences(texts: DataFrame, patterns: DataFrame, sequence: str = "seq", pattern: str = "pattern") -> DataFrame:
    """Occurrences of patterns of one length in all texts, overlaps included:
    both sides become k-mers, so this is an equi join of aggregated counts."""
    lengths = [r[0] for r in patterns.select(F.length(pattern)).distinct().collect()]
    out = None
    for k in sorted(n for n in lengths if n):
        found = counts(texts, k, sequence).join(patterns.filter(F.length(pattern) == k), F.col("kmer") == F.col(pattern), "right")
        found = found.select(pattern, F.coalesce("n", F.lit(0)).alias("n"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return patterns.select(pattern, F.lit(0).cast("long").alias("n")).limit(0)
    return out


def unique(texts: DataFrame, k: int, keep: list[str], sequence: str = "seq") -> DataFrame:
    """K-mers that stand at one position only, with that position."""
    rows = positions(texts, k, keep, sequence)
    where = F.struct(*keep, "offset")
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min(where).alias("at")).filter("n = 1").select("kmer", "at.*")


def spectrum(kmer_counts: DataFrame, top: int = 1000) -> DataFrame:
    """(count, kmers, share up to it); counts above ``top`` share a bin."""
    binned = kmer_counts.groupBy(F.least("n", F.lit(top)).alias("count")).agg(F.count("*").alias("kmers"))
    # a spectrum has at most ``top`` rows
    w = Window.orderBy("count")
    total = F.sum("kmers").over(Window.partitionBy())
    return binned.withColumn("share", F.sum("kmers").over(w) / total)


def cutoff_for_share(spectrum_: DataFrame, share: float) -> DataFrame:
    return spectrum_.filter(F.col("share") > share).agg(F.min("count").alias("cutoff"))


def censored_mode(spectrum_: DataFrame, least: int) -> DataFrame:
    """The most frequent count of at least ``least``; ties to the smaller."""
    return spectrum_.filter(F.col("count") >= least).agg(F.max_by("count", F.struct("kmers", -F.col("count"))).alias("mode"))


def first_minimum(spectrum_: DataFrame, ratio: float = 0.75) -> DataFrame:
    """First count whose bin holds more than ``ratio`` of the bin before it."""
    w = Window.orderBy("count")
    step = spectrum_.withColumn("prev", F.lag("kmers").over(w)).filter(F.col("kmers") / F.col("prev") > ratio)
    return step.agg(F.min("count").alias("first_minimum"))


def interval_cache(suffixes: DataFrame, k: int) -> DataFrame:
    """(kmer, lo, hi) rank interval of each k-mer in a suffix table."""
    rows = suffixes.filter(F.length("suffix") >= k)
    return rows.groupBy(F.left("suffix", F.lit(k)).alias("kmer")).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))


def dense(spectrum_: DataFrame, top: int = 1000) -> DataFrame:
    """The spectrum with a row for every count from 1 to ``top``."""
    counts_ = spectrum_.sparkSession.range(1, top + 1).withColumnRenamed("id", "count")
    return counts_.join(spectrum_.select(F.col("count").cast("long").alias("count"), "kmers"), "count", "left").fillna(0, ["kmers"])


def error_boundary(spectrum_: DataFrame, ratio: float = 2.0, trusted: int = 5) -> DataFrame:
    """One row: the trusted mode (of counts from ``trusted`` on); the count below
    it that adds the smallest share to the k-mers so far; the first count below
    it with less than ``ratio`` times the k-mers of the next; and all k-mers.
    Null where there is none. A spectrum has at most 1000 rows."""
    rows = dense(spectrum_)
    best = F.max_by("count", F.when((F.col("count") >= trusted) & (F.col("kmers") > 0), F.struct("kmers", -F.col("count"))))
    total = rows.agg(best.alias("mode"), F.sum("kmers").alias("total"))
    w = Window.orderBy("count")
    marked = rows.withColumns({"sofar": F.sum("kmers").over(w), "next": F.lead("kmers").over(w)}).join(F.broadcast(total))
    share = F.when((F.col("count") < F.col("mode")) & (F.col("sofar") > 0), F.col("kmers") / F.col("sofar"))
    falls = (F.col("count") < F.col("mode") - 1) & (F.col("kmers") < F.lit(ratio) * F.col("next"))
    return marked.groupBy("mode", "total").agg(
        F.min_by("count", F.when(share.isNotNull(), F.struct(share, "count"))).alias("by_contribution"), F.min(F.when(falls, F.col("count"))).alias("by_ratio")
    )
