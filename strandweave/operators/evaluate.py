"""Evaluation: gene classes, set differences, precision, coverage, pileups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import point_join
from strandweave.plans.runtime import tree_reduce


def mapping_classes(columns: DataFrame, genes: DataFrame, bin_size: int = 1000) -> DataFrame:
    """(class, gene, columns) counts of alignment columns.

    ``columns``: column_id, contig, base, reverse. ``genes``: contig, start, end,
    name, strand (+1 or -1). Every column is counted as total; without any gene
    it is background, else a gene column. The most frequent (gene, strand seen
    from the column) above one base makes an ortholog; a base whose genes lack it
    a paralog; a base without gene is unannotated. Ties go to the first name.
    """
    total = columns.groupBy("column_id").agg(F.count("*").alias("bases"))
    rows = columns.select("column_id", "contig", "base", F.when(F.col("reverse"), -1).otherwise(1).alias("own"), F.struct("contig", "base", "reverse").alias("b"))
    hits = point_join(rows, genes.select("contig", "start", "end", "name", "strand"), "contig", "base", ("start", "end"), bin_size)
    hits = hits.select("column_id", "b", "name", (F.col("strand") * F.col("own")).alias("strand")).distinct()
    counted = hits.groupBy("column_id", "name", "strand").agg(F.count("*").alias("n"))
    top = counted.groupBy("column_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "name", "strand")).alias("t"))
    top = top.select("column_id", F.col("t.name").alias("gene"), F.col("t.strand").alias("gene_strand"), (-F.col("t.n")).alias("top"))
    per_base = hits.join(top, "column_id").groupBy("column_id", "b").agg(
        F.bool_or((F.col("name") == F.col("gene")) & (F.col("strand") == F.col("gene_strand"))).alias("has_top")
    )
    annotated = per_base.groupBy("column_id").agg(F.count("*").alias("annotated"), F.count_if(~F.col("has_top")).alias("others"))
    known = total.join(top, "column_id", "left").join(annotated, "column_id", "left")
    gene_column, stop = F.col("gene").isNotNull(), F.col("top") == F.col("bases")
    made = F.array(
        F.struct(F.lit("total_columns").alias("class"), F.lit(None).cast("string").alias("gene"), F.lit(True).alias("on")),
        F.struct(F.lit("background").alias("class"), F.lit(None).cast("string").alias("gene"), (~gene_column).alias("on")),
        F.struct(F.lit("gene_columns").alias("class"), F.lit(None).cast("string").alias("gene"), gene_column.alias("on")),
        F.struct(F.lit("ortholog").alias("class"), F.col("gene").alias("gene"), (F.col("top") > 1).alias("on")),
        F.struct(F.lit("paralog").alias("class"), F.col("gene").alias("gene"), (gene_column & ~stop & (F.col("others") > 0)).alias("on")),
        F.struct(F.lit("unannotated").alias("class"), F.col("gene").alias("gene"), (gene_column & ~stop & (F.col("annotated") < F.col("bases"))).alias("on")),
    )
    flat = known.select(F.explode(F.filter(made, lambda x: x["on"])).alias("c"))
    return flat.groupBy(F.col("c.class").alias("class"), F.col("c.gene").alias("gene")).agg(F.count("*").alias("columns"))


def class_totals(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.sum("columns").alias("columns"), F.count("gene").alias("genes"))


def gene_pairs(hits: DataFrame, column: str = "column_id", gene: str = "gene") -> DataFrame:
    """Unordered pairs of different genes that share a column, with counts."""
    one = hits.select(column, gene).distinct()
    other = one.withColumnRenamed(gene, "gene_b")
    pairs = one.withColumnRenamed(gene, "gene_a").join(other, column).filter("gene_a < gene_b")
    return pairs.groupBy("gene_a", "gene_b").agg(F.count("*").alias("columns"))


def gene_set_difference(a: DataFrame, b: DataFrame, multiset: bool = True) -> DataFrame:
    """(category, gene, delta) of two gene sets, b against a; as sets: +1 or -1."""
    left = a.groupBy("category", "gene").agg(F.count("*").alias("x"))
    right = b.groupBy("category", "gene").agg(F.count("*").alias("y"))
    delta = F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))
    if not multiset:
        delta = F.coalesce("y", F.lit(0)).cast("boolean").cast("int") - F.coalesce("x", F.lit(0)).cast("boolean").cast("int")
    return left.join(right, ["category", "gene"], "full").select("category", "gene", delta.alias("delta")).filter("delta <> 0")


def net_difference(differences: DataFrame) -> DataFrame:
    return differences.groupBy("category").agg(
        F.sum("delta").alias("net"), F.sum(F.greatest("delta", F.lit(0))).alias("gained"), F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("lost")
    )


def describe_difference(differences: DataFrame, counts: bool = True) -> DataFrame:
    """Lines: ``+++``/``---`` with the gene, and how many."""
    sign = F.when(F.col("delta") > 0, "+++").otherwise("---")
    line = F.concat_ws("\t", sign, F.col("gene"), *([F.abs("delta").cast("string")] if counts else []))
    return differences.select("category", line.alias("line"))


def precision_recall(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Exact pair precision, recall and F of each group."""
    t = truth.select(*by, *keys).distinct().withColumn("_t", F.lit(1))
    f = found.select(*by, *keys).distinct().withColumn("_f", F.lit(1))
    n = t.join(f, [*by, *keys], "full").groupBy(*by).agg(
        F.count("_t").alias("truth"), F.count("_f").alias("found"), F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("both")
    )
    p, r = F.try_divide("both", "found"), F.try_divide("both", "truth")
    return n.select(*by, "truth", "found", "both", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f_score"))


def coverage(aligned: Column, length: Column, known_share: Column) -> Column:
    """aligned / (length x share that is not N); NaN where that is 0."""
    of = length * known_share
    return F.when(of == 0, F.lit(float("nan"))).otherwise(aligned / of)


def wrongness(counts: DataFrame, by: list[str]) -> DataFrame:
    """Share of annotated reads that went to another gene."""
    genes = F.col("category").startswith("gene2")
    return counts.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(F.col("category") == "gene2wrong", F.col("n")).otherwise(0)), F.sum(F.when(genes, F.col("n")).otherwise(0))).alias("wrongness")
    )


def read_coverage(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mapped share of reads; ``*2unmapped`` are unmapped, ``!*`` is metadata."""
    rows = counts.filter(~F.col("category").startswith("!"))
    lost = F.sum(F.when(F.col("category").endswith("2unmapped"), F.col("n")).otherwise(0))
    return rows.groupBy(*by).agg((1 - F.try_divide(lost, F.sum("n"))).alias("read_coverage"))


def wrong_gene_share(genes: DataFrame, by: list[str]) -> DataFrame:
    """Distinct genes with a wrong mapping among distinct genes."""
    wrong = F.count_distinct(F.when(F.col("category") == "gene2wrong", F.col("gene")))
    return genes.groupBy(*by).agg(F.try_divide(wrong, F.count_distinct("gene")).alias("share"))


def keyed_totals(stats: DataFrame) -> DataFrame:
    """(stat, value): counters summed with partial sums on each side."""
    return stats.groupBy("stat").agg(F.sum("value").alias("value"))


def error_rates(events: DataFrame, key: str, error: str) -> DataFrame:
    """(key, samples, errors, fraction) of boolean errors."""
    return events.groupBy(key).agg(F.count("*").alias("samples"), F.count_if(F.col(error)).alias("errors"), F.avg(F.col(error).cast("double")).alias("fraction"))


# ---- pileups ---------------------------------------------------------------


def pileup(columns: DataFrame, by: list[str], base: str = "base") -> DataFrame:
    """(depth, a, c, g, t, consensus) of each column; ties go to the first base."""
    n = {x: F.count_if(F.col(base) == x) for x in "ACGT"}
    out = columns.groupBy(*by).agg(F.count("*").alias("depth"), *[v.alias(k.lower()) for k, v in n.items()])
    top = F.greatest("a", "c", "g", "t")
    call = F.when(F.col("a") == top, "A").when(F.col("c") == top, "C").when(F.col("g") == top, "G").otherwise("T")
    return out.withColumn("consensus", call)


def keep_root(columns: DataFrame) -> DataFrame:
    """Simple consensus: the root's base if it ties with the most frequent."""
    top = F.greatest("a", "c", "g", "t")
    own = F.when(F.col("root") == "A", F.col("a")).when(F.col("root") == "C", F.col("c")).when(F.col("root") == "G", F.col("g")).otherwise(F.col("t"))
    return columns.withColumn("call", F.when(own == top, F.col("root")).otherwise(F.col("consensus")))


def conflicted(columns: DataFrame, by: list[str], cutoff: int) -> DataFrame:
    """Groups with a column whose second most frequent base exceeds a cutoff."""
    second = F.element_at(F.sort_array(F.array("a", "c", "g", "t"), asc=False), 2)
    return columns.groupBy(*by).agg(F.bool_or(second > cutoff).alias("conflicted"), F.count_if(F.col("depth") > 1).alias("covered"), F.avg("depth").alias("mean_depth"))


def bases_covered(columns: DataFrame, by: list[str]) -> DataFrame:
    """Columns more than one read deep, and the mean depth, of each group."""
    return columns.groupBy(*by).agg(F.count_if(F.col("depth") > 1).alias("covered"), F.avg("depth").alias("mean_depth"))


def _counts(rows: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col("base") == x).alias(f"{prefix}{x}") for x in "ACGT"])


def _count_of(base: Column, prefix: str) -> Column:
    out = F.lit(0)
    for x in "ACGT":
        out = F.when(base == x, F.col(f"{prefix}{x}")).otherwise(out)
    return out


def conflict_consensus(rows: DataFrame, root: DataFrame, by: list[str], cutoff: int, support: int = 3) -> DataFrame:
    """(by, i, root, call) from aligned reads (by, read, i, base) and a root
    (by, i, base), which counts as a read.

    A place is in conflict if its second most frequent base exceeds the cutoff.
    Reads that differ from the root at such a place, where the root's base exceeds
    the cutoff too, are set apart. The root's base stands if the other reads give it
    enough support; else their most frequent base is called if it has more, else that
    of all reads if the place is not in conflict and it has more. Ties go to the
    first base.

    A table of places grows with the reads, however small the files it was made from:
    it is merged by key, never sent to the driver to be broadcast.
    """
    at = [*by, "i"]
    own = root.select(*at, F.col("base").alias("root"))
    every = rows.select(*at, "base").unionByName(root.select(*at, "base"))
    second = F.element_at(F.sort_array(F.array(*[f"all{x}" for x in "ACGT"]), asc=False), 2)
    places = own.join(_counts(every, at, "all").hint("merge"), at).withColumn("conflict", second > cutoff)
    told = places.filter(F.col("conflict") & (_count_of(F.col("root"), "all") > cutoff)).select(*at, "root")
    apart = rows.join(told.hint("merge"), at).filter("base <> root").select(*by, "read").distinct()
    kept = rows.join(apart.hint("merge"), [*by, "read"], "left_anti").select(*at, "base").unionByName(root.select(*at, "base"))
    places = places.join(_counts(kept, at, "kept").hint("merge"), at)

    def top(prefix: str) -> tuple[Column, Column]:
        n = F.greatest(*[F.col(f"{prefix}{x}") for x in "ACGT"])
        return F.when(F.col(f"{prefix}A") == n, "A").when(F.col(f"{prefix}C") == n, "C").when(F.col(f"{prefix}G") == n, "G").otherwise("T"), n

    (base, n), (base_all, n_all), mine = top("kept"), top("all"), _count_of(F.col("root"), "kept")
    call = F.when(mine >= support, F.col("root")).when(n > mine, base).when(~F.col("conflict") & (n_all > mine), base_all).otherwise(F.col("root"))
    return places.select(*at, "root", call.alias("call"))


def partitioned_pileup(columns: DataFrame, by: list[str], part: str, base: str = "base") -> DataFrame:
    """The pileup of each part of the reads (a boolean column) by itself."""
    return pileup(columns, [*by, part], base)


def metric_series(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric over the runs of each scheme."""
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), *[F.avg(m).alias(m) for m in metrics])


def stacked(metric: str, **schemes: DataFrame) -> DataFrame:
    """(metric, scheme, value): metric tables (value) of several schemes, tagged."""
    tag = [df.select(F.lit(metric).alias("metric"), F.lit(name).alias("scheme"), F.col("value").cast("double").alias("value")) for name, df in sorted(schemes.items())]
    return tree_reduce(tag, DataFrame.unionByName)


def posterior(columns: DataFrame, error: float = 0.01) -> DataFrame:
    """Log likelihood and posterior of each base under an even error rate."""
    like = {x: sum((F.col(y) * F.log(F.lit(1 - error if x == y else error / 3)) for y in "acgt"), F.lit(0.0)) for x in "acgt"}
    out = columns.withColumns({f"log_{x}": v for x, v in like.items()})
    top = F.greatest(*[F.col(f"log_{x}") for x in "acgt"])
    scaled = sum((F.exp(F.col(f"log_{x}") - top) for x in "acgt"), F.lit(0.0))
    return out.withColumn("posterior", 1 / scaled)


def incorrect_bases(columns: DataFrame, cutoff: int) -> DataFrame:
    """Columns whose most frequent base is not the root's, which has few votes."""
    own = F.when(F.col("root") == "A", F.col("a")).when(F.col("root") == "C", F.col("c")).when(F.col("root") == "G", F.col("g")).otherwise(F.col("t"))
    return columns.filter((F.col("consensus") != F.col("root")) & (own < cutoff))


def top_by_count(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties to the first in order."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("t")).select(*by, "t.*")


def histogram(values: DataFrame, value: str, name: str = "count") -> DataFrame:
    return values.groupBy(value).agg(F.count("*").alias(name))


def index_rows(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """0-based index within groups."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
