"""Range and paging queries over stored graphs and alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sites_between(sites: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Polymorphic sites, insertions or deletions in [start, end]."""
    return sites.filter((F.col("contig") == contig) & F.col("position").between(start, end))


def attached(edges: DataFrame, side) -> DataFrame:
    """Sites and breakpoints with one end at a side."""
    return edges.filter((F.col("left_side") == side) | (F.col("right_side") == side))


def telomeres(sides: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """Sides that no adjacency touches."""
    used = adjacencies.select(F.col("left_side").alias("side")).unionByName(adjacencies.select(F.col("right_side").alias("side")))
    return sides.join(used.distinct(), "side", "left_anti")


def variable_owner(groups: DataFrame, variable) -> DataFrame:
    return groups.filter(F.col("variable") == variable)


def constraints_on(constraints: DataFrame, variable) -> DataFrame:
    """Constraints with a term in a variable (terms: array<struct<variable, ..>>)."""
    return constraints.filter(F.exists("terms", lambda t: t["variable"] == variable))


def page(rows: DataFrame, key: str, after=None, size: int = 100) -> DataFrame:
    """One page in key order after a token, with the next token: keyset paging,
    a filter and a bounded top-k instead of counting past rows."""
    found = rows if after is None else rows.filter(F.col(key) > after)
    return found.orderBy(key).limit(size)


def pages(rows: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """Every page of every group: (by, page, rows, token of its last row)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1
    paged = rows.withColumn("page", F.floor(n / size))
    return paged.groupBy(by, "page").agg(F.count("*").alias("rows"), F.max(key).alias("token"))


def uniform_edges(**kinds: DataFrame) -> DataFrame:
    """One (kind, id, left_side, right_side) table over record kinds."""
    out = None
    for kind, df in sorted(kinds.items()):
        part = df.select(F.lit(kind).alias("kind"), "id", "left_side", "right_side")
        out = part if out is None else out.unionByName(part)
    return out


# ---- sequence graph stores -----------------------------------------------------


def allele_group(groups: DataFrame, group_id: int) -> DataFrame:
    return groups.filter(F.col("edge.id") == group_id)


def allele_groups_at(groups: DataFrame, side: int) -> DataFrame:
    """Allele groups with an end at a side."""
    return groups.filter((F.col("edge.left") == side) | (F.col("edge.right") == side))


def adjacencies_of(adjacencies: DataFrame, group: DataFrame) -> DataFrame:
    """Adjacencies that touch an end of any of the groups."""
    ends = group.select(F.explode(F.array("edge.left", "edge.right")).alias("side")).distinct()
    a = adjacencies.withColumn("side", F.explode(F.array("edge.left", "edge.right")))
    return a.join(ends, "side", "left_semi").drop("side").distinct()


def transmissions_of(transmissions: DataFrame, group_ids: DataFrame) -> DataFrame:
    """Transmissions that start or end at the groups (id)."""
    t = transmissions.withColumn("id", F.explode(F.array("parent", "child")))
    return t.join(group_ids.select("id"), "id", "left_semi").drop("id").distinct()


def variant_groups_between(groups: DataFrame, places: DataFrame, contig: str, start: int, end: int, reference) -> DataFrame:
    """Allele groups whose place (id, contig, position) lies in [start, end] and
    whose allele is not the reference's."""
    here = places.filter((F.col("contig") == contig) & F.col("position").between(start, end)).select("id")
    not_reference = F.coalesce(F.col("allele_string"), F.col("allele_int").cast("string")) != F.lit(str(reference))
    return groups.filter(not_reference).withColumn("id", F.col("edge.id")).join(here, "id", "left_semi").drop("id")


def spans_longer(adjacencies: DataFrame, places: DataFrame, contig: str, start: int, end: int, inserted: bool) -> DataFrame:
    """Adjacencies in a region whose ends are further apart than neighbours
    (deletions), or that touch what has no place there (insertions)."""
    at = lambda side: places.select(F.col("side").alias(f"_{side}"), F.col("contig").alias(f"_{side}c"), F.col("position").alias(f"_{side}p"))
    a = adjacencies.withColumns({"_left": F.col("edge.left"), "_right": F.col("edge.right")}).join(at("left"), "_left", "left").join(at("right"), "_right", "left")
    within = lambda s: (F.col(f"_{s}c") == contig) & F.col(f"_{s}p").between(start, end)
    one = F.coalesce(within("left"), F.lit(False)) != F.coalesce(within("right"), F.lit(False))
    unplaced = F.col("_leftp").isNull() | F.col("_rightp").isNull()
    both = F.coalesce(within("left") & within("right") & (F.abs(F.col("_leftp") - F.col("_rightp")) > 1), F.lit(False))
    return a.filter(one & unplaced if inserted else both).select(*adjacencies.columns)
