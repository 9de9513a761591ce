"""Writers: DataFrames as the text formats that downstream tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.plans.runtime import global_index, running_sum, tree_reduce


def lines(df: DataFrame, path: str) -> None:
    """One text column, a value a line."""
    df.write.mode("overwrite").text(path)


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False, nullValue="")


def read_mappings(mapped: DataFrame) -> DataFrame:
    """Ragged rows: ``ref, off, read, i, backwards`` or ``read, i``."""
    text = lambda *c: F.concat_ws("\t", *[F.col(x).cast("string") for x in c])
    back = F.col("backwards").cast("int").cast("string")
    full = F.concat_ws("\t", text("ref", "ref_off", "read", "i"), back)
    return mapped.select(F.when(F.col("ref").isNotNull(), full).otherwise(text("read", "i")).alias("value"))


def stats_lines(stats: DataFrame) -> DataFrame:
    return stats.select(F.concat_ws("\t", "stat", F.col("value").cast("string")).alias("value"))


def fasta_lines(records: DataFrame) -> DataFrame:
    return records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def alignment_fasta(records: DataFrame, root_length) -> DataFrame:
    """The inputs behind a root of so many N."""
    root = records.sparkSession.range(1).select(F.lit("rootSeq").alias("name"), F.repeat(F.lit("N"), F.lit(root_length)).alias("seq"))
    return fasta_lines(root.unionByName(records.select("name", "seq")))


def first_renamed(records: DataFrame, order: str) -> DataFrame:
    """The first record becomes ``ref``, others ``GI`` and their number."""
    heads = global_index(records.select(order), [order], "_n")
    gi = F.concat(F.lit("GI"), F.regexp_extract("name", r"gi\|([0-9]+)", 1))
    return records.join(heads, order).withColumn("name", F.when(F.col("_n") == 0, "ref").otherwise(gi)).drop("_n")


def c2h_root(segments: DataFrame) -> DataFrame:
    """(event, sequence, row, value): a star tree below a synthetic root whose
    bottom segments are the blocks in order; segments are top rows, those in no
    block without a block field. ``segments``: event, name, contig, start,
    length, block, orientation."""
    blocks = segments.filter("block is not null").groupBy("block").agg(F.max("length").alias("length"))
    placed = running_sum(blocks, ["block"], {"upto": F.col("length")})
    bottom = placed.select("block", "length", (F.col("upto") - F.col("length")).alias("at"))
    text = lambda *c: F.concat_ws("\t", *[x if not isinstance(x, str) else F.lit(x) for x in c])
    cast = lambda c: F.col(c).cast("string")
    root = bottom.select(F.lit("rootSeq").alias("event"), F.lit("rootSeq").alias("sequence"), F.col("at").alias("row"), text("a", cast("block"), cast("at"), cast("length")).alias("value"))
    # a star tree refers to a block by its place in the root
    top = segments.select(
        "event", F.col("name").alias("sequence"), F.col("start").alias("row"),
        F.when(F.col("block").isNull(), text("a", cast("start"), cast("length")))
        .otherwise(text("a", cast("start"), cast("length"), cast("block"), F.col("orientation").cast("int").cast("string"))).alias("value"),
    )
    heads = segments.select("event", F.col("name").alias("sequence")).distinct().select(
        "event", "sequence", F.lit(-1).cast("long").alias("row"), F.concat(F.lit("s\t'"), "event", F.lit("'\t'"), "sequence", F.lit("'\t0")).alias("value")
    )
    first = bottom.sparkSession.range(1).select(F.lit("rootSeq").alias("event"), F.lit("rootSeq").alias("sequence"), F.lit(-1).cast("long").alias("row"), F.lit("s\t'rootSeq'\t'rootSeq'\t1").alias("value"))
    return first.unionByName(root).unionByName(heads).unionByName(top)


def c2h_reference(segments: DataFrame, reference_event: str) -> DataFrame:
    """The same below a reference genome instead of a synthetic root: blocks lie
    where the reference has them. A block it lacks, or has twice, raises."""
    own = segments.filter(F.col("event") == reference_event)
    counted = segments.filter("block is not null").groupBy("block").agg(F.count_if(F.col("event") == reference_event).alias("n"))
    message = F.concat(F.lit("block not once in the reference: "), F.col("block").cast("string"))
    none = F.lit(None).cast("string")
    # rows that raise when they are read; there are none if all is well
    bad = counted.filter("n <> 1").select(none.alias("event"), none.alias("sequence"), F.lit(0).cast("long").alias("row"), F.raise_error(message).cast("string").alias("value"))
    text = lambda *c: F.concat_ws("\t", *[x if not isinstance(x, str) else F.lit(x) for x in c])
    cast = lambda c: F.col(c).cast("string")
    bottom = own.filter("block is not null").select("event", F.col("name").alias("sequence"), F.col("start").alias("row"), text("a", cast("block"), cast("start"), cast("length")).alias("value"))
    rest = c2h_root(segments.filter(F.col("event") != reference_event)).filter("event <> 'rootSeq'")
    heads = own.select("event", F.col("name").alias("sequence")).distinct().select(
        "event", "sequence", F.lit(-1).cast("long").alias("row"), F.concat(F.lit("s\t'"), "event", F.lit("'\t'"), "sequence", F.lit("'\t1")).alias("value")
    )
    return heads.unionByName(bottom).unionByName(rest).unionByName(bad)


def keep_events(segments: DataFrame, events: DataFrame) -> DataFrame:
    return segments.join(events.select("event"), "event", "left_semi")


def last_graph(segments: DataFrame, sequences: DataFrame) -> DataFrame:
    """NODE and ARC lines: a node a block, arcs between blocks that follow each
    other, one for an arc and its reverse complement."""
    node = segments.filter("block is not null").join(sequences, "block").select(
        F.concat_ws("\t", F.lit("NODE"), F.col("block").cast("string"), F.length("seq").cast("string")).alias("value")
    ).distinct()
    w = Window.partitionBy("contig").orderBy("start")
    signed = segments.filter("block is not null").withColumn("a", F.when(F.col("orientation"), F.col("block")).otherwise(-F.col("block")))
    arcs = signed.withColumn("b", F.lead("a").over(w)).filter("b is not null")
    same = F.greatest(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct((-F.col("b")).alias("x"), (-F.col("a")).alias("y")))
    counted = arcs.groupBy(same.alias("k")).agg(F.count("*").alias("n"))
    return node.unionByName(counted.select(F.concat_ws("\t", F.lit("ARC"), *[F.col(c).cast("string") for c in ("k.x", "k.y", "n")]).alias("value")))


def mapping_table(rows) -> list[str]:
    """Console lines of mapped sides (level, base, left, both, right), a table a level."""
    out, level = [], None
    pad = lambda values: "\t".join((v or "").ljust(10) for v in values)
    for r in rows:
        if r["level"] != level:
            level = r["level"]
            out += [f"Mappings to level {level}:", pad(("Base", "Left", "Both", "Right"))]
        out.append(pad((r["base"], r["left"], r["both"], r["right"])))
    return out


def dot(edges: DataFrame, label: str = "label") -> DataFrame:
    """Graphviz lines of (a, b, label)."""
    line = F.concat(F.lit("  "), F.col("a").cast("string"), F.lit(" -- "), F.col("b").cast("string"), F.lit(' [label="'), F.col(label).cast("string"), F.lit('"];'))
    return edges.select(line.alias("value"))


def vcf_lines(variants: DataFrame) -> DataFrame:
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return variants.select(
        F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", F.array_join("alt", ","), F.coalesce(F.col("qual").cast("string"), F.lit(".")), "filter", info).alias("value")
    )


def concatenated(spark, paths: list[str]) -> DataFrame:
    """The lines of several files, one below the other."""
    return tree_reduce([spark.read.text(p) for p in paths], DataFrame.unionByName)


def rename_wiggle(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Wiggle lines with genomes renamed."""
    value = F.col("value")
    for old, new in names.items():
        value = F.replace(value, F.lit(f"chrom={old}"), F.lit(f"chrom={new}"))
    return rows.select(value.alias("value"))
