"""The five tools as functions and as a command line, with their public option
names and defaults: ``python -m strandweave.plans.tools createIndex ...``."""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.operators import cactus, contigs, graph, lookup, suffixes
from strandweave.plans import mapping
from strandweave.plans.runtime import global_index, materialize
from strandweave.sources import readers, writers


def contigs_of(spark: SparkSession, fastas: list[str]) -> DataFrame:
    """(contig, name, start, length, genome, seq) of FASTA files, a genome each;
    contigs are numbered in the order of genomes, records and starts."""
    records = reduce(DataFrame.unionByName, [readers.fasta(spark, f, i, numbered=True) for i, f in enumerate(fastas)])
    keyed = materialize(records.withColumn("key", F.struct("genome", "record", "name")).select("key", "seq"))
    parts = contigs.split_contigs(keyed, "key")
    parts = parts.select(F.col("key.genome").cast("long").alias("genome"), F.col("key.record").alias("record"), F.col("key.name").alias("name"), "start", "length", "seq")
    return materialize(global_index(parts, ["genome", "record", "start"], "contig").drop("record"))


def indexed(spark: SparkSession, indexDirectory: str | None, fastas: list[str]) -> DataFrame:
    """The contigs of an index directory that is there; else those of FASTA files,
    saved in the directory if one is named."""
    if indexDirectory and lookup.has_index(spark, indexDirectory):
        return lookup.load_index(spark, indexDirectory, "contigs")["contigs"]
    rows = contigs_of(spark, fastas)
    if indexDirectory:
        lookup.save_index(indexDirectory, contigs=rows)
    return rows


def scheme_parameters(mapType: str, **o) -> dict:
    """Options of a tool as parameters of a mapping scheme."""
    if mapType == "zip":
        return {
            "min_context": o.get("context", 0), "credit": o.get("credit", False), "credit_mismatches": o.get("mismatches", 0),
            "max_range_count": o.get("maxRangeCount", 100), "max_extend_through": o.get("maxExtendThrough", 100),
            "mismatch_tolerance": o.get("maxEditDistance", 0), "min_unique_strings": o.get("minEditBound", 0),
        }
    return {
        "context": o.get("context", 0), "credit": o.get("credit", False), "mismatches": o.get("mismatches", 0),
        "ignore_matches_below": o.get("ignoreMatchesBelow", 0), "min_edit_bound": o.get("minEditBound", 0),
        "max_edit_distance": o.get("maxEditDistance", 0), "unstable": o.get("unstable", False),
    }


def create_index(spark: SparkSession, indexDirectory: str, fastas: list[str], mapType: str = "natural", noMerge: bool = False, **o) -> dict[str, DataFrame]:
    """Index FASTA files, merge their genomes greedily, and measure the graph.

    Returns the tables; those whose option names a path are written as text too.
    ``sampleRate`` is accepted without effect: the whole suffix array is kept, and
    tasks take the place of ``threads``.
    """
    rows = contigs_of(spark, fastas)
    texts = contigs.double_strand(rows.select("contig", "genome", "seq"))
    lookup.save_index(indexDirectory, contigs=rows, texts=texts, suffixes=suffixes.ranked(texts, ["genome"]))
    out: dict[str, DataFrame] = {"contigs": rows}
    if noMerge:
        return out
    merges, coverage = mapping.merge_greedy(spark, rows.select("contig", "seq", "genome"), mapType, **scheme_parameters(mapType, **o))
    bases = graph.base_table(rows)
    segments = materialize(graph.segments_of(bases, mapping.canonical(merges)))
    components = materialize(graph.adjacency_components(segments))
    out |= {
        "merges": merges, "coverage": coverage, "segments": segments, "degrees": graph.degrees(segments), "spectrum": graph.component_spectrum(components),
        "indelLengths": graph.indel_lengths(segments), "tandemDuplications": graph.tandem_duplications(segments),
        "nontrivialRearrangements": graph.rearrangements(segments),
    }
    named = segments.join(rows.select("contig", "name", F.col("genome").cast("string").alias("event")), "contig")
    out["alignment"] = writers.c2h_root(named)
    text = {
        "degrees": lambda d: d.select(F.col("degree").cast("string")), "indelLengths": lambda d: d.select(F.col("length").cast("string")),
        "tandemDuplications": lambda d: d.groupBy().agg(F.count("*").cast("string")), "nontrivialRearrangements": lambda d: d.select("ends"),
        "spectrum": lambda d: d.select(F.concat_ws("\t", F.col("size").cast("string"), F.col("count").cast("string"))),
    }
    for name, line in text.items():
        if o.get(name):
            writers.lines(line(out[name]), o[name])
    if o.get("alignment"):
        ordered = out["alignment"].repartitionByRange("event", "sequence", "row").sortWithinPartitions("event", "sequence", "row")
        writers.lines(ordered.select("value"), o["alignment"])
    if o.get("alignmentFasta"):
        blocks = segments.filter("block is not null").groupBy("block").agg(F.max("length").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        writers.lines(writers.alignment_fasta(rows.select("name", "seq"), int(blocks)), o["alignmentFasta"])
    if o.get("mapStats"):
        stats = coverage.select(F.concat(F.lit("mapped"), F.col("genome").cast("string")).alias("stat"), F.col("aligned").alias("value"))
        writers.lines(writers.stats_lines(stats), o["mapStats"])
    return out


def map_reads(spark: SparkSession, reference: str, fastas: list[str], alignment: str | None = None, stats: str | None = None, indexDirectory: str | None = None, **o) -> DataFrame:
    """Reads of FASTA files to the one N-free record of a reference file, or of an
    index directory that is there."""
    if not (indexDirectory and lookup.has_index(spark, indexDirectory)):
        record = readers.fasta(spark, reference).limit(2).collect()
        if len(record) != 1 or "N" in record[0].seq:
            raise ValueError("the reference must hold one record, without N")
    rows = indexed(spark, indexDirectory, [reference])
    reads = contigs.drop_ambiguous(reduce(DataFrame.unionByName, [readers.fasta(spark, f) for f in fastas]).select(F.col("name").alias("read"), "seq"))
    known = mapping.collect_reference(rows, "name")
    mapped = mapping.map_reads(reads, known, "natural", **scheme_parameters("natural", **o))
    if alignment:
        writers.lines(writers.read_mappings(mapped), alignment)
    if stats:
        counted = mapping.map_counters(reads, known, "natural", **scheme_parameters("natural", **o))
        writers.lines(writers.stats_lines(counted.filter("value > 0 or stat in ('mapped', 'unmapped')")), stats)
    return mapped


def map_to_index(spark: SparkSession, index: str, pattern: str | None = None, fasta: str | None = None, repeat: int = 1, minContext: int = 0, cluster: str = "local") -> DataFrame:
    """(level, i, base, left, both, right): the sides of a saved index's bases that
    a string's bases map to by their left, both, or right contexts. The last of
    ``repeat`` rounds is returned; the milliseconds of one are printed."""
    if (pattern is None) == (fasta is None):
        raise ValueError("give a pattern or a FASTA file")
    text = pattern if pattern is not None else readers.fasta(spark, fasta, numbered=True).orderBy("record").first().seq
    reference = mapping.collect_reference(lookup.load_index(spark, index, "contigs")["contigs"].select("contig", "seq", "genome"))
    query = spark.createDataFrame([("0", text)], "read string, seq string")
    began = time.perf_counter()
    for _ in range(max(1, repeat)):
        found = mapping.map_sides(query, reference, minContext).collect()
    print(f"map() took {(time.perf_counter() - began) * 1000 / max(1, repeat):f} ms/call")
    return spark.createDataFrame(found, mapping.SIDES).select(F.lit(0).alias("level"), "i", "base", "left", "both", "right")


def evaluate_mapability(spark: SparkSession, reference: str, outputFile: str | None = None, minEditBound: int = 0, indexDirectory: str | None = None) -> DataFrame:
    rows = indexed(spark, indexDirectory, [reference])
    found = mapping.evaluate_mapability(rows.select("contig", "seq"), mapping.collect_reference(rows.select("contig", "seq", "genome")), minEditBound)
    if outputFile:
        ordered = found.repartitionByRange("contig", "base").sortWithinPartitions("contig", "base")
        writers.lines(ordered.select(F.col("length").cast("string")), outputFile)
    return found


def cactus_merge(spark: SparkSession, c2h: list[str], fasta: list[str], suffix: list[str], mergeOn: str, c2hOut: str | None = None, fastaOut: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge c2h and FASTA pairs on a shared event; (segments, sequences)."""
    files = [readers.c2h(spark, f) for f in c2h]
    segments, merges = cactus.merge(files, suffix, mergeOn)
    ids = segments.select("event", "sequence").distinct()
    numbered = segments.join(global_index(ids, ["event", "sequence"], "contig"), ["event", "sequence"])
    w = Window.partitionBy("contig").orderBy("start")
    blocks = cactus.blocks(merges).select(F.col("node").alias("base"), "component", "reversed")
    placed = numbered.withColumn("base", F.shiftleft("contig", 32) + F.col("start")).join(blocks, "base", "left")
    rows = placed.select("event", F.col("sequence").alias("name"), "contig", "start", "length", F.col("component").alias("block"), (~F.col("reversed")).alias("orientation"), F.row_number().over(w).alias("n"))
    records = cactus.first_by_name([readers.fasta(spark, f, keep_case=True) for f in fasta])
    if c2hOut:
        lines = writers.c2h_root(rows).repartitionByRange("event", "sequence", "row").sortWithinPartitions("event", "sequence", "row")
        writers.lines(lines.select("value"), c2hOut)
    if fastaOut:
        writers.lines(writers.fasta_lines(records), fastaOut)
    return rows, records


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandweave")
    tools = top.add_subparsers(dest="tool", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    for name, default in (("context", 0), ("mismatches", 0), ("ignoreMatchesBelow", 0), ("minEditBound", 0), ("maxEditDistance", 0), ("sampleRate", 64)):
        shared.add_argument(f"--{name}", type=int, default=default)
    for name in ("credit", "unstable"):
        shared.add_argument(f"--{name}", action="store_true")
    build = tools.add_parser("createIndex", parents=[shared])
    build.add_argument("indexDirectory")
    build.add_argument("fastas", nargs="+")
    build.add_argument("--noMerge", action="store_true")
    build.add_argument("--scheme", choices=["greedy"], default="greedy")
    build.add_argument("--mapType", choices=["natural", "zip"], default="natural")
    build.add_argument("--maxRangeCount", type=int, default=100)
    build.add_argument("--maxExtendThrough", type=int, default=100)
    for name in ("alignment", "alignmentFasta", "lastGraph", "degrees", "spectrum", "indelLengths", "tandemDuplications", "nontrivialRearrangements", "mapStats"):
        build.add_argument(f"--{name}")
    reads = tools.add_parser("mapReads", parents=[shared])
    reads.add_argument("indexDirectory")
    reads.add_argument("reference")
    reads.add_argument("fastas", nargs="+")
    reads.add_argument("--mapType", choices=["natural"], default="natural")
    reads.add_argument("--threads", type=int, default=16)
    reads.add_argument("--alignment")
    reads.add_argument("--stats")
    able = tools.add_parser("evaluateMapability")
    able.add_argument("indexDirectory")
    able.add_argument("reference")
    able.add_argument("outputFile")
    able.add_argument("--minEditBound", type=int, default=0)
    able.add_argument("--sampleRate", type=int, default=64)
    table = tools.add_parser("mapToIndex")
    table.add_argument("index")
    table.add_argument("--cluster", default="local")
    table.add_argument("--pattern")
    table.add_argument("--fasta")
    table.add_argument("--repeat", type=int, default=1)
    table.add_argument("--minContext", type=int, default=0)
    merge = tools.add_parser("cactusMerge")
    for name in ("c2h", "fasta", "suffix"):
        merge.add_argument(f"--{name}", action="append", required=True)
    merge.add_argument("--mergeOn", required=True)
    merge.add_argument("c2hOut")
    merge.add_argument("fastaOut")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = vars(_parser().parse_args(arguments))
    spark = spark or SparkSession.builder.getOrCreate()
    tool = o.pop("tool")
    o.pop("scheme", None), o.pop("threads", None), o.pop("sampleRate", None)
    if tool == "createIndex":
        create_index(spark, **o)
    elif tool == "mapReads":
        o.pop("mapType")
        map_reads(spark, **o)
    elif tool == "evaluateMapability":
        evaluate_mapability(spark, **o)
    elif tool == "mapToIndex":
        for line in writers.mapping_table(map_to_index(spark, **o).orderBy("level", "i").collect()):
            print(line)
    else:
        cactus_merge(spark, **o)


if __name__ == "__main__":
    main()
