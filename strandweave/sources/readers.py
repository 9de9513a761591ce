"""Readers of sequence, alignment and annotation formats as DataFrames.

Files are split and parsed in the JVM by Spark's text and csv sources; nothing
is opened on the driver. ``gz`` files are unpacked by the source itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.operators import contigs

CONTIGS = "name string, start long, length long, genome int"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, line, value): lines numbered from 0 in each file; a part is a
    split of the file. Splits are counted first, and only one row for each of them
    is summed in one place, so no task reads a whole file."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("_m"), "value"
    )
    parts = rows.groupBy("file", "part").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("part")) - F.col("_n")
    placed = rows.join(F.broadcast(parts.select("file", "part", "_first", before.alias("_before"))), ["file", "part"])
    return placed.select("file", "part", (F.col("_m") - F.col("_first") + F.col("_before")).alias("line"), "value")


def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The last ``value`` that is not null up to each line of a file: inside a
    split by a window, and from the splits before it by one row for each."""
    rows = rows.withColumn("_v", value)
    upto = Window.unboundedPreceding
    ends = rows.groupBy("file", "part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line"))).alias("_e"))
    earlier = F.last("_e", ignorenulls=True).over(Window.partitionBy("file").orderBy("part").rowsBetween(upto, -1))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy("file", "part").orderBy("line").rowsBetween(upto, 0))
    both = rows.withColumn("_o", own).join(F.broadcast(ends.select("file", "part", earlier.alias("_b"))), ["file", "part"])
    return both.withColumn(name, F.coalesce("_o", "_b")).drop("_v", "_o", "_b")


def fasta(spark: SparkSession, path: str, genome: int | None = None, keep_case: bool = False, validate: bool = False, numbered: bool = False) -> DataFrame:
    """(genome, name, seq), and with ``numbered`` a record number that rises in file order. A name ends at the first comma, space, tab or VT;
    white space inside sequences goes. Text before the first ``>`` raises."""
    records = spark.read.text(path, lineSep="\n>").select(
        F.regexp_replace("value", "^>", "").alias("r"), F.input_file_name().alias("file"), F.col("value").startswith(">").alias("marked"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")).alias("record"),
    )
    head = F.split_part("r", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.expr("substring(r, length(split_part(r, '\n', 1)) + 1)"), r"\s", "")
    ok = records.filter(F.length(F.trim("r")) > 0).withColumn("seq", body if keep_case else F.upper(body))
    # the separator takes every mark but the one a file begins with
    unmarked = records.groupBy("file").agg(F.bool_or("marked").alias("ok")).filter("not ok")
    bad = unmarked.select(
        F.lit(genome).cast("int").alias("genome"), F.raise_error(F.lit("record does not begin with >")).cast("string").alias("name"), F.lit("").alias("seq"),
        *([F.lit(None).cast(records.schema["record"].dataType).alias("record")] if numbered else []),
    )
    if validate:
        ok = ok.withColumn("seq", F.when(F.col("seq").rlike("^[ACGTN]*$"), F.col("seq")).otherwise(F.raise_error(F.lit("sequence holds other letters"))))
    found = ok.select(F.lit(genome).cast("int").alias("genome"), F.regexp_extract(head, r"^[^, \t\x0B\r]*", 0).alias("name"), "seq", *(["record"] if numbered else []))
    return found.unionByName(bad)


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of four-line records."""
    at = F.col("line")
    rows = numbered_lines(spark, path).select("file", F.floor(at / 4).alias("rec"), (at % 4).alias("k"), "value")
    out = rows.groupBy("file", "rec").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(n) for k, n in ((0, "head"), (1, "seq"), (3, "qual"))])
    return out.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.upper("seq").alias("seq"), "qual")


def contig_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=CONTIGS)


def c2h(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their sequence: (event, sequence, is_bottom, line, start,
    length, name, block, orientation). ``s`` rows set what follows them; a top
    row of two fields has no block, one of four names block and orientation.
    A wrong number of fields raises."""
    rows = numbered_lines(spark, path).withColumn("f", F.split(F.trim("value"), "\t")).filter("value <> ''")
    s = F.when(F.col("f")[0] == "s", F.struct(unquoted(F.col("f")[1]).alias("event"), unquoted(F.col("f")[2]).alias("sequence"), (F.col("f")[3] == "1").alias("is_bottom")))
    rows = carried(rows, s, "s").filter(F.col("f")[0] == "a")
    n, bottom = F.size("f"), F.col("s.is_bottom")
    good = F.when(bottom, n == 4).otherwise((n == 3) | (n == 5))
    f = lambda i: F.when(good, F.col("f")[i]).otherwise(F.raise_error(F.lit("a row has a wrong number of fields")))
    return rows.select(
        "s.*", "line",
        F.when(bottom, f(2)).otherwise(f(1)).cast("long").alias("start"), F.when(bottom, f(3)).otherwise(f(2)).cast("long").alias("length"),
        F.when(bottom, f(1)).when(n == 5, f(3)).cast("long").alias("block"), F.when(~bottom & (n == 5), f(4).cast("int") == 1).alias("orientation"),
    )


def unquoted(c):
    return F.regexp_replace(c, "^'(.*)'$", "$1")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, name, strand): ``+`` is 1, all else -1."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, start long, end long, name string, score string, sign string")
    return rows.select("contig", "start", "end", "name", F.when(F.col("sign") == "+", 1).otherwise(-1).alias("strand"))


def maf(spark: SparkSession, path: str, root: str = "rootSeq") -> DataFrame:
    """(column_id, contig, base, reverse) of columns with two bases or more;
    gaps and the synthetic root's rows go. On the reverse strand bases count
    down from the start."""
    rows = numbered_lines(spark, path)
    s = carried(rows, F.when(F.col("value").startswith("a"), F.col("line")), "block").filter(F.col("value").startswith("s ") | F.col("value").startswith("s\t"))
    f = F.split(F.trim("value"), r"\s+")
    s = s.select("file", "block", f[1].alias("contig"), f[2].cast("long").alias("start"), (f[4] == "-").alias("reverse"), f[6].alias("text"))
    s = s.filter(F.col("contig") != root).select("*", F.posexplode(F.split("text", "")).alias("at", "c")).filter("c <> ''")
    seen = F.sum((F.col("c") != "-").cast("int")).over(Window.partitionBy("file", "block", "contig", "start", "reverse").orderBy("at")) - 1
    s = s.withColumn("k", seen).filter("c <> '-'")
    base = F.col("start") + F.when(F.col("reverse"), -F.col("k")).otherwise(F.col("k"))
    column = F.concat_ws(":", F.col("file"), F.col("block").cast("string"), F.col("at").cast("string"))
    s = s.select(F.xxhash64(column).alias("column_id"), "contig", base.alias("base"), "reverse")
    return s.join(s.groupBy("column_id").count().filter("count > 1").select("column_id"), "column_id", "left_semi")


def sam(spark: SparkSession, path: str, least_quality: int = 0) -> DataFrame:
    """Primary alignments: (read, flag, ref, pos, mapq, cigar, seq), pos 1-based."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@")).select(
        f[0].alias("read"), f[1].cast("int").alias("flag"), f[2].alias("ref"), f[3].cast("long").alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq")
    )
    return rows.filter((F.col("flag").bitwiseAND(0x900) == 0) & (F.col("mapq") >= least_quality))


def aligned_pairs(alignments: DataFrame) -> DataFrame:
    """(read, ref, i, ref_off, base, backwards): aligned bases of SAM rows, by
    running sums over CIGAR operations; i counts on the read's own strand."""
    ops = F.regexp_extract_all("cigar", F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    steps = F.transform(ops, lambda o: F.struct(F.expr("0").alias("z"), F.substring(o, F.lit(1), F.length(o) - 1).cast("int").alias("n"), F.right(o, F.lit(1)).alias("op")))
    state = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<q:int,r:int,n:int>>").alias("out")),
        lambda s, o: F.struct(
            (s["q"] + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(0)).alias("q"),
            (s["r"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["n"]).otherwise(0)).alias("r"),
            F.when(o["op"].isin("M", "=", "X"), F.concat(s["out"], F.array(F.struct(s["q"].alias("q"), s["r"].alias("r"), o["n"].alias("n"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    rows = alignments.filter(F.col("flag").bitwiseAND(4) == 0).withColumn("m", F.explode(state))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m.n") - 1)))
    at, back = F.col("m.q") + F.col("k"), F.col("flag").bitwiseAND(16) != 0
    i = F.when(back, F.length("seq") - 1 - at).otherwise(at)
    return rows.select("read", "ref", i.alias("i"), (F.col("pos") + F.col("m.r") + F.col("k")).alias("ref_off"), F.substring("seq", at + 1, F.lit(1)).alias("base"), back.alias("backwards"))


#: Bases of one piece of a reference that pairs are joined with.
PIECE = 256
#: Bases of all pieces that may be sent to every executor.
SENT = 16_000_000


def matching_pairs(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Aligned pairs whose bases agree (reference: ref, seq); others emit nothing.

    References are cut in pieces, and a pair meets the piece its base lies on. Pieces
    are broadcast if their counted bases are few, else joined by a shuffle: the files
    that sequences were made from do not tell how long those are. A base off the
    reference agrees with none; a pair without a base agrees with a place off it.
    """
    bases = reference.agg(F.sum(F.length("seq"))).first()[0] or 0
    whole = reference.filter("seq is not null").select("ref", F.lit(-1).cast("long").alias("_k"), F.length("seq").alias("_n"), F.lit(None).cast("string").alias("_piece"))
    cut = contigs.pieces(reference.select("ref", "seq"), "ref", PIECE)
    cut = cut.select("ref", F.floor(F.col("start") / PIECE).alias("_k"), F.lit(0).alias("_n"), F.col("seq").alias("_piece")).unionByName(whole)
    on = F.when(F.col("base") == "", -1).when(F.col("ref_off") > 0, F.floor((F.col("ref_off") - 1) / PIECE))
    joined = pairs.withColumn("_k", on).join(F.broadcast(cut) if bases <= SENT else cut.hint("merge"), ["ref", "_k"])
    own = F.substring("_piece", ((F.col("ref_off") - 1) % PIECE + 1).cast("int"), F.lit(1))
    agree = F.when(F.col("base") == "", ~F.col("ref_off").between(1, F.col("_n"))).otherwise(F.upper(own) == F.upper("base"))
    return joined.filter(agree).drop("_k", "_n", "_piece", "base")


def psl(spark: SparkSession, path: str) -> DataFrame:
    """(query, target, strand, block, q_start, t_start, length) of BLAT blocks."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^[0-9]")).select(
        f[8].alias("strand"), f[9].alias("query"), f[13].alias("target"),
        F.posexplode(F.arrays_zip(*[F.filter(F.split(f[i], ","), lambda x: x != "").alias(n) for i, n in ((18, "n"), (19, "q"), (20, "t"))])).alias("block", "b"),
    )
    return rows.select("query", "target", "strand", "block", F.col("b.q").cast("long").alias("q_start"), F.col("b.t").cast("long").alias("t_start"), F.col("b.n").cast("long").alias("length"))


def mag(spark: SparkSession, path: str) -> DataFrame:
    """Unitigs: ends array<long>, reads, left and right array<struct<end,len>>, seq."""
    rows = fastq_like(spark, path)
    f = F.split(F.regexp_replace("head", "^@", ""), "\t")
    links = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.contains(x, F.lit(","))), lambda x: F.struct(F.split(x, ",")[0].cast("long").alias("end"), F.split(x, ",")[1].cast("int").alias("len")))
    return rows.select(F.transform(F.split(f[0], ":"), lambda x: x.cast("long")).alias("ends"), f[1].cast("int").alias("reads"), links(f[2]).alias("left"), links(f[3]).alias("right"), "seq")


def fastq_like(spark: SparkSession, path: str) -> DataFrame:
    at = F.col("line")
    rows = numbered_lines(spark, path).select("file", F.floor(at / 4).alias("rec"), (at % 4).alias("k"), "value")
    return rows.groupBy("file", "rec").agg(F.max(F.when(F.col("k") == 0, F.col("value"))).alias("head"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("seq"))


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="category string, gene string").filter("gene is not null")


def hal_stats(spark: SparkSession, path: str) -> DataFrame:
    """(genome, children, length, sequences, top, bottom) rows of a stats listing."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(path).withColumn("f", f).filter((F.size("f") == 6) & F.col("f")[2].rlike("^[0-9]+$"))
    return rows.select(F.col("f")[0].alias("genome"), *[F.col("f")[i + 1].cast("long").alias(n) for i, n in enumerate(("children", "length", "sequences", "top", "bottom"))])


def base_composition(spark: SparkSession, path: str) -> DataFrame:
    """(a, c, g, t, n) shares; N is what the four leave."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(f) == 4).select(*[f[i].cast("double").alias(x) for i, x in enumerate("agct")])
    return rows.withColumn("n", 1 - (F.col("a") + F.col("c") + F.col("g") + F.col("t")))


def maf_comparison(spark: SparkSession, path: str) -> DataFrame:
    """(total, true, average) of each homology test's aggregate, from XML."""
    xml = spark.read.text(path, wholetext=True)
    at = lambda name: F.xpath("value", F.lit(f"//homologyTests/aggregateResults/all/@{name}"))
    rows = xml.select(F.posexplode(F.arrays_zip(at("totalTests").alias("total"), at("totalTrue").alias("true"), at("average").alias("average"))).alias("test", "r"))
    return rows.select("test", F.col("r.total").cast("long").alias("total"), F.col("r.true").cast("long").alias("true"), F.col("r.average").cast("double").alias("average"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt array, qual, filter, info map, format, samples)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(
        f[0].alias("chrom"), f[1].cast("long").alias("pos"), F.when(f[2] != ".", f[2]).alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alt"),
        F.when(f[5] != ".", f[5]).cast("double").alias("qual"), f[6].alias("filter"), F.str_to_map(f[7], F.lit(";"), F.lit("=")).alias("info"),
        F.try_element_at(f, F.lit(9)).alias("format"), F.slice(f, 10, 10_000).alias("samples"),
    )


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, size, reads array<struct<id, seq>>) of rows of one cluster each."""
    rows = spark.read.csv(path, sep="\t", schema="cluster string, size int, id string, seq string")
    return rows.groupBy("cluster").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("id", "seq"))).alias("reads"))


def population(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, sample): which sample a range of read numbers belongs to."""
    return spark.read.csv(path, sep="\t", schema="start long, end long, sample string")


def merge_populations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two population indices as one; the second's numbers move up."""
    last = a.agg((F.max("end") + 1).alias("_by"))
    moved = b.join(F.broadcast(last)).select((F.col("start") + F.col("_by")).alias("start"), (F.col("end") + F.col("_by")).alias("end"), "sample")
    return a.unionByName(moved)


SIDE = T.StructType([T.StructField("coordinate", T.LongType()), T.StructField("face", T.StringType())])


def side_array(spark: SparkSession, path: str) -> DataFrame:
    """(i, coordinate, face) of 8-byte little-endian records: the low bit is the
    face. Files of fixed records are split by Spark's binary record reader."""
    records = spark.sparkContext.binaryRecords(path, 8).zipWithIndex()  # no DataFrame source reads fixed-size records
    rows = records.map(lambda r: (r[1], int.from_bytes(r[0], "little"))).map(lambda r: (r[0], r[1] >> 1, "RIGHT" if r[1] & 1 else "LEFT"))
    return spark.createDataFrame(rows, "i long, coordinate long, face string")
