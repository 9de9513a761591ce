"""Queries that write a format to the shared folder and read it back, and of the
tools on saved indices. What is read must equal what the tables held."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import seq
from strandweave.operators import cactus, contigs, evaluate, lookup, suffixes
from strandweave.plans import mapping
from strandweave.plans.runtime import materialize, shared_folder
from strandweave.queries import AS_BASES, HEX, SUFFIX_SQL, load, query, texts
from strandweave.queries_mapping import INPUT_SQL, MAP_SQL, STATISTICS_SQL, contigs_and_reads
from strandweave.sources import readers, schemas, writers
from strandweave.streaming import reads as streaming


def written(spark: SparkSession, rows: DataFrame, parts: int = 3) -> str:
    """The path of text files of one column ``value``; a value may hold several lines."""
    path = shared_folder(spark, "files")
    writers.lines(rows.select("value").repartition(parts), path)
    return path


def joined(*parts, by: str = "\t"):
    return F.concat_ws(by, *[p if not isinstance(p, str) else F.col(p).cast("string") for p in parts]).alias("value")


def bases(of: str):
    return F.translate(F.md5(of), HEX, AS_BASES)


SUPPLIER_SEQ = f"translate(md5(s_name), '{HEX}', '{AS_BASES}')"


# ---- sequences ---------------------------------------------------------------------


@query(f"SELECT 3 AS genome, s_name AS name, {SUPPLIER_SEQ} AS seq FROM supplier")
def fasta_file(spark, d):
    s = load(spark, d, "supplier").select(
        F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ", a note").otherwise(" other words")).alias("name"), F.lower(bases("s_name")).alias("seq")
    )
    folded = s.withColumn("seq", F.concat(F.left("seq", F.lit(10)), F.lit("\n"), F.substring("seq", 11, 32), F.lit(" ")))
    return readers.fasta(spark, written(spark, writers.fasta_lines(folded)), 3)


@query(f"SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN lower({SUPPLIER_SEQ}) ELSE {SUPPLIER_SEQ} END AS seq, {SUPPLIER_SEQ} AS checked FROM supplier")
def fasta_flags(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.lower(bases("s_name"))).otherwise(bases("s_name")).alias("seq"))
    path = written(spark, writers.fasta_lines(s))
    checked = readers.fasta(spark, path, validate=True).select("name", F.col("seq").alias("checked"))
    return readers.fasta(spark, path, keep_case=True).select("name", "seq").join(checked, "name")


FASTQ_SQL = f"SELECT s_name AS name, {SUPPLIER_SEQ} AS seq, repeat(chr(CAST(40 + s_nationkey AS INTEGER)), 32) AS qual FROM supplier"


def _fastq(spark, d) -> str:
    s = load(spark, d, "supplier")
    record = joined(F.concat(F.lit("@"), "s_name", F.lit(" 1:N:0")), bases("s_name"), F.lit("+"), F.repeat(F.char(F.col("s_nationkey") + 40), F.lit(32)), by="\n")
    return written(spark, s.select(record))


@query(FASTQ_SQL)
def fastq_file(spark, d):
    return readers.fastq(spark, _fastq(spark, d))


@query(f"WITH q AS ({FASTQ_SQL}) SELECT name, reverse(seq) AS reversed, CAST(length(seq) AS BIGINT) AS length, reverse(qual) AS quality FROM q")
def read_table(spark, d):
    rows = readers.fastq(spark, _fastq(spark, d))
    turned = contigs.reversed_reads(rows, "seq", "qual")
    return turned.join(contigs.read_lengths(rows, "name", "seq"), "name").select("name", F.col("seq").alias("reversed"), "length", F.col("qual").alias("quality"))


@query(f"SELECT s_name AS name, {SUPPLIER_SEQ} AS seq FROM supplier WHERE s_suppkey % 10 = 3")
def reads_by_name(spark, d):
    wanted = load(spark, d, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_name").alias("name"))
    return contigs.reads_by_id(readers.fastq(spark, _fastq(spark, d)), wanted, "name").select("name", "seq")


@query("SELECT s_name AS name, s_suppkey * 10 AS start, CAST(s_nationkey AS BIGINT) AS length, CAST(s_nationkey % 3 AS INTEGER) AS genome FROM supplier")
def contig_file(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 10).alias("start"), F.col("s_nationkey").alias("length"), (F.col("s_nationkey") % 3).alias("genome"))
    path = shared_folder(spark, "files")
    writers.tsv(s, path)
    return readers.contig_table(spark, path)


@query(f'WITH {SUFFIX_SQL} SELECT rank, text, "offset", suffix FROM sa')
def saved_index(spark, d):
    path = shared_folder(spark, "index")
    t = texts(spark, d)
    lookup.save_index(path, texts=t, suffixes=suffixes.ranked(t))
    return lookup.load_index(spark, path, "suffixes")["suffixes"].select("rank", "text", "offset", "suffix")


@query("SELECT p_partkey % 7 AS k, p_name AS name, CAST(count(*) OVER (PARTITION BY p_partkey % 7) AS INTEGER) AS size FROM part")
def cluster_file(spark, d):
    p = load(spark, d, "part").withColumn("k", F.col("p_partkey") % 7)
    n = F.count("*").over(Window.partitionBy("k")).cast("string")
    rows = p.select(joined("k", n, "p_name", bases("p_name")))
    found = readers.clusters(spark, written(spark, rows))
    return found.select(F.col("cluster").cast("long").alias("k"), F.explode("reads.id").alias("name"), "size")


# ---- annotation and alignment ---------------------------------------------------------


@query("SELECT p_brand AS contig, p_partkey AS start, CAST(p_partkey + p_size AS BIGINT) AS \"end\", p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS strand FROM part")
def bed_file(spark, d):
    sign = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    rows = load(spark, d, "part").select(joined("p_brand", "p_partkey", (F.col("p_partkey") + F.col("p_size")).cast("string"), "p_name", F.lit("0"), sign))
    return readers.bed(spark, written(spark, rows))


@query(f"""WITH b AS (SELECT s_suppkey AS k, unnest(range(0, 6)) AS i, left(translate(md5(s_name), '{HEX}', 'ACGTACGTACGTAC--'), 6) AS x, right(translate(md5(s_name), '{HEX}', 'ACGTACGTACGTAC--'), 6) AS y FROM supplier),
c AS (SELECT k, i, 'a' || k % 5 AS contig, k * 10 + sum(CASE WHEN substr(x, i + 1, 1) <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) - 1 AS base, FALSE AS reverse, substr(x, i + 1, 1) AS c FROM b
 UNION ALL SELECT k, i, 'b' || k % 5, k * 10 - sum(CASE WHEN substr(y, i + 1, 1) <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) + 1, TRUE, substr(y, i + 1, 1) FROM b),
d AS (SELECT *, count(*) OVER (PARTITION BY k, i) AS n FROM c WHERE c <> '-')
SELECT contig, CAST(base AS BIGINT) AS base, reverse, count(*) AS n FROM d WHERE n > 1 GROUP BY ALL""")
def maf_file(spark, d):
    text = F.translate(F.md5("s_name"), HEX, "ACGTACGTACGTAC--")
    k = F.col("s_suppkey")
    row = lambda name, sign, s: joined(F.lit("s"), F.concat(F.lit(name), (k % 5).cast("string")), (k * 10).cast("string"), F.lit("6"), F.lit(sign), F.lit("1000"), s, by=" ")
    block = joined(F.lit("a score=0"), F.lit("s rootSeq 0 6 + 6 AAAAAA"), row("a", "+", F.left(text, F.lit(6))), row("b", "-", F.right(text, F.lit(6))), F.lit(""), by="\n")
    found = readers.maf(spark, written(spark, load(spark, d, "supplier").select(block)))
    return found.groupBy("contig", F.col("base").cast("long").alias("base"), "reverse").agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey AS read, l_linenumber AS n, CAST(l_linenumber % 2 * 16 AS INTEGER) AS flag, 'r' || l_suppkey % 3 AS ref, l_partkey AS pos, CAST(l_quantity AS INTEGER) AS mapq, count(*) AS copies
FROM lineitem WHERE l_linenumber <> 4 AND l_quantity >= 10 GROUP BY ALL""")
def sam_file(spark, d):
    flag = F.col("l_linenumber") % 2 * 16 + F.when(F.col("l_linenumber") == 4, 256).otherwise(0)
    row = joined(
        F.concat_ws("/", "l_orderkey", "l_linenumber"), flag.cast("string"), F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")), "l_partkey", F.col("l_quantity").cast("int").cast("string"),
        F.lit("4M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("*"),
    )
    head = spark.range(1).select(F.lit("@HD\tVN:1.0").alias("value"))
    found = readers.sam(spark, written(spark, load(spark, d, "lineitem").select(row).unionByName(head)), 10)
    part = lambda i: F.split("read", "/")[i]
    return found.groupBy(part(0).cast("long").alias("read"), part(1).cast("int").alias("n"), "flag", "ref", "pos", "mapq").agg(F.count("*").alias("copies"))


@query("""SELECT s_name AS "query", 't' || s_nationkey AS target, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(b AS INTEGER) AS block, s_suppkey + 10 * b AS q_start, s_suppkey * 2 + 20 * b AS t_start, CAST(5 + b AS BIGINT) AS length
FROM (SELECT *, unnest(range(0, 1 + s_suppkey % 3)) AS b FROM supplier)""")
def psl_file(spark, d):
    k = F.col("s_suppkey")
    listed = lambda f: F.concat(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda b: f(b).cast("string")), ","), F.lit(","))
    zero = [F.lit("0")] * 7
    row = joined(F.lit("9"), *zero, F.when(k % 2 == 0, "+").otherwise("-"), "s_name", F.lit("99"), F.lit("0"), F.lit("99"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")), F.lit("99"), F.lit("0"), F.lit("99"), F.lit("1"),
                 listed(lambda b: b + 5), listed(lambda b: k + 10 * b), listed(lambda b: k * 2 + 20 * b))
    head = spark.range(1).select(F.lit("psLayout version 3").alias("value"))
    return readers.psl(spark, written(spark, load(spark, d, "supplier").select(row).unionByName(head)))


@query(f"""SELECT 2 * s_suppkey AS left_end, 2 * s_suppkey + 1 AS right_end, CAST(s_nationkey AS INTEGER) AS reads, CAST(s_suppkey % 3 AS INTEGER) AS links, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey + 5 END AS first, {SUPPLIER_SEQ} AS seq FROM supplier""")
def mag_file(spark, d):
    k = F.col("s_suppkey")
    some = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k % 3, F.lit(1))), lambda i: F.concat_ws(",", (k + 4 + i).cast("string"), F.lit("20"))), ";")
    links = F.when(k % 3 > 0, F.concat(some, F.lit(";"))).otherwise(".")
    head = joined(F.concat(F.lit("@"), (2 * k).cast("string"), F.lit(":"), (2 * k + 1).cast("string")), "s_nationkey", links, F.lit("."))
    row = joined(head, bases("s_name"), F.lit("+"), F.repeat(F.lit("I"), F.lit(32)), by="\n")
    u = readers.mag(spark, written(spark, load(spark, d, "supplier").select(row)))
    return u.select(F.col("ends")[0].alias("left_end"), F.col("ends")[1].alias("right_end"), "reads", F.size("left").alias("links"), F.get("left.end", F.lit(0)).alias("first"), "seq")


@query("SELECT p_brand AS category, p_name AS gene FROM part")
def gene_set_file(spark, d):
    return readers.gene_sets(spark, written(spark, load(spark, d, "part").select(joined("p_brand", "p_name"))))


@query("SELECT s_name AS genome, CAST(s_suppkey % 2 AS BIGINT) AS children, s_suppkey * 100 AS length, CAST(s_nationkey AS BIGINT) AS sequences, s_suppkey AS top, s_suppkey + 1 AS bottom FROM supplier")
def hal_stats_file(spark, d):
    k = F.col("s_suppkey")
    row = joined("s_name", (k % 2).cast("string"), (k * 100).cast("string"), "s_nationkey", "s_suppkey", (k + 1).cast("string"), by=", ")
    head = spark.range(1).select(F.lit("GenomeName, NumChildren, Length, NumSequences, NumTopSegments, NumBottomSegments").alias("value"))
    return readers.hal_stats(spark, written(spark, load(spark, d, "supplier").select(row).unionByName(head)))


@query("SELECT s_suppkey / 1000 AS a, s_nationkey / 1000 AS g, 0.25 AS c, 0.125 AS t, round(1 - s_suppkey / 1000 - s_nationkey / 1000 - 0.375, 9) AS n FROM supplier")
def composition_file(spark, d):
    row = joined((F.col("s_suppkey") / 1000).cast("string"), (F.col("s_nationkey") / 1000).cast("string"), F.lit("0.25"), F.lit("0.125"))
    found = readers.base_composition(spark, written(spark, load(spark, d, "supplier").select(row)))
    return found.select("a", "g", "c", "t", F.round("n", 9).alias("n"))


@query("SELECT CAST(s_suppkey % 2 AS INTEGER) AS test, s_suppkey AS total, CAST(s_nationkey AS BIGINT) AS \"true\", s_nationkey / 100 AS average FROM supplier")
def comparison_file(spark, d):
    n = F.col("s_nationkey")
    one = F.concat(F.lit('<homologyTests><aggregateResults><all totalTests="'), F.col("s_suppkey").cast("string"), F.lit('" totalTrue="'), n.cast("string"), F.lit('" average="'), (n / 100).cast("string"), F.lit('"/></aggregateResults></homologyTests>'))
    pairs = load(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 2).alias("k"), "s_suppkey", one.alias("x")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "x"))).alias("t"))
    # a document for each pair: the text reader takes whole files, so one is written for each
    files = pairs.select("k", F.concat(F.lit("<r>"), F.when(F.col("t")[0]["s_suppkey"] % 2 == 1, "<homologyTests><aggregateResults/></homologyTests>").otherwise(""), F.array_join(F.col("t.x"), ""), F.lit("</r>")).alias("value"))
    path = shared_folder(spark, "files")
    files.repartition("k").write.partitionBy("k").text(path)
    found = readers.maf_comparison(spark, f"{path}/*/*")
    return found.select(F.when(F.col("total") % 2 == 1, 1).otherwise(0).alias("test"), "total", "true", "average")


@query("""SELECT 'chr' || s_nationkey AS chrom, s_suppkey AS pos, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS id, 'A' AS ref, 'C,G' AS alt, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS DOUBLE) END AS qual, 'PASS' AS filter, CAST(s_nationkey AS VARCHAR) AS depth FROM supplier""")
def vcf_file(spark, d):
    k = F.col("s_suppkey")
    v = load(spark, d, "supplier").select(
        F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("chrom"), k.alias("pos"), F.when(k % 2 == 0, F.col("s_name")).alias("id"), F.lit("A").alias("ref"), F.array(F.lit("C"), F.lit("G")).alias("alt"),
        F.when(k % 3 == 0, k.cast("double")).alias("qual"), F.lit("PASS").alias("filter"), F.create_map(F.lit("DP"), F.col("s_nationkey").cast("string"), F.lit("AF"), F.lit("0.5")).alias("info"),
    )
    head = spark.range(1).select(F.lit("##fileformat=VCFv4.0").alias("value"))
    found = readers.vcf(spark, written(spark, writers.vcf_lines(v).unionByName(head)))
    return found.select("chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), "qual", "filter", F.col("info")["DP"].alias("depth"))


# ---- star trees and graphs ---------------------------------------------------------------

STAR = """seg AS (SELECT 'e' || c_nationkey % 3 AS event, 'q' || c_custkey AS name, c_custkey AS contig, 10 * i AS start, 10 AS length, CASE WHEN (c_custkey + i) % 4 > 0 THEN (c_custkey + i) % 11 END AS block,
 CASE WHEN (c_custkey + i) % 4 > 0 THEN (c_custkey * i) % 2 = 0 END AS orientation FROM (SELECT *, unnest(range(0, 3)) AS i FROM customer))"""


def _star(spark, d) -> DataFrame:
    c = load(spark, d, "customer").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    k = F.col("c_custkey") + F.col("i")
    return c.select(
        F.concat(F.lit("e"), (F.col("c_nationkey") % 3).cast("string")).alias("event"), F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("contig"),
        (F.col("i") * 10).cast("long").alias("start"), F.lit(10).alias("length"), F.when(k % 4 > 0, k % 11).alias("block"), F.when(k % 4 > 0, F.col("c_custkey") * F.col("i") % 2 == 0).alias("orientation"),
    )


def _c2h(spark, rows: DataFrame) -> str:
    path = shared_folder(spark, "files")
    writers.lines(rows.repartition(4, "event", "sequence").sortWithinPartitions("event", "sequence", "row").select("value"), path)
    return path


@query(f"""WITH {STAR}, b AS (SELECT block, max(length) AS length FROM seg WHERE block IS NOT NULL GROUP BY block),
r AS (SELECT block, length, sum(length) OVER (ORDER BY block) - length AS place FROM b)
SELECT event, name AS sequence, FALSE AS is_bottom, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, block, orientation FROM seg
UNION ALL SELECT 'rootSeq', 'rootSeq', TRUE, CAST(place AS BIGINT), CAST(length AS BIGINT), block, NULL FROM r""")
def c2h_file(spark, d):
    return readers.c2h(spark, _c2h(spark, writers.c2h_root(_star(spark, d)))).drop("line")


REFERENCE = """ref AS (SELECT DISTINCT 'e9' AS event, 'ref' AS name, CAST(block * 10 AS BIGINT) AS start, CAST(10 AS BIGINT) AS length, block FROM seg WHERE block IS NOT NULL)"""


@query(f"""WITH {STAR}, {REFERENCE} SELECT event, name AS sequence, FALSE AS is_bottom, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, block, orientation FROM seg
UNION ALL SELECT event, name, TRUE, start, length, block, NULL FROM ref""")
def c2h_below_reference(spark, d):
    s = _star(spark, d)
    own = s.filter("block is not null").select("block").distinct().select(
        F.lit("e9").alias("event"), F.lit("ref").alias("name"), F.lit(-1).cast("long").alias("contig"), (F.col("block") * 10).alias("start"), F.lit(10).alias("length"), "block", F.lit(True).alias("orientation")
    )
    return readers.c2h(spark, _c2h(spark, writers.c2h_reference(materialize(s.unionByName(own)), "e9"))).drop("line")


@query(f"WITH {STAR} SELECT event, name, start FROM seg WHERE event IN ('e0', 'e2')")
def kept_events(spark, d):
    wanted = spark.createDataFrame([("e0",), ("e2",), ("other",)], "event string")
    return writers.keep_events(_star(spark, d), wanted).select("event", "name", F.col("start").cast("int").alias("start"))


@query(f"""WITH {STAR}, a AS (SELECT contig, start, CASE WHEN orientation THEN block ELSE -block END AS a FROM seg WHERE block IS NOT NULL),
n AS (SELECT a, lead(a) OVER (PARTITION BY contig ORDER BY start) AS b FROM a), k AS (SELECT CASE WHEN a > -b OR (a = -b AND b >= -a) THEN a ELSE -b END AS x, CASE WHEN a > -b OR (a = -b AND b >= -a) THEN b ELSE -a END AS y FROM n WHERE b IS NOT NULL)
SELECT concat_ws(chr(9), 'ARC', x, y, count(*)) AS value FROM k GROUP BY x, y UNION ALL SELECT DISTINCT concat_ws(chr(9), 'NODE', block, 3 + block % 5) FROM seg WHERE block IS NOT NULL""")
def graph_file(spark, d):
    s = _star(spark, d)
    sequences = s.filter("block is not null").select("block").distinct().withColumn("seq", F.repeat(F.lit("A"), (F.col("block") % 5 + 3).cast("int")))
    path = written(spark, writers.last_graph(s, sequences))
    return spark.read.text(path)


@query("SELECT '  ' || c_custkey || ' -- ' || c_nationkey || ' [label=\"' || c_mktsegment || '\"];' AS value FROM customer")
def dot_file(spark, d):
    e = load(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b"), F.col("c_mktsegment").alias("label"))
    return spark.read.text(written(spark, writers.dot(e)))


@query("SELECT c_mktsegment || chr(9) || CAST(sum(c_custkey) AS BIGINT) AS value FROM customer GROUP BY c_mktsegment")
def stats_file(spark, d):
    totals = evaluate.keyed_totals(load(spark, d, "customer").select(F.col("c_mktsegment").alias("stat"), F.col("c_custkey").alias("value")))
    return spark.read.text(written(spark, writers.stats_lines(totals)))


@query(f"SELECT 'rootSeq' AS name, repeat('N', 77) AS seq UNION ALL SELECT s_name, {SUPPLIER_SEQ} FROM supplier")
def alignment_fasta_file(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_name").alias("name"), bases("s_name").alias("seq"))
    return readers.fasta(spark, written(spark, writers.alignment_fasta(s, 77))).select("name", "seq")


@query(f"SELECT CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN 'ref' ELSE 'GI' || s_suppkey END AS name, {SUPPLIER_SEQ} AS seq FROM supplier")
def renamed_records(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("x gi|"), F.col("s_suppkey").cast("string"), F.lit("|ref")).alias("name"), bases("s_name").alias("seq"))
    return writers.first_renamed(s, "s_suppkey").select("name", "seq")


@query("SELECT 'fixedStep chrom=' || replace(replace(c_mktsegment, 'BUILDING', 'b'), 'MACHINERY', 'm') || ' start=' || c_custkey AS value FROM customer")
def renamed_wiggle(spark, d):
    rows = load(spark, d, "customer").select(F.concat(F.lit("fixedStep chrom="), "c_mktsegment", F.lit(" start="), F.col("c_custkey").cast("string")).alias("value"))
    return writers.rename_wiggle(spark.read.text(written(spark, rows)), {"BUILDING": "b", "MACHINERY": "m"})


@query("SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier")
def concatenated_files(spark, d):
    paths = [written(spark, load(spark, d, t).select(F.col(c).alias("value"))) for t, c in (("customer", "c_name"), ("supplier", "s_name"))]
    return writers.concatenated(spark, paths)


# ---- stored records -------------------------------------------------------------------------


@query("SELECT s_suppkey AS id, s_suppkey % 20 AS \"left\", CAST(s_nationkey AS BIGINT) AS \"right\", s_name AS bases, CASE WHEN s_suppkey % 2 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS face FROM supplier")
def stored_records(spark, d):
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier")
    sites = s.select(F.struct(k.alias("id"), (k % 20).alias("left"), F.col("s_nationkey").cast("long").alias("right")).alias("edge"), F.col("s_name").alias("bases"))
    sides = s.select(k.alias("coordinate"), F.when(k % 2 == 0, "LEFT").otherwise("RIGHT").alias("face"))
    path = shared_folder(spark, "records")
    sites.write.parquet(f"{path}/sites")
    schemas.checked_faces(sides).write.parquet(f"{path}/sides")
    read = spark.read.schema(schemas.SITE).parquet(f"{path}/sites")
    faces = spark.read.schema(schemas.SIDE).parquet(f"{path}/sides")
    return read.join(faces, F.col("edge.id") == F.col("coordinate")).select("edge.id", "edge.left", "edge.right", "bases", "face")


@query("""SELECT s_suppkey * 10 AS start, s_suppkey * 10 + 9 AS "end", s_name AS sample FROM supplier WHERE s_suppkey <= 50
UNION ALL SELECT s_suppkey * 10 + 510, s_suppkey * 10 + 519, s_name FROM supplier WHERE s_suppkey > 50""")
def merged_populations(spark, d):
    k = F.col("s_suppkey") * 10
    s = load(spark, d, "supplier").withColumns({"start": k, "end": k + 9})
    row = joined("start", "end", "s_name")
    a, b = (readers.population(spark, written(spark, s.filter(c).select(row))) for c in ("s_suppkey <= 50", "s_suppkey > 50"))
    return readers.merge_populations(a, b)


# ---- star-tree merges --------------------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT 'e' || c_nationkey % 3 AS event, 'q' || c_custkey AS sequence, c_custkey FROM customer)
SELECT event || '.' || f AS event, sequence, CAST(3 AS BIGINT) AS segments FROM e, (SELECT unnest(['x', 'y']) AS f) WHERE event <> 'e0'
UNION ALL SELECT event, sequence, CAST(6 AS BIGINT) FROM e WHERE event = 'e0'""")
def cactus_segments(spark, d):
    path = _c2h(spark, writers.c2h_root(_star(spark, d)))
    files = [readers.c2h(spark, path).filter("not is_bottom or event = 'rootSeq'") for _ in range(2)]
    found, _ = cactus.merge(files, [".x", ".y"], "e0")
    return found.filter("not is_bottom").groupBy("event", "sequence").agg(F.count("*").alias("segments"))


@query(f"SELECT s_name AS name, {SUPPLIER_SEQ} AS seq FROM supplier")
def first_records(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_name").alias("name"), bases("s_name").alias("seq"))
    again = s.withColumn("seq", F.lit("ACGT"))
    return cactus.first_by_name([s, again])


# ---- mapping to saved indices, counters, streams -------------------------------------------------

BOTH_WAYS = STATISTICS_SQL.replace("{queries}", "(SELECT read || '+' AS read, seq FROM reads UNION ALL SELECT read || '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads)")


@query(f"""WITH {BOTH_WAYS}, r AS (SELECT left(read, length(read) - 1) AS read, i, text, pos FROM st WHERE uniq IS NOT NULL AND longest >= 8 AND read LIKE '%+'),
l AS (SELECT left(read, length(read) - 1) AS read, 31 - i AS i, CASE WHEN text % 2 = 0 THEN text + 1 ELSE text - 1 END AS text, 31 - pos AS pos FROM st WHERE uniq IS NOT NULL AND longest >= 8 AND read LIKE '%-'),
rside AS (SELECT read, i, CASE WHEN text % 2 = 0 THEN text // 2 * 32 + pos ELSE text // 2 * 32 + 31 - pos END AS c, CASE WHEN text % 2 = 0 THEN 'R' ELSE 'L' END AS f FROM r),
lside AS (SELECT read, i, CASE WHEN text % 2 = 0 THEN text // 2 * 32 + pos ELSE text // 2 * 32 + 31 - pos END AS c, CASE WHEN text % 2 = 0 THEN 'L' ELSE 'R' END AS f FROM l),
b AS (SELECT read, seq, unnest(range(0, 32)) AS i FROM reads)
SELECT read, CAST(i AS INTEGER) AS i, substr(seq, i + 1, 1) AS base, lside.c || lside.f AS "left", rside.c || rside.f AS "right",
 CASE WHEN lside.c IS NULL THEN rside.c || CASE rside.f WHEN 'L' THEN 'R' ELSE 'L' END WHEN rside.c IS NULL OR (lside.c = rside.c AND lside.f <> rside.f) THEN lside.c || lside.f END AS "both" FROM b LEFT JOIN lside USING (read, i) LEFT JOIN rside USING (read, i)""")
def mapped_sides(spark, d):
    known, asked = contigs_and_reads(spark, d)
    path = shared_folder(spark, "index")
    lookup.save_index(path, contigs=known)
    reference = mapping.collect_reference(lookup.load_index(spark, path, "contigs")["contigs"])
    return mapping.map_sides(asked, reference, 8)


@query(f"""WITH {STATISTICS_SQL.replace('{queries}', 'reads')}, win AS (SELECT read, arg_min(start + length, start) - 1 AS a, max(start) AS b FROM mus GROUP BY read),
votes AS (SELECT read, text, pos + b - start AS o, b AS i FROM (SELECT *, unnest(range(start, start + length)) AS b FROM mum)),
one AS (SELECT read, i, count(DISTINCT (text, o)) AS n FROM votes JOIN win USING (read) WHERE i BETWEEN a AND b GROUP BY read, i),
t AS (SELECT count(*) FILTER (n = 1) AS mapped, count(*) FILTER (n > 1) AS conflicted, (SELECT 32 * count(*) FROM reads) AS every FROM one)
SELECT 'mapped' AS stat, mapped AS value FROM t UNION ALL SELECT 'conflicted', conflicted FROM t UNION ALL SELECT 'unmapped', every - mapped FROM t UNION ALL SELECT 'credit', 0 FROM t UNION ALL SELECT 'conflictedCredit', 0 FROM t""")
def mapping_counters(spark, d):
    known, asked = contigs_and_reads(spark, d)
    return mapping.map_counters(asked, mapping.collect_reference(known), "natural")


@query(f"WITH {INPUT_SQL} SELECT CAST(32 * count(*) AS BIGINT) AS bases FROM reads")
def zip_counters(spark, d):
    known, asked = contigs_and_reads(spark, d)
    counted = mapping.map_counters(asked, mapping.collect_reference(known), "zip", min_context=8)
    return counted.filter("stat in ('mapped', 'unmapped')").agg(F.sum("value").alias("bases"))


LONG = f"""g AS (SELECT string_agg(translate(md5(c_name) || md5(c_name || 'x') || left(md5(c_name || 'y'), 8), '{HEX}', '{AS_BASES}'), '' ORDER BY c_custkey) AS s FROM customer),
reads AS (SELECT s_name AS read, left(substr(s, s_suppkey * 103 + 1, 32), 15) || translate(substr(s, s_suppkey * 103 + 16, 1), 'ACGT', 'CGTA') || substr(s, s_suppkey * 103 + 17, 16) AS seq FROM supplier, g),
texts AS (SELECT 0 AS text, s AS seq FROM g UNION ALL SELECT 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM g),
letters AS (SELECT text, unnest(string_split(seq, '')) AS c, unnest(range(0, length(seq))) AS i FROM texts),
heads AS (SELECT text, i, string_agg(c, '') OVER (PARTITION BY text ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS head FROM letters),
rs AS (SELECT text, i, left(head, l) AS sub FROM (SELECT text, head, i, unnest(range(1, 33)) AS l FROM heads) WHERE l <= length(head)),
qs AS (SELECT read, i, l, substr(seq, i + 1, l) AS sub FROM (SELECT read, seq, i, unnest(range(1, 33 - i)) AS l FROM (SELECT read, seq, unnest(range(0, 32)) AS i FROM reads))),
occ AS (SELECT sub, count(*) AS n, min(text) AS text, min(i) AS pos FROM rs WHERE sub IN (SELECT sub FROM qs) GROUP BY sub),
st AS (SELECT read, i, max(l) AS longest, min(CASE WHEN n = 1 THEN l END) AS uniq, arg_max(text, l) FILTER (n = 1) AS text, arg_max(pos, l) FILTER (n = 1) AS pos FROM qs JOIN occ USING (sub) GROUP BY read, i),
w AS (SELECT *, lag(longest) OVER (PARTITION BY read ORDER BY i) AS before FROM st)"""


def _long(spark, d):
    name = F.concat(F.md5("c_name"), F.md5(F.concat("c_name", F.lit("x"))), F.left(F.md5(F.concat("c_name", F.lit("y"))), F.lit(8)))
    c = load(spark, d, "customer").select("c_custkey", F.translate(name, HEX, AS_BASES).alias("s"))
    # one contig, made once
    genome = c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "s"))), lambda x: x["s"]), "").alias("seq"))
    known = materialize(genome.select(F.lit(0).cast("long").alias("contig"), "seq", F.lit(0).cast("long").alias("genome")))
    at = F.col("at")
    cut = F.concat(F.substring("seq", at + 1, F.lit(15)), F.translate(F.substring("seq", at + 16, F.lit(1)), "ACGT", "CGTA"), F.substring("seq", at + 17, F.lit(16)))
    # a read comes from the piece it starts on: ``substring`` counts from the start of a text
    pieces = contigs.pieces(known.select("contig", "seq"), "contig", mapping.PIECE, 31).select((F.col("start") / mapping.PIECE).cast("int").alias("piece"), "seq")
    at = (F.col("s_suppkey") * 103).cast("long")
    s = load(spark, d, "supplier").select("s_name", (at % mapping.PIECE).cast("int").alias("at"), F.floor(at / mapping.PIECE).cast("int").alias("piece"))
    asked = s.join(pieces.hint("merge"), "piece", "left").select(F.col("s_name").alias("read"), F.coalesce(cut, F.lit("")).alias("seq"))
    return known, materialize(asked)


@query(f"""WITH {LONG} SELECT read, CAST(i AS INTEGER) AS start, CAST(longest AS INTEGER) AS length, CAST(text AS BIGINT) AS text, CAST(pos AS BIGINT) AS "offset" FROM w WHERE uniq IS NOT NULL AND (i = 0 OR before <= longest)""")
def long_reference_mum(spark, d):
    known, asked = _long(spark, d)
    both = known.select(F.lit(0).alias("text"), "seq").unionByName(known.select(F.lit(1).alias("text"), seq.reverse_complement("seq").alias("seq")))
    return mapping.relational_matchings(asked, both)


@query(f"""WITH {LONG} SELECT read, CAST(i AS INTEGER) AS i, CAST(longest AS INTEGER) AS longest, CASE WHEN uniq IS NOT NULL THEN CAST(uniq AS INTEGER) END AS "unique" FROM st WHERE longest >= 4""")
def long_statistics(spark, d):
    known, asked = _long(spark, d)
    both = known.select("seq").unionByName(known.select(seq.reverse_complement("seq").alias("seq")))
    return mapping.relational_statistics(asked, both, 1).filter("longest >= 4")


@query(MAP_SQL)
def streamed_mapping(spark, d):
    known, asked = contigs_and_reads(spark, d)
    folder = shared_folder(spark, "stream")
    asked.select("read", "seq").write.parquet(f"{folder}/in")
    mapped = streaming.map_stream(streaming.read_stream(spark, f"{folder}/in", 2), mapping.collect_reference(known))
    streaming.write_mappings(mapped, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(mapping.MAPPED).parquet(f"{folder}/out")
