"""Queries of formats, alignments and scalar text functions on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.functions import seq
from strandweave.operators import contexts, msa
from strandweave.plans.runtime import materialize
from strandweave.queries import AS_BASES, HEX, READS_SQL, load, query, reads
from strandweave.sources import readers, writers

CIGAR = "(l_linenumber || 'M' || (CAST(l_quantity AS INTEGER) % 3 + 1) || 'D' || (CAST(l_quantity AS INTEGER) % 5 + 1) || 'M')"


@query(f"""SELECT l_orderkey, l_linenumber, {CIGAR} AS cigar, repeat('M', l_linenumber) || repeat('D', CAST(l_quantity AS INTEGER) % 3 + 1)
 || repeat('M', CAST(l_quantity AS INTEGER) % 5 + 1) AS expanded, {CIGAR} AS again FROM lineitem""")
def cigar_round_trip(spark, d):
    q = F.col("l_quantity").cast("int")
    cigar = F.concat(F.col("l_linenumber").cast("string"), F.lit("M"), (q % 3 + 1).cast("string"), F.lit("D"), (q % 5 + 1).cast("string"), F.lit("M"))
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cigar.alias("cigar")).withColumn("expanded", seq.expand_cigar("cigar"))
    return rows.withColumn("again", seq.compact_cigar("expanded"))


SAM_SQL = f"""WITH a AS (SELECT l_orderkey AS read, l_linenumber, l_partkey AS pos, l_returnflag = 'R' AS backwards, l_linenumber AS m1, CAST(l_quantity AS INTEGER) % 3 + 1 AS dn,
 CAST(l_quantity AS INTEGER) % 5 + 1 AS m2, left(translate(md5(CAST(l_partkey AS VARCHAR)), '{HEX}', '{AS_BASES}'), l_linenumber + CAST(l_quantity AS INTEGER) % 5 + 1) AS seq FROM lineitem),
p AS (SELECT *, k AS q_at, pos + k AS ref_off FROM (SELECT *, unnest(range(0, m1)) AS k FROM a) UNION ALL
 SELECT *, m1 + k, pos + m1 + dn + k FROM (SELECT *, unnest(range(0, m2)) AS k FROM a))"""


@query(SAM_SQL + """ SELECT read, backwards, substr(seq, CAST(q_at AS INTEGER) + 1, 1) AS base, count(*) AS n, CAST(sum(ref_off) AS BIGINT) AS ref_sum,
 CAST(sum(CASE WHEN backwards THEN length(seq) - 1 - q_at ELSE q_at END) AS BIGINT) AS i_sum FROM p GROUP BY ALL""")
def sam_pairs(spark, d):
    q = F.col("l_quantity").cast("int")
    bases = F.translate(F.md5(F.col("l_partkey").cast("string")), HEX, AS_BASES)
    sam = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read"), F.lit("r").alias("ref"), F.col("l_partkey").alias("pos"), F.when(F.col("l_returnflag") == "R", 16).otherwise(0).alias("flag"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("M"), (q % 3 + 1).cast("string"), F.lit("D"), (q % 5 + 1).cast("string"), F.lit("M")).alias("cigar"),
        F.left(bases, F.col("l_linenumber") + q % 5 + 1).alias("seq"),
    )
    pairs = readers.aligned_pairs(sam)
    return pairs.groupBy("read", "backwards", "base").agg(F.count("*").alias("n"), F.sum("ref_off").alias("ref_sum"), F.sum("i").cast("long").alias("i_sum"))


@query(SAM_SQL + f""", r AS (SELECT s_suppkey AS ref, repeat(translate(md5(s_name), '{HEX}', '{AS_BASES}'), 700) AS rs FROM supplier)
SELECT read, ref, count(*) AS n FROM p JOIN r ON read % 100 = ref WHERE substr(rs, CAST(ref_off AS INTEGER), 1) = substr(seq, CAST(q_at AS INTEGER) + 1, 1) AND ref_off > 0 GROUP BY ALL""")
def sam_mismatch_filter(spark, d):
    q = F.col("l_quantity").cast("int")
    bases = F.translate(F.md5(F.col("l_partkey").cast("string")), HEX, AS_BASES)
    sam = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read"), (F.col("l_orderkey") % 100).alias("ref"), F.col("l_partkey").alias("pos"), F.when(F.col("l_returnflag") == "R", 16).otherwise(0).alias("flag"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("M"), (q % 3 + 1).cast("string"), F.lit("D"), (q % 5 + 1).cast("string"), F.lit("M")).alias("cigar"),
        F.left(bases, F.col("l_linenumber") + q % 5 + 1).alias("seq"),
    )
    ref = load(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.repeat(F.translate(F.md5("s_name"), HEX, AS_BASES), F.lit(700)).alias("seq"))
    pairs = readers.aligned_pairs(sam).filter("ref_off > 0")
    used = materialize(ref.join(sam.select("ref").distinct(), "ref", "left_semi"))  # others meet no read
    return readers.matching_pairs(pairs, used).groupBy("read", "ref").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN c_acctbal > 0 THEN concat_ws(chr(9), c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name, CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 1 THEN '1' ELSE '0' END)
 ELSE concat_ws(chr(9), c_name, CAST(c_custkey AS VARCHAR)) END AS value FROM customer""")
def ragged_mappings(spark, d):
    c = load(spark, d, "customer")
    ok = F.col("c_acctbal") > 0
    mapped = c.select(
        F.when(ok, F.col("c_mktsegment")).alias("ref"), F.when(ok, F.col("c_nationkey")).alias("ref_off"), F.col("c_name").alias("read"), F.col("c_custkey").alias("i"),
        F.when(ok, F.col("c_custkey") % 2 == 1).alias("backwards"),
    )
    return writers.read_mappings(mapped)


@query("""SELECT c_custkey, c_name || '/' || (c_custkey % 2 + 1) AS read, c_name AS base, CAST(c_custkey % 2 AS INTEGER) AS index, c_name || '/' || (2 - c_custkey % 2) AS other FROM customer""")
def pair_names(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("/"), (F.col("c_custkey") % 2 + 1).cast("string")).alias("read"))
    return c.select("c_custkey", "read", seq.pair_basename("read").alias("base"), seq.pair_index("read").alias("index"), seq.pair_id("read").alias("other"))


@query(f"""WITH {READS_SQL}, p AS (SELECT doc_id, seq, lead(seq) OVER (PARTITION BY lang ORDER BY doc_id) AS other FROM reads),
e AS (SELECT doc_id, unnest(range(1, 33)) AS i, seq, other FROM p WHERE other IS NOT NULL)
SELECT doc_id, string_agg(CASE WHEN substr(seq, i, 1) = substr(other, i, 1) THEN '.' ELSE substr(seq, i, 1) END, '' ORDER BY i) AS diff,
 CAST(coalesce(min(CASE WHEN substr(seq, i, 1) <> substr(other, i, 1) THEN i END) - 1, 32) AS INTEGER) AS shared FROM e GROUP BY doc_id""")
def diff_strings(spark, d):
    from pyspark.sql import Window

    p = reads(spark, d).withColumn("other", F.lead("seq").over(Window.partitionBy("lang").orderBy("doc_id"))).filter("other is not null")
    return p.select("doc_id", seq.diff_string("seq", "other").alias("diff"), seq.shared_prefix("seq", "other").alias("shared"))


@query(f"""WITH {READS_SQL}, g AS (SELECT doc_id AS node, left(seq, n) AS context FROM (SELECT doc_id, seq, unnest(range(1, 13)) AS n FROM reads)),
u AS (SELECT context, min(node) AS node FROM (SELECT DISTINCT node, context FROM g) GROUP BY context HAVING count(*) = 1)
SELECT node, min(length(context)) AS shortest FROM u GROUP BY node""")
def context_sets(spark, d):
    strings = reads(spark, d).select(F.col("doc_id").alias("node"), "seq")
    found = contexts.minimal_unique_contexts(strings, 12)
    return contexts.context_lengths(found).select("node", F.col("shortest").cast("long").alias("shortest"))


@query("""WITH c AS (SELECT o_custkey AS msa, o_orderkey AS k, ['A','C','G','T','-'][o_orderkey % 5 + 1] AS r, ['A','G','G','T','-'][o_custkey % 5 + 1] AS s,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT msa, count(*) FILTER (r <> s) AS mismatches FROM c GROUP BY msa""")
def msa_mismatches(spark, d):
    o = load(spark, d, "orders")
    letter = lambda letters, at: F.element_at(F.array(*map(F.lit, letters)), at.cast("int"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("x")))), lambda y: y["x"]), "")
    rows = o.groupBy(F.col("o_custkey").alias("msa")).agg(
        text(letter("ACGT-", F.col("o_orderkey") % 5 + 1)).alias("r"), text(letter("AGGT-", F.col("o_custkey") % 5 + 1)).alias("s")
    )
    flat = rows.select("msa", F.explode(F.create_map(F.lit("r"), "r", F.lit("s"), "s")).alias("name", "text")).withColumns({"start": F.lit(0), "strand": F.lit(1)})
    return msa.mismatches(flat, "r", "s")
