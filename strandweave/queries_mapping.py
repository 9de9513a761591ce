"""Queries of the mapping schemes. The reference has a contig for each market
segment and nation of the customers; each customer is a read: its contig with
one base changed, on the reverse strand for odd keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from strandweave.functions import align, seq
from strandweave.plans import mapping
from strandweave.queries import AS_BASES, HEX, load, query

INPUT_SQL = f"""c AS (SELECT c_custkey, translate(md5(c_mktsegment || c_nationkey), '{HEX}', '{AS_BASES}') AS s FROM customer),
ref AS (SELECT s AS seq, row_number() OVER (ORDER BY s) - 1 AS contig FROM (SELECT DISTINCT s FROM c)),
texts AS (SELECT 2 * contig AS text, seq FROM ref UNION ALL SELECT 2 * contig + 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ref),
m AS (SELECT c_custkey, left(s, c_custkey % 32) || translate(substr(s, c_custkey % 32 + 1, 1), 'ACGT', 'CGTA') || substr(s, c_custkey % 32 + 2) AS s FROM c),
reads AS (SELECT CAST(c_custkey AS VARCHAR) AS read, CASE WHEN c_custkey % 2 = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq FROM m)"""
STATISTICS_SQL = INPUT_SQL + """, rs AS (SELECT text, i, substr(seq, i + 1, l) AS sub FROM (SELECT text, seq, i, unnest(range(1, 33 - i)) AS l
  FROM (SELECT text, seq, unnest(range(0, 32)) AS i FROM texts))),
occ AS (SELECT sub, count(*) AS n, min(text) AS text, min(i) AS pos FROM rs GROUP BY sub),
qs AS (SELECT read, i, l, substr(seq, i + 1, l) AS sub FROM (SELECT read, seq, i, unnest(range(1, 33 - i)) AS l
  FROM (SELECT read, seq, unnest(range(0, 32)) AS i FROM {queries}))),
st AS (SELECT read, i, max(l) AS longest, min(CASE WHEN n = 1 THEN l END) AS uniq,
  arg_max(text, l) FILTER (n = 1) AS text, arg_max(pos, l) FILTER (n = 1) AS pos FROM qs JOIN occ USING (sub) GROUP BY read, i),
w AS (SELECT *, lag(longest) OVER (PARTITION BY read ORDER BY i) AS before, lead(uniq) OVER (PARTITION BY read ORDER BY i) AS after FROM st),
mum AS (SELECT read, i AS start, longest AS length, text, pos FROM w WHERE uniq IS NOT NULL AND (i = 0 OR before <= longest)),
mus AS (SELECT read, i AS start, uniq AS length, text, pos FROM w WHERE uniq IS NOT NULL AND (after IS NULL OR i + 1 + after > i + uniq))"""
OF_READS = STATISTICS_SQL.replace("{queries}", "reads")
OF_CONTIGS = STATISTICS_SQL.replace("{queries}", "(SELECT CAST(contig AS VARCHAR) AS read, seq FROM ref)")


def contigs_and_reads(spark, d):
    s = F.translate(F.md5(F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))), HEX, AS_BASES)
    c = load(spark, d, "customer").select("c_custkey", s.alias("s"))
    ordered = sorted(r.s for r in c.select("s").distinct().collect())  # a segment and nation each
    contigs = spark.createDataFrame([(i, x, 0) for i, x in enumerate(ordered)], "contig long, seq string, genome long")
    at = (F.col("c_custkey") % 32).cast("int")
    changed = F.concat(F.left("s", at), F.translate(F.substring("s", at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring("s", at + 2, F.lit(32)))
    reads = c.select(F.col("c_custkey").cast("string").alias("read"), F.when(F.col("c_custkey") % 2 == 1, seq.reverse_complement(changed)).otherwise(changed).alias("seq"))
    return contigs, reads


@query(f"WITH {OF_READS} SELECT read, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, text, pos AS \"offset\" FROM mum")
def mum(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    return mapping.matchings(reads, mapping.collect_reference(contigs), shortest=False)


@query(f"WITH {OF_READS} SELECT read, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, text, pos AS \"offset\" FROM mus")
def mus(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    return mapping.matchings(reads, mapping.collect_reference(contigs), shortest=True)


@query(f"WITH {OF_READS} SELECT read, CAST(i AS INTEGER) AS i, CAST(longest AS INTEGER) AS longest, CASE WHEN uniq IS NOT NULL THEN CAST(greatest(uniq, 4) AS INTEGER) END AS \"unique\" FROM st WHERE longest >= 4")
def matching_statistics(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    both = contigs.select("seq").unionByName(contigs.select(seq.reverse_complement("seq").alias("seq")))
    return mapping.relational_statistics(reads, both, 4).filter("longest >= 4")


MAP_SQL = f"""WITH {OF_READS}, win AS (SELECT read, arg_min(start + length, start) - 1 AS a, max(start) AS b FROM mus GROUP BY read),
votes AS (SELECT read, text, pos + b - start AS o, b AS i FROM (SELECT *, unnest(range(start, start + length)) AS b FROM mum)),
one AS (SELECT read, i, min(text) AS text, min(o) AS o FROM votes JOIN win USING (read) WHERE i BETWEEN a AND b GROUP BY read, i HAVING count(DISTINCT (text, o)) = 1),
bases AS (SELECT read, unnest(range(0, 32)) AS i FROM reads)
SELECT read, CAST(i AS INTEGER) AS i, CAST(text // 2 AS VARCHAR) AS ref, CASE WHEN text % 2 = 1 THEN 32 - o ELSE o + 1 END AS ref_off, text, o AS "offset",
  text % 2 = 1 AS backwards FROM bases LEFT JOIN one USING (read, i)"""


@query(MAP_SQL)
def natural_map(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    return mapping.map_reads(reads, mapping.collect_reference(contigs), "natural")


@query(f"SELECT ref, count(*) AS bases, count(DISTINCT read) AS reads FROM ({MAP_SQL}) GROUP BY ref")
def read_map_outer(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    mapped = mapping.map_reads(reads, mapping.collect_reference(contigs), "natural")
    return mapped.groupBy("ref").agg(F.count("*").alias("bases"), F.count_distinct("read").alias("reads"))


@query()
def natural_credit(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    return mapping.map_reads(reads, mapping.collect_reference(contigs), "natural", credit=True, mismatches=2, max_edit_distance=1, min_edit_bound=2)


@query(f"""WITH {OF_READS}, win AS (SELECT read, arg_min(start + length, start) - 1 AS a, max(start) AS b FROM mus GROUP BY read),
votes AS (SELECT read, text, pos + b - start AS o, b AS i FROM (SELECT *, unnest(range(start, start + length)) AS b FROM mum)),
one AS (SELECT read, i, min(text) AS text, min(o) AS o FROM votes JOIN win USING (read) WHERE i BETWEEN a AND b GROUP BY read, i HAVING count(DISTINCT (text, o)) = 1),
bases AS (SELECT read, seq, unnest(range(0, 32)) AS i FROM reads),
mapped AS (SELECT read, i, substr(bases.seq, i + 1, 1) AS base, text, o FROM bases LEFT JOIN one USING (read, i)),
near AS (SELECT *, max(CASE WHEN text IS NOT NULL THEN i END) OVER (PARTITION BY read ORDER BY i) AS l, min(CASE WHEN text IS NOT NULL THEN i END) OVER (PARTITION BY read ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM mapped),
said AS (SELECT n.read, n.i, n.base, n.l, n.r, x.text AS lt, x.o + n.i - n.l AS lo, y.text AS rt, y.o + n.i - n.r AS ro FROM near n JOIN mapped x ON x.read = n.read AND x.i = n.l JOIN mapped y ON y.read = n.read AND y.i = n.r WHERE n.text IS NULL),
seen AS (SELECT s.*, substr(a.seq, lo + 1, 1) AS lb, substr(b.seq, ro + 1, 1) AS rb, lo BETWEEN 0 AND 31 AS lin, ro BETWEEN 0 AND 31 AS rin FROM said s JOIN texts a ON a.text = lt JOIN texts b ON b.text = rt),
missed AS (SELECT *, sum(CASE WHEN lin AND lb <> base THEN 1 ELSE 0 END) OVER (PARTITION BY read, l ORDER BY i) AS lm, sum(CASE WHEN rin AND rb <> base THEN 1 ELSE 0 END) OVER (PARTITION BY read, r ORDER BY i DESC) AS rm FROM seen),
got AS (SELECT *, CASE WHEN lin AND lm <= 1 THEN [lt, lo] END AS left_, CASE WHEN rin AND rm <= 1 THEN [rt, ro] END AS right_ FROM missed),
credit AS (SELECT read, i, coalesce(left_, right_) AS at FROM got WHERE (left_ IS NULL OR right_ IS NULL OR left_ = right_) AND CASE WHEN left_ IS NOT NULL THEN lb ELSE rb END = base),
every AS (SELECT m.read, m.i, coalesce(m.text, c.at[1]) AS text, coalesce(m.o, c.at[2]) AS o FROM mapped m LEFT JOIN credit c ON m.read = c.read AND m.i = c.i)
SELECT read, CAST(i AS INTEGER) AS i, CAST(text // 2 AS VARCHAR) AS ref, CASE WHEN text % 2 = 1 THEN 32 - o ELSE o + 1 END AS ref_off, text, o AS "offset", text % 2 = 1 AS backwards FROM every""")
def credit_map(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    return mapping.map_reads(reads, mapping.collect_reference(contigs), "natural", credit=True, mismatches=1)


@query()
def zip_map(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    return mapping.map_reads(reads, mapping.collect_reference(contigs), "zip", min_context=8)


@query()
def zip_credit(spark, d):
    contigs, reads = contigs_and_reads(spark, d)
    return mapping.map_reads(reads, mapping.collect_reference(contigs), "zip", min_context=8, credit=True, credit_mismatches=1)


@query(f"""WITH {OF_CONTIGS}, b AS (SELECT CAST(contig AS VARCHAR) AS read, unnest(range(0, 32)) AS i FROM ref)
SELECT read AS contig, CAST(i AS INTEGER) AS base, CAST(min(CASE WHEN start <= i AND i < start + length THEN length WHEN start + length <= i THEN i - start + 1
  ELSE start + length - i END) AS INTEGER) AS length FROM b JOIN mus USING (read) GROUP BY read, i""")
def min_context(spark, d):
    contigs, _ = contigs_and_reads(spark, d)
    return mapping.evaluate_mapability(contigs, mapping.collect_reference(contigs))


@query()
def greedy_merge(spark, d):
    contigs, _ = contigs_and_reads(spark, d)
    five = contigs.withColumn("genome", F.col("contig") % 3)
    return mapping.merge_greedy(spark, five, min_edit_bound=1)[1]


@query()
def global_align(spark, d):
    _, reads = contigs_and_reads(spark, d)
    both = reads.withColumn("other", F.reverse("seq"))

    def run(batches):
        for batch in batches:
            got = align.global_alignments(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())], names=["read", "score", "cigar"]
            )

    return both.mapInArrow(run, "read string, score int, cigar string")


@query(f"""WITH RECURSIVE {INPUT_SQL}, p AS (SELECT read, seq AS a, reverse(seq) AS b FROM reads),
d AS (SELECT read, a, b, 0 AS i, j, CASE WHEN j = 0 THEN 0 ELSE -5 - 2 * j END AS h, -1000000 AS e FROM (SELECT *, unnest(range(0, 33)) AS j FROM p)
 UNION ALL SELECT read, a, b, i, j, greatest(x, max(x + 2 * j) OVER (PARTITION BY read ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5 - 2 * j) AS h, e FROM (
  SELECT read, a, b, i, j, e, CASE WHEN diagonal IS NULL THEN e ELSE greatest(e, diagonal) END AS x FROM (
   SELECT read, a, b, i + 1 AS i, j, greatest(h - 7, e - 2) AS e, lag(h) OVER (PARTITION BY read ORDER BY j) + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 1 ELSE -3 END AS diagonal FROM d WHERE i < 32)))
SELECT read, CAST(h AS INTEGER) AS score FROM d WHERE i = 32 AND j = 32""")
def alignment_scores(spark, d):
    return global_align(spark, d).select("read", "score")
