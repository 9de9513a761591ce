"""Queries over the driver tables, each with the SQL it must agree with.

Sequence-shaped inputs are derived from the tables alike in both engines: a
read is a document's md5 written in four letters, a scaffold its text with every
other character masked, genes and intervals come from ``part``, alignments and
pileups from ``lineitem``. Whole tables are used throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import seq
from strandweave.operators import contigs, evaluate, graph, intervals, kmers, store, suffixes, views
from strandweave.plans.runtime import global_index, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed value: hexadecimal digits as bases.
HEX, AS_BASES = "0123456789abcdef", "ACGTACGTACGTACGT"

READS_SQL = f"""reads AS (SELECT doc_id, lang, source, translate(md5(text), '{HEX}', '{AS_BASES}') AS seq
  FROM documents WHERE text IS NOT NULL)"""
TEXTS_SQL = READS_SQL + """, texts AS (
  SELECT 2 * doc_id AS text, doc_id, lang, seq FROM reads UNION ALL
  SELECT 2 * doc_id + 1, doc_id, lang, reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads)"""


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", "lang", "source", F.translate(F.md5("text"), HEX, AS_BASES).alias("seq"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return contigs.double_strand(reads(spark, d).drop("source"), "doc_id").select("text", "doc_id", "lang", "seq")


# ---- contigs and scalar functions -------------------------------------------


@query(r"""
WITH c AS (SELECT doc_id, regexp_extract_all(upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')), '(N+|[^N]+)') AS p FROM documents),
e AS (SELECT doc_id, unnest(p) AS seq, generate_subscripts(p, 1) AS i FROM c),
s AS (SELECT doc_id, seq, i, sum(length(seq)) OVER (PARTITION BY doc_id ORDER BY i) - length(seq) AS start FROM e)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS part, CAST(start AS BIGINT) AS start,
  CAST(length(seq) AS BIGINT) AS length, seq FROM s WHERE seq NOT LIKE 'N%'""")
def contigs_split(spark, d):
    docs = load(spark, d, "documents").select("doc_id", contigs.mask_to_bases("text").alias("seq"))
    return contigs.split_contigs(docs, "doc_id")


@query(f"WITH {TEXTS_SQL} SELECT text, doc_id, lang, seq FROM texts")
def double_strand(spark, d):
    return texts(spark, d)


@query(f"WITH {READS_SQL} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def revcomp(spark, d):
    return reads(spark, d).select("doc_id", seq.reverse_complement("seq").alias("rc"))


@query(f"""WITH {READS_SQL}, p AS (SELECT doc_id, lang, seq, lead(seq) OVER (PARTITION BY lang ORDER BY doc_id) AS other FROM reads)
SELECT doc_id, CAST(hamming(seq, other) AS INTEGER) AS hamming, CAST(levenshtein(seq, other) AS INTEGER) AS edits FROM p WHERE other IS NOT NULL""")
def hamming_pairs(spark, d):
    w = Window.partitionBy("lang").orderBy("doc_id")
    pairs = reads(spark, d).withColumn("other", F.lead("seq").over(w)).filter("other is not null")
    return pairs.select("doc_id", seq.hamming("seq", "other").alias("hamming"), F.levenshtein("seq", "other").alias("edits"))


@query(f"""WITH {READS_SQL}, k AS (SELECT doc_id, length(seq) AS n, unnest([substr(seq, i, 3) for i in range(1, length(seq) - 2)]) AS k FROM reads),
c AS (SELECT doc_id, n, k, count(*) AS m FROM k GROUP BY ALL)
SELECT doc_id, sum(m * (m - 1) / 2) / (any_value(n) - 2) AS score FROM c GROUP BY doc_id""")
def dust_score(spark, d):
    return reads(spark, d).select("doc_id", seq.dust_score("seq").alias("score"))


@query(f"""WITH {READS_SQL}, w AS (SELECT doc_id, unnest(range(1, length(seq) - 6)) AS i, seq FROM reads),
s AS (SELECT doc_id, i, substr(seq, i, 16) AS s FROM w WHERE length(substr(seq, i, 16)) >= 8),
k AS (SELECT doc_id, i, length(s) AS n, unnest([substr(s, j, 3) for j in range(1, length(s) - 2)]) AS k FROM s),
c AS (SELECT doc_id, i, n, k, count(*) AS m FROM k GROUP BY ALL),
t AS (SELECT doc_id, i, sum(m * (m - 1) / 2) / (any_value(n) - 2) AS score FROM c GROUP BY doc_id, i)
SELECT doc_id, max(score) AS score FROM t GROUP BY doc_id""")
def max_dust_window(spark, d):
    rows = reads(spark, d)
    starts = F.sequence(F.lit(1), F.length("seq") - 7)
    windows = rows.select("doc_id", F.explode(F.transform(starts, lambda i: F.substring("seq", i, F.lit(16)))).alias("w"))
    return windows.groupBy("doc_id").agg(F.max(seq.dust_score("w")).alias("score"))


@query(f"""WITH {READS_SQL} SELECT doc_id, CAST(instr('ACGT', left(seq, 1)) - 1 AS INTEGER) AS first_base,
  length(regexp_extract(seq, '^(A+|C+|G+|T+)')) AS run, contains(seq, 'ACGT') OR contains(seq, 'GGTT') AS primer,
  2 * doc_id + (doc_id % 2) AS side, doc_id * 2 + 1 AS rc_text,
  'N' || doc_id || 'B' || (length(seq) - 3) AS base_name FROM reads""")
def scalar_functions(spark, d):
    r = reads(spark, d)
    return r.select(
        "doc_id", F.expr("instr('ACGT', left(seq, 1)) - 1").alias("first_base"),
        seq.homopolymer_length("seq").cast("long").alias("run"), seq.contains_primer("seq", ["ACGT", "GGTT"]).alias("primer"),
        seq.pack_side("doc_id", F.col("doc_id") % 2).alias("side"),
        seq.flip(F.shiftleft("doc_id", 1), F.lit(0), F.length("seq"))["text"].alias("rc_text"),
        seq.base_name("doc_id", seq.contig_offset(F.shiftleft("doc_id", 1), F.length("seq") - 4, F.length("seq"))).alias("base_name"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN length(r) = length(a) THEN 'SUB' WHEN length(r) > length(a) AND starts_with(r, a) THEN 'DEL'
  WHEN length(r) < length(a) AND starts_with(a, r) THEN 'INS' ELSE 'COMPLEX' END AS kind, count(*) AS n FROM (
  SELECT l_orderkey, l_linenumber, left(translate(md5(CAST(l_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), l_linenumber % 4 + 1) AS r,
    left(translate(md5(CAST(l_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), CAST(l_quantity AS INTEGER) % 4) || l_returnflag AS a FROM lineitem)
GROUP BY ALL""")
def vcf_classify(spark, d):
    bases = F.translate(F.md5(F.col("l_partkey").cast("string")), HEX, AS_BASES)
    rows = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.left(bases, F.col("l_linenumber") % 4 + 1).alias("r"),
        F.concat(F.left(bases, F.col("l_quantity").cast("int") % 4), "l_returnflag").alias("a"),
    )
    return rows.groupBy("l_orderkey", "l_linenumber", seq.vcf_class("r", "a").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity - 1) / 49 AS p0, round(pow(10, -l_quantity / 10), 9) AS error,
  CASE WHEN l_quantity >= 20 THEN 3 ELSE 4 END AS support, round(l_linenumber * ln(l_quantity) - l_quantity
   - list_sum(list_transform(range(1, l_linenumber + 1), lambda x: ln(x))), 6) AS log_poisson FROM lineitem""")
def quality_statistics(spark, d):
    rows = load(spark, d, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", ((F.col("l_quantity") - 1) / 49).alias("p0"), F.round(seq.phred_to_probability("l_quantity"), 9).alias("error"),
        seq.required_support("l_quantity").alias("support"), F.round(seq.log_poisson("l_linenumber", "l_quantity"), 6).alias("log_poisson"),
    )


@query(f"""WITH {READS_SQL} SELECT doc_id || ':' || s || '-' || (s + 20) AS read_name, doc_id, CAST(s AS INTEGER) AS start, substr(seq, s + 1, 20) AS read
FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 19, 4)) AS s FROM reads)""")
def shred(spark, d):
    return contigs.shred(reads(spark, d), "doc_id", size=20, spacing=4)


@query(f"""WITH {READS_SQL}, g AS (SELECT lang, doc_id, length(seq) AS n FROM reads)
SELECT lang AS genome, count(*) AS contigs, min(doc_id) AS first_contig, max(doc_id) + 1 AS end_contig, CAST(sum(n) AS BIGINT) AS bases,
  CAST(2 * sum(n) AS BIGINT) AS total_length, CAST(2 * sum(n + 1) AS BIGINT) AS "rows" FROM g GROUP BY lang""")
def index_metadata(spark, d):
    rows = reads(spark, d).select(F.col("lang").alias("genome"), F.col("doc_id").alias("contig"), F.length("seq").cast("long").alias("length"))
    return contigs.metadata(rows)


# ---- k-mers -----------------------------------------------------------------

KMERS = "unnest([substr(seq, i, {k}) for i in range(1, length(seq) - {k} + 2)])"


@query(f"WITH {TEXTS_SQL} SELECT kmer, count(*) AS n FROM (SELECT {KMERS.format(k=8)} AS kmer FROM texts) GROUP BY kmer")
def kmer_counts(spark, d):
    return kmers.counts(texts(spark, d), 8)


SPECTRUM_SQL = f"""WITH {TEXTS_SQL}, c AS (SELECT kmer, count(*) AS n FROM (SELECT {KMERS.format(k=6)} AS kmer FROM texts) GROUP BY kmer),
s AS (SELECT least(n, 1000) AS count, count(*) AS kmers FROM c GROUP BY 1),
t AS (SELECT count, kmers, sum(kmers) OVER (ORDER BY count) / sum(kmers) OVER () AS share FROM s)"""


@query(SPECTRUM_SQL + " SELECT count, kmers, share FROM t")
def kmer_spectrum(spark, d):
    return kmers.spectrum(kmers.counts(texts(spark, d), 6))


@query(SPECTRUM_SQL + """, l AS (SELECT *, lag(kmers) OVER (ORDER BY count) AS prev FROM t)
SELECT (SELECT min(count) FROM l WHERE kmers / prev > 0.75) AS first_minimum, (SELECT min(count) FROM t WHERE share > 0.5) AS cutoff,
 (SELECT count FROM t WHERE count >= 2 ORDER BY kmers DESC, count LIMIT 1) AS mode""")
def kmer_error_boundary(spark, d):
    s = kmers.spectrum(kmers.counts(texts(spark, d), 6))
    one = kmers.first_minimum(s).withColumn("_k", F.lit(1))  # three one-row results side by side
    two, three = (x.withColumn("_k", F.lit(1)) for x in (kmers.cutoff_for_share(s, 0.5), kmers.censored_mode(s, 2)))
    return one.join(two, "_k").join(three, "_k").drop("_k")


@query(SPECTRUM_SQL + """, d AS (SELECT c AS count, coalesce(kmers, 0) AS kmers FROM (SELECT unnest(range(1, 1001)) AS c) LEFT JOIN t ON t.count = c),
m AS (SELECT (SELECT count FROM d WHERE count >= 5 AND kmers > 0 ORDER BY kmers DESC, count LIMIT 1) AS mode, (SELECT CAST(sum(kmers) AS BIGINT) FROM d) AS total),
x AS (SELECT count, kmers, sum(kmers) OVER (ORDER BY count) AS sofar, lead(kmers) OVER (ORDER BY count) AS nxt FROM d)
SELECT mode, total, (SELECT count FROM x WHERE count < mode AND sofar > 0 ORDER BY kmers / sofar, count LIMIT 1) AS by_contribution,
 (SELECT min(count) FROM x WHERE count < mode - 1 AND kmers < 2 * nxt) AS by_ratio FROM m""")
def kmer_trust(spark, d):
    return kmers.error_boundary(kmers.spectrum(kmers.counts(texts(spark, d), 6)))


@query(f"""WITH {TEXTS_SQL}, w AS (SELECT {KMERS.format(k=7)} AS w FROM texts)
SELECT left(w, 6) AS kmer, count(*) FILTER (w LIKE '%A') AS a, count(*) FILTER (w LIKE '%C') AS c, count(*) FILTER (w LIKE '%G') AS g,
 count(*) FILTER (w LIKE '%T') AS t FROM w GROUP BY 1""")
def extension_counts(spark, d):
    return kmers.extensions(texts(spark, d), 6)


@query(f"""WITH {TEXTS_SQL}, s AS (SELECT unnest([right(seq, i) for i in range(1, least(7, length(seq)) + 1)]) AS suffix FROM texts)
SELECT suffix, count(*) AS n FROM s GROUP BY suffix""")
def dead_ends(spark, d):
    return kmers.dead_ends(texts(spark, d), 8)


@query(f"""WITH {TEXTS_SQL}, p AS (SELECT DISTINCT left(translate(md5(p_name), '{HEX}', '{AS_BASES}'), 7) AS pattern FROM part),
k AS (SELECT {KMERS.format(k=7)} AS kmer FROM texts), c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer)
SELECT pattern, coalesce(n, 0) AS n FROM p LEFT JOIN c ON kmer = pattern""")
def pattern_count_both_strands(spark, d):
    patterns = load(spark, d, "part").select(F.left(F.translate(F.md5("p_name"), HEX, AS_BASES), F.lit(7)).alias("pattern")).distinct()
    return kmers.occurrences(texts(spark, d), patterns)


@query(f"""WITH {TEXTS_SQL}, k AS (SELECT text, unnest(range(0, length(seq) - 11)) AS "offset", {KMERS.format(k=12)} AS kmer FROM texts)
SELECT kmer, min(text) AS text, CAST(min("offset") AS INTEGER) AS "offset" FROM k GROUP BY kmer HAVING count(*) = 1""")
def unique_kmers(spark, d):
    return kmers.unique(texts(spark, d), 12, ["text"])


# ---- the suffix table ---------------------------------------------------------

SUFFIX_SQL = TEXTS_SQL + """, sfx AS (SELECT text, lang, seq, unnest(range(0, length(seq) + 1)) AS "offset" FROM texts),
sa AS (SELECT text, lang, "offset", substr(seq, "offset" + 1) || '$' AS suffix, CASE WHEN "offset" = 0 THEN '$' ELSE substr(seq, "offset", 1) END AS bwt,
 row_number() OVER (ORDER BY substr(seq, "offset" + 1) || '$', text) - 1 AS rank FROM sfx)"""


def suffix_table(spark, d):
    return suffixes.ranked(texts(spark, d), ["lang"])


@query(f'WITH {SUFFIX_SQL} SELECT rank, text, "offset", bwt FROM sa')
def suffix_array(spark, d):
    return suffix_table(spark, d).select("rank", "text", "offset", "bwt")


@query(f"WITH {SUFFIX_SQL} SELECT bwt, left(suffix, 1) AS first, count(*) AS n, min(rank) AS lo, max(rank) AS hi FROM sa GROUP BY ALL")
def bwt(spark, d):
    return suffix_table(spark, d).groupBy("bwt", F.left("suffix", F.lit(1)).alias("first")).agg(
        F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi")
    )


LCP_SQL = SUFFIX_SQL + """, lag_ AS (SELECT rank, suffix, lag(suffix) OVER (ORDER BY rank) AS prev FROM sa),
lcp AS (SELECT rank, CAST(coalesce(len(list_filter(range(1, least(length(suffix), length(prev))), lambda i: left(suffix, i) = left(prev, i))), 0) AS INTEGER) AS lcp FROM lag_)"""


@query(f"WITH {LCP_SQL} SELECT rank, lcp FROM lcp")
def lcp(spark, d):
    return suffixes.with_lcp(suffix_table(spark, d)).select("rank", "lcp")


@query(f"""WITH {SUFFIX_SQL}, b AS (SELECT rank, bwt, lag(rank) OVER (PARTITION BY text ORDER BY "offset") AS lf, row_number() OVER (PARTITION BY bwt ORDER BY rank) - 1 AS n FROM sa)
SELECT rank, CASE WHEN bwt = '$' THEN n ELSE lf END AS lf FROM b""")
def lf_mapping(spark, d):
    return suffixes.lf(suffix_table(spark, d))


@query(f"""WITH {SUFFIX_SQL} SELECT rank, CAST(sum(CAST(bwt = 'A' AS BIGINT)) OVER w AS BIGINT) AS a, CAST(sum(CAST(bwt = 'C' AS BIGINT)) OVER w AS BIGINT) AS c,
 CAST(sum(CAST(bwt = 'G' AS BIGINT)) OVER w AS BIGINT) AS g, CAST(sum(CAST(bwt = 'T' AS BIGINT)) OVER w AS BIGINT) AS t FROM sa
 WINDOW w AS (ORDER BY rank ROWS UNBOUNDED PRECEDING)""")
def occurrence_ranks(spark, d):
    return suffixes.occurrence_counts(suffix_table(spark, d))


@query(f"""WITH {SUFFIX_SQL}, p AS (SELECT DISTINCT left(translate(md5(p_name), '{HEX}', '{AS_BASES}'), 7) AS pattern FROM part)
SELECT pattern, text, "offset" FROM sa JOIN p ON left(suffix, 7) = pattern""")
def locate(spark, d):
    patterns = load(spark, d, "part").select(F.left(F.translate(F.md5("p_name"), HEX, AS_BASES), F.lit(7)).alias("pattern"))
    return suffixes.locate(suffix_table(spark, d), patterns).select("pattern", "text", "offset")


@query(f"WITH {SUFFIX_SQL} SELECT left(suffix, 5) AS kmer, min(rank) AS lo, max(rank) AS hi FROM sa WHERE length(suffix) >= 5 GROUP BY 1")
def interval_cache(spark, d):
    return kmers.interval_cache(suffix_table(spark, d), 5)


@query(f"WITH {SUFFIX_SQL} SELECT lang, count(*) AS \"rows\", min(rank) AS lo, max(rank) AS hi FROM sa GROUP BY lang")
def genome_mask(spark, d):
    return suffix_table(spark, d).groupBy("lang").agg(F.count("*").alias("rows"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))


# ---- views --------------------------------------------------------------------

VIEW_SQL = SUFFIX_SQL + """, v AS (SELECT rank, lang IN ('en', 'fr') AS in_mask, text, "offset", left(suffix, 4) AS canon FROM sa),
m AS (SELECT rank, canon, lag(canon) OVER (ORDER BY rank) AS prev FROM v WHERE in_mask),
runs AS (SELECT rank, canon, CAST(sum(CAST(prev IS NULL OR prev <> canon AS BIGINT)) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS range_no FROM m)"""


def view(spark, d):
    t = views.masked(suffix_table(spark, d).withColumnRenamed("lang", "genome"), ["en", "fr"])
    return t.withColumn("canon", F.left("suffix", F.lit(4)))


@query(f"WITH {VIEW_SQL} SELECT range_no, canon, min(rank) AS lo, max(rank) AS hi, count(*) AS n FROM runs GROUP BY ALL")
def merged_runs(spark, d):
    return views.merged_runs(view(spark, d)).groupBy("range_no", "canon").agg(
        F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n")
    )


BITS = "SELECT o_orderkey AS i, o_orderstatus = 'F' AS bit FROM orders"


@query(f"""SELECT i, bit, CAST(sum(CAST(bit AS BIGINT)) OVER w AS BIGINT) AS rank, CAST(sum(CAST(bit AS BIGINT)) OVER w AS BIGINT) - CAST(bit AS BIGINT) AS rank_before
FROM ({BITS}) WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def rank_select(spark, d):
    bits = load(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderstatus") == "F").alias("bit"))
    return views.ranks_and_selects(bits).select("i", "bit", "rank", "rank_before")


@query(f"""WITH o AS (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM ({BITS}) WHERE bit) SELECT min(i) AS start, count(*) AS length FROM o GROUP BY g""")
def bit_runs(spark, d):
    return views.bit_runs(load(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderstatus") == "F").alias("bit")))


@query("""SELECT i, bool_or(bit) AS bit FROM (SELECT o_orderkey AS i, o_orderstatus = 'F' AS bit FROM orders UNION ALL
 SELECT l_orderkey, l_returnflag = 'R' FROM lineitem) GROUP BY i""")
def mask_union(spark, d):
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderstatus") == "F").alias("bit"))
    b = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_returnflag") == "R").alias("bit"))
    return views.union_masks(a, b)


@query("SELECT DISTINCT o_custkey AS range_no FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def new_ranges(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("range_no"), "o_orderpriority")
    return views.new_ranges(o.select("range_no").distinct(), o.filter("o_orderpriority = '1-URGENT'").select("range_no").distinct())


# ---- intervals ----------------------------------------------------------------

GENES_SQL = """genes AS (SELECT p_brand AS contig, p_partkey AS start, p_partkey + p_size AS "end", p_name AS name,
  CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS strand FROM part)"""


def genes(spark, d):
    return load(spark, d, "part").select(
        F.col("p_brand").alias("contig"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"),
        F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("strand"),
    )


@query("""SELECT a.c_custkey, a.c_nationkey, b.s_suppkey AS match_key, b.s_name AS "match" FROM customer a ASOF LEFT JOIN supplier b
 ON a.c_nationkey = b.s_nationkey AND a.c_custkey >= b.s_suppkey""")
def interval_asof(spark, d):
    left = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"))
    right = load(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("start"), F.col("s_name").alias("value"))
    return intervals.starting_before(left, right, ["n"], "c_custkey").withColumnRenamed("n", "c_nationkey")


@query("""SELECT a.c_custkey, a.c_nationkey, b.s_suppkey AS match_key, b.s_name AS "match" FROM customer a ASOF LEFT JOIN supplier b
 ON a.c_nationkey = b.s_nationkey AND a.c_custkey <= b.s_suppkey""")
def interval_asof_forward(spark, d):
    left = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"))
    right = load(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("start"), F.col("s_name").alias("value"))
    return intervals.starting_after(left, right, ["n"], "c_custkey").withColumnRenamed("n", "c_nationkey")


@query(f"""WITH {GENES_SQL} SELECT a.contig, a.start AS a_start, b.start AS b_start, a.name AS a_name, b.name AS b_name
FROM genes a JOIN genes b ON a.contig = b.contig AND a.start < b."end" AND b.start < a."end" AND a.start < b.start""")
def interval_overlap(spark, d):
    g = genes(spark, d)
    a = g.select("contig", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("name").alias("a_name"))
    b = g.select("contig", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("name").alias("b_name"))
    pairs = intervals.overlap_join(a, b, "contig", ("a_start", "a_end"), ("b_start", "b_end"), 64).filter("a_start < b_start")
    return pairs.select("contig", "a_start", "b_start", "a_name", "b_name")


@query(f"""WITH {GENES_SQL}, r AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes),
g AS (SELECT *, sum(CAST(reach IS NULL OR start > reach AS INT)) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT contig, min(start) AS start, max("end") AS "end", array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM g GROUP BY contig, g""")
def interval_merge(spark, d):
    return intervals.merge(genes(spark, d), "contig", "start", "end", "name")


SPANS_SQL = "spans AS (SELECT o_custkey AS k, o_orderkey AS start, o_orderkey AS \"end\", o_orderstatus AS value FROM orders)"


@query(f"""WITH {SPANS_SQL}, r AS (SELECT *, lag("end") OVER (PARTITION BY k ORDER BY start) AS reach FROM spans)
SELECT k, start, "end", value FROM spans UNION ALL
SELECT k, coalesce(reach, -1) + 1, start - 1, NULL FROM r WHERE coalesce(reach, -1) + 1 <= start - 1""")
def interval_bake(spark, d):
    o = load(spark, d, "orders")
    spans = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"), F.col("o_orderstatus").alias("value"))
    return intervals.fill_gaps(spans, "k")


@query("""WITH s AS (SELECT o_orderstatus AS k, o_orderkey AS start, o_orderkey AS "end", left(o_orderpriority, 1) < '4' AS value FROM orders),
r AS (SELECT *, lag("end") OVER w AS pe, lag(value) OVER w AS pv FROM s WINDOW w AS (PARTITION BY k ORDER BY start)),
g AS (SELECT *, sum(CAST(NOT coalesce(pe + 1 = start AND pv IS NOT DISTINCT FROM value, FALSE) AS INT)) OVER (PARTITION BY k ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT k, min(start) AS start, max("end") AS "end", value FROM g GROUP BY k, g, value""")
def interval_map_update(spark, d):
    o = load(spark, d, "orders")
    spans = o.select(
        F.col("o_orderstatus").alias("k"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"),
        (F.left("o_orderpriority", F.lit(1)) < "4").alias("value"),
    )
    return intervals.coalesce_equal(spans, "k")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY r) AS previous, l_partkey AS next FROM x
UNION ALL SELECT l_orderkey, arg_max(l_partkey, r), NULL FROM x GROUP BY l_orderkey""")
def with_neighbors(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("r"))
    return intervals.with_neighbours(rows, ["l_orderkey"], "r", "l_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders")
def zip_with_index(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return global_index(o, ["o_totalprice", "o_orderkey"], "index").select("o_orderkey", "index")


# ---- evaluation -----------------------------------------------------------------


@query(f"""WITH {GENES_SQL}, b AS (SELECT l_orderkey AS column_id, 'Brand#' || (l_suppkey % 25 + 1) AS contig, l_partkey AS base, l_returnflag = 'R' AS reverse FROM lineitem),
total AS (SELECT column_id, count(*) AS bases FROM b GROUP BY 1),
hits AS (SELECT DISTINCT column_id, b.contig, base, reverse, name, strand * (CASE WHEN reverse THEN -1 ELSE 1 END) AS strand FROM b
  JOIN genes g ON b.contig = g.contig AND g.start <= base AND base < g."end"),
n AS (SELECT column_id, name, strand, count(*) AS n FROM hits GROUP BY ALL),
t AS (SELECT column_id, name AS gene, strand AS gs, n AS top FROM n QUALIFY row_number() OVER (PARTITION BY column_id ORDER BY n DESC, name, strand) = 1),
pb AS (SELECT column_id, contig, base, reverse, bool_or(name = gene AND strand = gs) AS has_top FROM hits JOIN t USING (column_id) GROUP BY ALL),
a AS (SELECT column_id, count(*) AS annotated, count(*) FILTER (NOT has_top) AS others FROM pb GROUP BY 1),
k AS (SELECT * FROM total LEFT JOIN t USING (column_id) LEFT JOIN a USING (column_id)),
c AS (SELECT 'total_columns' AS class, NULL AS gene FROM k UNION ALL SELECT 'background', NULL FROM k WHERE gene IS NULL
 UNION ALL SELECT 'gene_columns', NULL FROM k WHERE gene IS NOT NULL UNION ALL SELECT 'ortholog', gene FROM k WHERE top > 1
 UNION ALL SELECT 'paralog', gene FROM k WHERE gene IS NOT NULL AND top <> bases AND others > 0
 UNION ALL SELECT 'unannotated', gene FROM k WHERE gene IS NOT NULL AND top <> bases AND annotated < bases)
SELECT class, gene, count(*) AS columns FROM c GROUP BY ALL""")
def gene_classes(spark, d):
    li = load(spark, d, "lineitem")
    columns = li.select(
        F.col("l_orderkey").alias("column_id"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("contig"),
        F.col("l_partkey").alias("base"), (F.col("l_returnflag") == "R").alias("reverse"),
    )
    return evaluate.mapping_classes(columns, genes(spark, d), 64)


@query("""WITH h AS (SELECT DISTINCT l_orderkey, p_name AS gene FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.gene AS gene_a, b.gene AS gene_b, count(*) AS columns FROM h a JOIN h b USING (l_orderkey) WHERE a.gene < b.gene GROUP BY ALL""")
def gene_pairs(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("gene"))
    return evaluate.gene_pairs(load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey"), "l_orderkey")


GENE_SETS = """a AS (SELECT l_returnflag AS category, p_type || p_brand AS gene, count(*) AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY ALL),
b AS (SELECT l_returnflag AS category, p_type || p_brand AS gene, count(*) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY ALL),
diff AS (SELECT category, gene, coalesce(y, 0) - coalesce(x, 0) AS delta FROM a FULL JOIN b USING (category, gene) WHERE coalesce(y, 0) <> coalesce(x, 0))"""


def _gene_difference(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_type", "p_brand").alias("gene"))
    g = load(spark, d, "lineitem").join(p, "l_partkey").select(F.col("l_returnflag").alias("category"), "gene", "l_linestatus")
    return evaluate.gene_set_difference(g.filter("l_linestatus = 'F'"), g.filter("l_linestatus = 'O'"))


@query(f"WITH {GENE_SETS} SELECT category, gene, delta FROM diff")
def gene_set_diff(spark, d):
    return _gene_difference(spark, d)


@query(f"""WITH {GENE_SETS} SELECT category, CAST(sum(delta) AS BIGINT) AS net, CAST(sum(greatest(delta, 0)) AS BIGINT) AS gained,
 CAST(sum(greatest(-delta, 0)) AS BIGINT) AS lost FROM diff GROUP BY category""")
def gene_set_net(spark, d):
    return evaluate.net_difference(_gene_difference(spark, d))


@query("""WITH t AS (SELECT DISTINCT l_linestatus AS k, l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10),
f AS (SELECT DISTINCT l_linestatus AS k, l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 40),
n AS (SELECT k, count(t.l_partkey) AS truth, count(f.l_partkey) AS found, count(*) FILTER (t.l_partkey IS NOT NULL AND f.l_partkey IS NOT NULL) AS "both"
 FROM (SELECT *, 1 AS o FROM t) t FULL JOIN (SELECT *, 1 AS o FROM f) f USING (k, l_orderkey, l_partkey) GROUP BY k)
SELECT k, truth, found, "both", "both" / found AS precision, "both" / truth AS recall, 2 * ("both" / found) * ("both" / truth) / ("both" / found + "both" / truth) AS f_score FROM n""")
def precision_recall(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("k"), "l_orderkey", "l_partkey", "l_quantity")
    return evaluate.precision_recall(li.filter("l_quantity > 10"), li.filter("l_quantity < 40"), ["l_orderkey", "l_partkey"], ["k"])


CATEGORIES = """n AS (SELECT c_mktsegment AS scheme, ['gene2gene', 'gene2wrong', 'gene2unmapped', 'background2gene', '!reads'][o_orderkey % 5 + 1] AS category, count(*) AS n
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _categories(spark, d):
    names = F.array(*map(F.lit, ("gene2gene", "gene2wrong", "gene2unmapped", "background2gene", "!reads")))
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("scheme"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {CATEGORIES} SELECT scheme, sum(CASE WHEN category = 'gene2wrong' THEN n ELSE 0 END) / sum(CASE WHEN category LIKE 'gene2%' THEN n ELSE 0 END) AS wrongness FROM n GROUP BY scheme")
def wrongness(spark, d):
    return evaluate.wrongness(_categories(spark, d), ["scheme"])


@query(f"WITH {CATEGORIES} SELECT scheme, 1 - sum(CASE WHEN category LIKE '%2unmapped' THEN n ELSE 0 END) / sum(n) AS read_coverage FROM n WHERE category NOT LIKE '!%' GROUP BY scheme")
def read_coverage(spark, d):
    return evaluate.read_coverage(_categories(spark, d), ["scheme"])


@query(f"""WITH {READS_SQL}, b AS (SELECT source, unnest(range(1, 33)) AS i, unnest(string_split(seq, '')) AS base FROM reads),
p AS (SELECT source, i, count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM b GROUP BY ALL)
SELECT source, CAST(i AS INTEGER) AS i, depth, a, c, g, t, CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS consensus FROM p""")
def consensus(spark, d):
    rows = reads(spark, d).select("source", F.posexplode(seq.letters("seq")).alias("i", "base")).withColumn("i", F.col("i") + 1)
    return evaluate.pileup(rows, ["source", "i"])


@query("""SELECT event_type AS stat, count(*) AS samples, count(*) FILTER (value > 50) AS errors, avg(CAST(value > 50 AS INT)) AS fraction FROM events GROUP BY 1""")
def error_rates(spark, d):
    return evaluate.error_rates(load(spark, d, "events").select(F.col("event_type").alias("stat"), (F.col("value") > 50).alias("e")), "stat", "e")


@query("SELECT event_type AS stat, CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY 1")
def stat_totals(spark, d):
    return evaluate.keyed_totals(load(spark, d, "events").select(F.col("event_type").alias("stat"), F.col("user_id").alias("value")))


@query("""WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_name, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) = 1""")
def top_gene(spark, d):
    return evaluate.top_by_count(load(spark, d, "part"), ["p_brand"], "p_name")


# ---- graph ------------------------------------------------------------------------

SEGMENTS = """seg AS (SELECT c_custkey AS contig, 10 * (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1) AS start, 8 AS length,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 2000 END AS block, o_orderkey % 3 > 0 AS orientation FROM orders JOIN customer ON o_custkey = c_custkey)"""


def segments(spark, d):
    o = load(spark, d, "orders").join(load(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey")) - 1
    return o.select(
        F.col("c_custkey").alias("contig"), (n * 10).cast("long").alias("start"), F.lit(8).alias("length"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 2000).alias("block"), (F.col("o_orderkey") % 3 > 0).alias("orientation"),
    )


@query(f"""WITH {SEGMENTS}, n AS (SELECT block, CAST(lag(start) OVER w IS NOT NULL AS BIGINT) + CAST(lead(start) OVER w IS NOT NULL AS BIGINT) AS near FROM seg WINDOW w AS (PARTITION BY contig ORDER BY start)),
g AS (SELECT count(*) AS degree FROM seg WHERE block IS NOT NULL GROUP BY block UNION ALL SELECT near FROM n WHERE block IS NULL)
SELECT degree, count(*) AS n FROM g GROUP BY degree""")
def degrees(spark, d):
    return evaluate.histogram(graph.degrees(segments(spark, d)), "degree", "n")


ENDS = SEGMENTS + """, e AS (SELECT contig, start, length, block * 2 + CASE WHEN orientation THEN 0 ELSE 1 END AS l FROM seg WHERE block IS NOT NULL),
adj AS (SELECT xor(l, 1) AS a, lead(l) OVER w AS b, lead(start) OVER w - start - length AS between_ FROM e WINDOW w AS (PARTITION BY contig ORDER BY start))"""


@query(f"WITH {ENDS} SELECT a, b, between_ AS between FROM adj WHERE b IS NOT NULL".replace(" AS between ", ' AS "between" '))
def adjacencies(spark, d):
    return graph.adjacencies(segments(spark, d))


COMPONENTS_SQL = """WITH RECURSIVE edges AS (SELECT DISTINCT c_nationkey AS a, 100 + s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 97 = s_suppkey),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS r FROM both_ UNION SELECT reach.node, b FROM reach JOIN both_ ON r = a)"""


def _edges(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    on = (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 97 == F.col("s_suppkey"))
    return c.join(s, on).select(F.col("c_nationkey").cast("long").alias("a"), (F.col("s_suppkey") + 100).alias("b")).distinct()


@query(COMPONENTS_SQL + " SELECT CAST(node AS BIGINT) AS node, CAST(min(r) AS BIGINT) AS component FROM reach GROUP BY node")
def components(spark, d):
    return graph.connected_components(_edges(spark, d))


@query(COMPONENTS_SQL + """, c AS (SELECT node, min(r) AS component FROM reach GROUP BY node), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
SELECT size, count(*) AS count FROM s GROUP BY size""")
def spectrum(spark, d):
    return graph.component_spectrum(graph.connected_components(_edges(spark, d)))


@query("""WITH l AS (SELECT c_mktsegment AS genome, c_custkey AS contig, 40 AS length FROM customer), p AS (SELECT DISTINCT c_mktsegment AS genome, c_custkey AS contig, o_orderkey % 40 AS base FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT genome, count(*) AS aligned FROM p GROUP BY 1), t AS (SELECT genome, CAST(sum(length) AS BIGINT) AS bases FROM l GROUP BY 1)
SELECT genome, bases, coalesce(aligned, 0) AS aligned, coalesce(aligned, 0) / bases AS coverage FROM t LEFT JOIN a USING (genome)""")
def coverage(spark, d):
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("genome"), F.col("c_custkey").alias("contig"), F.lit(40).alias("length"))
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("contig"), (F.col("o_orderkey") % 40).alias("base"))
    return graph.coverage(o.join(c.select("genome", "contig"), "contig"), c)


# ---- stores -----------------------------------------------------------------------


@query("SELECT o_orderkey AS position, o_orderstatus AS contig, o_custkey AS site FROM orders WHERE o_orderstatus = 'F' AND o_orderkey BETWEEN 1000 AND 9000")
def store_range(spark, d):
    sites = load(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("contig"), F.col("o_custkey").alias("site"))
    return store.sites_between(sites, "F", 1000, 9000)


@query("""WITH n AS (SELECT o_orderstatus, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS page FROM orders)
SELECT o_orderstatus, page, count(*) AS "rows", max(o_orderkey) AS token FROM n GROUP BY ALL""")
def search_pages(spark, d):
    return store.pages(load(spark, d, "orders"), "o_orderstatus", "o_orderkey", 100)


@query("""SELECT 100 + s_suppkey AS side FROM supplier WHERE 100 + s_suppkey NOT IN (SELECT 100 + c_custkey % 97 FROM customer WHERE c_nationkey < 10)""")
def telomeres(spark, d):
    sides = load(spark, d, "supplier").select((F.col("s_suppkey") + 100).alias("side"))
    adj = load(spark, d, "customer").filter("c_nationkey < 10").select(F.col("c_nationkey").cast("long").alias("left_side"), (F.col("c_custkey") % 97 + 100).alias("right_side"))
    return store.telomeres(sides, adj)


# ---- look-ups and constructed graphs ------------------------------------------


@query("""SELECT p_partkey AS gene_id, p_brand AS contig, p_partkey - 100 AS start, p_partkey + p_size - 100 AS "end", s_name AS name
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey WHERE p_brand = 'Brand#2' AND p_partkey >= 100 AND p_partkey + p_size <= 1900""")
def known_genes(spark, d):
    from strandweave.operators import lookup

    g = genes(spark, d).drop("name", "strand").withColumn("gene_id", F.col("start"))
    names = load(spark, d, "supplier").select(F.col("s_suppkey").alias("gene_id"), F.col("s_name").alias("name"))
    return lookup.known_genes(g, names, "Brand#2", 100, 1900)


@query("""SELECT o_orderkey AS read, s_name AS sample FROM orders LEFT JOIN supplier ON o_orderkey >= s_suppkey * 50 AND o_orderkey <= s_suppkey * 50 + 30""")
def population_lookup(spark, d):
    from strandweave.operators import lookup

    pop = load(spark, d, "supplier").select((F.col("s_suppkey") * 50).alias("start"), (F.col("s_suppkey") * 50 + 30).alias("end"), F.col("s_name").alias("sample"))
    return lookup.population_of(load(spark, d, "orders").select(F.col("o_orderkey").alias("read")), pop)


@query(f"""WITH {READS_SQL}, k AS (SELECT DISTINCT left(seq, 8) AS kmer FROM reads), p AS (SELECT DISTINCT right(seq, 8) AS pattern FROM reads)
SELECT pattern, kmer, CAST(hamming(pattern, kmer) AS INTEGER) AS mismatches FROM p, k WHERE hamming(pattern, kmer) <= 2""")
def hamming_neighbourhood(spark, d):
    from strandweave.operators import lookup

    r = reads(spark, d)
    k, p = r.select(F.left("seq", F.lit(8)).alias("kmer")).distinct(), r.select(F.right("seq", F.lit(8)).alias("pattern")).distinct()
    return lookup.neighbourhood(k, p, 8, 2)


@query(f"""WITH {READS_SQL}, h AS (SELECT doc_id, n, left(seq, n) AS p FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS n FROM reads)),
a AS (SELECT p, min(doc_id) AS id, min(n) AS n FROM h GROUP BY p HAVING count(*) = 1)
SELECT id, CAST(min(n) AS INTEGER) AS n FROM a GROUP BY id""")
def unique_prefix(spark, d):
    from strandweave.operators import lookup

    return lookup.unique_prefixes(reads(spark, d).select(F.col("doc_id").alias("id"), "seq"))


@query(f"""WITH {VIEW_SQL}, i AS (SELECT s_suppkey AS id, s_suppkey * 97 AS lo, s_suppkey * 97 + s_nationkey AS hi FROM supplier),
x AS (SELECT id, lo, hi, count(rank) AS masked_rows, count(DISTINCT range_no) AS ranges, min(range_no) AS first_range, max(range_no) AS last_range
  FROM i LEFT JOIN runs ON rank BETWEEN lo AND hi GROUP BY ALL)
SELECT *, CASE WHEN masked_rows = 0 THEN 'empty' WHEN ranges = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM x""")
def interval_states(spark, d):
    asked = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 97).alias("lo"), (F.col("s_suppkey") * 97 + F.col("s_nationkey")).alias("hi"))
    return views.interval_summary(views.merged_runs(view(spark, d)).withColumn("in_mask", F.lit(True)), asked)


@query(f"""WITH {LCP_SQL}, x AS (SELECT rank, lcp, l FROM lcp, (SELECT unnest(range(0, 34)) AS l)),
y AS (SELECT rank, lcp, l, max(CASE WHEN lcp < l THEN rank END) OVER (PARTITION BY l ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
 min(CASE WHEN lcp < l THEN rank END) OVER (PARTITION BY l ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM x)
SELECT rank, CAST(lcp AS BIGINT) AS lcp, coalesce(p, 0) AS psv, coalesce(n, (SELECT count(*) FROM sa)) AS nsv FROM y WHERE l = lcp""")
def psv_nsv(spark, d):
    return suffixes.previous_next_smaller(suffixes.with_lcp(suffix_table(spark, d)).select("rank", "lcp"))


def pair_segments(spark, d):
    """Contigs in pairs that share two blocks with a gap of their own between."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("contig"), (F.col("c_nationkey") % 5).cast("long").alias("gap"))
    k = F.floor(F.col("contig") / 2) * 2
    part = lambda block, start: F.struct(block.cast("long").alias("block"), start.cast("long").alias("start"), F.lit(8).alias("length"))
    rows = c.withColumn("s", F.explode(F.array(part(k, F.lit(0)), part(k + 1, F.col("gap") + 8))))
    return rows.select("contig", "s.start", "s.length", "s.block", F.lit(True).alias("orientation"))


@query("""WITH c AS (SELECT c_custkey // 2 AS k, c_nationkey % 5 AS gap FROM customer)
SELECT CAST(4 * k + 1 AS BIGINT) AS component, CAST(max(gap) - min(gap) AS BIGINT) AS length FROM c GROUP BY k HAVING count(*) = 2""")
def indel_lengths(spark, d):
    return graph.indel_lengths(pair_segments(spark, d))


def tandem_segments(spark, d):
    """A contig a supplier: blocks A B C, with B twice where the nation is even."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("contig"), (F.col("s_nationkey") % 2 == 0).alias("twice"))
    b = F.col("contig") * 3
    rows = s.withColumn("p", F.when(F.col("twice"), F.array(b, b + 1, b + 1, b + 2)).otherwise(F.array(b, b + 1, b + 2)))
    rows = rows.select("contig", F.posexplode("p").alias("i", "block"))
    return rows.select("contig", (F.col("i") * 8).cast("long").alias("start"), F.lit(8).alias("length"), "block", F.lit(True).alias("orientation"))


@query("SELECT 6 * s_suppkey + 1 AS component, 3 * s_suppkey + 1 AS block FROM supplier WHERE s_nationkey % 2 = 0")
def tandem_dups(spark, d):
    return graph.tandem_duplications(tandem_segments(spark, d))


@query("""WITH n AS (SELECT count(*) AS every, count(*) FILTER (s_nationkey % 2 = 0) AS twice FROM supplier),
x AS (SELECT 1 AS size, 2 * every AS count FROM n UNION ALL SELECT 2, 2 * (every - twice) FROM n UNION ALL SELECT 4, twice FROM n)
SELECT CAST(size AS BIGINT) AS size, count FROM x WHERE count > 0""")
def adjacency_spectrum(spark, d):
    return graph.component_spectrum(graph.adjacency_components(tandem_segments(spark, d)))


@query("""SELECT 6 * s_suppkey + 1 AS component, CAST(4 AS BIGINT) AS size, array_to_string(list_sort([(3 * s_suppkey) || 'R', (3 * s_suppkey + 1) || 'L',
 (3 * s_suppkey + 1) || 'R', (3 * s_suppkey + 2) || 'L']), ' ') AS ends FROM supplier WHERE s_nationkey % 2 = 0""")
def rearrangements(spark, d):
    return graph.rearrangements(tandem_segments(spark, d))


@query("""WITH e AS (SELECT DISTINCT c_custkey AS a, c_custkey // 7 * 7 AS b, c_custkey % 2 = 1 AS opposite FROM customer WHERE c_custkey % 7 <> 0)
SELECT x AS node, r AS component, reversed, FALSE AS inverted FROM (SELECT a AS x, b AS r, opposite AS reversed FROM e
 UNION SELECT b, b, FALSE FROM e)""")
def oriented_blocks(spark, d):
    c = load(spark, d, "customer").filter("c_custkey % 7 <> 0")
    merges = c.select(F.col("c_custkey").alias("a"), (F.floor(F.col("c_custkey") / 7) * 7).alias("b"), (F.col("c_custkey") % 2 == 1).alias("opposite"))
    return graph.oriented_components(merges)


@query(f"""WITH {READS_SQL}, b AS (SELECT source, unnest(range(1, 33)) AS i, unnest(string_split(seq, '')) AS base FROM reads),
p AS (SELECT source, i, count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM b GROUP BY ALL)
SELECT source, bool_or(list_sort([a, c, g, t], 'DESC')[2] > 14) AS conflicted, count(*) FILTER (depth > 1) AS covered, avg(depth) AS mean_depth FROM p GROUP BY source""")
def conflicts(spark, d):
    rows = reads(spark, d).select("source", F.posexplode(seq.letters("seq")).alias("i", "base"))
    return evaluate.conflicted(evaluate.pileup(rows, ["source", "i"]), ["source"], 14)


@query(f"""WITH {READS_SQL}, n AS (SELECT doc_id, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c,
 length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'T', '')) AS t FROM reads)
SELECT doc_id, a + 1 AS a, CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS top FROM n""")
def letter_counts(spark, d):
    from strandweave.operators import lookup

    n = reads(spark, d).select("doc_id", lookup.letter_counts(F.col("seq")).alias("n"), lookup.letter_counts(F.lit("A")).alias("one"))
    return n.select("doc_id", lookup.combine_counts(F.col("n"), F.col("one"))["a"].cast("long").alias("a"), lookup.largest_letter(F.col("n")).alias("top"))
