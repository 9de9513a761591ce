"""Queries of scalar functions, views, graphs, stores and evaluation that the
other modules do not reach, each with the SQL it must agree with."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import align, seq
from strandweave.operators import contexts, contigs, evaluate, graph, intervals, kmers, lookup, msa, store, suffixes, views
from strandweave.plans.runtime import tree_reduce
from strandweave.queries import (
    AS_BASES, GENES_SQL, HEX, LCP_SQL, READS_SQL, SEGMENTS, SUFFIX_SQL, TEXTS_SQL, VIEW_SQL,
    genes, load, query, reads, segments, suffix_table, texts, view,
)

# ---- scalar functions ----------------------------------------------------------

CODES = "ACGTRYSWKMBDHVNA"


@query(f"""WITH r AS (SELECT doc_id, translate(md5(text), '{HEX}', '{CODES}') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, reverse(translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS rc, left(s, 1) IN ('A', 'C', 'G', 'T') AS base, left(s, 1) NOT IN ('A', 'C', 'G', 'T') AS ambiguous,
 CASE left(s, 1) WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'R' THEN 'AG' WHEN 'Y' THEN 'CT' WHEN 'S' THEN 'CG' WHEN 'W' THEN 'AT' WHEN 'K' THEN 'GT'
 WHEN 'M' THEN 'AC' WHEN 'B' THEN 'CGT' WHEN 'D' THEN 'AGT' WHEN 'H' THEN 'ACT' WHEN 'V' THEN 'ACG' ELSE 'ACGT' END AS possible FROM r""")
def iupac_codes(spark, d):
    r = load(spark, d, "documents").filter("text is not null").select("doc_id", F.translate(F.md5("text"), HEX, CODES).alias("s"))
    one = F.left("s", F.lit(1))
    return r.select("doc_id", seq.reverse_complement_iupac("s").alias("rc"), seq.is_base(one).alias("base"), seq.is_ambiguous(one).alias("ambiguous"), seq.possible_bases(one).alias("possible"))


@query(f"WITH {READS_SQL} SELECT doc_id, reverse(seq) AS reversed, left(seq, 5) AS head, right(seq, 5) AS tail FROM reads")
def affixes(spark, d):
    return reads(spark, d).select("doc_id", F.reverse("seq").alias("reversed"), seq.prefix("seq", 5).alias("head"), seq.suffix("seq", 5).alias("tail"))


@query(f"""WITH r AS (SELECT doc_id, translate(md5(text), '{HEX}', 'ACGTACGTACGTACGN') AS seq FROM documents WHERE text IS NOT NULL)
SELECT doc_id, seq FROM r WHERE NOT contains(seq, 'N')""")
def unambiguous_reads(spark, d):
    r = load(spark, d, "documents").filter("text is not null").select("doc_id", F.translate(F.md5("text"), HEX, "ACGTACGTACGTACGN").alias("seq"))
    return contigs.drop_ambiguous(r)


@query(r"""WITH p AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.fastq.gz' WHEN 1 THEN '.fq' WHEN 2 THEN '.fa.gz' ELSE '' END AS p FROM pages WHERE url IS NOT NULL)
SELECT page_id, regexp_extract(p, '\.([^./]*)$', 1) AS extension, regexp_replace(p, '\.[^./]*$', '') AS stem, regexp_extract(p, '[^/]*$') AS file, page_id % 2 = 0 AND page_id % 4 <> 3 AS gz, page_id % 4 IN (0, 1) AS fq FROM p""")
def path_helpers(spark, d):
    k = F.col("page_id") % 4
    ending = F.when(k == 0, ".fastq.gz").when(k == 1, ".fq").when(k == 2, ".fa.gz").otherwise("")
    p = load(spark, d, "pages").filter("url is not null").select("page_id", F.concat("url", ending).alias("p"))
    return p.select("page_id", seq.file_extension("p").alias("extension"), seq.strip_extension("p").alias("stem"), seq.strip_directory("p").alias("file"), seq.is_gzip("p").alias("gz"), seq.is_fastq("p").alias("fq"))


@query("""SELECT c_custkey, c_name AS key, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ':' || c_nationkey END AS value,
 CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '''' END AS plain FROM customer""")
def key_values(spark, d):
    c = load(spark, d, "customer")
    pair = F.when(F.col("c_custkey") % 3 > 0, F.concat_ws(":", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))).otherwise(F.col("c_name"))
    quoted = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("'"), "c_name", F.lit("'"))).otherwise(F.concat("c_name", F.lit("'")))
    return c.select("c_custkey", seq.split_key_value(pair).alias("kv"), seq.unquote(quoted).alias("plain")).select("c_custkey", "kv.key", "kv.value", "plain")


@query("""WITH p AS (SELECT o_orderkey, o_custkey * 2 + (o_orderkey % 2) AS text, o_orderkey % 50 AS off FROM orders)
SELECT o_orderkey, text % 2 = 1 AS back, text // 2 AS contig, CASE WHEN text % 2 = 1 THEN 50 - off ELSE off + 1 END AS at, text AS text2, off AS off2,
 off + 3 AS further, CASE WHEN text % 2 = 1 THEN off - 3 ELSE off + 3 END AS ahead, off % 7 = 0 AS consistent, 100 + CASE WHEN text % 2 = 1 THEN 50 - off ELSE off + 1 END - 1 AS base FROM p""")
def position_algebra(spark, d):
    k = F.col("o_orderkey")
    p = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2 + k % 2).alias("text"), (k % 50).alias("off"), F.lit(50).cast("long").alias("n"))
    at = seq.contig_offset("text", "off", "n")
    back = p.withColumn("at", at).withColumn("p", seq.text_position(seq.contig_of("text"), "at", seq.strand("text"), "n"))
    return back.select(
        "o_orderkey", seq.strand("text").alias("back"), seq.contig_of("text").alias("contig"), "at", F.col("p.text").alias("text2"), F.col("p.offset").alias("off2"),
        seq.local_shift("off", 3).alias("further"), seq.global_shift("text", "off", 3).alias("ahead"),
        seq.is_consistent("text", "off", "text", F.when(F.col("off") % 7 == 0, F.col("off") + 2).otherwise(F.col("off") + 1), 2).alias("consistent"),
        seq.base_id(F.lit(100).cast("long"), "at").alias("base"),
    )


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_partkey % 5 END AS lc, CASE WHEN l_linestatus = 'F' THEN l_suppkey % 5 END AS rc,
 CASE WHEN l_quantity < 25 THEN 'LEFT' ELSE 'RIGHT' END AS lf, CASE WHEN l_discount < 0.05 THEN 'LEFT' ELSE 'RIGHT' END AS rf FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(coalesce(CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN CASE WHEN lc = rc AND lf <> rf THEN lc END WHEN lc IS NOT NULL THEN lc ELSE rc END, -1)) AS BIGINT) AS coordinates,
 count(*) FILTER (CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN CASE WHEN lc = rc AND lf <> rf THEN lf END WHEN lc IS NOT NULL THEN lf WHEN rc IS NOT NULL THEN CASE rf WHEN 'LEFT' THEN 'RIGHT' ELSE 'LEFT' END END = 'LEFT') AS lefts,
 count(*) FILTER (rf = 'RIGHT') AS flipped FROM s GROUP BY ALL""")
def disambiguated_sides(spark, d):
    s = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_partkey") % 5).alias("lc"), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey") % 5).alias("rc"),
        F.when(F.col("l_quantity") < 25, "LEFT").otherwise("RIGHT").alias("lf"), F.when(F.col("l_discount") < 0.05, "LEFT").otherwise("RIGHT").alias("rf"),
    )
    s = s.withColumn("side", seq.disambiguate("lc", "lf", "rc", "rf"))
    return s.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("side.coordinate", F.lit(-1))).alias("coordinates"), F.count_if(F.col("side.face") == "LEFT").alias("lefts"),
        F.count_if(seq.opposite_face("rf") == "LEFT").alias("flipped"),
    )


@query("""SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey % 2, s_suppkey) AS BIGINT) - 1 AS place, s_nationkey * 2 + s_suppkey % 2 AS packed FROM supplier""")
def side_order(spark, d):
    from strandweave.plans.runtime import global_index

    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("coordinate"), F.when(F.col("s_suppkey") % 2 == 1, "RIGHT").otherwise("LEFT").alias("face"))
    ordered = global_index(s.withColumn("side", seq.side_order("coordinate", "face")), ["side", "s_suppkey"], "place")
    packed = seq.pack_side("coordinate", F.col("face") == "RIGHT")
    return ordered.select("s_suppkey", "place", packed.alias("packed"), seq.unpack_side(packed).alias("u")).filter("u.coordinate is not null").drop("u")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey % 20 AS s1, l_partkey % 20 + l_suppkey % 30 AS e1, l_suppkey % 20 AS s2, l_suppkey % 20 + l_partkey % 30 AS e2 FROM lineitem)
SELECT l_orderkey, CAST(sum(e1 - s1 + 1) AS BIGINT) AS bases, count(*) FILTER (s1 <= e2 AND s2 <= e1) AS meet, CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN 49 - (s2 + e1 - s1) ELSE s2 + e1 - s1 END) AS BIGINT) AS carried,
 CAST(sum(CASE WHEN s1 > 0 THEN s1 - 1 ELSE 49 END) AS BIGINT) AS rest_ends, count(*) FILTER ((s1 = 0 AND e1 = 49) OR (s2 = 0 AND e2 = 29)) AS contained FROM o GROUP BY l_orderkey""")
def overlap_algebra(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    o = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (p % 20).alias("s1"), (p % 20 + s % 30).alias("e1"), (s % 20).alias("s2"), (s % 20 + p % 30).alias("e2"))
    fifty = F.lit(50).cast("long")
    return o.groupBy("l_orderkey").agg(
        F.sum(seq.interval_length("s1", "e1")).alias("bases"), F.count_if(seq.intersects("s1", "e1", "s2", "e2")).alias("meet"),
        F.sum(seq.translate_coordinate("e1", "s1", "s2", F.col("l_linenumber") % 2 == 1, fifty)).alias("carried"),
        F.sum(seq.complement_interval("s1", "e1", fifty)["end"]).alias("rest_ends"), F.count_if(seq.is_containment("s1", "e1", fifty, "s2", "e2", F.lit(30).cast("long"))).alias("contained"),
    )


LN = "list_sum(list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda x: ln(x)))"


@query(f"""WITH t AS (SELECT DISTINCT l_linenumber AS k, CAST(l_quantity AS INTEGER) + 7 AS n FROM lineitem),
f AS (SELECT k, n, {LN.format(n='n')} AS fn, coalesce({LN.format(n='k')}, 0) AS fk, coalesce({LN.format(n='n - k')}, 0) AS fr FROM t)
SELECT k, n, round(fn - fk - fr + k * ln(0.25) + (n - k) * ln(0.75), 6) AS binomial,
 round(fn - fk - fr + coalesce({LN.format(n='k + 1')}, 0) + coalesce({LN.format(n='n - k + 2')}, 0) - coalesce({LN.format(n='n + 4')}, 0) - (ln(2) - ln(24)), 6) AS beta_binomial FROM f""")
def log_probabilities(spark, d):
    t = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), (F.col("l_quantity").cast("int") + 7).alias("n")).distinct()
    return t.select("k", "n", F.round(seq.log_binomial("k", "n", F.lit(0.25)), 6).alias("binomial"), F.round(seq.log_beta_binomial("k", "n", F.lit(2), F.lit(3)), 6).alias("beta_binomial"))


@query("""SELECT DISTINCT CAST(l_quantity AS INTEGER) AS q, CAST(round(-10 * log10(pow(10, -l_quantity / 10))) AS INTEGER) AS again, chr(CAST(l_quantity AS INTEGER) + 33) AS code, CAST(l_quantity AS INTEGER) AS decoded FROM lineitem""")
def phred_codes(spark, d):
    q = load(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q")).distinct().withColumn("code", F.char(F.col("q") + 33))
    return q.select("q", seq.probability_to_phred(seq.phred_to_probability("q")).alias("again"), "code", seq.phred("code").alias("decoded"))


@query(f"""WITH {READS_SQL}, p AS (SELECT doc_id, left(seq, 10) AS q, right(seq, 12) AS r FROM reads) SELECT doc_id, CAST(levenshtein(q, r) AS INTEGER) AS edits FROM p""")
def edit_counts(spark, d):
    def run(batches):
        for b in batches:
            n = [align.edits(x, y, 100) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "edits"])

    return reads(spark, d).select("doc_id", seq.prefix("seq", 10), seq.suffix("seq", 12)).mapInArrow(run, "doc_id long, edits int")


@query(f"""WITH {READS_SQL}, p AS (SELECT doc_id, left(seq, 12) AS a, substr(seq, 5, 12) AS b FROM reads)
SELECT doc_id, '12M' AS cigar, a AS x, b AS y, CAST(12 - hamming(a, b) AS INTEGER) AS same FROM p""")
def padded_pairs(spark, d):
    def run(batches):
        for b in batches:
            pairs = [align.padded(x, y, "12M") for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            out = [b.column(0), pa.array(["12M"] * len(pairs)), pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "cigar", "x", "y"])

    rows = reads(spark, d).select("doc_id", F.left("seq", F.lit(12)), F.substring("seq", 5, 12)).mapInArrow(run, "doc_id long, cigar string, x string, y string")
    return rows.withColumn("same", (F.lit(12) - seq.hamming("x", "y")).cast("int"))


@query(f"""WITH {READS_SQL}, h AS (SELECT doc_id, seq, CAST('0x' || left(md5(doc_id || ':7'), 8) AS BIGINT) AS h FROM reads)
SELECT doc_id, CAST(h % 23 AS INTEGER) AS start, substr(seq, h % 23 + 1, 10) AS piece, substr('ACGT', h % 4 + 1, 1) AS base FROM h""")
def random_pieces(spark, d):
    r = reads(spark, d)
    return contigs.random_substrings(r, "doc_id", 10, 7).join(contigs.random_bases(r, "doc_id", 7), "doc_id")


@query(f"WITH {READS_SQL} SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, count(*) AS same_length FROM reads")
def noisy_reads(spark, d):
    r = reads(spark, d)
    noise = contigs.noisy(r.select("doc_id", "seq"), "seq", 0.05, 3).withColumnRenamed("seq", "noise")
    both = r.select("doc_id", "seq").join(noise, "doc_id").filter(F.length("noise") == F.length("seq"))
    return both.agg(F.count("*").alias("reads"), F.sum(F.length("noise")).alias("bases"), F.count_if(F.length(F.translate("noise", "ACGT", "")) == 0).alias("same_length"))


@query(f"""WITH {READS_SQL}, n AS (SELECT doc_id, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c,
 length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'T', '')) AS t FROM (SELECT doc_id, left(seq, 2) AS seq FROM reads))
SELECT doc_id, (a > 0)::INT + (c > 0)::INT + (g > 0)::INT + (t > 0)::INT = 1 AS lone FROM n""")
def lone_letters(spark, d):
    n = reads(spark, d).select("doc_id", lookup.letter_counts(F.left("seq", F.lit(2))).alias("n"))
    return n.select("doc_id", lookup.has_one_letter(F.col("n")).alias("lone"))


@query(f"WITH {READS_SQL} SELECT lang, doc_id, CAST(sum(length(seq)) OVER (PARTITION BY lang ORDER BY doc_id) - length(seq) AS BIGINT) AS cum_len FROM reads")
def cumulative_starts(spark, d):
    rows = reads(spark, d).select("lang", "doc_id", F.length("seq").cast("long").alias("length"))
    return contigs.cumulative_starts(rows, "doc_id", "length", "lang").drop("length")


@query(f"""WITH c AS (SELECT doc_id, regexp_extract_all(upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')), '[ACGT]+') AS p FROM documents)
SELECT doc_id, count(*) AS parts, max(length(s)) AS longest FROM (SELECT doc_id, unnest(p) AS s FROM c) GROUP BY doc_id""")
def contig_values(spark, d):
    docs = load(spark, d, "documents").select("doc_id", contigs.mask_to_bases("text").alias("seq"))
    return contigs.contig_values(docs, "doc_id", "seq").groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(F.length("seq")).cast("long").alias("longest"))


# ---- the suffix table and its texts ----------------------------------------------


@query(f"WITH {SUFFIX_SQL} SELECT text // 2 AS contig, rank FROM sa WHERE suffix = '$' AND text % 2 = 0")
def contig_ends(spark, d):
    return suffixes.contig_ends(suffix_table(spark, d))


@query(f'WITH {SUFFIX_SQL} SELECT text, "offset", rank FROM sa')
def inverse_order(spark, d):
    return suffixes.inverse(suffix_table(spark, d))


@query(f'WITH {TEXTS_SQL} SELECT text, text % 20 AS "offset", 5 + text % 7 AS n, substr(seq, text % 20 + 1, 5 + text % 7) AS piece FROM texts')
def extracted_strings(spark, d):
    t = texts(spark, d)
    return suffixes.extracted(t, t.select("text", (F.col("text") % 20).alias("offset"), (F.col("text") % 7 + 5).alias("n")))


@query(f"WITH {READS_SQL} SELECT doc_id AS contig, doc_id % 32 + 1 AS at, substr(seq, doc_id % 32 + 1, 1) AS base FROM reads")
def displayed_letters(spark, d):
    t = texts(spark, d)
    return suffixes.display(t, reads(spark, d).select(F.col("doc_id").alias("contig"), (F.col("doc_id") % 32 + 1).alias("at")))


@query(f"""WITH {TEXTS_SQL} SELECT text, text % 32 AS "offset", substr(seq, text % 32 + 1, 1) AS base FROM texts""")
def displayed_positions(spark, d):
    t = texts(spark, d)
    return suffixes.display_positions(suffixes.display_contigs(t), t.select("text", (F.col("text") % 32).alias("offset")))


@query(f"""WITH {READS_SQL}, sfx AS (SELECT doc_id AS text, unnest(range(0, length(seq) + 1)) AS o, seq FROM reads WHERE doc_id % 3 <> 1),
sa AS (SELECT text, o AS "offset", row_number() OVER (ORDER BY substr(seq, o + 1) || '$', text) - 1 AS rank FROM sfx) SELECT text, "offset", rank FROM sa""")
def merged_and_removed(spark, d):
    r = reads(spark, d).select(F.col("doc_id").alias("text"), "seq")
    parts = [suffixes.ranked(r.filter(F.col("text") % 3 == k)) for k in range(3)]
    whole = tree_reduce(parts, suffixes.merge_indices)
    return suffixes.remove_texts(whole, r.filter(F.col("text") % 3 == 1).select("text")).select("text", "offset", "rank")


@query("SELECT CAST(0 AS BIGINT) AS broken")
def order_check(spark, d):
    return suffixes.invalid_rows(suffix_table(spark, d)).agg(F.count("*").alias("broken"))


@query(f"""WITH {READS_SQL}, s AS (SELECT doc_id, seq, unnest(range(0, 32)) AS o FROM reads WHERE length(seq) = 32), r AS (SELECT doc_id, seq, o, substr(seq, o + 1) AS x, lag(substr(seq, o + 1)) OVER (PARTITION BY doc_id ORDER BY substr(seq, o + 1)) AS y FROM s)
SELECT doc_id, CAST(sum(coalesce(len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i))), 0)) AS BIGINT) AS shared FROM r GROUP BY doc_id""")
def lcp_of_strings(spark, d):
    import numpy as np

    def run(batches):
        for b in batches:
            total = []
            for s in b.column(1).to_pylist():
                order = np.array(sorted(range(len(s)), key=lambda i: s[i:]))
                total.append(int(suffixes.kasai(s, order).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64())], names=["doc_id", "shared"])

    return reads(spark, d).select("doc_id", "seq").mapInArrow(run, "doc_id long, shared long")


# ---- views ------------------------------------------------------------------------


@query(f"WITH {VIEW_SQL} SELECT range_no, min(rank) AS lo, max(rank) AS hi FROM runs GROUP BY range_no")
def range_bounds(spark, d):
    return views.range_bounds(views.merged_runs(view(spark, d)))


@query(f"""WITH {VIEW_SQL} SELECT range_no, arg_min(text, v.rank) AS text, arg_min("offset", v.rank) AS "offset" FROM runs JOIN v USING (rank) GROUP BY range_no""")
def range_positions(spark, d):
    rows = view(spark, d)
    ranges = views.merged_runs(rows).select("rank", "range_no").join(rows.select("rank", "text", "offset", "in_mask"), "rank")
    found = views.range_position(ranges.withColumn("canon", F.lit(None).cast("struct<text:bigint,offset:bigint>")))
    return found.select("range_no", "position.text", "position.offset")


@query(f"WITH {VIEW_SQL} SELECT canon, count(DISTINCT range_no) AS n, min(range_no) AS first FROM runs GROUP BY canon")
def position_ranges(spark, d):
    found = views.position_ranges(views.merged_runs(view(spark, d)))
    return found.select("canon", F.size("ranges").cast("long").alias("n"), F.col("ranges")[0].alias("first"))


@query(f"""WITH {VIEW_SQL} SELECT s_suppkey AS id, b.range_no - a.range_no + 1 AS n FROM supplier JOIN runs a ON a.rank = s_suppkey * 91 JOIN runs b ON b.rank = s_suppkey * 91 + s_nationkey""")
def approximate_ranges(spark, d):
    lo = F.col("s_suppkey") * 91
    asked = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), lo.alias("lo"), (lo + F.col("s_nationkey")).alias("hi"))
    return views.approximate_ranges(views.merged_runs(view(spark, d)), asked)


def _bits(spark, d) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderstatus") == "F").alias("bit"))


@query("""WITH o AS (SELECT o_orderkey AS i, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderstatus = 'F')
SELECT s_suppkey * 80 AS k, i FROM supplier LEFT JOIN o ON k = s_suppkey * 80""")
def bit_select(spark, d):
    return views.select(_bits(spark, d), load(spark, d, "supplier").select((F.col("s_suppkey") * 80).alias("k")))


@query("""SELECT s_suppkey * 160 + 3 AS "at", max(o_orderkey) FILTER (o_orderkey <= s_suppkey * 160 + 3) AS before, min(o_orderkey) FILTER (o_orderkey >= s_suppkey * 160 + 3) AS after
FROM supplier, (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY s_suppkey""")
def bit_neighbours(spark, d):
    bits, at = _bits(spark, d), load(spark, d, "supplier").select((F.col("s_suppkey") * 160 + 3).alias("at"))
    return views.value_before(bits, at).withColumnRenamed("i", "before").join(views.value_after(bits, at).withColumnRenamed("i", "after"), "at")


# ---- look-ups ------------------------------------------------------------------------


@query(f"""WITH {READS_SQL}, k AS (SELECT DISTINCT left(seq, 6) AS kmer FROM reads), p AS (SELECT DISTINCT right(seq, 6) AS pattern FROM reads),
m AS (SELECT pattern, kmer, CAST(hamming(pattern, kmer) AS INTEGER) AS mismatches FROM p, k WHERE hamming(pattern, kmer) <= 1)
SELECT * FROM m QUALIFY mismatches = 0 OR min(mismatches) OVER (PARTITION BY pattern) = 1""")
def greedy_matches(spark, d):
    r = reads(spark, d)
    k, p = r.select(F.left("seq", F.lit(6)).alias("kmer")).distinct(), r.select(F.right("seq", F.lit(6)).alias("pattern")).distinct()
    return lookup.greedy_matches(lookup.neighbourhood(k, p, 6, 1))


@query(f"""WITH s AS (SELECT s_suppkey AS id, left(translate(md5(s_name), '{HEX}', '{AS_BASES}'), 9) AS seq FROM supplier),
h AS (SELECT id, n, left(seq, n) AS p FROM (SELECT id, seq, unnest(range(1, 10)) AS n FROM s)),
a AS (SELECT x.id, x.n FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.n = x.n AND y.id <> x.id AND hamming(x.p, y.p) <= 2))
SELECT id, CAST(min(n) AS INTEGER) AS n FROM a GROUP BY id""")
def dissimilar_prefixes(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.left(F.translate(F.md5("s_name"), HEX, AS_BASES), F.lit(9)).alias("seq"))
    return lookup.unique_prefixes(s, mismatches=1, dissimilarity=2)


@query("""SELECT c_custkey AS read, CAST(1 AS INTEGER) AS level, s_suppkey AS coordinate, CASE WHEN s_suppkey % 2 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS face FROM customer JOIN supplier ON s_suppkey = c_custkey % 100 WHERE c_nationkey >= 10
UNION ALL SELECT c_custkey, 0, s_nationkey, 'LEFT' FROM customer JOIN supplier ON s_suppkey = c_custkey % 100 WHERE c_nationkey >= 3""")
def levels_of_faces(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("read"), F.lit(0).alias("i"), (F.col("c_custkey") % 100).alias("range_no"), F.col("c_nationkey").alias("context"))
    s = load(spark, d, "supplier")
    upper = s.select(F.col("s_suppkey").alias("range_no"), F.col("s_suppkey").alias("coordinate"), F.when(F.col("s_suppkey") % 2 == 0, "LEFT").otherwise("RIGHT").alias("face"))
    lower = s.select(F.col("s_suppkey").alias("range_no"), F.col("s_nationkey").cast("long").alias("coordinate"), F.lit("LEFT").alias("face"))
    return lookup.map_levels([lookup.faces(c, lower, 3), lookup.faces(c, upper, 10)]).select("read", "level", "coordinate", "face")


@query(f"""WITH {READS_SQL}, p AS (SELECT DISTINCT left(seq, n) AS context, doc_id AS node FROM (SELECT doc_id, seq, unnest(range(1, 13)) AS n FROM reads)),
u AS (SELECT context, min(node) AS node FROM p GROUP BY context HAVING count(*) = 1), m AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.node = u.node AND v.context = left(u.context, length(u.context) - 1))),
q AS (SELECT c_custkey AS query, translate(md5(c_name), '{HEX}', '{AS_BASES}') AS seq FROM customer)
SELECT DISTINCT query, node FROM q JOIN m ON starts_with(seq, context)""")
def context_matches(spark, d):
    known = contexts.minimal_unique_contexts(reads(spark, d).select(F.col("doc_id").alias("node"), "seq"), 12)
    asked = load(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.translate(F.md5("c_name"), HEX, AS_BASES).alias("seq"))
    return contexts.matches(known, asked)


@query("""WITH l AS (SELECT l_orderkey AS query, min(l_suppkey % 4) AS node FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_suppkey % 4) = 1),
r AS (SELECT l_orderkey AS query, min(l_partkey % 4) AS node FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(DISTINCT l_partkey % 4) = 1)
SELECT query, coalesce(l.node, r.node) AS node, CASE WHEN l.node = r.node THEN 'B' ELSE 'L' END AS class FROM l FULL JOIN r USING (query) WHERE l.node = r.node OR l.node IS NULL OR r.node IS NULL""")
def mapped_classes(spark, d):
    li = load(spark, d, "lineitem")
    left = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query"), (F.col("l_suppkey") % 4).alias("node"))
    right = li.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("query"), (F.col("l_partkey") % 4).alias("node"))
    return contexts.mapped_class(left, right)


WALK = """n AS (SELECT s_suppkey AS node, substr('ACGT', s_nationkey % 4 + 1, 1) AS base FROM supplier),
e AS (SELECT s_suppkey AS a, s_suppkey % 97 + 1 AS b FROM supplier UNION SELECT s_suppkey, s_suppkey * 7 % 100 + 1 FROM supplier),
w AS (SELECT node AS start, node AS "end", base AS seq FROM n UNION ALL SELECT start, b, seq || base FROM w JOIN e ON "end" = a JOIN n ON b = node WHERE length(seq) < 4)"""


def _walks(spark, d):
    s = load(spark, d, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), F.substring(F.lit("ACGT"), F.col("s_nationkey").cast("int") % 4 + 1, F.lit(1)).alias("base"))
    k = F.col("s_suppkey")
    edges = s.select(k.alias("a"), (k % 97 + 1).alias("b")).union(s.select(k, k * 7 % 100 + 1)).distinct()
    return contexts.walks(nodes, edges, 4)


@query(f"WITH RECURSIVE {WALK} SELECT start, \"end\", seq, count(*) AS n FROM w GROUP BY ALL")
def graph_walks(spark, d):
    return _walks(spark, d).groupBy("start", "end", "seq").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {WALK} SELECT start, seq FROM w GROUP BY start, seq QUALIFY row_number() OVER (PARTITION BY start ORDER BY length(seq) DESC, seq DESC) = 1")
def longest_walks(spark, d):
    return contexts.longest_walks(_walks(spark, d))


# ---- intervals ---------------------------------------------------------------------

POINTS = """p AS (SELECT c_custkey AS id, c_nationkey AS n, c_custkey % 100 AS x FROM customer), s AS (SELECT s_nationkey AS n, s_suppkey AS start, s_suppkey % 3 + 1 AS length, s_name AS value FROM supplier)"""


def _points(spark, d):
    p = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 100).alias("x"))
    s = load(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") % 3 + 1).alias("length"), F.col("s_name").alias("value"))
    return p, s


@query(f"""WITH {POINTS}, e AS (SELECT n, start + length - 1 AS "end", max(value) AS value FROM s GROUP BY ALL)
SELECT id, p.n AS n, x, e."end" AS match_key FROM p ASOF LEFT JOIN e ON p.n = e.n AND x >= e."end" """)
def ending_before(spark, d):
    p, s = _points(spark, d)
    return intervals.ending_before(p, s, ["n"], "x").drop("match")


@query(f"""WITH {POINTS}, e AS (SELECT n, start + length - 1 AS "end", max(value) AS value FROM s GROUP BY ALL)
SELECT id, p.n AS n, x, e."end" AS match_key FROM p ASOF LEFT JOIN e ON p.n = e.n AND x <= e."end" """)
def ending_after(spark, d):
    p, s = _points(spark, d)
    return intervals.ending_after(p, s, ["n"], "x").drop("match")


@query("""SELECT o_orderkey, o_custkey % 100 AS k, s_name AS value FROM orders LEFT JOIN supplier ON s_suppkey % 10 = o_custkey % 10 AND s_suppkey <= o_orderkey % 90 AND o_orderkey % 90 + 1 <= s_suppkey + 4""")
def containing_spans(spark, d):
    k = F.col("o_orderkey") % 90
    p = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), (F.col("o_custkey") % 10).alias("g"), k.alias("at"))
    s = load(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("g"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 4).alias("end"), F.col("s_name").alias("value"))
    return intervals.containing(p, s, ["g"], "at", F.col("at") + 1).select("o_orderkey", "k", "value")


# ---- evaluation ----------------------------------------------------------------------


@query(f"""WITH {GENES_SQL}, b AS (SELECT DISTINCT l_orderkey AS column_id, 'Brand#' || (l_suppkey % 25 + 1) AS contig, l_partkey AS base FROM lineitem),
h AS (SELECT DISTINCT column_id, name FROM b JOIN genes g ON b.contig = g.contig AND g.start <= base AND base < g."end") SELECT count(DISTINCT column_id) AS columns, count(DISTINCT name) AS genes FROM h""")
def hit_totals(spark, d):
    points = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("column_id"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("contig"), F.col("l_partkey").alias("base"))
    hits = intervals.point_join(points, genes(spark, d).select("contig", "start", "end", "name"), "contig", "base", ("start", "end"), 64)
    return hits.agg(F.count_distinct("column_id").alias("columns"), F.count_distinct("name").alias("genes"))


@query("""WITH c AS (SELECT l_returnflag AS class, l_partkey % 50 AS gene, count(*) AS columns FROM lineitem GROUP BY ALL)
SELECT class, CAST(sum(columns) AS BIGINT) AS columns, count(gene) AS genes FROM c GROUP BY class""")
def class_totals(spark, d):
    c = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("class"), (F.col("l_partkey") % 50).alias("gene")).agg(F.count("*").alias("columns"))
    return evaluate.class_totals(c)


@query("""WITH a AS (SELECT l_returnflag AS category, l_partkey % 40 AS gene, count(*) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_returnflag AS category, l_partkey % 40 AS gene, count(*) AS y FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT category, concat_ws(chr(9), CASE WHEN coalesce(y, 0) > coalesce(x, 0) THEN '+++' ELSE '---' END, CAST(gene AS VARCHAR), CAST(abs(coalesce(y, 0) - coalesce(x, 0)) AS VARCHAR)) AS line
FROM a FULL JOIN b USING (category, gene) WHERE coalesce(x, 0) <> coalesce(y, 0)""")
def described_difference(spark, d):
    g = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), (F.col("l_partkey") % 40).cast("string").alias("gene"), "l_linestatus")
    return evaluate.describe_difference(evaluate.gene_set_difference(g.filter("l_linestatus = 'F'"), g.filter("l_linestatus = 'O'")))


@query(
    """SELECT l_linestatus AS scheme, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) / count(DISTINCT l_partkey) AS share FROM lineitem GROUP BY 1""")
def wrong_gene_share(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("scheme"), F.col("l_partkey").alias("gene"), F.when(F.col("l_returnflag") == "R", "gene2wrong").otherwise("gene2gene").alias("category"))
    return evaluate.wrong_gene_share(rows, ["scheme"])


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_custkey / (c_nationkey % 3 * 100.0) END AS coverage FROM customer""")
def coverage_ratio(spark, d):
    k = F.col("c_nationkey") % 3
    return load(spark, d, "customer").select("c_custkey", evaluate.coverage(F.col("c_custkey"), F.lit(100.0), k.cast("double")).alias("coverage"))


@query("""SELECT o_orderstatus AS scheme, count(*) AS runs, avg(o_totalprice) AS price, avg(CAST(o_custkey AS DOUBLE)) AS customer FROM orders GROUP BY 1""")
def metric_series(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderstatus").alias("scheme"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return evaluate.metric_series(rows, ["scheme"], ["price", "customer"])


@query("""SELECT 'indels' AS metric, scheme, value FROM (SELECT 'a' AS scheme, CAST(o_custkey AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', CAST(o_orderkey AS DOUBLE) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'c', o_totalprice FROM orders WHERE o_orderstatus = 'P')""")
def stacked_metrics(spark, d):
    o = load(spark, d, "orders")
    part = lambda status, c: o.filter(F.col("o_orderstatus") == status).select(F.col(c).cast("double").alias("value"))
    return evaluate.stacked("indels", a=part("F", "o_custkey"), b=part("O", "o_orderkey"), c=part("P", "o_totalprice"))


PILE = """b AS (SELECT l_suppkey AS k, l_linenumber AS i, substr('ACGT', l_partkey % 4 + 1, 1) AS base FROM lineitem),
p AS (SELECT k, i, count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, substr('ACGT', k % 4 + 1, 1) AS root FROM b GROUP BY k, i),
q AS (SELECT *, CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS consensus, CASE root WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END AS own FROM p)"""


def _pile(spark, d):
    b = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("i"), F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    return evaluate.pileup(b, ["k", "i"]).withColumn("root", F.substring(F.lit("ACGT"), (F.col("k") % 4 + 1).cast("int"), F.lit(1)))


@query(f"WITH {PILE} SELECT k, i, CASE WHEN own = greatest(a, c, g, t) THEN root ELSE consensus END AS call FROM q")
def rooted_consensus(spark, d):
    return evaluate.keep_root(_pile(spark, d)).select("k", "i", "call")


@query(f"WITH {PILE} SELECT k, i, root, consensus FROM q WHERE consensus <> root AND own < 20")
def incorrect_bases(spark, d):
    return evaluate.incorrect_bases(_pile(spark, d), 20).select("k", "i", "root", "consensus")


@query(f"WITH {PILE} SELECT k, count(*) FILTER (depth > 1) AS covered, avg(depth) AS mean_depth FROM q GROUP BY k")
def bases_covered(spark, d):
    return evaluate.bases_covered(_pile(spark, d), ["k"])


@query("""SELECT l_suppkey AS k, l_linenumber AS i, l_returnflag = 'R' AS part, count(*) AS depth, count(*) FILTER (l_partkey % 4 = 0) AS a FROM lineitem GROUP BY ALL""")
def partitioned_pileup(spark, d):
    b = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_returnflag") == "R").alias("part"), F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    return evaluate.partitioned_pileup(b, ["k", "i"], "part").select("k", "i", "part", "depth", "a")


LIKE = " + ".join(f"{x} * ln(CASE WHEN '{x}' = '{{y}}' THEN 0.99 ELSE 0.01 / 3 END)" for x in "acgt")


@query(f"""WITH {PILE}, l AS (SELECT k, i, {', '.join(f"{LIKE.format(y=y)} AS l{y}" for y in 'acgt')} FROM q), m AS (SELECT *, greatest(la, lc, lg, lt) AS top FROM l)
SELECT k, i, round(la, 6) AS log_a, round(1 / (exp(la - top) + exp(lc - top) + exp(lg - top) + exp(lt - top)), 6) AS posterior FROM m""")
def base_posteriors(spark, d):
    return evaluate.posterior(_pile(spark, d)).select("k", "i", F.round("log_a", 6).alias("log_a"), F.round("posterior", 6).alias("posterior"))


@query(f"""WITH root AS (SELECT c_custkey AS k, unnest(range(1, 9)) AS i, translate(md5(CAST(c_custkey AS VARCHAR)), '{HEX}', '{AS_BASES}') AS s FROM customer),
r AS (SELECT k, i, substr(s, i, 1) AS root FROM root),
b AS (SELECT o_custkey AS k, o_orderkey AS read, i, CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), i, 1) < '6' THEN translate(root, 'ACGT', 'CGTA') ELSE root END AS base FROM orders JOIN r ON k = o_custkey),
every AS (SELECT k, i, base FROM b UNION ALL SELECT k, i, root FROM r),
n AS (SELECT k, i, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM every GROUP BY ALL),
p AS (SELECT *, list_sort([a, c, g, t], 'DESC')[2] > 3 AS conflict, CASE root WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END AS own, greatest(a, c, g, t) AS top FROM r JOIN n USING (k, i)),
apart AS (SELECT DISTINCT k, read FROM b JOIN p USING (k, i) WHERE conflict AND own > 3 AND base <> root),
kept AS (SELECT k, i, base FROM b ANTI JOIN apart USING (k, read) UNION ALL SELECT k, i, root FROM r),
m AS (SELECT k, i, count(*) FILTER (base = 'A') AS ka, count(*) FILTER (base = 'C') AS kc, count(*) FILTER (base = 'G') AS kg, count(*) FILTER (base = 'T') AS kt FROM kept GROUP BY ALL),
z AS (SELECT *, CASE root WHEN 'A' THEN ka WHEN 'C' THEN kc WHEN 'G' THEN kg ELSE kt END AS mine, greatest(ka, kc, kg, kt) AS best FROM p JOIN m USING (k, i))
SELECT k, CAST(i AS INTEGER) AS i, root, CASE WHEN mine >= 3 THEN root WHEN best > mine THEN CASE best WHEN ka THEN 'A' WHEN kc THEN 'C' WHEN kg THEN 'G' ELSE 'T' END
 WHEN NOT conflict AND top > mine THEN CASE top WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END ELSE root END AS call FROM z""")
def conflict_consensus(spark, d):
    s = F.translate(F.md5(F.col("c_custkey").cast("string")), HEX, AS_BASES)
    root = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.posexplode(seq.letters(F.left(s, F.lit(8)))).alias("i", "base")).withColumn("i", F.col("i") + 1)
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("read"), F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    rows = o.join(root.hint("merge"), "k")  # eight rows a customer, which the size of the file does not tell
    changed = F.when(F.substring("h", F.col("i"), F.lit(1)) < "6", F.translate("base", "ACGT", "CGTA")).otherwise(F.col("base"))
    return evaluate.conflict_consensus(rows.select("k", "read", "i", changed.alias("base")), root, ["k"], 3)


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS index FROM orders")
def index_rows(spark, d):
    return evaluate.index_rows(load(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT c_mktsegment AS stat, CAST(sum(c_custkey) AS BIGINT) AS value FROM customer GROUP BY 1")
def reduced_totals(spark, d):
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("stat"), F.col("c_custkey").alias("value"))
    parts = [evaluate.keyed_totals(c.filter(F.col("value") % 5 == k)) for k in range(5)]
    return tree_reduce(parts, lambda a, b: evaluate.keyed_totals(a.unionByName(b)))


# ---- graphs ---------------------------------------------------------------------------


@query(f"""WITH {SEGMENTS.replace('o_orderkey % 2000', 'o_orderkey % 3')}, s AS (SELECT contig, start, length + 2 AS length, block, CASE WHEN block IS NOT NULL THEN TRUE END AS orientation, start AS block_start FROM seg),
n AS (SELECT *, coalesce(lag(start + length) OVER w = start AND lag(block) OVER w IS NOT DISTINCT FROM block AND lag(orientation) OVER w IS NOT DISTINCT FROM orientation, FALSE) AS same FROM s WINDOW w AS (PARTITION BY contig ORDER BY start)),
g AS (SELECT *, sum(CAST(NOT same AS INT)) OVER (PARTITION BY contig ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT contig, block, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, min(block_start) AS block_start FROM g GROUP BY contig, g, block, orientation""")
def collinear_segments(spark, d):
    s = segments(spark, d).withColumn("block", F.when(F.col("block").isNotNull(), F.col("block")))
    o = load(spark, d, "orders").join(load(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey")) - 1
    s = o.select(F.col("c_custkey").alias("contig"), (n * 10).cast("long").alias("start"), F.lit(10).alias("length"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 3).alias("block"))
    s = s.withColumns({"orientation": F.when(F.col("block").isNotNull(), F.lit(True)), "block_start": F.col("start")})
    return graph.join_collinear(s).select("contig", "block", "start", "length", "block_start")


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT c_nationkey AS a, 100 + s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 97 = s_suppkey),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS r FROM both_ UNION SELECT reach.node, b FROM reach JOIN both_ ON r = a),
c AS (SELECT node, min(r) AS component FROM reach GROUP BY node), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component, size FROM c JOIN s USING (component) WHERE size >= 3""")
def large_components(spark, d):
    from strandweave.queries import _edges

    return graph.components_of_size(graph.connected_components(_edges(spark, d)), lambda n: n >= 3)


UNITIGS = "SELECT s_suppkey AS u, [2 * s_suppkey, 2 * s_suppkey + 1] AS ends, s_nationkey AS reads, s_suppkey % 4 AS n_left, s_suppkey % 3 AS n_right, s_name AS seq FROM supplier"


def _unitigs(spark, d):
    s = load(spark, d, "supplier")
    k = F.col("s_suppkey")
    link = lambda n, step: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((2 * ((k * step + i) % 100 + 1) + i % 2).cast("long").alias("end"), F.lit(20).alias("len")))
    some = lambda n, step: F.when(n > 0, link(F.greatest(n, F.lit(1)), step)).otherwise(F.array().cast("array<struct<end:bigint,len:int>>"))
    return s.select(F.array(2 * k, 2 * k + 1).alias("ends"), F.col("s_nationkey").alias("reads"), some(k % 4, 3).alias("left"), some(k % 3, 7).alias("right"), F.col("s_name").alias("seq"))


@query(f"SELECT count(*) AS unitigs, avg(length(seq)) AS mean_length, CAST(sum(n_left + n_right) AS BIGINT) AS overlaps, CAST(sum(reads) AS BIGINT) AS reads FROM ({UNITIGS})")
def unitig_totals(spark, d):
    return graph.overlap_stats(_unitigs(spark, d))


@query(f"""WITH RECURSIVE u AS ({UNITIGS}), e AS (SELECT ends[1] AS a, 2 * ((u * 3 + i) % 100 + 1) + i % 2 AS b FROM (SELECT *, unnest(range(0, n_left)) AS i FROM u)
 UNION SELECT ends[2], 2 * ((u * 7 + i) % 100 + 1) + i % 2 FROM (SELECT *, unnest(range(0, n_right)) AS i FROM u) UNION SELECT ends[1], ends[2] FROM u),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS r FROM x UNION SELECT node, b FROM reach JOIN x ON r = a)
SELECT CAST(node AS BIGINT) AS node, CAST(min(r) AS BIGINT) AS component FROM reach GROUP BY node""")
def unitig_components(spark, d):
    return graph.unitig_components(_unitigs(spark, d))


@query(f"""WITH c AS (SELECT s_suppkey AS contig, s_nationkey AS genome, left(translate(md5(s_name), '{HEX}', '{AS_BASES}'), CAST(5 + s_suppkey % 9 AS INTEGER)) AS seq FROM supplier),
n AS (SELECT *, sum(length(seq)) OVER (ORDER BY contig) - length(seq) AS cum FROM c)
SELECT CAST(cum + o AS BIGINT) AS base, contig, CAST(o AS BIGINT) AS "offset", genome, substr(seq, o + 1, 1) AS letter FROM (SELECT *, unnest(range(0, length(seq))) AS o FROM n)""")
def thread_bases(spark, d):
    c = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("contig"), F.col("s_nationkey").alias("genome"), F.left(F.translate(F.md5("s_name"), HEX, AS_BASES), (F.col("s_suppkey") % 9 + 5).cast("int")).alias("seq")
    )
    return graph.base_table(c)


# ---- stores ----------------------------------------------------------------------------

EDGES = "e AS (SELECT s_suppkey AS id, s_suppkey % 20 AS left_side, s_nationkey AS right_side FROM supplier)"


def _stored_edges(spark, d):
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 20).alias("left_side"), F.col("s_nationkey").alias("right_side"))


@query(f"WITH {EDGES} SELECT id, left_side, right_side FROM e WHERE left_side = 7 OR right_side = 7")
def attached_edges(spark, d):
    return store.attached(_stored_edges(spark, d), 7)


@query(f"WITH {EDGES} SELECT 'breakpoint' AS kind, id, left_side, right_side FROM e WHERE id % 2 = 0 UNION ALL SELECT 'site', id, left_side, right_side FROM e WHERE id % 2 = 1")
def uniform_edges(spark, d):
    e = _stored_edges(spark, d)
    return store.uniform_edges(site=e.filter("id % 2 = 1"), breakpoint=e.filter("id % 2 = 0"))


@query("SELECT o_orderkey, o_custkey AS variable FROM orders WHERE o_custkey = 7")
def variable_owner(spark, d):
    return store.variable_owner(load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("variable")), 7)


@query("SELECT o_orderkey, count(*) AS terms FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING bool_or(l_suppkey = 7)")
def constraints_on(spark, d):
    terms = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_suppkey").alias("variable"), F.lit(1.0).alias("weight"))).alias("terms"))
    found = store.constraints_on(load(spark, d, "orders").select("o_orderkey").join(terms, "o_orderkey"), 7)
    return found.select("o_orderkey", F.size("terms").cast("long").alias("terms"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def one_page(spark, d):
    return store.page(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 100)


def _groups(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    edge = F.struct(k.alias("id"), (k % 20).alias("left"), F.col("s_nationkey").cast("long").alias("right"))
    return load(spark, d, "supplier").select(edge.alias("edge"), F.when(k % 2 == 0, (k % 3).cast("int")).alias("allele_int"), F.when(k % 2 == 1, F.col("s_name")).alias("allele_string"))


def _adjacent(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(F.struct(k.alias("id"), (k % 50).alias("left"), (F.col("c_nationkey") * 3).cast("long").alias("right")).alias("edge"))


ALLELES = """g AS (SELECT s_suppkey AS id, s_suppkey % 20 AS l, CAST(s_nationkey AS BIGINT) AS r, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 3 AS VARCHAR) ELSE s_name END AS allele FROM supplier),
a AS (SELECT c_custkey AS id, c_custkey % 50 AS l, CAST(c_nationkey * 3 AS BIGINT) AS r FROM customer)"""


@query(f"WITH {ALLELES} SELECT 'group' AS kind, id, l AS left_side, r AS right_side FROM g WHERE l = 7 OR r = 7 UNION ALL SELECT 'one', id, l, r FROM g WHERE id = 31")
def allele_groups(spark, d):
    from strandweave.sources import schemas

    g = _groups(spark, d)
    return schemas.flat_edges(store.allele_groups_at(g, 7), "group").unionByName(schemas.flat_edges(store.allele_group(g, 31), "one"))


@query(f"WITH {ALLELES}, s AS (SELECT l AS side FROM g WHERE id < 6 UNION SELECT r FROM g WHERE id < 6) SELECT 'adjacency' AS kind, id, l AS left_side, r AS right_side FROM a WHERE l IN (FROM s) OR r IN (FROM s)")
def adjacencies_of(spark, d):
    from strandweave.sources import schemas

    return schemas.flat_edges(store.adjacencies_of(_adjacent(spark, d), _groups(spark, d).filter("edge.id < 6")), "adjacency")


@query("SELECT DISTINCT o_custkey AS parent, o_orderkey AS child FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 20) OR o_orderkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 20)")
def transmissions_of(spark, d):
    t = load(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    return store.transmissions_of(t, load(spark, d, "supplier").filter("s_suppkey < 20").select(F.col("s_suppkey").alias("id")))


@query(f"WITH {ALLELES}, p AS (SELECT s_suppkey AS id, s_suppkey * 10 AS position, CASE WHEN s_nationkey < 12 THEN 'x' ELSE 'y' END AS contig FROM supplier) SELECT g.id FROM g JOIN p USING (id) WHERE contig = 'x' AND position BETWEEN 100 AND 900 AND allele <> '1'")
def variant_groups(spark, d):
    s = load(spark, d, "supplier")
    places = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 10).alias("position"), F.when(F.col("s_nationkey") < 12, "x").otherwise("y").alias("contig"))
    return store.variant_groups_between(_groups(spark, d), places, "x", 100, 900, 1).select("edge.id")


SPAN_SQL = f"""WITH {ALLELES}, p AS (SELECT s_suppkey AS side, s_suppkey * 10 AS position, 'x' AS contig FROM supplier WHERE s_suppkey <= 40),
j AS (SELECT a.*, x.position AS lp, y.position AS rp FROM a LEFT JOIN p x ON a.l = x.side LEFT JOIN p y ON a.r = y.side)"""


def _placed_sides(spark, d):
    return load(spark, d, "supplier").filter("s_suppkey <= 40").select(F.col("s_suppkey").alias("side"), (F.col("s_suppkey") * 10).alias("position"), F.lit("x").alias("contig"))


@query(SPAN_SQL + " SELECT id FROM j WHERE lp BETWEEN 50 AND 300 AND rp BETWEEN 50 AND 300 AND abs(lp - rp) > 1")
def deletion_spans(spark, d):
    return store.spans_longer(_adjacent(spark, d), _placed_sides(spark, d), "x", 50, 300, False).select("edge.id")


@query(SPAN_SQL + " SELECT id FROM j WHERE (coalesce(lp BETWEEN 50 AND 300, FALSE) <> coalesce(rp BETWEEN 50 AND 300, FALSE)) AND (lp IS NULL OR rp IS NULL)")
def insertion_spans(spark, d):
    return store.spans_longer(_adjacent(spark, d), _placed_sides(spark, d), "x", 50, 300, True).select("edge.id")


# ---- alignments as rows ---------------------------------------------------------------

MSA = f"""m AS (SELECT s_suppkey AS msa, translate(left(md5(s_name), 12), '{HEX}', 'ACGTACGTACGTAC--') AS r, translate(substr(md5(s_name), 13, 12), '{HEX}', 'ACGTACGTACGTAC--') AS s FROM supplier),
c AS (SELECT msa, i, substr(r, i + 1, 1) AS r, substr(s, i + 1, 1) AS s FROM (SELECT *, unnest(range(0, 12)) AS i FROM m))"""


def _alignments(spark, d):
    s = load(spark, d, "supplier")
    row = lambda name, at: s.select(F.col("s_suppkey").alias("msa"), F.lit(name).alias("name"), F.lit(10).alias("start"), F.lit(1).alias("strand"), F.translate(F.substring(F.md5("s_name"), at, 12), HEX, "ACGTACGTACGTAC--").alias("text"))
    return row("r", 1).unionByName(row("s", 13))


@query(f"""WITH {MSA} SELECT msa, 'r' AS name, reverse(translate(string_agg(r, '' ORDER BY i), 'ACGT', 'TGCA')) AS text, CAST(9 + count(*) FILTER (r <> '-') AS INTEGER) AS start, -1 AS strand FROM c GROUP BY msa
UNION ALL SELECT msa, 's', reverse(translate(string_agg(s, '' ORDER BY i), 'ACGT', 'TGCA')), CAST(9 + count(*) FILTER (s <> '-') AS INTEGER), -1 FROM c GROUP BY msa""")
def reversed_alignments(spark, d):
    return msa.reverse(_alignments(spark, d)).select("msa", "name", "text", "start", "strand")


@query(f"WITH {MSA} SELECT msa, string_agg(CASE WHEN r = s THEN '*' ELSE ' ' END, '' ORDER BY i) AS marks FROM c GROUP BY msa")
def match_strings(spark, d):
    a = _alignments(spark, d)
    both = a.filter("name = 'r'").select("msa", F.col("text").alias("x")).join(a.filter("name = 's'").select("msa", F.col("text").alias("y")), "msa")
    return both.select("msa", msa.match_string([F.col("x"), F.col("y")]).alias("marks"))


@query(f"""WITH {MSA} SELECT msa, 'r' AS name, CAST(i AS INTEGER) AS "column", CAST(row_number() OVER (PARTITION BY msa ORDER BY i) - 1 AS INTEGER) AS index FROM c WHERE r <> '-'
UNION ALL SELECT msa, 's', CAST(i AS INTEGER), CAST(row_number() OVER (PARTITION BY msa ORDER BY i) - 1 AS INTEGER) FROM c WHERE s <> '-'""")
def base_indices(spark, d):
    return msa.base_index(_alignments(spark, d))


@query(f"""WITH {MSA}, f AS (SELECT *, r <> s AS differs, lag(r <> s) OVER w AS before, lag(r) OVER w AS prev, sum(CASE WHEN r <> '-' THEN 1 ELSE 0 END) OVER w AS seen FROM c WINDOW w AS (PARTITION BY msa ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN differs AND NOT coalesce(before, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY msa ORDER BY i) AS g FROM f),
t AS (SELECT msa, g, replace(string_agg(r, '' ORDER BY i), '-', '') AS ref, replace(string_agg(s, '' ORDER BY i), '-', '') AS alt, min(CASE WHEN r <> '-' THEN 9 + seen END) AS here,
 arg_min(prev, i) AS prev, min(seen - CASE WHEN r <> '-' THEN 1 ELSE 0 END) AS earlier FROM g WHERE differs GROUP BY msa, g)
SELECT msa, count(*) AS runs, count(*) FILTER (length(ref) = length(alt)) AS subs, CAST(sum(CASE WHEN length(ref) = length(alt) THEN here ELSE CASE WHEN earlier > 0 THEN 9 + earlier END END) AS BIGINT) AS positions FROM t GROUP BY msa""")
def alignment_variants(spark, d):
    v = msa.variants(_alignments(spark, d), "r", "s")
    return v.groupBy("msa").agg(F.count("*").alias("runs"), F.count_if(F.col("kind") == "SUB").alias("subs"), F.sum("pos").alias("positions"))


# ---- k-mers -----------------------------------------------------------------------------


@query(f"""WITH {LCP_SQL} SELECT lcp, count(*) AS n FROM lcp GROUP BY lcp""")
def lcp_histogram(spark, d):
    return evaluate.histogram(suffixes.with_lcp(suffix_table(spark, d)).select("lcp"), "lcp", "n")


@query(f"""WITH {TEXTS_SQL}, k AS (SELECT text, unnest(range(0, length(seq) - 9)) AS o, seq FROM texts) SELECT text, CAST(o AS INTEGER) AS "offset", substr(seq, o + 1, 10) AS kmer FROM k""")
def kmer_positions(spark, d):
    return kmers.positions(texts(spark, d), 10, ["text"])
