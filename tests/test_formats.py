"""Readers, writers and table operators on small files and tables."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import seq
from strandweave.operators import cactus, contexts, contigs, evaluate, graph, intervals, msa, store, suffixes, views
from strandweave.plans.runtime import global_index
from strandweave.sources import readers, writers


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
        return str(path)

    return write


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_fasta_and_fastq(spark, put):
    path = put("a.fa", ">one, first\nACGT\nacgt\n>two\nNN NAC\n")
    assert table(readers.fasta(spark, path, 3), "genome", "name", "seq") == [(3, "one", "ACGTACGT"), (3, "two", "NNNAC")]
    assert table(readers.fasta(spark, put("b.fa.gz", ">x\nAc\n"), keep_case=True), "name", "seq") == [("x", "Ac")]
    with pytest.raises(Exception, match="does not begin"):
        readers.fasta(spark, put("c.fa", "ACGT\n>x\nA\n")).collect()
    with pytest.raises(Exception, match="other letters"):
        readers.fasta(spark, put("d.fa", ">x\nAQ\n"), validate=True).collect()
    assert table(readers.fastq(spark, put("r.fq", "@r1 x\nacgt\n+\nIIII\n@r2\nAA\n+\n##\n")), "name", "seq", "qual") == [("r1", "ACGT", "IIII"), ("r2", "AA", "##")]


def test_annotation_readers(spark, put):
    assert table(readers.bed(spark, put("g.bed", "c1\t1\t9\tg\t0\t+\nc1\t4\t6\th\t0\t-\n")), "start", "name", "strand") == [(1, "g", 1), (4, "h", -1)]
    text = "a score=0\ns r.x 5 3 + 99 A-CG\ns rootSeq 0 4 + 9 NNNN\ns s.y 7 4 - 88 TACG\n"
    got = readers.maf(spark, put("m.maf", text))
    assert table(got, "contig", "base", "reverse") == sorted([("r.x", 5, False), ("r.x", 6, False), ("r.x", 7, False), ("s.y", 7, True), ("s.y", 5, True), ("s.y", 4, True)], key=repr)
    lines = "s\t'ev'\t'sq'\t1\na\t1\t0\t10\ns\t'ev2'\t'sq2'\t0\na\t0\t10\t1\t0\na\t10\t5\n"
    c2h = readers.c2h(spark, put("x.c2h", lines))
    assert table(c2h, "event", "start", "length", "block", "orientation") == [("ev", 0, 10, 1, None), ("ev2", 0, 10, 1, False), ("ev2", 10, 5, None, None)]
    with pytest.raises(Exception, match="wrong number"):
        readers.c2h(spark, put("y.c2h", "s\t'e'\t's'\t0\na\t1\n")).collect()
    vcf = readers.vcf(spark, put("v.vcf", "##x\n#CHROM\n1\t5\t.\tA\tC,G\t9\tPASS\tDP=3;HP=2\tGT\t0|1\t1|1\n"))
    row = vcf.first()
    assert (row.chrom, row.pos, row.id, row.alt, row.info["DP"], row.samples) == ("1", 5, None, ["C", "G"], "3", ["0|1", "1|1"])
    assert writers.vcf_lines(vcf).first().value == "1\t5\t.\tA\tC,G\t9.0\tPASS\tDP=3;HP=2"
    assert table(readers.gene_sets(spark, put("s.tsv", "o\tg1\no\tg2\n")), "category", "gene") == [("o", "g1"), ("o", "g2")]
    stats = readers.hal_stats(spark, put("h.txt", "hal v2\n\nGenomeName, NumChildren, Length, NumSequences, NumTopSegments, NumBottomSegments\nroot, 2, 55, 1, 0, 7\n"))
    assert table(stats, "genome", "children", "bottom") == [("root", 2, 7)]
    assert abs(readers.base_composition(spark, put("b.txt", "0.25\t0.25\t0.25\t0.2\n")).first().n - 0.05) < 1e-9
    xml = '<r><homologyTests><aggregateResults><all totalTests="4" totalTrue="3" average="0.75"/></aggregateResults></homologyTests></r>'
    assert table(readers.maf_comparison(spark, put("c.xml", xml)), "total", "true", "average") == [(4, 3, 0.75)]
    assert table(readers.contig_table(spark, put("i.contigs", "s\t0\t5\t1\n")), "name", "start", "length", "genome") == [("s", 0, 5, 1)]


def test_alignment_readers(spark, put):
    sam = "@HD\nr1\t0\tc\t2\t60\t1S3M1D2M\t*\t0\t0\tTACGTT\nr1\t256\tc\t9\t60\t1M\t*\t0\t0\tA\nr2\t16\tc\t1\t60\t2M\t*\t0\t0\tAC\n"
    rows = readers.sam(spark, put("a.sam", sam))
    assert rows.count() == 2
    pairs = readers.aligned_pairs(rows)
    assert table(pairs.filter("read = 'r1'"), "i", "ref_off", "base") == [(1, 2, "A"), (2, 3, "C"), (3, 4, "G"), (4, 6, "T"), (5, 7, "T")]
    assert table(pairs.filter("read = 'r2'"), "i", "ref_off") == [(0, 2), (1, 1)]
    ref = spark.createDataFrame([("c", "ACCGATA")], "ref string, seq string")
    assert table(readers.matching_pairs(pairs, ref), "read", "ref_off") == [("r1", 3), ("r1", 4), ("r1", 6), ("r2", 1), ("r2", 2)]
    psl = "\t".join(["9"] + ["0"] * 7 + ["+", "q", "20", "0", "9", "t", "30", "0", "9", "2", "4,5,", "0,6,", "10,17,"])
    assert table(readers.psl(spark, put("b.psl", "psLayout\n" + psl + "\n")), "q_start", "t_start", "length") == [(0, 10, 4), (6, 17, 5)]
    mag = readers.mag(spark, put("u.mag.gz", "@1:2\t5\t3,10;\t.\nACGT\n+\nIIII\n@3:4\t1\t1,10;\t.\nAC\n+\nII\n"))
    assert table(mag, "ends", "reads", "seq") == [([1, 2], 5, "ACGT"), ([3, 4], 1, "AC")]
    assert graph.overlap_stats(mag).first().overlaps == 2
    assert {r.component for r in graph.unitig_components(mag).collect()} == {1}


def test_side_array(spark, tmp_path):
    path = tmp_path / "v.bin"
    path.write_bytes(struct.pack("<3Q", 10, 11, 2000001))
    assert table(readers.side_array(spark, str(path)), "i", "coordinate", "face") == [(0, 5, "LEFT"), (1, 5, "RIGHT"), (2, 1000000, "RIGHT")]
    ids = spark.range(1000).crossJoin(spark.createDataFrame([(0,), (1,)], "f int"))
    back = ids.select("id", "f", seq.unpack_side(seq.pack_side("id", "f")).alias("s"))
    assert back.filter("s.coordinate <> id or cast(s.face as int) <> f").count() == 0


def test_scalar_functions(spark):
    row = spark.createDataFrame([("ACGTR", "ACCT", "'q'", "a/1", "x/y.fastq.gz", "k:v")], "a string, b string, q string, r string, p string, kv string").select(
        seq.reverse_complement_iupac("a").alias("rc"), seq.possible_bases(F.lit("R")).alias("poss"), seq.hamming("a", "b").alias("ham"), seq.diff_string("a", "b").alias("diff"),
        seq.unquote("q").alias("unq"), seq.pair_id("r").alias("pair"), seq.pair_index("r").alias("pi"), seq.is_fastq("p").alias("fq"), seq.strip_directory("p").alias("base"),
        seq.split_key_value("kv").alias("kv"), seq.is_ambiguous(F.lit("R")).alias("amb"), seq.shared_prefix("a", "b").alias("lcp"), seq.log_binomial(F.lit(1), F.lit(2), F.lit(0.5)).alias("lb"),
        seq.disambiguate(F.lit(3), F.lit("LEFT"), F.lit(3), F.lit("RIGHT")).alias("d1"), seq.disambiguate(F.lit(3), F.lit("LEFT"), F.lit(4), F.lit("RIGHT")).alias("d2"),
        seq.disambiguate(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(4), F.lit("RIGHT")).alias("d3"), seq.text_position(F.lit(2), F.lit(5), F.lit(True), F.lit(9)).alias("tp"),
        seq.dust_score(F.lit("AAAAAA")).alias("dust"), seq.dust_score(F.lit("AC")).alias("short"), seq.log_beta_binomial(F.lit(1), F.lit(2), F.lit(1), F.lit(1)).alias("bb"),
    ).first()
    assert (row.rc, row.poss, row.ham, row["diff"], row.unq, row.pair, row.pi, row.fq) == ("YACGT", "AG", 1, "..G.", "q", "a/2", 0, True)
    assert (row.base, tuple(row.kv), row.amb, row.lcp) == ("y.fastq.gz", ("k", "v"), True, 2)
    assert abs(row.lb - np.log(0.5)) < 1e-12 and abs(row.bb - np.log(1 / 3)) < 1e-12
    assert tuple(row.d1) == (3, "LEFT") and row.d2 is None and tuple(row.d3) == (4, "LEFT") and tuple(row.tp) == (5, 4)
    assert row.dust == 3 / 4 and row.short == 0.0  # three 3-mers are looked at, the last is not


def test_interval_lookups(spark):
    spans = spark.createDataFrame([(1, 2, 3, "Ash"), (1, 3, 7, "Bret"), (1, 10, 1, "Corey")], "k int, start long, length long, value string")
    points = spark.createDataFrame([(1, x) for x in (0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 100)], "k int, at long")
    look = lambda f: {r["at"]: r["match"] for r in f(points, spans, ["k"], "at").collect()}
    A, B, C = "Ash", "Bret", "Corey"
    assert look(intervals.starting_before) == {0: None, 1: None, 2: A, 3: B, 4: B, 5: B, 8: B, 9: B, 10: C, 11: C, 100: C}
    assert look(intervals.starting_after) == {0: A, 1: A, 2: A, 3: B, 4: C, 5: C, 8: C, 9: C, 10: C, 11: None, 100: None}
    assert look(intervals.ending_after) == {0: A, 1: A, 2: A, 3: A, 4: A, 5: B, 8: B, 9: B, 10: C, 11: None, 100: None}
    assert look(intervals.ending_before) == {0: None, 1: None, 2: None, 3: None, 4: A, 5: A, 8: A, 9: B, 10: C, 11: C, 100: C}
    fixed = spark.createDataFrame([(1, 9, 10, "H"), (1, 5, 6, "H"), (1, 7, 8, "H"), (1, 1, 4, "W")], "k int, start long, end long, value string")
    whole = intervals.coalesce_equal(fixed, "k")
    assert table(whole, "start", "end", "value") == [(1, 4, "W"), (5, 10, "H")]
    asked = spark.createDataFrame([(1, 5, 10), (1, 1, 4), (1, 2, 3), (1, 0, 10), (1, 4, 6)], "k int, at long, until long")
    assert {(r["at"], r["until"]): r["value"] for r in intervals.containing(asked, whole, ["k"], "at", F.col("until")).drop("x").join(asked, ["k", "at"]).collect()} == {
        (5, 10): "H", (1, 4): "W", (2, 3): "W", (0, 10): None, (4, 6): None
    }
    assert table(intervals.fill_gaps(whole, "k"), "start", "value") == [(0, None), (1, "W"), (5, "H")]


def test_bits_and_suffixes(spark):
    bits = spark.createDataFrame([(i, i in (1, 9, 10, 19)) for i in range(20)], "i long, bit boolean")
    assert [r["rank"] for r in sorted(views.ranks_and_selects(bits).collect(), key=lambda r: r.i)] == [0] + [1] * 8 + [2] + [3] * 9 + [4]
    assert table(views.bit_runs(bits), "start", "length") == [(1, 1), (19, 1), (9, 2)]
    s1, s2 = "CATGCTTCGGCGATTCGACGCTCATCTGCGACTCT", "CGGGCGCATCGCTATTATTTCTTTCTCTTTTCACA"
    texts = contigs.double_strand(spark.createDataFrame([(0, s1), (1, s2)], "contig long, seq string"))
    t = suffixes.ranked(texts)
    rows = sorted(t.collect(), key=lambda r: r["rank"])
    assert len(rows) == 144 and [r["rank"] for r in rows if r.bwt == "$"] == [21, 45, 63, 133]
    step = {r["rank"]: r["lf"] for r in suffixes.lf(t).collect()}
    assert step[21] == 0 and all(rows[step[r["rank"]]].suffix[0] == r.bwt for r in rows)
    lcp = suffixes.with_lcp(t).select("rank", "lcp")
    values = [r.lcp for r in sorted(lcp.collect(), key=lambda r: r["rank"])]
    for r in suffixes.previous_next_smaller(lcp).collect():
        i = r["rank"]
        assert r.psv == max((j for j in range(i) if values[j] < values[i]), default=0)
        assert r.nsv == min((j for j in range(i + 1, 144) if values[j] < values[i]), default=144)
    assert suffixes.invalid_rows(t).count() == 0
    order = sorted(range(len(s1)), key=lambda i: s1[i:])
    want = [0] + [seq_shared(s1[order[k - 1] :], s1[order[k] :]) for k in range(1, len(order))]
    assert suffixes.kasai(s1, np.array(order)).tolist() == want
    left = suffixes.remove_texts(t, spark.createDataFrame([(0,), (1,)], "text long"))
    assert left.count() == 72 and left.agg(F.max("rank")).first()[0] == 71


def seq_shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_contigs(spark):
    df = spark.createDataFrame([("s", "NNacgtNAANN"), ("t", "NN"), ("u", "A")], "name string, seq string")
    assert table(contigs.split_contigs(df), "name", "part", "start", "seq") == [("s", 0, 2, "ACGT"), ("s", 1, 7, "AA"), ("u", 0, 0, "A")]
    long = spark.createDataFrame([("x", "A" * 450), ("y", "A" * 150 + "N" + "A" * 149)], "name string, seq string")
    assert table(contigs.shred(long), "read_name") == [("x:0-200",), ("x:100-300",), ("x:200-400",)]


def test_graph_measures(spark):
    merges = spark.createDataFrame([(0, 5, True), (5, 7, False), (1, 2, False), (3, 4, False), (3, 4, True)], "a long, b long, opposite boolean")
    got = {r.node: (r.component, r.reversed, r.inverted) for r in graph.oriented_components(merges).collect()}
    assert got[0] == (0, False, False) and got[5] == (0, True, False) and got[7] == (0, True, False) and got[2] == (1, False, False)
    assert got[3][2] and got[4][2]
    parts = "contig long, start long, length long, block long, orientation boolean"
    two = [(1, 0, 8, 1, True), (1, 8, 3, None, None), (1, 11, 8, 2, True), (2, 0, 8, 1, True), (2, 8, 8, 2, True)]
    df = spark.createDataFrame(two, parts)
    assert table(graph.degrees(df), "degree") == [(2,), (2,), (2,)]
    assert table(graph.indel_lengths(df), "length") == [(3,)]
    assert table(graph.component_spectrum(graph.adjacency_components(df)), "size", "count") == [(1, 2), (2, 1)]
    tandem = spark.createDataFrame([(1, 0, 4, 1, True), (1, 4, 4, 2, True), (1, 8, 4, 2, True), (1, 12, 4, 3, True)], parts)
    assert table(graph.tandem_duplications(tandem), "block") == [(2,)]
    joined = spark.createDataFrame([(1, 0, 4, 1, True, 0), (1, 4, 4, 1, True, 4), (1, 8, 2, 2, True, 0)], parts + ", block_start long")
    assert table(graph.join_collinear(joined), "start", "length", "block") == [(0, 8, 1), (8, 2, 2)]
    dup = spark.createDataFrame([(1, "ACGT"), (2, "AC"), (3, "GG")], "block long, seq string")
    assert "ARC\t1\t2\t2" in [r.value for r in writers.last_graph(df, dup).collect()]


def test_writers(spark):
    seg = spark.createDataFrame([("ref", "c", 0, 0, 8, 1, True), ("alt", "d", 1, 0, 8, 1, False), ("alt", "d", 1, 8, 2, None, None)], "event string, name string, contig long, start long, length long, block long, orientation boolean")
    lines = [r.value for r in writers.c2h_root(seg).orderBy("event", "sequence", "row").collect()]
    assert "s\t'rootSeq'\t'rootSeq'\t1" in lines and "a\t1\t0\t8" in lines and "a\t0\t8\t1\t0" in lines and "a\t8\t2" in lines
    assert "s\t'ref'\t'c'\t1" in [r.value for r in writers.c2h_reference(seg, "ref").collect()]
    for reference in ("nobody", "alt"):
        twice = seg if reference == "nobody" else seg.withColumn("event", F.lit("alt"))
        with pytest.raises(Exception, match="not once"):
            writers.c2h_reference(twice, reference).collect()
    assert writers.keep_events(seg, spark.createDataFrame([("ref",)], "event string")).count() == 1
    fa = [r.value for r in writers.alignment_fasta(spark.createDataFrame([("a", "AC")], "name string, seq string"), 3).collect()]
    assert fa == [">rootSeq\nNNN", ">a\nAC"]


def test_msa_and_contexts(spark):
    rows = spark.createDataFrame([(1, "ref", 5, 1, "AC-GT"), (1, "x", 0, 1, "ACTGA")], "msa long, name string, start long, strand int, text string")
    back = {r.name: (r.start, r.strand, r.text) for r in msa.reverse(rows).collect()}
    assert back["ref"] == (8, -1, "AC-GT") and back["x"] == (4, -1, "TCAGT")
    assert msa.mismatches(rows, "ref", "x").first().mismatches == 2
    found = table(msa.variants(rows, "ref", "x"), "pos", "ref", "alt", "kind")
    assert found == [(6, "C", "CT", "INS"), (8, "T", "A", "SUB")]
    other = spark.createDataFrame([(2, "ref", 5, 1, "ACG"), (2, "y", 0, 1, "A-G")], "msa long, name string, start long, strand int, text string")
    whole = {r.name: r.text for r in msa.rendered(msa.merge_on_reference(rows, other, "ref")).collect()}
    assert whole == {"ref": "AC-GT", "x": "ACTGA", "y": "A--G-"}
    found = contexts.minimal_unique_contexts(spark.createDataFrame([(1, "ACG"), (2, "ACT"), (3, "GA")], "node long, seq string"), 3)
    assert table(found, "node", "context") == [(1, "ACG"), (2, "ACT"), (3, "G")]
    hits = contexts.matches(found, spark.createDataFrame([("q", "ACGA"), ("r", "TT"), ("s", "GG")], "query string, seq string"))
    assert table(hits, "query", "node") == [("q", 1), ("s", 3)]
    assert table(contexts.mapped_class(hits, hits), "query", "class") == [("q", "B"), ("s", "B")]
    nodes = spark.createDataFrame([(1, "A"), (2, "C"), (3, "G")], "node long, base string")
    w = contexts.walks(nodes, spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), 3)
    assert table(w, "seq") == [("A",), ("AC",), ("ACG",), ("C",), ("CG",), ("G",)]


def test_cactus_merge(spark):
    schema = "event string, sequence string, is_bottom boolean, line long, start long, length long, block long, orientation boolean"
    one = spark.createDataFrame([("root", "r", True, 1, 0, 4, 1, None), ("ref", "c", False, 2, 0, 4, 1, True)], schema)
    two = spark.createDataFrame([("root", "r", True, 1, 0, 4, 1, None), ("ref", "c", False, 2, 0, 4, 1, True), ("alt", "d", False, 3, 0, 4, 1, False)], schema)
    segments, merges = cactus.merge([one, two], ["", "2"], "ref")
    assert {r.event for r in segments.collect()} == {"root-0", "root2-1", "ref", "alt2"}
    assert merges.count() == 12
    sizes = sorted(r["count"] for r in cactus.blocks(merges).groupBy("component").count().collect())
    assert sizes == [4, 4, 4, 4]  # both roots, the shared reference and the other genome
    fa = spark.createDataFrame([("a", "AC")], "name string, seq string")
    assert table(cactus.first_by_name([fa, fa.withColumn("seq", F.lit("GG"))]), "name", "seq") == [("a", "AC")]


def test_stores_and_evaluation(spark):
    rows = spark.createDataFrame([(i, "c") for i in range(10)], "position long, contig string")
    assert [r.position for r in store.page(rows, "position", 3, 4).collect()] == [4, 5, 6, 7]
    genes = spark.createDataFrame([("c", 0, 10, "g", 1), ("c", 20, 30, "h", 1)], "contig string, start long, end long, name string, strand int")
    columns = spark.createDataFrame(
        [(1, "c", 5, False), (1, "c", 6, False), (2, "c", 5, False), (2, "c", 25, False), (2, "c", 50, False), (3, "c", 50, False), (3, "c", 60, False)],
        "column_id long, contig string, base long, reverse boolean",
    )
    got = {(r["class"], r.gene): r["columns"] for r in evaluate.mapping_classes(columns, genes).collect()}
    assert got == {("total_columns", None): 3, ("background", None): 1, ("gene_columns", None): 2, ("ortholog", "g"): 1, ("paralog", "g"): 1, ("unannotated", "g"): 1}
    pile = evaluate.pileup(spark.createDataFrame([(1, b) for b in "AACA"], "k int, base string"), ["k"])
    top = evaluate.posterior(pile).first()
    assert top.consensus == "A" and top.posterior > 0.99
    assert evaluate.conflicted(pile, ["k"], 1).first().conflicted is False


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [(r.x, r.i) for r in global_index(df, ["x"], "i").collect() if r.x != r.i] == []
    assert global_index(df.limit(0), ["x"], "i").count() == 0


def test_graph_store(spark):
    from strandweave.sources import schemas

    ploidy = (1, None, None)
    groups = spark.createDataFrame([((1, 10, 11), 0, None, ploidy, "g"), ((2, 12, 13), None, "ACG", ploidy, None)], schemas.ALLELE_GROUP)
    adj = spark.createDataFrame([((7, 11, 12), ploidy, None), ((8, 13, 90), ploidy, None), ((9, 10, 13), ploidy, None)], schemas.SG_ADJACENCY)
    places = spark.createDataFrame([(10, "c", 1), (11, "c", 2), (12, "c", 3), (13, "c", 4)], "side long, contig string, position long")
    assert store.allele_group(groups, 2).first().allele_string == "ACG"
    assert [r.edge.id for r in store.allele_groups_at(groups, 11).collect()] == [1]
    assert sorted(r.edge.id for r in store.adjacencies_of(adj, store.allele_group(groups, 1)).collect()) == [7, 9]
    sent = spark.createDataFrame([(1, 2, ploidy), (3, 4, ploidy)], schemas.TRANSMISSION)
    assert store.transmissions_of(sent, spark.createDataFrame([(2,)], "id long")).count() == 1
    where = spark.createDataFrame([(1, "c", 1), (2, "c", 3)], "id long, contig string, position long")
    assert [r.edge.id for r in store.variant_groups_between(groups, where, "c", 1, 9, 0).collect()] == [2]
    assert [r.edge.id for r in store.spans_longer(adj, places, "c", 0, 9, inserted=False).collect()] == [9]
    assert [r.edge.id for r in store.spans_longer(adj, places, "c", 0, 9, inserted=True).collect()] == [8]
    rules = spark.createDataFrame([([("a", 1.0), ("b", 2.0)], 3)], schemas.CONSTRAINT)
    assert store.constraints_on(rules, "b").count() == 1 and store.constraints_on(rules, "z").count() == 0
    both = schemas.flat_edges(groups, "allele").unionByName(schemas.flat_edges(adj, "adjacency"))
    assert both.groupBy("kind").count().count() == 2
    with pytest.raises(Exception, match="no face"):
        schemas.checked_faces(spark.createDataFrame([(1, "UP")], schemas.SIDE)).collect()


def test_lookups(spark):
    from strandweave.operators import lookup

    found = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("q", "c", 1)], "pattern string, kmer string, mismatches int")
    assert table(lookup.greedy_matches(found), "pattern", "kmer") == [("p", "a"), ("q", "c")]
    mapped = spark.createDataFrame([("r", 0, 5, 9), ("r", 1, 6, 2)], "read string, i int, range_no long, context int")
    ranges = spark.createDataFrame([(5, 40, "LEFT"), (6, 41, "RIGHT")], "range_no long, coordinate long, face string")
    faces = lookup.faces(mapped, ranges, 3)
    assert table(faces, "i", "coordinate", "face") == [(0, 40, "LEFT")]
    assert table(lookup.map_levels([faces, faces]), "level") == [(0,), (1,)]
    n = spark.createDataFrame([("AACG",), ("TT",), ("",)], "s string").select(lookup.letter_counts(F.col("s")).alias("n"))
    got = n.select(lookup.largest_letter(F.col("n")).alias("top"), lookup.has_one_letter(F.col("n")).alias("one")).collect()
    assert [(r.top, r.one) for r in got] == [("A", False), ("T", True), (None, False)]
    a = spark.createDataFrame([(0, 9, "x")], "start long, end long, sample string")
    merged = readers.merge_populations(a, spark.createDataFrame([(0, 4, "y")], "start long, end long, sample string"))
    assert table(merged, "start", "end", "sample") == [(0, 9, "x"), (10, 14, "y")]
    assert table(lookup.population_of(spark.createDataFrame([(3,), (12,), (99,)], "read long"), merged), "read", "sample") == [(12, "y"), (3, "x"), (99, None)]


def test_unique_prefixes_reach_the_whole_string(spark):
    from strandweave.operators import lookup

    a, b = "ACGT" * 5 + "A", "ACGT" * 5 + "C"
    df = spark.createDataFrame([(1, a), (2, b), (3, "T"), (4, ""), (5, a[:16])], "id long, seq string")
    assert table(lookup.unique_prefixes(df), "id", "n") == [(1, 21), (2, 21), (3, 1)]
    assert table(lookup.unique_prefixes(df, 12), "id", "n") == [(3, 1)]
