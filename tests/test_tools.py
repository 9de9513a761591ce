"""The four tools end to end, on small files."""

from strandweave.operators.index import reverse_complement
from strandweave.plans import tools

SEQ1 = "CATGCTTCGGCGATTCGACGCTCATCTGCGACTCT"
SEQ2 = "CGGGCGCATCGCTATTATTTCTTTCTCTTTTCACA"


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_create_index(spark, tmp_path):
    (tmp_path / "a.fa").write_text(f">one\n{SEQ1}NN{SEQ2}\n")
    (tmp_path / "b.fa").write_text(f">two\n{reverse_complement(SEQ1)}\n")
    (tmp_path / "c.fa").write_text(f">three\n{SEQ1[:15]}{SEQ1[18:]}\n")
    files = [str(tmp_path / f"{x}.fa") for x in "abc"]
    args = ["createIndex", str(tmp_path / "index"), *files, "--degrees", str(tmp_path / "deg"), "--spectrum", str(tmp_path / "spec"), "--alignment", str(tmp_path / "c2h"), "--mapStats", str(tmp_path / "stats")]
    tools.main(args, spark)
    assert spark.read.parquet(str(tmp_path / "index" / "contigs")).count() == 4
    assert spark.read.parquet(str(tmp_path / "index" / "suffixes")).count() == 2 * (36 + 36 + 36 + 33)
    assert {x.split("\t")[0] for x in lines(spark, tmp_path / "stats")} == {"mapped1", "mapped2"}
    assert lines(spark, tmp_path / "deg") and lines(spark, tmp_path / "spec")
    out = tools.create_index(spark, str(tmp_path / "index2"), files)
    segments = out["segments"].collect()
    by_contig = {}
    for s in segments:
        by_contig.setdefault(s.contig, []).append(s)
    lengths = {r.contig: r.length for r in out["contigs"].collect()}
    for contig, own in by_contig.items():  # segments tile each contig
        own.sort(key=lambda s: s.start)
        assert own[0].start == 0 and sum(s.length for s in own) == lengths[contig]
        assert all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
    seqs = {r.contig: r.seq for r in out["contigs"].collect()}
    for block in {s.block for s in segments if s.block is not None}:  # segments of a block read alike
        members = [s for s in segments if s.block == block]
        assert len(members) > 1
        texts = {(lambda t: t if s.orientation else reverse_complement(t))(seqs[s.contig][s.start : s.start + s.length]) for s in members}
        assert len(texts) == 1


def test_map_reads_and_mapability(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(f">ref\n{SEQ1}\n")
    (tmp_path / "reads.fa").write_text(f">r1\n{SEQ1}\n>r2\n{reverse_complement(SEQ1)}\n>bad\nACGNN\n")
    tools.main(["mapReads", str(tmp_path / "i"), str(tmp_path / "ref.fa"), str(tmp_path / "reads.fa"), "--alignment", str(tmp_path / "al"), "--stats", str(tmp_path / "st")], spark)
    got = [x.split("\t") for x in lines(spark, tmp_path / "al")]
    assert len(got) == 70 and {len(x) for x in got} == {2, 5}
    assert all(int(x[1]) == int(x[3]) + 1 for x in got if len(x) == 5 and x[2] == "r1")
    assert sorted(x.split("\t")[0] for x in lines(spark, tmp_path / "st")) == ["mapped", "unmapped"]
    tools.main(["evaluateMapability", str(tmp_path / "i"), str(tmp_path / "ref.fa"), str(tmp_path / "out")], spark)
    assert len(lines(spark, tmp_path / "out")) == 35


def test_cactus_merge(spark, tmp_path):
    head = "s\t'root'\t'r'\t1\na\t1\t0\t4\ns\t'ref'\t'c'\t0\na\t0\t4\t1\t1\n"
    (tmp_path / "one.c2h").write_text(head)
    (tmp_path / "two.c2h").write_text(head + "s\t'alt'\t'd'\t0\na\t0\t4\t1\t0\n")
    for n, t in (("one", ">r\nNNNN\n>c\nACGT\n"), ("two", ">r\nNNNN\n>c\nACGT\n>d\nACGT\n")):
        (tmp_path / f"{n}.fa").write_text(t)
    p = lambda x: str(tmp_path / x)
    tools.main(["cactusMerge", "--c2h", p("one.c2h"), "--c2h", p("two.c2h"), "--fasta", p("one.fa"), "--fasta", p("two.fa"), "--suffix", "", "--suffix", "2", "--mergeOn", "ref", p("out.c2h"), p("out.fa")], spark)
    c2h = lines(spark, tmp_path / "out.c2h")
    assert "s\t'rootSeq'\t'rootSeq'\t1" in c2h and sum(x.startswith("s\t") for x in c2h) == 5
    assert sum(x.startswith(">") for x in lines(spark, tmp_path / "out.fa")) == 3
