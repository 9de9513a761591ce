"""The sorted index at a real size, distributed orders, and the new operators of
the tools, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import align
from strandweave.operators import contigs, intervals, lookup, suffixes, views
from strandweave.operators.index import MAX_BASES, ViewIndex, reverse_complement, sorted_suffixes
from strandweave.plans import mapping, tools
from strandweave.plans.runtime import shared_folder, tree_reduce
from strandweave.sources import readers


def letters(seed, n, of="ACGT"):
    r = random.Random(seed)
    return "".join(r.choice(of) for _ in range(n))


@pytest.mark.parametrize("texts", [["ACGT"], ["A" * 50, "A" * 50, ""], ["GATTACA", "GATTACA", "TTAC"], [letters(1, 300), letters(2, 200, "AC"), letters(1, 300)]])
def test_sorted_suffixes_equal_a_plain_sort(texts):
    text, offset, lcp = sorted_suffixes(texts)
    rows = sorted(((t, o) for t, s in enumerate(texts) for o in range(len(s))), key=lambda r: (texts[r[0]][r[1] :] + "$", r[0]))
    assert list(zip(text.tolist(), offset.tolist())) == rows
    for k in range(1, len(rows)):
        a, b = (texts[t][o:] for t, o in rows[k - 1 : k + 1])
        assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_masked_rows_keep_their_common_prefixes():
    names = [letters(3, 60, "AC"), letters(4, 60, "AC"), letters(5, 60, "AC")]
    whole, some = ViewIndex(names, [0, 1, 2]), ViewIndex(names, [0, 1, 2], [0, 2])
    assert some.rows == [r for r in whole.rows if r[0] // 2 != 1] and len(some.lcp) == len(some.rows) + 1
    for k in range(1, len(some.rows)):
        a, b = (some.texts[t][o:] for t, o in some.rows[k - 1 : k + 1])
        assert some.lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    assert ViewIndex(names, [0, 1, 2], [9]).rows == [] and ViewIndex([]).rows == []


def test_an_index_of_a_hundred_thousand_bases():
    genome = letters(7, 100_000) + "A" * 2000 + letters(8, 1000)
    index = ViewIndex([genome])
    r = random.Random(9)
    for _ in range(50):
        at = r.randrange(len(genome) - 40)
        piece = genome[at : at + r.randrange(5, 40)]
        both = (genome, reverse_complement(genome))
        want = {(t, i) for t, s in enumerate(both) for i in range(len(s)) if s.startswith(piece, i)}
        assert index.positions(*index.interval(piece)) == want
    assert MAX_BASES >= 100_000
    with pytest.raises(ValueError):
        ViewIndex(["A" * (MAX_BASES + 1)])


@pytest.mark.parametrize("piece", [4096, 50])
def test_relational_statistics_equal_the_index(spark, monkeypatch, piece):
    monkeypatch.setattr(mapping, "PIECE", piece)
    genome = letters(11, 400, "AC") + letters(12, 400)
    reads = [(f"r{i}", letters(20 + i, 30, "AC")) for i in range(5)] + [("hit", genome[100:140]), ("short", "AC"), ("none", "")]
    df = spark.createDataFrame(reads, "read string, seq string")
    ref = spark.createDataFrame([(genome,), (reverse_complement(genome),)], "seq string")
    got = {(x.read, x.i): (x.longest, x.unique) for x in mapping.relational_statistics(df, ref, 4).collect()}
    index = ViewIndex([genome])
    from strandweave.operators.matching import matching_statistics

    want = {}
    for name, q in reads:
        for i, (n, unique, _) in enumerate(matching_statistics(q, index)):
            if n >= 4:
                want[name, i] = (n, None if unique is None else max(unique, 4))
    assert got == want


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_without_keys(spark, forward):
    r = random.Random(3)
    left, right = [(i, r.randrange(1000)) for i in range(300)], sorted(r.sample(range(1000), 40))
    a = spark.createDataFrame(left, "id long, x long").repartition(4)
    b = spark.createDataFrame([(x, f"v{x}") for x in right], "start long, value string")
    got = {x.id: x.match for x in intervals.as_of(a, b, [], "x", "start", "value", "forward" if forward else "backward").collect()}
    for i, x in left:
        near = [y for y in right if (y >= x if forward else y <= x)]
        assert got[i] == (f"v{(min if forward else max)(near)}" if near else None)


def test_nearest_smaller_over_many_blocks(spark):
    r = random.Random(6)
    minima = [r.randrange(30) for _ in range(500)]
    m = spark.createDataFrame(list(enumerate(minima)), "b long, m long")
    asked = [(b, v) for b in range(0, 500, 7) for v in (1, 3, 10)]
    df = spark.createDataFrame(asked, "b long, v long")
    for before in (True, False):
        got = {(x.b, x.v): x.b2 for x in suffixes.nearest_block(df, m, before, 500, 4).collect()}
        for b, v in asked:
            near = [i for i in (range(b) if before else range(b + 1, 500)) if minima[i] < v]
            assert got.get((b, v)) == ((max if before else min)(near) if near else None)


def test_lines_are_numbered_through_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 7)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
        assert len({x.part for x in rows}) > 3
        assert all(x.value == f"{x.file.rsplit('/', 1)[1]}{x.line}" for x in rows) and len(rows) == 3007
        marks = readers.carried(readers.numbered_lines(spark, str(tmp_path)), F.when(F.col("line") % 1000 == 5, F.col("line")), "last").collect()
        assert all(x["last"] == (None if x.line < 5 else (x.line - 5) // 1000 * 1000 + 5) for x in marks)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_contigs_are_numbered_in_file_order(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">z\nACGTNNAC\n>a\nGGGG\n>m\nTTTT\n")
    rows = tools.contigs_of(spark, [str(path)]).orderBy("contig").collect()
    assert [(x.contig, x.name, x.start, x.seq) for x in rows] == [(0, "z", 0, "ACGT"), (1, "z", 6, "AC"), (2, "a", 0, "GGGG"), (3, "m", 0, "TTTT")]


def test_tools_use_a_saved_index(spark, tmp_path, capsys):
    seq = letters(31, 80)
    fa, reads, folder = tmp_path / "r.fa", tmp_path / "q.fa", str(tmp_path / "index")
    fa.write_text(f">one\n{seq}\n")
    reads.write_text(f">q\n{seq[10:50]}\n")
    first = tools.map_reads(spark, str(fa), [str(reads)], stats=str(tmp_path / "stats"), indexDirectory=folder).collect()
    assert lookup.has_index(spark, folder)
    again = tools.map_reads(spark, "/nowhere.fa", [str(reads)], indexDirectory=folder).collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr) and sum(x.ref == "one" for x in first) > 20
    assert {x.value.split("\t")[0] for x in spark.read.text(str(tmp_path / "stats")).collect()} >= {"mapped", "unmapped"}
    tools.main(["mapToIndex", folder, "--pattern", seq[10:30], "--repeat", "2", "--minContext", "5"], spark)
    said = capsys.readouterr().out.splitlines()
    assert said[0].startswith("map() took") and said[1] == "Mappings to level 0:" and said[2].split() == ["Base", "Left", "Both", "Right"]
    assert len(said) == 3 + 20 and any(line.split("\t")[2].strip() == "20L" for line in said[3:])
    with pytest.raises(ValueError):
        tools.map_to_index(spark, folder)
    fa.write_text(f">one\n{seq}\n>two\n{seq}\n")
    with pytest.raises(ValueError):
        tools.map_reads(spark, str(fa), [str(reads)])


def test_alignments_together_equal_one_by_one():
    r = random.Random(2)
    pairs = [(letters(r.random(), r.randrange(25), "ACG"), letters(r.random(), r.randrange(25), "ACG")) for _ in range(300)]
    pairs += [(a, a[:3] + a[6:]) for a, _ in pairs[:50]] + [("", ""), ("A", ""), ("", "AC"), (letters(1, 70), letters(2, 60))]
    firsts, seconds = map(list, zip(*pairs))
    assert align.global_alignments(firsts, seconds) == [align.global_alignment(a, b) for a, b in pairs]


def test_tree_reduce():
    assert tree_reduce(list("abcdefg"), lambda a, b: f"({a}{b})") == "(((ab)(cd))((ef)g))"
    with pytest.raises(ValueError):
        tree_reduce([], lambda a, b: a)


def test_select_past_the_end_and_neighbours_without_any(spark):
    bits = spark.createDataFrame([(i, i in (1, 9, 10, 19)) for i in range(20)], "i long, bit boolean")
    wanted = spark.createDataFrame([(k,) for k in range(6)], "k long")
    assert {x.k: x.i for x in views.select(bits, wanted).collect()} == {0: 1, 1: 9, 2: 10, 3: 19, 4: None, 5: None}
    at = spark.createDataFrame([(0,), (1,), (15,), (19,), (25,)], "at long")
    assert {x["at"]: x.i for x in views.value_before(bits, at).collect()} == {0: None, 1: 1, 15: 10, 19: 19, 25: 19}
    assert {x["at"]: x.i for x in views.value_after(bits, at).collect()} == {0: 1, 1: 1, 15: 19, 19: 19, 25: None}


def test_seeded_pieces_repeat(spark):
    df = spark.createDataFrame([(i, letters(i, 30)) for i in range(40)] + [(99, "AC")], "id long, seq string")
    one, two, other = (contigs.random_substrings(df, "id", 8, seed).collect() for seed in (1, 1, 2))
    assert sorted(one) == sorted(two) != sorted(other) and len(one) == 40


def test_a_cluster_without_a_shared_folder_raises(spark):
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError):
        shared_folder(Session)
