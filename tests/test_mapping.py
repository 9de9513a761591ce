"""Golden expectations of the index, the mapping schemes, and credit."""

import random

import pytest

from strandweave.functions import align
from strandweave.operators.index import ViewIndex, reverse_complement
from strandweave.operators.matching import Natural, flipped_reverse, matching_statistics, max_matchings, min_matchings, minimum_contexts, natural_map
from strandweave.operators.zipmap import Zip, activities, apply_credit, zip_map
from strandweave.plans import mapping

SEQ1 = "CATGCTTCGGCGATTCGACGCTCATCTGCGACTCT"
SEQ2 = "CGGGCGCATCGCTATTATTTCTTTCTCTTTTCACA"


@pytest.fixture(scope="module")
def index():
    return ViewIndex([SEQ1, SEQ2])


def mapped(query, index, **p):
    return [x for x in natural_map(query, index, Natural(**p)).positions if x is not None]


def test_counts_and_places(index):
    assert [index.count(x) for x in ("GATTACA", "TCTTTT", "AAAAGA", "TTCG", SEQ2)] == [0, 1, 1, 2, 1]
    assert index.positions(*index.interval("TCTTTT")) == {(2, 25)}
    assert index.positions(*index.interval(SEQ1)) == {(0, 0)} and index.positions(*index.interval(reverse_complement(SEQ1))) == {(1, 0)}


def test_natural_goldens(index):
    assert mapped(SEQ1, index) == [(0, i) for i in range(4, 31)]
    assert mapped(reverse_complement(SEQ1), index) == [(1, i) for i in range(4, 31)]
    both = natural_map(SEQ1 + reverse_complement(SEQ1), index).positions
    assert sum(x is not None for x in both) == 58 and all(both[i] is None for i in range(33, 37))
    assert all(x == ((0, i) if i < 33 else (1, i - 35)) for i, x in enumerate(both) if x is not None)
    bound = dict(min_edit_bound=6, max_edit_distance=1)
    assert len(mapped("CATGCTTCGGCGATTCGAGGCTCATCTGCGACTCT", index, **bound)) == 26
    inserted = mapped("CATGCTTCGGCGTATTCGACGCTCATCTGCGACTCT", index, **bound)
    assert len(inserted) == 27 and {t for t, _ in inserted} == {0}
    assert len(mapped("CATGCTTCGGCGATCGACGCTCATCTGCGACTCT", index, **bound)) == 25
    three = "CATGCTTCGGCGAGTTCGAGGCTCATCTGGACTCT"
    assert len(mapped(three, index, min_edit_bound=6)) == 0
    assert len(mapped(three, index, min_edit_bound=6, max_edit_distance=4)) == 25
    masked = ViewIndex([SEQ1, SEQ2, SEQ1, SEQ2], [0, 0, 1, 1], [0])
    assert len(mapped(SEQ1, masked)) == 27


def test_matchings_are_what_their_definition_says():
    r = random.Random(1)
    for _ in range(40):
        ref = ["".join(r.choice("ACGT") for _ in range(r.choice([12, 30]))) for _ in range(2)]
        ix, q = ViewIndex(ref), "".join(r.choice("ACGT") for _ in range(14))
        n = lambda s: sum(t[i:].startswith(s) for t in ix.texts for i in range(len(t)))
        stats = matching_statistics(q, ix)
        for i, (longest, unique, _) in enumerate(stats):
            lengths = [k for k in range(1, len(q) - i + 1) if n(q[i : i + k])]
            assert longest == max(lengths, default=0)
            assert unique == min((k for k in lengths if n(q[i : i + k]) == 1), default=None)
        spans = [(a, b) for a in range(len(q)) for b in range(a + 1, len(q) + 1) if n(q[a:b]) == 1]
        top = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
        low = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
        assert [(m.start, m.end) for m in max_matchings(stats)] == top
        assert [(m.start, m.end) for m in min_matchings(stats)] == low


def test_mapping_is_symmetric(index):
    r = random.Random(2)
    for _ in range(25):
        q = list(SEQ1 + SEQ2)
        for _ in range(r.randrange(5)):
            q[r.randrange(len(q))] = r.choice("ACGT")
        q = "".join(q)
        p = Natural(min_edit_bound=2, max_edit_distance=1)
        assert natural_map(reverse_complement(q), index, p).positions == flipped_reverse(natural_map(q, index, p).positions, index)


def merged_pairs():
    full = ViewIndex([SEQ1, SEQ1], [0, 1])
    canon = {}
    for k in range(0, len(full.rows), 2):
        a, b = full.rows[k], full.rows[k + 1]
        canon[a] = canon[b] = min(a, b)
    return canon


def test_zip_goldens():
    ranges = ViewIndex([SEQ1, SEQ1], [0, 1], canon=merged_pairs())
    assert zip_map(SEQ1, ranges)[0] == [(0, i) for i in range(35)]
    assert zip_map(reverse_complement(SEQ1), ranges)[0] == [(1, i) for i in range(35)]
    assert zip_map(SEQ1, ViewIndex([SEQ1, SEQ1], [0, 1], [0]))[0] == [(0, i) for i in range(35)]
    second = ViewIndex([SEQ1, SEQ1], [0, 1], [1])
    assert zip_map(SEQ1, second)[0] == [(2, i) for i in range(35)] == zip_map(SEQ1, second, Zip(mismatch_tolerance=1))[0]
    off = zip_map("CATGCTCCGGCGATTCGACGCTCATCTGCGAATCT", second, Zip(mismatch_tolerance=1, min_unique_strings=2))[0]
    assert off == [None if i in (6, 31) else (2, i) for i in range(35)]


def test_credit_goldens():
    view = ViewIndex([SEQ1, SEQ1], [0, 1], [0])
    ends = [(0, 0), *[None] * 33, (0, 34)]
    assert apply_credit(SEQ1, ends, view, 0) == [(0, i) for i in range(35)]
    q = list(SEQ1)
    q[5], q[28] = "A", "A" if SEQ1[28] != "A" else "C"
    assert apply_credit("".join(q), ends, view, 1) == [None if i in (5, 28) else (0, i) for i in range(35)]


def test_natural_credit_fills_between_anchors(index):
    q = list(SEQ1)
    q[17] = "A" if SEQ1[17] != "A" else "C"
    p = Natural(min_edit_bound=1, max_edit_distance=1)
    without = natural_map("".join(q), index, p)
    filled = natural_map("".join(q), index, Natural(min_edit_bound=1, max_edit_distance=1, credit=True, mismatches=1))
    assert all(a == b for a, b in zip(filled.positions, without.positions) if b is not None)
    assert filled.stats["mapped"] == without.stats["mapped"] + filled.stats["credit"]


def test_minimum_contexts_and_edges(index):
    found = minimum_contexts(SEQ1, index)
    assert len(found) == 35 and min(found) >= 1 and found[15] == min(m.length for m in min_matchings(matching_statistics(SEQ1, index)) if m.start <= 15 < m.end)
    with pytest.raises(ValueError):
        minimum_contexts("AAAA", ViewIndex(["AAAA", "AAAA"]))
    assert natural_map("", index).positions == [] and natural_map("NNNN", index).stats["mapped"] == 0
    assert activities([(0, 3), (2, 5), (5, 7), (6, 9)]) == 2 and activities([(0, 1), (1, 2), (2, 3)], 2) == 2


def test_alignment_kernels():
    assert align.edits("kitten", "sitting", 9) == 3 and align.edits("", "abc", 9) == 3 and align.edits("", "abc", 9, left_free=True) == 0
    assert align.edits("abc", "xxabc", 9, left_free=True) == 0 and align.edits("abc", "abcxx", 9, right_free=True) == 0
    assert align.edits("a", "abcdef", 3) == 3
    score, cigar = align.global_alignment("ACGTACGT", "ACGTCGT")
    assert cigar in ("4M1I3M", "3M1I4M") and score == 0
    a, b = align.padded("ACGTACGT", "ACGTCGT", "4M1I3M")
    assert a == "ACGTACGT" and b == "ACGT-CGT"
    assert align.local_alignment("TTTACGTACGTTT", "GGACGTACGGG")[0] == 7
    assert align.compact(align.expand("3M1D2I")) == "3M1D2I"


def test_tables_of_mappings(spark):
    contigs = spark.createDataFrame([(0, SEQ1, 0), (1, SEQ2, 0)], "contig long, seq string, genome long")
    reads = spark.createDataFrame([("a", SEQ1), ("b", reverse_complement(SEQ1)), ("n", "ACGN"), ("e", "")], "read string, seq string")
    rows = mapping.map_reads(reads, mapping.collect_reference(contigs)).collect()
    assert len(rows) == 70 and sum(r.ref is not None for r in rows) == 54
    assert {(r.i, r.ref_off) for r in rows if r.read == "b" and r.ref} == {(i, 35 - i) for i in range(4, 31)}
    shortest = mapping.evaluate_mapability(contigs, mapping.collect_reference(contigs)).collect()
    assert len(shortest) == 70 and all(r.length >= 1 for r in shortest)


def test_greedy_merge(spark):
    rows = [(0, SEQ1, 0), (1, SEQ1[:20] + "T" + SEQ1[20:], 1), (2, reverse_complement(SEQ1), 2)]
    merges, coverage = mapping.merge_greedy(spark, spark.createDataFrame(rows, "contig long, seq string, genome long"))
    assert [r.aligned > 20 for r in coverage.collect()] == [True, True]
    bases = "".join(r[1] for r in rows)
    for m in merges.collect():
        same = reverse_complement(bases[m.b]) if m.opposite else bases[m.b]
        assert bases[m.a] == same
    blocks = mapping.canonical(merges).collect()
    assert all(b.canon <= b.base for b in blocks)


def test_streamed_reads_map_as_a_table(spark, tmp_path):
    from strandweave.streaming import reads as streaming

    contigs = spark.createDataFrame([(0, SEQ1, 0), (1, SEQ2, 0)], "contig long, seq string, genome long")
    reference = mapping.collect_reference(contigs)
    reads = spark.createDataFrame([("a", SEQ1), ("b", SEQ2[3:30]), ("n", "ACNN")], "read string, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    stream = streaming.map_stream(streaming.read_stream(spark, str(tmp_path / "in")), reference)
    streaming.write_mappings(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in mapping.map_reads(reads, reference).collect()} and got
