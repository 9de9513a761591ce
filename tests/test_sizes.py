"""What made queries fail on larger tables, on tables that are small."""

import random
from collections import Counter

from strandweave.operators import evaluate, index as suffixes, intervals, views
from strandweave.operators.index import ViewIndex, reverse_complement
from strandweave.operators.zipmap import Zip, apply_credit, zip_map
from strandweave.plans import mapping
from strandweave.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_forward_as_of_frames_end_at_their_row(spark):
    r = random.Random(4)
    on, places = sorted(r.sample(range(4000), 700)), [(r.randrange(-9, 4010),) for _ in range(300)]
    bits = spark.createDataFrame([(i, i in set(on)) for i in range(4000)], "i long, bit boolean")
    after = views.value_after(bits, spark.createDataFrame(places, "at long"))
    assert "unboundedfollowing" not in plan(after)  # such a frame is summed up anew for each row
    assert sorted((x.at, x.i) for x in after.collect()) == sorted((at, next((i for i in on if i >= at), None)) for (at,) in places)
    keyed = spark.createDataFrame([(k, i, f"{k}-{i}") for k in "ab" for i in on[:40]], "k string, start long, value string")
    asked = spark.createDataFrame([(k, at) for k in "abc" for (at,) in places], "k string, at long")
    found = intervals.starting_after(asked, keyed, ["k"], "at")
    assert "unboundedfollowing" not in plan(found)
    first = lambda k, at: next((f"{k}-{i}" for i in on[:40] if i >= at and k != "c"), None)
    assert {tuple(x) for x in found.select("k", "at", "match").collect()} == {(k, at, first(k, at)) for k in "abc" for (at,) in places}


def test_places_of_a_consensus_are_not_sent_to_the_driver(spark):
    root = spark.createDataFrame([(1, i, "A") for i in range(3)], "k long, i int, base string")
    rows = spark.createDataFrame([(1, n, 0, "C") for n in range(9)] + [(1, n, 1, "A") for n in range(9)], "k long, read long, i int, base string")
    calls = evaluate.conflict_consensus(rows, root, ["k"], 3)
    assert "broadcast" not in plan(calls)
    assert sorted(tuple(x) for x in calls.collect()) == [(1, 0, "A", "C"), (1, 1, "A", "A"), (1, 2, "A", "A")]


def test_references_meet_pairs_in_pieces(spark, monkeypatch):
    r = random.Random(6)
    known = {"a": "".join(r.choice("ACGTacgt") for _ in range(1000)), "b": "".join(r.choice("ACGT") for _ in range(readers.PIECE)), "c": "", "d": None}
    rows = [(f"r{n}", ref, n, at, base, False) for ref in "abcde" for n, at in enumerate((-1, 0, 1, 2, 255, 256, 257, 512, 513, 1000, 1001)) for base in ("A", "c", "")]
    pairs = spark.createDataFrame(rows, "read string, ref string, i int, ref_off long, base string, backwards boolean")
    reference = spark.createDataFrame(list(known.items()), "ref string, seq string")
    letter = lambda s, at: s[at - 1].upper() if 0 < at <= len(s) else ""
    expected = sorted((read, ref, at) for read, ref, _, at, base, _ in rows if known.get(ref) is not None and letter(known[ref], at) == base.upper())
    found = readers.matching_pairs(pairs, reference)
    assert found.columns == ["ref", "read", "i", "ref_off", "backwards"]
    assert sorted((x.read, x.ref, x.ref_off) for x in found.collect()) == expected
    monkeypatch.setattr(readers, "SENT", 100)  # a reference of more bases than may be sent anywhere
    found = readers.matching_pairs(pairs, reference)
    assert "broadcast" not in plan(found)
    assert sorted((x.read, x.ref, x.ref_off) for x in found.collect()) == expected


CONTIGS = ["CATGCTTCGGCGATTCGACGCTCATCTGCGACTCT", "CGGGCGCATCGCTATTATTTCTTTCTCTTTTCACA"]


def reads_in_one_task(spark):
    """Seven reads, 30 copies of each, as one file is."""
    r, made = random.Random(7), []
    for n in range(7):
        q = list(CONTIGS[n % 2])
        q[r.randrange(35)] = r.choice("ACGT")
        made.append("".join(q))
    return made, spark.createDataFrame([(f"{n}-{k}", q) for k in range(30) for n, q in enumerate(made)], "read string, seq string").coalesce(1)


def dealt_out(df):
    return df.rdd.getNumPartitions()


def test_sides_of_copies_are_found_once_by_many_tasks(spark):
    made, reads = reads_in_one_task(spark)
    reference = [(n, c, 0) for n, c in enumerate(CONTIGS)]
    found = mapping.map_sides(reads, reference, 4)
    assert dealt_out(found) >= spark.sparkContext.defaultParallelism
    rows = sorted(tuple(x) for x in found.collect())
    alone = {tuple(x) for n, q in enumerate(made) for x in mapping.map_sides(spark.createDataFrame([(str(n), q)], "read string, seq string"), reference, 4).collect()}
    assert rows == sorted((f"{x[0]}-{k}", *x[1:]) for x in alone for k in range(30)) and len(rows) == 7 * 30 * 35


def test_zip_maps_copies_once_by_many_tasks(spark):
    made, reads = reads_in_one_task(spark)
    reference, index = [(n, c, 0) for n, c in enumerate(CONTIGS)], ViewIndex(CONTIGS)
    found = mapping.map_reads(reads, reference, "zip", min_context=4)
    assert dealt_out(found) >= spark.sparkContext.defaultParallelism
    positions = [zip_map(q, index, Zip(min_context=4))[0] for q in made]
    expected = sorted((f"{n}-{k}", i, *(p or (None, None))) for k in range(30) for n, found in enumerate(positions) for i, p in enumerate(found))
    assert sorted((x.read, x.i, x.text, x.offset) for x in found.collect()) == expected
    calls = []
    get = mapping.once(lambda q: calls.append(q) or len(q))
    assert [get(q) for q in ("AC", "AC", "A", "A", "AC")] == [2, 2, 1, 1, 2] and calls == ["AC", "A", "AC"]


def test_counters_of_copies(spark):
    made, reads = reads_in_one_task(spark)
    reference, index = [(n, c, 0) for n, c in enumerate(CONTIGS)], ViewIndex(CONTIGS)
    expected = Counter()
    for q in made:
        expected.update({stat: 30 * n for stat, n in zip_map(q, index, Zip(min_context=4))[1].items()})
    found = mapping.map_counters(reads, reference, "zip", min_context=4)
    assert {x.stat: x.value for x in found.collect()} == dict(expected)
    assert list(mapping.copies(["A", "A", "C", "A"])) == [("A", 2), ("C", 1), ("A", 1)]


def test_credit_looks_positions_up_in_one_table():
    index = ViewIndex(CONTIGS)
    assert index.canon_of is index.canon_of and index.canon_of == dict(zip(index.rows, index.canon))
    q = CONTIGS[0][:17] + ("A" if CONTIGS[0][17] != "A" else "C") + CONTIGS[0][18:]
    found = [(0, i) if i < 12 or i > 22 else None for i in range(35)]
    index.by_canon  # noqa: B018
    del index.__dict__["canon_of"]
    assert apply_credit(q, found, index, 1) == [None if i == 17 else (0, i) for i in range(35)]
    assert "canon_of" in index.__dict__


def test_matchings_for_any_size_of_reference(spark, monkeypatch):
    r = random.Random(9)
    made = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    reference = [(n, s, 0) for n, s in enumerate([made(9000), made(300), made(300).lower(), "ACGT" * 20, ""])]
    at = [r.randrange(8900) for _ in range(40)] + [4080, 4095, 4096, 8970]
    reads = [(f"r{n}", reference[0][1][a : a + 14] + made(2) + reference[1][1][a % 280 : a % 280 + 9]) for n, a in enumerate(at)]
    reads += [("r0", made(20)), ("low", reads[3][1].lower()), ("n", "ACGNNACG"), ("short", "A"), ("e", ""), ("two", "ACGTACGT"), ("same", reads[5][1]), ("same", reads[5][1])]
    asked = spark.createDataFrame(reads, "read string, seq string")
    expected = sorted(tuple(x) for x in mapping.matchings(asked, reference, shortest=False).collect())
    texts = [(2 * n + k, s) for n, t, _ in reference for k, s in enumerate((t, reverse_complement(t.upper())))]
    monkeypatch.setattr(mapping, "MAX_BASES", 100)
    found = mapping.relational_matchings(asked, spark.createDataFrame(texts, "text int, seq string"))
    assert sorted(tuple(x) for x in found.collect()) == expected and expected


def test_suffixes_that_are_no_neighbours_go(spark):
    r = random.Random(10)
    rows = [("".join(r.choice("ACGT") for _ in range(6)), n % 40 == 0) for n in range(3000)]
    kept = mapping.beside_reads(spark.createDataFrame(rows, "s string, asks boolean")).collect()
    order = sorted(rows)
    near = set()
    for k, (_, asks) in enumerate(order):
        if asks:
            near |= {j for side in (range(k - 1, -1, -1), range(k + 1, len(order))) for j in [j for j in side if not order[j][1]][:2]}
    wanted = Counter([x for x in order if x[1]] + [order[j] for j in near])
    assert not wanted - Counter((x.s, x.asks) for x in kept) and len(kept) < 600


def zip_case():
    r = random.Random(9)
    genome = "".join(r.choice("ACGT") for _ in range(400))
    texts = [genome[i : i + 80] for i in range(0, 400, 40)] + ["ACAC" * 15]
    reads = [t[:k] + "ACGT"[n % 4] + t[k + 1 :] for n, t in enumerate(texts) for k in (3, 30, 55)]
    return texts, reads + [reverse_complement(q) for q in reads[::4]]


def test_zip_looks_few_rows_up_for_a_base():
    texts, reads = zip_case()
    index, asked = ViewIndex(texts), []
    index.interval("A")

    class Counted(list):
        def __getitem__(self, at):
            asked.append(at)
            return super().__getitem__(at)

    index.texts = Counted(index.texts)
    bases = sum(len(zip_map(q[:32], index, Zip(min_context=8))[0]) for q in reads)
    assert len(asked) < 40 * bases


def test_zip_is_the_same_with_and_without_heads(monkeypatch):
    texts, reads = zip_case()
    merged = {(0, o + 40): (2, o) for o in range(40)} | {(1, 39 - o): (3, 79 - o) for o in range(40)}
    for canon in (None, merged):
        found = {}
        for heads, letters in ((10**6, 32), (10**6, 5), (0, 32)):
            monkeypatch.setattr(suffixes, "HEADS", heads)
            monkeypatch.setattr(suffixes, "HEAD", letters)
            index = ViewIndex(texts, canon=canon)
            assert (index.heads is None) == (heads == 0)
            assert all(index.texts[t][o:].startswith(s) == (lo <= k < hi) for s in ("", "A", "CA", "ACACAC", texts[0][3:50]) for lo, hi in [index.interval(s)] for k, (t, o) in enumerate(index.rows))
            found[heads, letters] = [zip_map(q, index, p) for q in reads for p in (Zip(min_context=8), Zip(max_range_count=3, credit=True, credit_mismatches=1))]
        assert found[10**6, 32] == found[10**6, 5] == found[0, 32]
        assert any(p is not None for q in found[0, 32] for p in q[0])


def test_copies_are_counted_before_they_are_dealt(spark):
    made, reads = reads_in_one_task(spark)
    found = mapping.map_counters(reads, [(n, c, 0) for n, c in enumerate(CONTIGS)], "zip", min_context=4)
    steps = plan(found)
    python = steps.index("mapinarrow")
    assert "hashaggregate(keys=[seq" in steps[python:] and "sort" not in steps[python:]
    assert f", {mapping.tasks(spark)}), repartition_by_num" in steps[python:]
