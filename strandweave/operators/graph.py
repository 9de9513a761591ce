"""Connected and oriented components, and measures of a merged graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.plans.runtime import discard, materialize, running_sum


def _star_round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(small).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in (a, b); a component is its least node.

    Alternating star contractions: rounds grow with the logarithm of the nodes,
    minima are aggregated before the shuffle, and each round is materialised.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        before, edges = edges, materialize(_star_round(edges))
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges.withColumnsRenamed({"a": "node", "b": "component"}), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def oriented_components(merges: DataFrame) -> DataFrame:
    """(node, component, reversed, inverted) under merges (a, b, opposite).

    A merge says two bases are one, on equal or opposite strands. Every node is
    doubled into its two strands, and a merge joins strands pairwise; components
    of the doubled graph then carry orientation for free. Where both strands of a
    node fall together the block is merged with its own inverse (``inverted``).
    """
    strand_of = lambda c, s: (F.col(c) * 2 + s).cast("long")
    flip = F.col("opposite").cast("long")
    doubled = merges.select(strand_of("a", F.lit(0)).alias("a"), strand_of("b", flip).alias("b")).unionByName(
        merges.select(strand_of("a", F.lit(1)).alias("a"), strand_of("b", 1 - flip).alias("b"))
    )
    labels = connected_components(doubled)
    labels = labels.select(F.floor(F.col("node") / 2).alias("n"), (F.col("node") % 2).alias("s"), "component")
    pairs = labels.groupBy("n").agg(
        F.max(F.when(F.col("s") == 0, F.col("component"))).alias("fwd"), F.max(F.when(F.col("s") == 1, F.col("component"))).alias("rev")
    )
    root = F.floor(F.least("fwd", "rev") / 2)
    return pairs.select(
        F.col("n").alias("node"), root.alias("component"),
        (F.col("fwd") != F.col("rev")) & (F.col("fwd") % 2 == 1) & (F.floor(F.col("fwd") / 2) == root)
        | (F.col("fwd") != F.col("rev")) & (F.col("rev") % 2 == 0) & (F.floor(F.col("rev") / 2) == root).alias("reversed"),
        (F.col("fwd") == F.col("rev")).alias("inverted"),
    ).toDF("node", "component", "reversed", "inverted")


def coverage(positions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Aligned share of each genome: distinct aligned bases over all bases."""
    aligned = positions.select("genome", "contig", "base").distinct().groupBy("genome").agg(F.count("*").alias("aligned"))
    total = lengths.groupBy("genome").agg(F.sum("length").alias("bases"))
    return total.join(aligned, "genome", "left").select(
        "genome", "bases", F.coalesce("aligned", F.lit(0)).alias("aligned"), (F.coalesce("aligned", F.lit(0)) / F.col("bases")).alias("coverage")
    )


def degrees(segments: DataFrame) -> DataFrame:
    """Degree of each block (its segments), and of bare segments (neighbours)."""
    w = Window.partitionBy("contig").orderBy("start")
    around = segments.withColumn("near", F.lag("start").over(w).isNotNull().cast("int") + F.lead("start").over(w).isNotNull().cast("int"))
    blocks = around.filter("block is not null").groupBy("block").agg(F.count("*").alias("degree")).select("degree")
    return blocks.unionByName(around.filter("block is null").select(F.col("near").cast("long").alias("degree")))


def ends(segments: DataFrame) -> DataFrame:
    """(contig, start, left_end, right_end): block ends as 2 x block + side, as
    they follow each other along a contig."""
    left = F.col("block") * 2 + F.when(F.col("orientation"), 0).otherwise(1)
    return segments.filter("block is not null").select(
        "contig", "start", "length", "block", left.alias("left_end"), left.bitwiseXOR(F.lit(1)).alias("right_end")
    )


def adjacencies(segments: DataFrame) -> DataFrame:
    """(a, b, between): ends that face each other along a contig, and the bases
    between their blocks."""
    w = Window.partitionBy("contig").orderBy("start")
    near = ends(segments).withColumns({"b": F.lead("left_end").over(w), "s": F.lead("start").over(w)})
    return near.filter("b is not null").select(F.col("right_end").alias("a"), "b", (F.col("s") - F.col("start") - F.col("length")).alias("between"))


def adjacency_components(segments: DataFrame) -> DataFrame:
    """(node, component) of block ends joined by adjacencies; lone ends are
    components of their own."""
    found = connected_components(adjacencies(segments).select("a", "b"))
    e = ends(segments)
    every = e.select(F.col("left_end").alias("node")).unionByName(e.select(F.col("right_end").alias("node"))).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_spectrum(components: DataFrame) -> DataFrame:
    """(size, count) of components."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("count"))


def components_of_size(components: DataFrame, predicate) -> DataFrame:
    """Components whose size fulfils ``predicate(size)``, with their nodes."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).filter(predicate(F.col("size")))
    return components.join(sizes, "component")


def indel_lengths(segments: DataFrame) -> DataFrame:
    """(component, length): two ends of blocks of degree two joined by exactly
    two paths; the length is how much those paths differ (0: a substitution)."""
    parts = components_of_size(adjacency_components(segments), lambda n: n == 2)
    degree = ends(segments).groupBy("block").agg(F.count("*").alias("degree"))
    parts = parts.withColumn("block", F.floor(F.col("node") / 2)).join(degree, "block")
    good = parts.groupBy("component").agg(F.min("degree").alias("lo"), F.max("degree").alias("hi")).filter("lo = 2 and hi = 2")
    paths = adjacencies(segments).join(parts.select(F.col("node").alias("a"), "component"), "a").join(good, "component")
    paths = paths.filter("a <> b")
    both = paths.groupBy("component").agg(F.count("*").alias("n"), F.max("between").alias("x"), F.min("between").alias("y")).filter("n = 2")
    return both.select("component", (F.col("x") - F.col("y")).alias("length"))


def tandem_duplications(segments: DataFrame) -> DataFrame:
    """(component, block): components of four ends that hold both ends of a block
    which an adjacency connects."""
    parts = components_of_size(adjacency_components(segments), lambda n: n == 4).select("component", "node")
    joined = adjacencies(segments).filter(F.floor(F.col("a") / 2) == F.floor(F.col("b") / 2)).filter("a <> b")
    return joined.join(parts.withColumnRenamed("node", "a"), "a").select("component", F.floor(F.col("a") / 2).alias("block")).distinct()


def rearrangements(segments: DataFrame, least: int = 3) -> DataFrame:
    """(component, size, ends): components too large to be an indel, as text."""
    parts = components_of_size(adjacency_components(segments), lambda n: n >= least)
    side = F.when(F.col("node") % 2 == 0, "L").otherwise("R")
    name = F.concat(F.floor(F.col("node") / 2).cast("string"), side)
    return parts.groupBy("component", "size").agg(F.array_join(F.array_sort(F.collect_list(name)), " ").alias("ends"))


def join_collinear(segments: DataFrame) -> DataFrame:
    """Coalesce segments of a contig that continue each other in one block:
    touching on the contig and, in their orientation, in the block."""
    w = Window.partitionBy("contig").orderBy("start")
    p = lambda c: F.lag(c).over(w)
    touch = p("start") + p("length") == F.col("start")
    step = F.when(F.col("orientation"), p("block_start") + p("length")).otherwise(p("block_start") - F.col("length"))
    same = touch & p("block").eqNullSafe(F.col("block")) & p("orientation").eqNullSafe(F.col("orientation"))
    same = F.coalesce(same & (F.col("block").isNull() | (step == F.col("block_start"))), F.lit(False))
    islands = segments.withColumn("_n", (~same).cast("int"))
    islands = islands.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("contig", "_g", "block", "orientation").agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.min("block_start").alias("block_start")
    ).drop("_g")


def overlap_stats(unitigs: DataFrame) -> DataFrame:
    """Unitigs (ends array<long>, reads, left/right array<struct<end,len>>, seq):
    count, mean length, overlaps."""
    n = F.size("left") + F.size("right")
    return unitigs.agg(F.count("*").alias("unitigs"), F.avg(F.length("seq")).alias("mean_length"), F.sum(n).alias("overlaps"), F.sum("reads").alias("reads"))


def unitig_components(unitigs: DataFrame, overlaps_only: bool = False) -> DataFrame:
    """Components of unitig ends joined by overlaps and (or not) by unitigs."""
    l_end, r_end = F.col("ends")[0], F.col("ends")[1]
    left = unitigs.select(l_end.alias("a"), F.explode("left.end").alias("b"))
    right = unitigs.select(r_end.alias("a"), F.explode("right.end").alias("b"))
    edges = left.unionByName(right)
    if not overlaps_only:
        edges = edges.unionByName(unitigs.select(l_end.alias("a"), r_end.alias("b")))
    return connected_components(edges)


def base_table(contigs: DataFrame) -> DataFrame:
    """(base, contig, offset, genome, letter) of contigs (contig, seq, genome):
    bases are numbered through all contigs in order."""
    lengths = contigs.select("contig", F.length("seq").cast("long").alias("n"))
    starts = running_sum(lengths, ["contig"], {"upto": F.col("n")}).withColumn("cum", F.col("upto") - F.col("n"))
    rows = contigs.select("contig", "genome", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("offset", "letter"))
    rows = rows.join(starts.select("contig", "cum"), "contig")
    return rows.select((F.col("cum") + F.col("offset")).alias("base"), "contig", F.col("offset").cast("long").alias("offset"), "genome", "letter")


def segments_of(bases: DataFrame, canon: DataFrame) -> DataFrame:
    """(contig, start, length, block, orientation, block_start) of a merged graph.

    ``canon``: (base, canon, reversed) of merged bases. Two neighbouring canonical
    bases are in one block if each base of the first is followed, in its own
    orientation, by one of the second and both have as many: boundaries that no
    base needs are joined. Bases merged with none form segments without block.
    """
    own = bases.join(canon, "base", "left").select(
        "base", "contig", "offset", F.coalesce("canon", "base").alias("canon"), F.coalesce("reversed", F.lit(False)).alias("rev")
    )
    own = materialize(own)
    size = own.groupBy("canon").agg(F.count("*").alias("members"))
    after = own.select(
        F.col("contig").alias("c2"), F.col("offset").alias("o2"), F.col("canon").alias("canon2"), F.col("rev").alias("rev2")
    )
    step = F.when(F.col("rev"), -1).otherwise(1)
    near = own.withColumn("o2", F.col("offset") + step).withColumn("c2", F.col("contig")).join(after, ["c2", "o2"], "left")
    follows = F.coalesce((F.col("canon2") == F.col("canon") + 1) & (F.col("rev2") == F.col("rev")), F.lit(False))
    going = near.groupBy("canon").agg(F.bool_and(follows).alias("all"), F.count("*").alias("members"))
    nxt = size.select((F.col("canon") - 1).alias("canon"), F.col("members").alias("members2"))
    going = going.join(nxt, "canon", "left").select("canon", "members", F.coalesce(F.col("all") & (F.col("members") == F.col("members2")), F.lit(False)).alias("joins"))
    home = own.filter("base = canon").select("canon", F.col("contig").alias("home"))
    w = Window.partitionBy("home").orderBy("canon")
    runs = going.join(home, "canon").withColumn("new", (~F.coalesce(F.lag("joins").over(w), F.lit(False)) | (F.lag("canon").over(w) + 1 != F.col("canon"))).cast("int"))
    first = F.when(F.col("new") == 1, F.col("canon"))
    runs = runs.withColumn("block", F.last(first, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    members = own.join(runs.select("canon", "block", "members"), "canon")
    # a base may stand in a block more than once on a contig: its place along the diagonal tells
    diagonal = F.when(F.col("rev"), F.col("offset") + F.col("canon")).otherwise(F.col("offset") - F.col("canon"))
    out = members.groupBy("contig", "block", "rev", diagonal.alias("_d")).agg(
        F.min("offset").alias("start"), F.count("*").alias("length"), F.min(F.col("canon") - F.col("block")).alias("block_start"), F.max("members").alias("members")
    )
    return out.select(
        "contig", "start", "length", F.when(F.col("members") > 1, F.col("block")).alias("block"),
        F.when(F.col("members") > 1, ~F.col("rev")).alias("orientation"), "block_start",
    )
