"""Context sets and bounded walks on small sequence graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.runtime import materialize


def minimal_unique_contexts(strings: DataFrame, longest: int) -> DataFrame:
    """(node, context): strings (node, context) of prefixes that single out their
    node and have no shorter prefix that does. ``strings``: node, seq - what can
    be read from a node."""
    grown = strings.select("node", F.explode(F.sequence(F.lit(1), F.least(F.length("seq"), F.lit(longest)))).alias("n"), "seq")
    grown = grown.select("node", F.expr("left(seq, n)").alias("context")).distinct()
    unique = grown.groupBy("context").agg(F.count("*").alias("nodes"), F.min("node").alias("node")).filter("nodes = 1").drop("nodes")
    shorter = unique.select(F.col("node"), F.col("context").alias("short"))
    # a context is not minimal if it without its last letter is unique already
    cut = F.expr("left(context, length(context) - 1)")
    return unique.join(shorter, (unique.node == shorter.node) & (cut == shorter.short), "left_anti").select("node", "context")


def context_lengths(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("node").agg(F.min(F.length("context")).alias("shortest"), F.max(F.length("context")).alias("longest"), F.count("*").alias("contexts"))


def matches(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, node): queries (query, seq) that start with a context of a node,
    by an equi join on each context length."""
    lengths = [r[0] for r in contexts.select(F.length("context")).distinct().collect()]
    out = None
    for n in sorted(lengths):
        part = queries.filter(F.length("seq") >= n).withColumn("context", F.left("seq", F.lit(n))).join(contexts, "context").select("query", "node")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else queries.select("query", F.lit(None).cast("long").alias("node")).limit(0)


def mapped_class(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query, node, class): B where both sides agree, L where one side maps
    alone, nothing where they differ; several nodes on a side map nowhere."""
    one = lambda df, c: df.groupBy("query").agg(F.count_distinct("node").alias("n"), F.min("node").alias(c)).filter("n = 1").drop("n")
    both = one(left, "l").join(one(right, "r"), "query", "full")
    kind = F.when(F.col("l") == F.col("r"), "B").when(F.col("l").isNull() | F.col("r").isNull(), "L")
    return both.select("query", F.coalesce("l", "r").alias("node"), kind.alias("class")).filter("class is not null")


def walks(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, end, seq) of walks of up to ``depth`` nodes (node, base) along
    edges (a, b): one join a step, each step materialised."""
    step = nodes.select(F.col("node").alias("start"), F.col("node").alias("end"), F.col("base").alias("seq"))
    out = step
    for _ in range(depth - 1):
        step = materialize(step.join(edges, step.end == edges.a).join(nodes, F.col("b") == nodes.node).select("start", F.col("node").alias("end"), F.concat("seq", "base").alias("seq")))
        out = out.unionByName(step)
    return out


def longest_walks(walks_: DataFrame) -> DataFrame:
    return walks_.groupBy("start").agg(F.max_by("seq", F.struct(F.length("seq"), "seq")).alias("seq"))
