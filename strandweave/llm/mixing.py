"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a domain-language-source tree by weight. What a subtree
can take is worked out from its leaves up: a leaf its tokens times the epochs
allowed, a branch the sum over its children, and nothing where the weight is 0.
A subtree that can take less than its share takes that; the shortage goes to its
siblings by weight, and only what all siblings together cannot take is settled
further up. Each leaf's quota becomes whole
epochs and a token prefix of one more, in an order seeded for that epoch.

The prefix needs no sort of a leaf: token sums over 4096 ranges of the order's
hash find the range where the quota ends, and only that range is summed row by
row. A leaf then has one cut value, and choosing rows is a narrow stage.

Edge cases: null domain, language or source count as the value ``(none)``;
null or empty texts have no tokens and come along wherever the prefix reaches
them; rows with equal ids share their fate, so a prefix never splits repeated
rows; unknown branches weigh 1, those of weight 0 or below get nothing; a table's own
columns are kept in a struct, so names never clash; a very long text is taken or
left whole; an empty table or a zero budget selects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm.common import broadcast_if_small, packed, persisted, prepare

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: The hash order is cut in 2**RANGE_BITS ranges.
RANGE_BITS = 12


def share_out(budget: float, parts: list[tuple[float, float]]) -> list[float]:
    """Split a budget over (weight, capacity) siblings; shortages are shared by
    weight among those that still have room."""
    got = [0.0] * len(parts)
    open_ = [i for i, (w, c) in enumerate(parts) if w > 0 and c > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(parts[i][0] for i in open_)
        full = [i for i in open_ if got[i] + left * parts[i][0] / total >= parts[i][1]]
        if not full:
            for i in open_:
                got[i] += left * parts[i][0] / total
            break
        for i in full:
            left -= parts[i][1] - got[i]
            got[i] = parts[i][1]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def quotas(
    leaves: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], budget: float, max_epochs: float
) -> dict[tuple[str, ...], int]:
    """Whole-token quota of each leaf path; weights are keyed by path prefix."""
    out: dict[tuple[str, ...], int] = {}

    def weight(n: tuple[str, ...]) -> float:
        return weights.get(n, weights.get(("*", *n[1:]), 1.0))

    room: dict[tuple[str, ...], float] = {}
    for path, n in sorted(leaves.items()):
        if all(weight(path[: d + 1]) > 0 for d in range(len(path))):
            for d in range(len(path)):
                room[path[: d + 1]] = room.get(path[: d + 1], 0.0) + max_epochs * n

    def down(prefix: tuple[str, ...], own: list[tuple[str, ...]], budget: float) -> None:
        depth = len(prefix)
        if own and depth == len(own[0]):
            out[prefix] = int(budget + 1e-6)
            return
        children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for path in own:
            children.setdefault(path[: depth + 1], []).append(path)
        names = sorted(children)
        parts = [(weight(n), room.get(n, 0.0)) for n in names]
        for name, part in zip(names, share_out(budget, parts)):
            down(name, children[name], part)

    if leaves:
        down((), sorted(leaves), budget)
    return out


def with_leaf(documents: DataFrame, domain: Column) -> DataFrame:
    """The tree columns (prefixed with ``_``) beside a table's own."""
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return documents.withColumns({f"_{k}": F.coalesce(v.cast("string"), F.lit(NONE)) for k, v in levels.items()})


def order_key(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col("doc_id"))


def tokens_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan(
    documents: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float], fraction: float | None = None,
    budget: int | None = None, max_epochs: float = 2.0, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(leaf table: quota, whole epochs and cut of the last; narrow token table).

    Only one row for each leaf of the tree comes to the driver.
    """
    prepare(documents.sparkSession)
    leaf = [f"_{k}" for k in LEVELS]
    rows = documents.select("doc_id", "text", "lang", "source", domain.alias("_of"))
    narrow = persisted(with_leaf(rows, F.col("_of")).select("doc_id", *leaf, tokens_of().alias("_tokens")))
    totals = {tuple(r[:3]): int(r[3]) for r in narrow.groupBy(*leaf).agg(F.sum("_tokens")).collect()}
    budget = int(fraction * sum(totals.values())) if budget is None else budget
    got = quotas(totals, weights, budget, max_epochs)
    rows = []
    for path, quota in got.items():
        whole, rest = divmod(quota, totals[path]) if totals[path] else (0, 0)
        rows.append((*path, totals[path], quota, whole, rest))
    schema = T.StructType(
        [T.StructField(k, T.StringType()) for k in leaf]
        + [T.StructField(k, T.LongType()) for k in ("_total", "_quota", "_whole", "_rest")]
    )
    leaves = documents.sparkSession.createDataFrame(rows, schema)
    keyed = narrow.join(broadcast_if_small(leaves), leaf).withColumn("_key", order_key(F.col("_whole"), seed))
    keyed = keyed.withColumn("_range", F.shiftright("_key", 64 - RANGE_BITS)).filter("_rest > 0")
    sums = keyed.groupBy(*leaf, "_range", "_rest").agg(F.sum("_tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*leaf).orderBy("_range"))
    ends = sums.withColumn("_upto", upto).filter("_upto > _rest")
    ends = ends.groupBy(*leaf).agg(F.min(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_e"))
    ends = ends.select(*leaf, F.col("_e._range").alias("_range"), F.col("_e._before").alias("_before"))
    ends = persisted(ends)
    inside = keyed.join(broadcast_if_small(ends), [*leaf, "_range"])
    run = F.col("_before") + F.sum("_tokens").over(Window.partitionBy(*leaf).orderBy("_key"))
    last = inside.withColumn("_run", run).filter("_run <= _rest").groupBy(*leaf).agg(F.max("_key").alias("_last"))
    cuts = ends.join(last, leaf, "left").select(
        *leaf, F.coalesce(F.col("_last") + 1, F.shiftleft("_range", 64 - RANGE_BITS)).alias("_cut")
    )
    return persisted(leaves.join(cuts, leaf, "left")), narrow


def copies(leaves: DataFrame, rows: DataFrame, seed: int = 1) -> DataFrame:
    """``rows`` (with doc_id and leaf columns) and how often each is taken."""
    leaf = [f"_{k}" for k in LEVELS]
    joined = rows.join(broadcast_if_small(leaves), leaf, "left")
    in_prefix = F.coalesce(order_key(F.col("_whole"), seed) < F.col("_cut"), F.lit(False)).cast("long")
    return joined.withColumn("_copies", F.coalesce(F.col("_whole") + in_prefix, F.lit(0)))


def mixed(documents: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float], seed: int = 1, **how) -> DataFrame:
    """The rows taken, repeated for further epochs, with the table's columns."""
    leaves, _ = plan(documents, domain, weights, seed=seed, **how)
    rows = with_leaf(packed(documents, F.col("doc_id"), F.col("lang"), F.col("source"), domain.alias("_of")), F.col("_of"))
    taken = copies(leaves, rows, seed).filter("_copies > 0")
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("row.*")
