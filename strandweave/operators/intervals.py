"""Interval and as-of joins, islands and gap filling, all by partitioned keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.plans.runtime import materialize

def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, key: str, value: str, direction: str = "backward") -> DataFrame:
    """For each left row the right row with the nearest ``key``: at or before
    ``at`` (backward) or at or after it (forward). Both sides are merged in key
    order once; no pair is ever formed. Right keys are unique within ``by``; without
    ``by`` the order is range-partitioned, and the last right row of each partition
    is carried into the next."""
    forward = direction == "forward"
    l_rows = left.withColumns({"_at": F.col(at), "_side": F.lit(0 if forward else 1), "_v": F.lit(None).cast("struct<k:bigint,v:string>")})
    r_cols = [F.col(c) for c in by] + [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by]
    r_rows = right.select(
        *r_cols, F.col(key).alias("_at"), F.lit(1 if forward else 0).alias("_side"),
        F.struct(F.col(key).cast("long").alias("k"), F.col(value).cast("string").alias("v")).alias("_v"),
    )
    marked = l_rows.withColumn("_left", F.lit(True)).unionByName(r_rows.withColumn("_left", F.lit(False)))
    if not by:
        return _as_of_everywhere(marked, forward).filter("_left").select(*left.columns, F.col("_f.k").alias("match_key"), F.col("_f.v").alias("match"))
    out = marked.withColumn("_f", _carried(by, forward)).filter("_left")
    return out.select(*left.columns, F.col("_f.k").alias("match_key"), F.col("_f.v").alias("match"))


def _carried(by: list[str], forward: bool) -> Column:
    """The last ``_v`` up to each row, or (``forward``) the first from it on. That is
    the last one in falling order: a frame that ends at its row grows by a row at a
    time, where one that starts there is summed up anew for each row."""
    order = [F.col(c).desc() if forward else F.col(c).asc() for c in ("_at", "_side")]
    return F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _as_of_everywhere(marked: DataFrame, forward: bool) -> DataFrame:
    """``_f``: the nearest ``_v`` in order of ``_at`` and ``_side``."""
    rows = materialize(marked.repartitionByRange("_at", "_side").withColumn("_p", F.spark_partition_id()))
    place = F.when(F.col("_v").isNotNull(), F.struct("_at", "_side"))
    edge = rows.groupBy("_p").agg((F.min_by("_v", place) if forward else F.max_by("_v", place)).alias("_e"))
    across = Window.orderBy(F.col("_p").desc() if forward else "_p")  # one row a partition
    carried = F.last("_e", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_o", _carried(["_p"], forward)).join(F.broadcast(edge.select("_p", carried.alias("_c"))), "_p").withColumn("_f", F.coalesce("_o", "_c"))


def starting_before(points: DataFrame, intervals: DataFrame, by: list[str], at: str) -> DataFrame:
    return as_of(points, intervals, by, at, "start", "value")


def starting_after(points: DataFrame, intervals: DataFrame, by: list[str], at: str) -> DataFrame:
    return as_of(points, intervals, by, at, "start", "value", "forward")


def _ends(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("end", F.col("start") + F.col("length") - 1)


def ending_before(points: DataFrame, intervals: DataFrame, by: list[str], at: str) -> DataFrame:
    return as_of(points, _ends(intervals), by, at, "end", "value")


def ending_after(points: DataFrame, intervals: DataFrame, by: list[str], at: str) -> DataFrame:
    return as_of(points, _ends(intervals), by, at, "end", "value", "forward")


def overlap_join(left: DataFrame, right: DataFrame, by: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int) -> DataFrame:
    """Pairs whose half-open spans overlap on the same ``by``.

    A synthetic key, the bins each span touches, makes it an equi join; a pair
    is kept in the first bin it shares only, so nothing is made distinct.
    """
    (ls, le), (rs, re_) = left_span, right_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size)))
    a = left.filter(F.col(le) > F.col(ls)).withColumn("_bin", bins(ls, le))
    b = right.filter(F.col(re_) > F.col(rs)).withColumn("_bin", bins(rs, re_))
    pairs = a.join(b, [by, "_bin"]).filter((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)))
    return pairs.filter(F.col("_bin") == F.floor(F.greatest(ls, rs) / bin_size)).drop("_bin")


def point_join(points: DataFrame, spans: DataFrame, by: str, at: str, span: tuple[str, str], bin_size: int, how: str = "inner") -> DataFrame:
    """Points and the half-open spans that hold them."""
    s, e = span
    b = spans.filter(F.col(e) > F.col(s)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size))))
    a = points.withColumn("_bin", F.floor(F.col(at) / bin_size)).alias("a")
    b = b.alias("b")
    on = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._bin") == F.col("b._bin")) & (F.col(s) <= F.col(at)) & (F.col(at) < F.col(e))
    return a.join(b, on, how).select("a.*", *[F.col(f"b.{c}") for c in spans.columns if c != by]).drop("_bin")


def merge(spans: DataFrame, by: str, start: str, end: str, name: str) -> DataFrame:
    """Merge touching or overlapping half-open spans of each ``by``, with the
    sorted distinct names of what was merged."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    island = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(by, "_g").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names")
    )
    return out.drop("_g")


def coalesce_equal(spans: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Join inclusive spans that touch (end + 1 = start) and hold equal values."""
    w = Window.partitionBy(by).orderBy("start")
    new = (F.lag("end").over(w) + 1 == F.col("start")) & F.lag(value).over(w).eqNullSafe(F.col(value))
    marked = spans.withColumn("_new", (~F.coalesce(new, F.lit(False))).cast("int"))
    island = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "_g", value).agg(F.min("start").alias("start"), F.max("end").alias("end")).select(by, "start", "end", value)


def fill_gaps(spans: DataFrame, by: str, value: str = "value", first: int = 0) -> DataFrame:
    """Inclusive spans with the gaps between them as rows of null value."""
    w = Window.partitionBy(by).orderBy("start")
    reach = F.coalesce(F.lag("end").over(w), F.lit(first - 1))
    gaps = spans.select(F.col(by), (reach + 1).alias("start"), (F.col("start") - 1).alias("end"), F.lit(None).cast(spans.schema[value].dataType).alias(value))
    return spans.select(by, "start", "end", value).unionByName(gaps.filter("start <= end"))


def containing(points: DataFrame, spans: DataFrame, by: list[str], at: str, until: Column) -> DataFrame:
    """The value of the disjoint inclusive span that holds [at, until], or null."""
    keyed = spans.withColumn("_pack", F.concat_ws("|", F.col("end").cast("string"), F.col("value").cast("string")))
    found = as_of(points.withColumn("_until", until), keyed, by, at, "start", "_pack")
    end = F.split_part("match", F.lit("|"), F.lit(1)).cast("long")
    value = F.when(end >= F.col("_until"), F.expr("substring(match, instr(match, '|') + 1)"))
    return found.withColumn("value", value).drop("match", "match_key", "_until")


def with_neighbours(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Sliding pairs (previous, next) of each group, both ends included: n + 1
    pairs for n rows."""
    w = Window.partitionBy(*by).orderBy(order)
    pairs = rows.select(*by, F.lag(value).over(w).alias("previous"), F.col(value).alias("next"))
    last = rows.groupBy(*by).agg(F.max_by(value, order).alias("previous"))
    return pairs.unionByName(last.withColumn("next", F.lit(None).cast(rows.schema[value].dataType)).select(*by, "previous", "next"))
