"""Exact top-k inner products with block-at-a-time pruning.

Vectors in id ranges form blocks; a block keeps its forward index (the matrix)
and, for each term (component), the largest and smallest weight. For a query
the sum over terms of the larger possible product bounds every score in a
block. Each query takes blocks in order of falling bounds, scores them through
the forward index, and stops when the next bound is below its k-th score.

Work is laid out on a grid: slices of the blocks times slices of the queries,
each slice of bounded size, so no task holds all of either. Each cell returns
its k best for each query, and the k best of those are the answer.

Edge cases: vectors that are null, empty or hold null or non-finite components,
and rows with a null id, take no part; vectors of unequal length count as padded with zeros; equal
scores go to the smaller id; repeated ids are separate rows, none of which is
returned for a query of that id; with fewer candidates than k all are returned;
components of any size give exact scores, and a returned score that 64 bits
cannot hold raises ``OverflowError``; columns beside ``vec_id`` and ``embedding``
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import prepare

BLOCK = 512
#: Rows of candidates and of queries that meet in one task, about.
CANDIDATES, QUERIES = 65_536, 8_192


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, terms array<double>: whole numbers) of the vectors that take part."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # doubles hold these whole numbers exactly; beyond 2**52 there is nothing to round down
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    terms = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return embeddings.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ok).select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))


#: Sums of products below this are exact in doubles, in any order.
EXACT = 2.0**53


class Block:
    """A document range: ids, forward index, and term maxima and minima."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.high, self.low = matrix.max(axis=0), matrix.min(axis=0)
        self.size = np.maximum(np.abs(self.high), np.abs(self.low))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Inner products, exact: doubles where every partial sum is below 2**53,
        else Python's whole numbers."""
        if (np.abs(queries) @ self.size < EXACT).all():
            return queries @ self.matrix.T
        whole = [[int(x) for x in row] for row in self.matrix]
        out = np.empty((len(queries), len(whole)), dtype=object)
        for i, query in enumerate(queries):
            own = [int(x) for x in query]
            out[i] = [sum(map(mul, own, row)) for row in whole]
        return out


def blocks(ids: np.ndarray, matrix: np.ndarray, size: int = BLOCK) -> list[Block]:
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    return [Block(ids[i : i + size], matrix[i : i + size]) for i in range(0, len(ids), size)]


def search(query_ids: np.ndarray, queries: np.ndarray, parts: list[Block], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) best first; exact."""
    n = len(query_ids)
    high, low = np.array([b.high for b in parts]), np.array([b.low for b in parts])
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    most = np.abs(queries) @ np.array([b.size for b in parts]).T
    bounds += np.where(most < EXACT, 0.0, most * 1e-9)  # rounding must not lower a bound
    order = np.argsort(-bounds, axis=1, kind="stable")
    best_ids = [np.zeros(0, np.int64)] * n
    best = [np.zeros(0)] * n
    kth = np.full(n, -np.inf)
    active = np.arange(n)
    for step in range(len(parts)):
        chosen = order[active, step]
        going = bounds[active, chosen] >= kth[active]
        active, chosen = active[going], chosen[going]
        if not len(active):
            break
        for b in np.unique(chosen):
            rows, part = active[chosen == b], parts[b]
            scores = part.scores(queries[rows])
            scores[part.ids[None, :] == query_ids[rows][:, None]] = -np.inf
            for i, q in enumerate(rows):
                good = np.flatnonzero((scores[i] >= kth[q]) & (scores[i] > -np.inf))
                ids, s = np.concatenate((best_ids[q], part.ids[good])), np.concatenate((best[q], scores[i, good]))
                top = np.lexsort((ids, -s)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], ids[j])), dtype=np.int64)
                best_ids[q], best[q] = ids[top[:k]], s[top[:k]]
                if len(best[q]) == k:
                    last = best[q][-1]  # rounded down where a double cannot hold it
                    kth[q] = last if abs(last) < EXACT else np.nextafter(float(last), -np.inf)
    for i in range(n):
        yield int(query_ids[i]), best_ids[i], best[i]


def _matrix(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each query row."""
    prepare(vectors.sparkSession)
    n, n_queries, width = vectors.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    across, down = max(1, math.ceil(n / candidates)), max(1, math.ceil((n_queries or 0) / queries))
    own = F.pmod(F.xxhash64("vec_id", "terms"), F.lit(down)).cast("int")
    docs = vectors.select("vec_id", "terms", F.pmod(F.floor(F.col("vec_id") / BLOCK), F.lit(across)).cast("int").alias("x"))
    docs = docs.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asked = vectors.filter(is_query).select("vec_id", "terms", own.alias("y")).distinct()
    asked = asked.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            parts = blocks(left["vec_id"].to_numpy(), _matrix(left["terms"], width))
            asked_ids, asked_terms = right["vec_id"].to_numpy(), _matrix(right["terms"], width)
            for at in range(0, len(asked_ids), 256):
                for query, ids, scores in search(asked_ids[at : at + 256], asked_terms[at : at + 256], parts, k):
                    out += [(query, int(i), int(s)) for i, s in zip(ids, scores)]
        query, ids, scores = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    best = docs.groupBy("x", "y").cogroup(asked.groupBy("x", "y")).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
