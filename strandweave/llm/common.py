"""What the training-data operators share: table access, session settings,
the shared folder for intermediate tables, and word hashing with numpy."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small.

    Workers inherit the package root by PYTHONPATH where the root is mounted;
    elsewhere the package is shipped with ``--py-files``.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, path) if p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset and the session runs on one machine, a local folder
    is chosen; on a cluster an unset folder raises.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/strandweave-checkpoints"
    return f"{base.rstrip('/')}/strandweave-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persisted(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: lineage ends there, and
    a lost executor costs nothing but the tasks it was running. Its shuffle files
    go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``persisted`` wrote; nothing may read it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/strandweave-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Rows of a narrow table that may be sent to every executor.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table to join with: broadcast if its counted rows are few, else left to
    a shuffled join, whose larger side can be split where a key is hot."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(df: DataFrame, *also: Column) -> DataFrame:
    """A table's columns as one struct ``row`` beside others made from them:
    names that a caller's table has can then clash with none of ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *also)


def map_batches(
    df: DataFrame, columns: Iterable[str | Column], fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str
) -> DataFrame:
    """Apply ``fn`` (batch -> dicts of column lists) with one narrow Arrow stage."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_pydict(out)

    return df.select(*columns).mapInArrow(run, schema)


# ---- words -----------------------------------------------------------------

#: Bytes that separate words: space and 0x09-0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = {"up": _powers(_BASE, 1 << 12), "down": _powers(_INVERSE, 1 << 12)}


def powers(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) < n:
        _POW[kind] = _powers(_BASE if kind == "up" else _INVERSE, 1 << (n - 1).bit_length())
    return _POW[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs without separators."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SEPARATOR[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for each span, by prefix sums."""
    n = len(codes)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * powers("up", n), out=total[1:])
    down = powers("down", n + 1)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BYTE[7])


#: Longer texts are hashed in pieces of about this many bytes.
PIECE_BYTES = 1 << 22


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """Hashes of a text's words, in order."""
    data = np.frombuffer(text, dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE_BYTES:
            gaps = np.flatnonzero(SEPARATOR[data[at + PIECE_BYTES : end]])
            end = at + PIECE_BYTES + int(gaps[0]) if len(gaps) else end
        piece = data[at:end]
        starts, ends = word_spans(piece)
        if len(starts):
            out.append(run_hashes(_BYTE[LOWER[piece] if lower else piece], starts, ends))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return run_hashes(words, starts, starts + size)
