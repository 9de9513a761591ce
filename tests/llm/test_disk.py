"""What is left on disk between steps, and which rows are dealt out at all."""

import os
import time

import numpy as np
import pytest

pytest.importorskip("strandweave.llm")

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from strandweave.llm import ngram_join  # noqa: E402
from strandweave.llm.common import persisted  # noqa: E402


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(i).name() for i in range(blocks.size()) if blocks.apply(i).name().startswith("shuffle_")}


def test_persisted_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = persisted(held)
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.count() == held.count() == 7


def test_pipeline_keeps_one_table_between_stages(spark, monkeypatch, tmp_path):
    spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).write.parquet(f"{tmp_path}/strandweave-in/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, docs, d: docs.filter("doc_id > 0")) for n in "abcd"])
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, f"{tmp_path}/strandweave-in").count() == 19
    assert len(set(os.listdir(folder)) - before) == 1
    assert spark.read.parquet(f"{tmp_path}/strandweave-in/documents.parquet").count() == 20


@pytest.mark.parametrize("percent", [80, 90])
def test_rows_meet_where_enough_is_left_of_both(percent):
    r = np.random.default_rng(7)
    gram, size = np.sort(r.integers(0, 30, 200)), r.integers(1, 300, 200)
    place = (r.random(200) * 0.2 * size).astype(int)
    left = size - place
    want = [
        any(j != i and gram[j] == gram[i] and min(left[i], left[j]) >= ngram_join.needed(int(size[i] + size[j]), percent) for j in range(200))
        for i in range(200)
    ]
    assert ngram_join.meetable(gram, size, place, percent).tolist() == want and 0 < sum(want) < 200
    many = np.zeros(200, int)
    assert ngram_join.meetable(many, 10 ** np.arange(200) % 10**6 + 1, many, percent).all()  # too many to compare


def test_a_gram_longer_than_a_chunk_keeps_its_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    nodes = spark.createDataFrame([(n, 100, [5, 6 + n % 2, 100 + n]) for n in range(30)], "node long, size long, prefix array<long>")
    run = ngram_join.meeting(nodes.coalesce(1), 80)
    found = sorted((x.gram, x.node, x.pos, x._len) for x in run.collect())
    assert found == sorted([(5, n, 0, 64) for n in range(30)] + [(6 + n % 2, n, 1, 64) for n in range(30)])
