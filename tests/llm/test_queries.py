"""The registered queries and the pipeline on the smallest driver tables."""

import pytest

pytest.importorskip("strandweave.llm")

from strandweave.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["doc_id", "n_shingles", "component_id"],
    "op3": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5": ["query_id", "rank", "vec_id", "score"], "op6": ["doc_id", "held_out", "lang_pred", "score"],
    "op7": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op9": ["page_id", "host", "path", "rule", "verdict"], "op10": ["doc_id", "copies"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_its_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    n = df.count()
    if name != "op5_topk":
        table = "pages" if name.split("_")[0] in ("op3", "op9") else "documents"
        assert n == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "substring_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    from strandweave.llm.common import persisted

    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = persisted(stage(spark, docs, DATA))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] >= 0.95 * sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == sizes[4] and last.filter("n_tokens < 0").count() == 0
