"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import audio, bpe, language_id, mixing, ngram_join, substring_dedup, topk, toxicity, url_filter, warc
from strandweave.llm.common import id_crc, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies; it is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.sample(documents, labels, id_crc() % 4 != 2))
    scored = toxicity.score(documents, model)
    return scored.select(
        "doc_id",
        (id_crc() % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("sentences").alias("n_offending"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), size=3, percent=90).drop("text_hash")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    dictionaries = language_id.learn(documents, id_crc() % 3 != 1)
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return language_id.classify(narrow, dictionaries).select(
        "doc_id", (id_crc() % 3 == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


#: The listed rules of op9: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def domain() -> Column:
    """The mixture's domains: each a third of the sources, by crc32."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 3).cast("string"))


#: The mixture's weights by tree path (``*``: any domain), and its parameters.
WEIGHTS = {
    ("domain0",): 0.5, ("domain1",): 0.3, ("domain2",): 0.2,
    ("*", "en"): 0.55, ("*", "de"): 0.15, ("*", "fr"): 0.15, ("*", "es"): 0.15,
}
FRACTION, EPOCHS, SEED = 0.6, 2.0, 20


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    leaves, tokens = mixing.plan(documents, domain(), WEIGHTS, fraction=FRACTION, max_epochs=EPOCHS, seed=SEED)
    return mixing.copies(leaves, tokens, SEED).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"),
        F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_topk": op5_topk,
    "op6_language_id": op6_language_id,
    "op7_telephony_audio": op7_telephony_audio,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: SQL for the operators that SQL can express; the others are tested against
#: brute force, an exact round trip or held-out labels.
ORACLES: dict[str, str] = {
    "op2_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN links ON r = a)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON doc_id = d GROUP BY d""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top,
  array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
   '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
   + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM w),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN twice USING (h)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS t FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
