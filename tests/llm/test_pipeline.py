"""The corpus pipeline from end to end against plain Python, stage by stage."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("strandweave.llm")

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from strandweave.llm import language_id, mixing, queries  # noqa: E402
from test_operators import LANGS, brute_components  # noqa: E402


def corpus():
    r = random.Random(41)

    def text(lang, n):
        return ["".join(r.sample(LANGS[lang], 2)) + "abcdefghij"[r.randrange(10)] + "klmnopqrst"[r.randrange(10)] if r.random() < 0.6 else r.choice(LANGS[lang]) for _ in range(n)]

    rows, shared = [], {lang: text(lang, 70) for lang in LANGS}
    for i in range(150):
        lang = r.choice(sorted(LANGS))
        words = text(lang, r.choice([20, 90, 160]))
        if i % 9 == 0:
            words[10:10] = shared[lang][r.randrange(5) :]
        if i % 11 == 5:
            lang, words = rows[i - 3][2], rows[i - 3][1].split()
            if i % 2:
                words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), lang, f"s{r.randrange(4)}"))
    rows += [(500, None, "en", "s1"), (501, "", "de", "s1"), (502, "12 34 !", None, None), (3, rows[3][1], rows[3][2], rows[3][3])]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


def without_passages(rows, window):
    split = [(t or "").split() for _, t, *_ in rows]
    n = collections.Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (i, t, lang, source, _), w in zip(rows, split):
        gone = {j for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        t = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        out.append((i, t, lang, source, len(t or "")))
    return out


def mixture(rows, key):
    leaf = lambda r: (f"domain{zlib.crc32((r[3] or '').encode()) % 3}", r[2] or "(none)", r[3] or "(none)")
    tokens = lambda r: len((r[1] or "").split())
    totals = collections.Counter()
    for r in rows:
        totals[leaf(r)] += tokens(r)
    got = mixing.quotas(totals, queries.WEIGHTS, int(corpus_pipeline.FRACTION * sum(totals.values())), corpus_pipeline.EPOCHS)
    out = []
    for path, quota in got.items():
        own = [r for r in rows if leaf(r) == path]
        whole, rest = divmod(quota, totals[path]) if totals[path] else (0, 0)
        out += own * whole
        run = 0
        order = sorted({r[0] for r in own}, key=lambda i: key(whole, i))
        for i in order:
            same = [r for r in own if r[0] == i]
            run += sum(map(tokens, same))
            if run > rest or not rest:
                break
            out += same
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    decide = language_id.Classifier(language_id.learn(docs, F.lit(True)))
    told = [r for r in rows if not decide(r[1])[2]]
    assert 0 < len(told) < len(rows)
    components = {(i, n): c for i, n, c in brute_components([(r[0], r[1]) for r in told], 5, 80)}
    least = {c for c in components.values()}
    kept = [r for r in dict.fromkeys(told) if r[0] in least]
    assert len(kept) < len(told)
    cleaned = without_passages(kept, corpus_pipeline.PASSAGE_WORDS)
    assert sum(len(a[1] or "") != len(b[1] or "") for a, b in zip(kept, cleaned)) > 3
    ids = sorted({r[0] for r in cleaned})
    keyed = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    keys = {(e, r.doc_id): r[f"k{e}"] for r in keyed.select("doc_id", *[mixing.order_key(F.lit(e).cast("long"), corpus_pipeline.SEED).alias(f"k{e}") for e in range(3)]).collect() for e in range(3)}
    mixed = mixture(cleaned, lambda e, i: keys[e, i])
    assert mixed
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for r in mixed:
        own = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "substring_dedup", "mixing", "bpe"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
