"""Each training-data operator against brute force, an exact round trip or
held-out accuracy, on small tables with nulls, empties, ties and clashes."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("strandweave.llm")

from pyspark.sql import functions as F  # noqa: E402

from strandweave.llm import (  # noqa: E402
    audio, bpe, components, language_id, mixing, ngram_join, queries, substring_dedup, topk, toxicity, url_filter, warc,
)

WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "IOTA", "kappa", "lambda", "mu", "nu", "xi", "om,"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _lang long, _id long"


def words(r, n):
    return [r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.7 else "") for _ in range(n)]


def sample_rows(seed=1, n=60):
    """Texts with exact and near copies, shared passages and odd cases."""
    r = random.Random(seed)
    passage = words(r, 60)
    rows = []
    for i in range(n):
        w = words(r, r.choice([0, 1, 2, 3, 10, 50, 120]))
        if i % 5 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[r.randrange(10) :]
        if i % 7 == 0 and rows:
            w = (rows[r.randrange(len(rows))][1] or "").split()
            if w and r.random() < 0.6:
                w[r.randrange(len(w))] = "changed"
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "same same " * 60), (None, "a null id b c d"), (7, rows[7][1]), (8, "another text of id eight")]
    rows += [(1004, "x" * 5000), (1005, "\u00a0\u2003 non ascii \u00a0space")]
    return [(i, t, "en", "s", 1, 0.5, 3, 4) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- n-gram join ---------------------------------------------------------------


def brute_components(rows, size, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for i, text in rows:
        w = (text or "").encode().translate(lower).split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = []
    for k, (i, text) in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(k)] if rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return collections.Counter(out)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_ngram_join_matches_brute_force(docs, size, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs, size, percent).collect())
    assert got == brute_components(rows, size, percent)


def test_ngram_join_of_many_near_copies_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 300)  # groups are cut into tiles
    r = random.Random(3)
    first = words(r, 80)
    rows = []
    for i in range(40):
        w = list(first)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(df, 3, 90).collect())
    assert got == brute_components(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "CELL", 8_000_000)
    monkeypatch.setattr(ngram_join, "SETS", 6)  # by their number instead
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(df, 3, 90).collect())
    assert got == brute_components(rows, 3, 90)


def test_ngram_join_keeps_columns_and_one_of_each_group(docs, empty):
    kept = ngram_join.deduplicated(docs, 5, 80)
    assert kept.columns == docs.columns
    assert all((r["n_chars"], r["_lang"], r["_id"]) == (1, 3, 4) for r in kept.collect())
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) <= 1 and 1000 in ids and 1001 in ids
    assert ngram_join.join(empty, 5, 80).collect() == [] and ngram_join.deduplicated(empty).collect() == []


def test_signature_bound_holds():
    r = np.random.default_rng(1)
    for _ in range(200):
        pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
        a, b = np.unique(r.choice(pool, r.integers(1, 2500))), np.unique(r.choice(pool, r.integers(1, 2500)))
        x, y = ngram_join.signature(a).astype(int), ngram_join.signature(b).astype(int)
        if len(x) > len(y):
            x, y = y, x
        assert np.abs(y.reshape(len(x), -1).sum(axis=1) - x).sum() <= len(np.setxor1d(a, b))


def test_trie_links_equal_pairs():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[r.random(len(base)) < 0.92], r.integers(0, 2**63, 2, dtype=np.uint64)))) for _ in range(30)]
    trie = ngram_join.Trie(sets, 80)
    list(trie.links())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root = [root[j] if x == root[i] else x for x in root]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    assert [trie.root_of[i] == trie.root_of[j] for i, j in pairs] == [root[i] == root[j] for i, j in pairs]
    assert len(set(root)) > 1


@pytest.mark.parametrize("percent, common", [(90, 18), (80, 8)])
def test_trie_links_a_set_below_a_larger_one(percent, common):
    # x and y link, y and z link, x and z do not; z stands below y in the trie
    c = np.arange(100, 100 + common, dtype=np.uint64)
    x, y = (np.concatenate((np.array([k], np.uint64), c)) for k in (5, 6))
    z = np.concatenate((y, np.array([500], np.uint64)))
    trie = ngram_join.Trie([x, y, z], percent)
    list(trie.links())
    assert len(set(trie.root_of.tolist())) == 1


@pytest.mark.parametrize("percent", [70, 80, 90, 95, 100])
def test_trie_components_equal_brute_force(percent):
    r = np.random.default_rng(percent)
    for _ in range(60):
        base = np.arange(100, 100 + r.integers(4, 45), dtype=np.uint64)
        sets = [np.unique(np.concatenate((base[r.random(len(base)) < 0.97], r.integers(0, 200, r.integers(0, 3)).astype(np.uint64)))) for _ in range(12)]
        trie = ngram_join.Trie(sets, percent)
        list(trie.links())
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    root = [root[j] if x == root[i] else x for x in root]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
        assert [trie.root_of[i] == trie.root_of[j] for i, j in pairs] == [root[i] == root[j] for i, j in pairs]


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert got == want


# ---- substring dedup -------------------------------------------------------------


def brute_removed(rows, window):
    count = collections.Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] += 1
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [35, 50])
def test_substring_dedup_matches_brute_force(docs, empty, window):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collections.Counter(tuple(r) for r in substring_dedup.digests(docs, window).collect())
    assert got == brute_removed(rows, window)
    assert any(r[2] for r in got)
    assert substring_dedup.digests(empty).collect() == []


def test_substring_dedup_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 64)
    r = random.Random(9)
    shared = words(r, 90)
    rows = [(1, " ".join(words(r, 150) + shared + words(r, 70))), (2, " ".join(words(r, 33) + shared[3:])), (3, " ".join(words(r, 300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = list(substring_dedup.anchors(np.arange(10, dtype=np.uint64))[0])
    assert got == []
    from strandweave.llm.common import word_hashes

    for _, text in rows:  # stretches overlap by a window: together they hold every window once
        own = [w for _, part in substring_dedup.stretches(text, 35) for w in substring_dedup.window_hashes(part, 35).tolist()]
        assert own == substring_dedup.window_hashes(word_hashes(text.encode()), 35).tolist()
    assert df.count() == 3


def test_windows_at_the_end_of_a_full_stretch_meet_their_equals(spark):
    # each short row is one window of a row of more than 2**20 words, near where a stretch may end
    border = 1 << 20
    long = [f"w{i}" for i in range(border + 100)]
    starts = [*range(border - 40, border + 5), *range(substring_dedup.STRETCH - 40, substring_dedup.STRETCH + 5)]
    rows = [(0, long), *((1 + i, long[i : i + 35]) for i in dict.fromkeys(starts)), (-1, [f"x{i}" for i in range(35)])]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in rows[1:] for i in range(len(w) - 34))
    seen.update(t for i in range(border + 66) if (t := tuple(long[i : i + 35])) in seen)
    want = collections.Counter()
    for i, w in rows:
        gone = {k for at in range(len(w) - 34) if seen[tuple(w[at : at + 35])] > 1 for k in range(at, at + 35)}
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in substring_dedup.digests(df).collect()) == want


def test_cleaned_leaves_unique_texts_alone(docs):
    before = {(r.doc_id, r.text) for r in docs.collect()}
    after = substring_dedup.cleaned(docs, 50)
    assert after.columns == docs.columns
    rows = after.collect()
    assert len(rows) == docs.count() and all((r["_lang"], r["_id"], r["score"]) == (3, 4, 0.5) for r in rows)
    assert sum((r.doc_id, r.text) in before for r in rows) > 30


# ---- bpe ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(tokenizer):
    coder = bpe.Encoder(queries.tokenizer_path())
    r = random.Random(4)
    for _ in range(250):
        alphabet = r.choice(["abc de.'s \n", "a ", " \n\t", "日本 é\u0085\x1c", "ab<|endoftext|> "])
        text = "".join(r.choice(alphabet) for _ in range(r.choice([0, 3, 400, 4000])))
        if r.random() < 0.2:
            text += "<|endoftext|>" + text[:50]
        ids = coder.encode(text)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == text


def test_bpe_reuses_chunks(tokenizer):
    coder = bpe.Encoder(queries.tokenizer_path())
    r = random.Random(6)
    body = " ".join(words(r, 6000))
    for head in ("", "one ", "something else, "):
        assert coder.encode(head + body).tolist() == tokenizer.encode(head + body, add_special_tokens=False).ids
    assert coder.hits > coder.misses


def test_bpe_table(docs, empty, tokenizer):
    path = queries.tokenizer_path()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in bpe.digests(docs, path).collect():
        wanted = []
        for text in texts[r.doc_id]:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            wanted.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in wanted
    back = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(t for v in texts.values() for t in v) == sorted(r.text for r in back.collect())
    assert bpe.digests(empty, path).collect() == []


# ---- audio ----------------------------------------------------------------------------


def test_lookup_tables():
    assert audio.TABLES[audio.MULAW][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.TABLES[audio.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            size = step >> 3
            size += step if code & 4 else 0
            size += step >> 1 if code & 2 else 0
            size += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
            out.append(value)
    return out


def test_adpcm_and_containers():
    raw = np.random.default_rng(0).integers(0, 256, 5 * audio.BLOCK, dtype=np.uint8)
    got = audio.decode_adpcm(raw)
    assert got.tolist() == [slow_adpcm(bytes(b)) for b in raw.reshape(-1, audio.BLOCK)]
    for kind in (audio.MULAW, audio.ALAW, audio.ADPCM, audio.PCM):
        file = audio.wav(bytes(raw), kind)
        assert audio.unwav(file) == (kind, 8000, bytes(raw))
    assert audio.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    with pytest.raises(ValueError):
        audio.unwav(b"RIFF....nope")


def test_audio_digests(docs, empty):
    want = collections.Counter()
    for r in docs.collect():
        text = (r.text or "").encode()
        pad = text + b" " * ((-len(text)) % 192 if text else 192)
        want[r.doc_id, len(text), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])] += 1
    got = audio.digests(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert audio.digests(empty).collect() == []
    stored = audio.store(docs.withColumn("payload", F.col("text").cast("binary")), "doc_id", "payload").first()
    assert audio.unwav(bytes(stored.pcm_wav))[0] == audio.PCM


# ---- language and toxicity -------------------------------------------------------------


LANGS = {"en": ["the", "house", "which", "with", "morning", "other"], "de": ["der", "schloss", "nicht", "mädchen", "zwischen"], "es": ["que", "señor", "mañana", "porque", "los"]}


def lang_rows(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(LANGS))
        text = " ".join("".join(r.sample(LANGS[lang], 2)) if r.random() < 0.5 else r.choice(LANGS[lang]) for _ in range(r.choice([15, 80])))
        rows.append((i, text, lang, "s", 1, 0.1, 1, 1))
    return rows + [(9000, None, "en", "s", 1, None, 1, 1), (9001, "", None, "s", 1, 0.0, 1, 1), (9002, "123 !!", "de", "s", 1, 0.0, 1, 1), (None, "the house", "en", "s", 0, 0.0, 1, 1)]


def test_language_id(spark, empty):
    df = spark.createDataFrame(lang_rows(1, 240), SCHEMA)
    usable = queries.id_crc() % 3 != 1
    learned = language_id.learn(df, usable)
    assert set(learned) == set(LANGS)
    got = language_id.classify(df, learned, prefix="p_").collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.p_lang_pred == r.lang for r in held) > 0.95 * len(held)
    assert all(r.p_lang_pred == "und" and r.p_rejected and r.p_score == 0 for r in got if r.doc_id in (9000, 9001, 9002))
    assert all(0 <= r.p_score <= 1 for r in got)
    with pytest.raises(ValueError):
        language_id.classify(df, learned)  # there is a column ``score``
    kept = language_id.kept(df, usable)
    assert kept.columns == df.columns and kept.filter("doc_id < 9000").count() > 235
    assert language_id.kept(empty, F.lit(True)).collect() == []


def test_dictionaries_hold_a_share_of_every_text():
    texts = [" ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}{'uvwxyz'[k * 6 // 9000]}" for k in range(9000)) for i in range(96)]
    own = language_id.contents({"xx": [*texts, "short and whole"]})["xx"]
    assert 0.99 * language_id.DICTIONARY_BYTES < len(own) <= language_id.DICTIONARY_BYTES and b"short and whole" in own
    for i in range(96):  # from the start and the end of each
        stem = f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"
        assert f"{stem}u".encode() in own and f"{stem}z".encode() in own
    assert language_id.spread(b"abc", 5) == b"abc" and len(language_id.spread(bytes(9999), 1234)) == 1234
    assert language_id.contents({"xx": [], "yy": ["", "12"]}, 10).keys() <= {"yy"}


def test_toxicity_scores_long_words_and_very_many_sentences():
    scorer = toxicity.Scorer({"rasca": 8.0}, -4.0)
    for n in (10, 300):
        score, spans = scorer("x" * n + "rascal")
        assert score > 0.9 and len(spans) == 1
    assert not any(len(w) >= toxicity.LONG for w in scorer.words)
    long = "abcde" * 30 + "xyzzy" * 20
    every = toxicity.Scorer({g: 0.5 for g in toxicity.grams(long)} | {"other": 9.0}, -4.0)
    assert every.word(long) == 0.5 * len(toxicity.grams(long))
    many = toxicity.Scorer({}, -13.0)("word. " * 100_000)[0]
    assert math.isclose(many, -math.expm1(-100_000 * math.log1p(math.exp(-13.0))), rel_tol=1e-6)


def test_toxicity_learns_sentences_from_document_labels(spark, empty):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = ". ".join(" ".join(words(r, 8)) for _ in range(6))
        if toxic:
            at = r.randrange(6)
            parts = text.split(". ")
            parts[at] += " " + r.choice(["scoundrel", "scoundrels", "rascal"])
            text = ". ".join(parts)
        rows.append((i, text, "en", "s", 1, 0.0, 1, 1))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", "s", 1, 0.0, 1, 1), (901, "", "en", "s", 1, 0.0, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.sample(df, marks, queries.id_crc() % 4 != 2))
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i].score >= 0.3) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[900].score == 0 == got[901].score
    text = {x[0]: x[1] for x in rows}
    named = [any(w in text[i][s.start : s.end] for w in ("scoundrel", "rascal")) for i in got for s in got[i].sentences]
    assert named and sum(named) > 0.9 * len(named)
    assert toxicity.train([])[0] == {} and toxicity.score(empty, model).collect() == []


# ---- warc -------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    r = random.Random(8)
    body = lambda n: "".join(r.choice("abc<>é\r\n") for _ in range(n))
    rows = [(i, "u", body(r.choice([0, 10, 4096, 4097, 50_000])), 1) for i in range(40)]
    rows += [(100 + i, "u", rows[i % 3][2], 1) for i in range(6)] + [(200, "u", None, 1), (201, "u", "", 1), (202, "u", "WARC/1.1\r\n\r\n0\r\n\r\n", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, keeper int").repartition(3)
    owner = {}
    for i, _, html, _ in rows:
        owner[html or ""] = max(owner.get(html or "", -1), i)
    want = set()
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        top = owner[html or ""]
        want.add((i, len(payload), sha, "response" if i == top else "revisit", None if i == top else top))
    got = warc.round_trip(spark, df, segment=3000)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(rows)
    none = spark.createDataFrame([], df.schema)
    assert warc.round_trip(spark, none).collect() == []


def test_warc_refuses_broken_records():
    assert warc.unchunked(warc.chunked(b"x" * 10_000)) == b"x" * 10_000 and warc.unchunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    with pytest.raises(ValueError):
        warc.join_segments([(1, b"a"), (3, b"b")], 2)
    with pytest.raises(ValueError):
        warc.join_segments([(1, b"a"), (2, b"b")], 3)


# ---- top-k --------------------------------------------------------------------------------


def test_topk_matches_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).round(2).tolist(), 1) for i in range(700)]
    rows += [(700 + i, rows[5][1], 1) for i in range(30)]
    rows += [(800, None, 1), (900, [1.0, None], 1), (1000, [float("nan")] * 8, 1), (1100, [], 1), (1200, [1.0, 2.0], 1), (1300, [float("inf")] * 8, 1), (None, [9.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in good:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:10]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    vectors = topk.quantised(df)
    assert {tuple(x) for x in topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10).collect()} == want
    assert {tuple(x) for x in topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10, candidates=200, queries=3).collect()} == want
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).collect() == []


# ---- url filter -----------------------------------------------------------------------------


def slow_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:n], rest[n:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, h, p in queries.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_url_filter(spark):
    r = random.Random(1)
    hosts = ["a.example.com", "www.example.com", "B.NET", "x.net", "good.org", "spam.org", "notcom", "com", "sub.www.example.com"]
    rows = [(i, r.choice(["http", "https"]) + "://" + r.choice(hosts) + r.choice(["", "/", "/en/1", "/es/2?x=1", "/fr/a#b", "?q"]), 1) for i in range(300)]
    rows += [(1000, None, 1), (1001, "no scheme", 1), (1002, "://", 1), (1003, "x://com/a://b", 1), (1004, "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule int").repartition(3)
    got = {x.page_id: x for x in url_filter.judge(df, queries.URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows:
        host, path, rule, verdict = slow_url(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0), queries.URL_RULES).collect() == []


def test_mined_rules_are_supported_and_confident(spark):
    rows = [(["h:a", "p:x"], "block")] * 30 + [(["h:a", "p:y"], "allow")] * 30 + [(["h:b", "p:x"], "block")] * 5
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9).collect()
    for rule in rules:
        fits = [v for t, v in rows if set(rule.tokens) <= set(t)]
        share = fits.count(rule.verdict) / len(fits)
        assert share >= 0.9 and abs(share - rule.confidence) < 1e-9 and rule.indexed in rule.tokens
    assert {tuple(x.tokens): x.verdict for x in rules}[("p:x",)] == "block"
    sets = spark.createDataFrame([(["h:c", "p:x"],), (["h:z"],)], "tokens array<string>")
    assert [x.mined for x in url_filter.mined_verdicts(sets, spark.createDataFrame(rules)).collect()] == ["block"]


# ---- mixing -----------------------------------------------------------------------------------


def test_share_out_gives_shortages_to_siblings_first():
    assert mixing.share_out(100, [(1, 10), (1, 1000), (2, 1000)]) == pytest.approx([10, 30, 60])
    leaves = {("d0", "en", "a"): 10, ("d0", "en", "b"): 1000, ("d1", "en", "c"): 1000}
    got = mixing.quotas(leaves, {("d0",): 0.5, ("d1",): 0.5}, 400, 1)
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 190, ("d1", "en", "c"): 200}
    got = mixing.quotas({("d0", "en", "a"): 10, ("d1", "en", "c"): 1000}, {}, 400, 2)
    assert got == {("d0", "en", "a"): 20, ("d1", "en", "c"): 380}
    assert mixing.quotas({}, {}, 10, 1) == {}


def test_mixing_prefixes(spark, empty):
    r = random.Random(11)
    rows = [(i, " ".join(words(r, r.randrange(30))), r.choice(["en", "de", None]), r.choice(["a", "b"]), 1, 0.0, 1, 1) for i in range(500)]
    rows += [(2, rows[2][1], rows[2][2], rows[2][3], 1, 0.0, 1, 1), (None, "w x y", "en", "a", 1, 0.0, 1, 1), (900, None, "en", None, 1, 0.0, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    domain = F.lit("d")
    for fraction in (0.0, 0.3, 1.4):
        leaves, narrow = mixing.plan(df, domain, {("d", "en"): 3.0, ("d", "de"): 1.0}, fraction=fraction, max_epochs=2.0, seed=5)
        got = mixing.copies(leaves, narrow, 5).select("doc_id", "_lang", "_source", "_tokens", "_copies", mixing.order_key(F.col("_whole"), 5).alias("key"), "_quota", "_total", "_whole").collect()
        assert len(got) == len(rows)
        for leaf in {(x._lang, x._source) for x in got}:
            own = sorted((x for x in got if (x._lang, x._source) == leaf), key=lambda x: x.key)
            quota, total, whole = own[0]._quota, own[0]._total, own[0]._whole
            taken = sum(x._tokens * x._copies for x in own)
            assert taken <= quota
            rest, run, want = quota - whole * total, 0, []
            for k in range(len(own)):
                run += own[k]._tokens
                peers = run + sum(y._tokens for y in own[k + 1 :] if y.key == own[k].key)
                want.append(whole + (peers <= rest and rest > 0))
            assert [x._copies for x in own if x._tokens] == [w for x, w in zip(own, want) if x._tokens]
    out = mixing.mixed(df, domain, {}, fraction=1.4, max_epochs=2.0)
    assert out.columns == df.columns and all((r["_lang"], r["_id"]) == (1, 1) for r in out.collect())
    assert mixing.mixed(empty, domain, {}, fraction=0.5).collect() == []


# ---- rules that hold at every size ---------------------------------------------------------


def test_substring_dedup_splits_hot_anchors(spark, monkeypatch):
    r = random.Random(21)
    common = words(r, 8)  # one gram in many different surroundings
    lead = [f"l{i}" for i in range(27)]
    rows = []
    for i in range(120):
        tail = [f"t{i}_{k}" for k in range(20)]
        rows.append((i, " ".join((lead[r.randrange(20) :] if i % 3 else [f"o{i}_{k}" for k in range(27)]) + common + (words(random.Random(i // 4), 27) if i % 2 else tail))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_removed(rows, 35)
    assert any(x[2] for x in want)
    assert collections.Counter(tuple(x) for x in substring_dedup.digests(df).collect()) == want
    monkeypatch.setattr(substring_dedup, "SAMPLED", 1)
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    hot = substring_dedup.hot_anchors(df)
    assert len(hot) and (np.diff(hot.astype(float)) > 0).all()
    counted = substring_dedup.contexts(df, hot=hot).groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert counted < substring_dedup.contexts(df).groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert collections.Counter(tuple(x) for x in substring_dedup.digests(df).collect()) == want


def test_factors_are_longest_from_their_start():
    spans = [{"first": 3, "mask": 0b0110}, {"first": 6, "mask": 0b1}, {"first": 20, "mask": 0b1}, {"first": 21, "mask": 0b1}]
    assert substring_dedup.factors(30, spans, 5) == [(4, 11), (20, 26)]
    assert np.flatnonzero(substring_dedup.covered(30, spans, 5)).tolist() == [*range(4, 11), *range(20, 26)]
    assert substring_dedup.factors(3, None, 5) == [] and not substring_dedup.covered(0, None).any()
    with pytest.raises(ValueError):
        substring_dedup.anchors(np.arange(100, dtype=np.uint64), 71)


def test_topk_is_exact_for_large_components(spark):
    rows = [(0, [1e6, 1e6, 1e6]), (1, [1e6, 1e6, 1e6]), (2, [1e6, 1e6, 1e6 + 0.001]), (3, [1e6, 1e6, -1e6]), (4, [0.5, 0.25, 0.125]), (5, [2e5, 1.0, 7e6])]
    rows += [(10 + i, [i / 7, -i / 3, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(whole[0], v)), i) for i, v in whole.items() if i))
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 100 == 0, 50).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [(i, -s) for s, i in want]
    assert 2**53 < -want[0][0] < 2**63 and len({s for s, _ in want}) == len(want)
    huge = spark.createDataFrame([(0, [1e10]), (1, [1e10]), (2, [-1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|OverflowError"):
        topk.top_k(topk.quantised(huge), F.col("vec_id") % 100 == 0).collect()


def test_numbers_are_no_letters():
    decide = language_id.Classifier({"de": b"der hund und die katze " * 50, "en": b"the dog and the cat " * 50})
    for text in ("½", "²", "①", "123 _ !", "", None, "́"):
        assert decide(text) == ("und", 0.0, True)
    assert decide("½ der hund")[0] == "de" and decide("é")[0] in ("de", "en")
    assert language_id.letters("A½b²c①d_é") == "a b c d é".encode()


def test_one_rule_for_texts_of_every_length():
    for n in (1, 7, 39, 400, 1023, 1024, 2047, 2048, 2049, 10_000):
        parts = language_id.cuts(bytes(i % 251 for i in range(n)))
        whole = -(-n // language_id.PIECE)
        assert sum(map(len, parts[:whole])) == n
        assert len(parts) - whole == max(0, min(language_id.CUTS, language_id.PIECE // n) - 1)


def test_language_sample_is_bounded_under_repeated_ids(spark):
    rows = [(i % 3, f"the house number {'abcdefghij'[i % 10]} {'klmnop'[i % 6]}" * (1 + i % 4), "en") for i in range(200)] + [(None, "der hund", "de")]
    learned = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(learned) == {"en"} and len(learned["en"]) < 3 * 120
    long = spark.createDataFrame([(1, "wort " * 200_000, "de")], "doc_id long, text string, lang string")
    assert len(language_id.learn(long, F.lit(True))["de"]) <= language_id.FETCHED * language_id.DICTIONARY_BYTES // language_id.ROWS + 1


def test_toxicity_sample_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, marks, F.lit(True))
    assert len(got) == 2 and got[0][1] == 1 and got[1] == ("a", 0)


def test_scorers_of_two_models_differ(spark):
    df = spark.createDataFrame([(1, "rascal"), (1, "rascal"), (None, ""), (2, None)], "doc_id long, text string").coalesce(1)
    low = {(x.doc_id, round(x.score, 3)) for x in toxicity.score(df, ({"^rascal$": -9.0}, -3.0)).collect()}
    high = {(x.doc_id, round(x.score, 3)) for x in toxicity.score(df, ({"^rascal$": 9.0}, -3.0)).collect()}
    assert low == {(1, 0.0), (None, 0.0), (2, 0.0)} and high == {(1, 0.998), (None, 0.0), (2, 0.0)}


def brute_score(text, weights, bias):
    clean = 1.0
    for part in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        found = {w for w in "".join(c if c.isalpha() else " " for c in part.lower()).split()}
        if found:
            z = bias + sum(weights.get(g, 0.0) for w in found for g in set(toxicity.grams(w)))
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_scores_equal_brute_force(spark):
    r = random.Random(13)
    rows = [(i, r.choice([" ", ". ", "! "]).join(words(r, r.randrange(1, 30)))) for i in range(60)]
    weights = {g: r.uniform(-2, 2) for _, t in rows for w in t.split() for g in toxicity.grams(w.lower()) if r.random() < 0.3}
    got = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), (weights, -2.0)).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(brute_score(text, weights, -2.0), abs=1e-9)


def slow_budget(leaves, weights, budget, epochs):
    """Pour tokens in small drops down the tree: each to the child that has got
    least for its weight among those below which there is room."""
    weight = lambda n: weights.get(n, weights.get(("*", *n[1:]), 1.0))
    got = dict.fromkeys(leaves, 0.0)

    def room(prefix):
        return any(got[p] < epochs * leaves[p] - 1e-9 and all(weight(p[: d + 1]) > 0 for d in range(len(prefix), len(p))) for p in leaves if p[: len(prefix)] == prefix)

    drop = budget / 4000
    for _ in range(4000):
        at = ()
        while at not in leaves:
            below = {p[: len(at) + 1] for p in leaves if p[: len(at)] == at}
            open_ = [n for n in below if weight(n) > 0 and room(n)]
            if not open_:
                return got
            at = min(open_, key=lambda n: (sum(got[p] for p in leaves if p[: len(n)] == n) / weight(n), n))
        got[at] += drop
    return got


def test_budgets_go_where_tokens_are():
    leaves = {("d", "a", "x"): 90, ("d", "a", "y"): 10, ("d", "b", "z"): 1000}
    got = mixing.quotas(leaves, {("d", "a", "x"): 0.0}, 100, 1)
    assert got == {("d", "a", "x"): 0, ("d", "a", "y"): 10, ("d", "b", "z"): 90}
    r = random.Random(4)
    for _ in range(25):
        leaves = {(f"d{r.randrange(3)}", r.choice("ab"), r.choice("xyz")): r.choice([0, 5, 50, 500]) for _ in range(8)}
        weights = {p[:d]: r.choice([0.0, 0.5, 1.0, 3.0]) for p in leaves for d in (1, 2, 3) if r.random() < 0.5}
        budget = r.choice([40, 300, 900])
        want, got = slow_budget(leaves, weights, budget, 2.0), mixing.quotas(leaves, weights, budget, 2.0)
        for p in leaves:
            assert abs(got[p] - want[p]) <= 1 + budget / 200, (leaves, weights, budget, got, want)


def test_archives_are_read_by_as_many_tasks_as_files(spark):
    files = spark.createDataFrame([(f"{i:032x}.warc.gz",) for i in range(20)], "file string").coalesce(1)
    dealt = warc.spread(files).select("file", F.spark_partition_id().alias("p")).collect()
    assert len(dealt) == 20 and len({x.p for x in dealt}) >= 15
    assert warc.spread(files.limit(0)).collect() == []
    assert warc.file_system("file:///tmp/x")[1] == "/tmp/x"


def test_warc_with_very_long_pages_null_ids_and_shuffled_keepers(spark, monkeypatch):
    rows = [(1, "é" * 700_000), (2, "é" * 700_000), (None, "x"), (None, "x"), (3, None), (3, ""), (4, ""), (5, "only")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    want = collections.Counter()
    for i, html in rows:
        same = [j for j, h in rows if (h or "") == (html or "") and j is not None]
        top = max(same, default=None)
        payload = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        refers = top if len([1 for _, h in rows if (h or "") == (html or "")]) > 1 and top is not None and i != top else None
        want[(i, len(payload), sha, "revisit" if refers is not None else "response", refers)] += 1
    assert collections.Counter(tuple(x) for x in warc.round_trip(spark, df).collect()) == want
    monkeypatch.setattr(warc, "KEEPER_ROWS", 0)  # a shuffled join instead of a broadcast
    assert collections.Counter(tuple(x) for x in warc.round_trip(spark, df).collect()) == want


def test_long_files_are_decoded_in_pieces(monkeypatch):
    raw = np.random.default_rng(5).integers(0, 256, 50 * audio.BLOCK, dtype=np.uint8)
    file = audio.wav(raw.tobytes(), audio.MULAW)
    want = audio.features(file, audio.adpcm_crcs([raw.tobytes()])[0])
    whole = audio.resample(audio.TABLES[audio.MULAW][raw])
    assert audio.unwav(audio.pcm_file(file)) == (audio.PCM, 16000, whole.astype("<i2").tobytes())
    mu, a = (np.abs(audio.TABLES[k][raw].astype(int)) for k in (audio.MULAW, audio.ALAW))
    adpcm = np.array([slow_adpcm(bytes(b)) for b in raw.reshape(-1, audio.BLOCK)], "<i2")
    assert want == (
        f"mulaw={mu.sum() // len(raw)}/{mu.max()};alaw={a.sum() // len(raw)}/{a.max()}"
        f";adpcm={zlib.crc32(adpcm.tobytes()):08x};pcm16k={zlib.crc32(whole.astype('<i2').tobytes()):08x}"
    )
    monkeypatch.setattr(audio, "PIECE", 1000)
    monkeypatch.setattr(audio, "GROUP_BYTES", 5 * audio.BLOCK + 7)
    parts = [raw.tobytes(), b"", raw[: 7 * audio.BLOCK].tobytes()]
    assert audio.features(file, audio.adpcm_crcs(parts)[0]) == want
    assert audio.adpcm_crcs(parts)[2] == zlib.crc32(adpcm[:7].tobytes()) and audio.adpcm_crcs([]) == []
    for to in (8000, 11025, 16000):
        pcm = np.arange(-4000, 4000, 3).astype(np.int16)
        n = np.arange(len(pcm) * to // 8000, dtype=np.int64) * 8000
        right = pcm[np.minimum(n // to + 1, len(pcm) - 1)].astype(int)
        left = pcm[n // to].astype(int)
        assert audio.resample(pcm, 8000, to).tolist() == (left + (right - left) * (n % to) // to).tolist()


def test_bpe_leaves_other_vocabularies_to_the_library(tmp_path, tokenizer):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    assert bpe.is_plain_byte_bpe(spec)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    assert not bpe.is_plain_byte_bpe(spec)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    coder, want = bpe.Encoder(str(other)), Tokenizer.from_file(str(other))
    text = "hello wide world " * 300
    assert coder.encode(text).tolist() == want.encode(text, add_special_tokens=False).ids != tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.decode(coder.encode(text)) == want.decode(want.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def brute_mined(examples, sets, support, confidence):
    """Every combination of items as a rule."""
    import itertools

    where = collections.defaultdict(set)
    for n, (tokens, _) in enumerate(examples):
        for t in tokens:
            where[t].add(n)
    item = {t: min(u for u in where if where[u] == where[t]) for t in where if len(where[t]) >= support * len(examples)}
    names = sorted(set(item.values()))
    out = {}
    for tokens in sets:
        own = {item[t] for t in tokens if t in item}
        best = None
        for size in range(1, len(names) + 1):
            for needed in itertools.combinations(names, size):
                fits = set.intersection(*(where[t] for t in needed))
                for verdict in ("allow", "block"):
                    n = sum(examples[k][1] == verdict for k in fits)
                    if set(needed) <= own and n >= support * len(examples) and n >= confidence * len(fits):
                        rank = (n / len(fits), n / len(examples), size, " ".join(needed), verdict)
                        best = max(best or rank, rank)
        if best:
            out[tuple(tokens)] = best[-1]
    return out


def test_mined_verdicts_match_brute_force(spark):
    r = random.Random(17)
    pool = ["h:a", "h:b", "p:x", "p:y", "q:z", "p:always", "p:twin"]
    pick = lambda: sorted({t for t in pool[:5] if r.random() < 0.5} | ({"p:always", "p:twin"} if r.random() < 0.4 else set()))
    examples = [(t, "block" if ("p:x" in t) != (r.random() < 0.1) else "allow") for t in (pick() for _ in range(120))]
    sets = [list(t) for t in {tuple(pick()) for _ in range(40)} | {("p:twin",), ("other",), ()}]
    df = spark.createDataFrame(examples, "tokens array<string>, verdict string")
    asked = spark.createDataFrame([(s,) for s in sets], "tokens array<string>")
    for support, confidence in ((0.05, 0.8), (0.2, 0.6)):
        got = {tuple(x.tokens): x.mined for x in url_filter.verdicts(df, asked, support, confidence).collect()}
        assert got == brute_mined(examples, sets, support, confidence)


def test_equal_tokens_are_one_item(spark):
    many = [f"p:t{i}" for i in range(40)]  # 2**40 combinations of them
    df = spark.createDataFrame([(many, "block")] * 30 + [(["h:b"], "allow")] * 30, "tokens array<string>, verdict string")
    asked = spark.createDataFrame([(["p:t7"],), (["h:b"],)], "tokens array<string>")
    assert {x.tokens[0]: x.mined for x in url_filter.verdicts(df, asked).collect()} == {"p:t7": "block", "h:b": "allow"}
