"""Language identification by compression with per-language dictionaries.

A text is cut in pieces, and each is compressed with each language's zstandard
raw-content dictionary, behind a stretch of that language which makes the coder's
letter statistics those of the language from the first byte on. The language whose
dictionary makes the sum smallest wins. Sizes are whole bytes, so of a short text
further cuts are weighed too, until PIECE bytes have been seen: one rule for texts
of every length. Where the two smallest sums are almost equal the answer is rejected.

Edge cases: a null text, an empty one or one without a letter (Unicode's category
L: digits, fractions and circled numbers are none) is ``und`` with score 0 and
rejected; equal sizes go to the language first in order; rows with null ``lang`` or
null id are never learned; of an id with several texts in one language one text is
learned from; a table without labelled rows gives ``und`` everywhere; one language
alone is always the answer; a very long text is compressed piece by piece; repeated
rows get equal answers; other columns are not looked at, and names of the new ones
that clash are refused; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm.common import map_batches, prepare

#: Sample bounds: rows taken for each language, and bytes of each dictionary.
ROWS, DICTIONARY_BYTES = 96, 64_000
#: Bytes of a piece of a long text in a dictionary, at least.
STRIP = 200
#: Texts are compressed in pieces of this many bytes, so that the dictionary
#: counts as much at the end of a long text as at its start.
PIECE = 2048
#: Bytes of the language that every piece is compressed behind, and how many cuts
#: of a last piece are weighed at most.
LEAD, CUTS = 1000, 9
#: Relative gap between the two smallest sizes below which a text is rejected.
MARGIN = 0.003
#: Characters of a sampled text that are fetched, as a multiple of its even share.
FETCHED = 8
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """Lower-cased letter runs with single spaces: what the coders see."""
    return _OTHER.sub(" ", text.lower()).encode()


def learn(documents: DataFrame, usable: Column, rows: int = ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from at most ``rows`` texts a language.

    Ids are chosen first from two narrow columns; of the chosen texts (at most
    ``rows`` times the number of languages) at most FETCHED * size / rows characters
    each, spread over the text, are then fetched: about half a megabyte a language. A
    dictionary has at most ``size`` bytes; every chosen text has a share in it.
    """
    labelled = documents.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(order))
    chosen = ids.filter(F.col("n") <= rows).select("doc_id", "lang").distinct()
    found = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).filter(F.length("text") > 0)
    one = found.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    most = FETCHED * size // rows

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column(0), "lang": batch.column(1), "text": [spread(t, most) for t in batch.column(2).to_pylist()]}

    fetched = map_batches(one, (F.col("doc_id").cast("long"), "lang", "text"), run, "doc_id long, lang string, text string")
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in fetched.collect():
        texts.setdefault(r.lang, []).append((r.doc_id, r.text))
    return contents({k: [t for _, t in sorted(v)] for k, v in sorted(texts.items())}, size)


def contents(texts: dict[str, list[str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Each language's dictionary; lines met in several languages are left out."""
    langs: dict[str, set[str]] = {}
    for lang, own in texts.items():
        for text in own:
            for line in text.split("\n"):
                langs.setdefault(line, set()).add(lang)
    out = {}
    for lang, own in texts.items():
        seen = [letters("\n".join(x for x in text.split("\n") if len(langs[x]) == 1)) for text in own]
        share, left = {}, size
        for n, i in enumerate(sorted(range(len(seen)), key=lambda i: len(seen[i]))):  # what short texts leave is for longer ones
            share[i] = min(len(seen[i]), left // (len(seen) - n))
            left -= share[i]
        out[lang] = b"".join(spread(text, share[i]) for i, text in enumerate(seen))
    return {k: v for k, v in out.items() if v}


def spread[T: (str, bytes)](data: T, size: int) -> T:
    """``size`` bytes (or characters) of a text, in pieces of STRIP bytes or more that are spread
    evenly from its start to its end; a shorter text whole."""
    if len(data) <= size:
        return data
    n = max(1, size // STRIP)
    cuts = [size * i // n for i in range(n + 1)]
    starts = [(len(data) - size) * i // max(1, n - 1) for i in range(n)]
    return data[:0].join(data[at + a : at + b] for at, a, b in zip(starts, cuts, cuts[1:]))


def cuts(data: bytes) -> list[bytes]:
    """A text's pieces, and cuts of the last one (tails and heads that grow shorter
    by eighths) until they and the text have PIECE bytes or CUTS are made."""
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    last = pieces[-1]
    for i in range(1, min(CUTS, PIECE // len(data))):
        size = len(last) - len(last) * ((i + 1) // 2) // 8
        pieces.append(last[len(last) - size :] if i % 2 else last[:size])
    return pieces


class Classifier:
    """Compresses with every dictionary; made once for each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = []
        for lang, content in sorted(dictionaries.items()):
            params = zstandard.ZstdCompressionParameters(
                window_log=17, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=8,
                strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False,
            )
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=params)
            coder = zstandard.ZstdCompressor(dict_data=shared, compression_params=params)
            lead = content[-LEAD:] + b" "
            self.coders.append((lang, coder, lead, len(coder.compress(lead))))

    def __call__(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        if not text or not self.coders or not _LETTER.search(text):
            return "und", 0.0, True
        pieces = cuts(letters(text))
        sizes = [max(1, sum(len(coder.compress(lead + p)) - alone for p in pieces)) for _, coder, lead, alone in self.coders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = order[0]
        if len(sizes) == 1:
            return self.coders[best][0], 1.0, False
        gap = (sizes[order[1]] - sizes[best]) / sizes[order[1]]
        return self.coders[best][0], 1 - 0.5 * 2 ** (-gap / 0.02), gap < margin


def classify(documents: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, prefix: str = "") -> DataFrame:
    """Add lang_pred, score (0 to 1) and rejected to every row, in one narrow
    stage; the dictionaries' size is bounded by ``learn``. ``prefix`` goes before
    the new names, for tables that have such columns already."""
    prepare(documents.sparkSession)
    names, text_at = documents.columns, documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Classifier(dictionaries)
        for batch in batches:
            got = [decide(t, margin) for t in batch.column(text_at).to_pylist()]
            pred, score, rejected = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*names, *new],
            )

    new = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    if clash := set(new) & set(names):
        raise ValueError(f"columns {sorted(clash)} are made here; give a prefix")
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, k) for c, k in zip(new, kinds))])
    return documents.mapInArrow(run, schema)


def kept(documents: DataFrame, usable: Column, margin: float = MARGIN) -> DataFrame:
    """The rows whose language is told, with the table's columns."""
    rows = classify(documents, learn(documents, usable), margin, prefix="__lid_")
    return rows.filter(~F.col("__lid_rejected")).select(*[F.col(f"`{c}`") for c in documents.columns])
