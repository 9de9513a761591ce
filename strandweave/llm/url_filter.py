"""URL filtering by host/path rules, and by association rules mined from them.

Listed rules decide where they fit, the longest first. The urls they decide
are labelled examples: Spark's FP-growth mines which combinations of url tokens
(host labels, path words, query keys) imply a verdict, rules below a support or
confidence are pruned, and the rest judge the urls that no listed rule fits.
Each mined rule is indexed under its rarest token; a url looks up its tokens
and keeps the rules whose other tokens it has too.

Tokens that stand in the very same labelled urls imply the same, so they are one
item when rules are mined (n of them would make 2**n combinations of equal
support), and a url has the item if it has one of them.

Edge cases: a null url or one without ``://`` has empty host and path and no
tokens; no mined rule fits, nothing labelled, or an empty table: the default
verdict; equal confidence: higher support, then more items, then text order; urls
of any length are parsed whole; repeated rows are judged alike and kept; columns
other than ``page_id`` and ``url`` are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import broadcast_if_small, persisted

#: (verdict, host, path); a rule fits its host and every subdomain.
Rule = tuple[str, str, str]
SUPPORT, CONFIDENCE, DEFAULT = 0.01, 0.8, "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def listed(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens, sorted: digits are one sign, so ids are no tokens."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(
        F.split(F.translate(path, UPPER, LOWER), r"[^a-z0-9]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0"))
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    every = F.filter(F.concat(labels, words, keys), lambda x: F.length(x) > 2)
    return F.coalesce(F.array_sort(F.array_distinct(every)), F.array().cast("array<string>"))


def items(examples: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(token, item): frequent tokens, each with the first of those that stand in
    the same examples. At most as many as the tokens of one example over the
    support. Examples are told apart by their tokens' hash and their count."""
    sets = examples.groupBy("tokens").agg(F.count("*").alias("n"))
    n = sets.agg(F.sum("n")).first()[0] or 0
    by = [F.xxhash64(F.lit(i), "tokens") for i in (0, 1)]
    marked = sets.select("n", F.explode("tokens").alias("token"), by[0].alias("h0"), by[1].alias("h1"))
    found = marked.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1")).filter(F.col("n") >= support * n)
    first = found.groupBy("n", "h0", "h1").agg(F.min("token").alias("item"))
    return found.join(first, ["n", "h0", "h1"]).select("token", "item")


def with_items(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the sorted ``items`` of their ``tokens``. What is known is one row,
    a map whose size the support bounds, and goes to every task: a token set with a
    third of all rows is not dealt to one."""
    one = F.lit(1).alias("_one")
    table = known.agg(F.map_from_entries(F.collect_list(F.struct("token", "item"))).alias("_known")).select("_known", one)
    found = F.filter(F.transform("tokens", lambda t: F.try_element_at("_known", t)), lambda x: x.isNotNull())
    return rows.select("*", one).join(F.broadcast(table), "_one").withColumn("items", F.array_sort(F.array_distinct(found))).drop("_one", "_known")


def mine(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, indexed) from (tokens, verdict)."""
    spark = examples.sparkSession
    empty = "tokens array<string>, verdict string, confidence double, support double, indexed string"
    if examples.isEmpty():
        return spark.createDataFrame([], empty)
    items = examples.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    fitted = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = fitted.associationRules.filter(F.col("consequent")[0].startswith("=")).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"), "confidence", "support"
    )
    rules = rules.filter(F.forall("tokens", lambda x: ~x.startswith("=")) & (F.size("tokens") > 0))
    single = fitted.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (
        rules.withColumn("token", F.explode("tokens")).join(single, "token")
        .groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("indexed"))
    )
    return rarest


def mined_verdicts(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined) for the distinct token sets that some rule fits."""
    looked_up = sets.withColumn("indexed", F.explode("tokens"))
    rules = rules.withColumnRenamed("tokens", "needed")
    fits = looked_up.join(rules, "indexed").filter(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.max_by("verdict", F.struct("confidence", "support", F.size("needed"), F.array_join("needed", " "), "verdict"))
    return fits.groupBy("tokens").agg(best.alias("mined"))


def verdicts(examples: DataFrame, sets: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, mined) for the distinct token sets that rules mined from the
    examples (tokens, verdict) fit."""
    known = persisted(items(examples, support))
    rules = mine(with_items(examples, known).select(F.col("items").alias("tokens"), "verdict"), support, confidence)
    named = with_items(sets, known).filter(F.size("items") > 0)
    mined = mined_verdicts(named.select(F.col("items").alias("tokens")).distinct(), rules)
    return named.join(mined.withColumnRenamed("tokens", "items"), "items").select("tokens", "mined")


def judge(
    pages: DataFrame, rules: Sequence[Rule], support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Token sets are made distinct before they are shuffled and matched: a host
    with a third of all urls is a few rows by then.
    """
    host, path = host_and_path()
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "url")
    rule, verdict = listed(rules, F.col("host"), F.col("path"))
    parsed = parsed.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"),
        tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"),
    )
    examples = parsed.filter(F.col("listed").isNotNull()).select("tokens", F.col("listed").alias("verdict"))
    found = verdicts(examples, parsed.filter(F.col("listed").isNull()).select("tokens").distinct(), support, confidence)
    # written first: the join's sides are then plain tables, and a hot set can be split
    out = parsed.join(broadcast_if_small(persisted(found)), "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"))
