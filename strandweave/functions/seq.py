"""Sequence functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes, what each may stand for, and complements.
BASES, PAIRED = "ACGTN", "TGCAN"
IUPAC, IUPAC_PAIRED = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- strings ---------------------------------------------------------------


def complement(c):
    return F.translate(col(c), BASES, PAIRED)


def reverse_complement(c):
    return F.reverse(complement(c))


def complement_iupac(c):
    return F.translate(col(c), IUPAC, IUPAC_PAIRED)


def reverse_complement_iupac(c):
    return F.reverse(complement_iupac(c))


def prefix(c, n: int):
    return F.substring(col(c), 1, n)


def suffix(c, n: int):
    return F.right(col(c), F.lit(n))


def is_base(c):
    return col(c).rlike("^[ACGT]$")


def is_unambiguous(c):
    return col(c).rlike("^[ACGT]$")


def is_ambiguous(c):
    return col(c).rlike("^[RYSWKMBDHVN]$")


def is_iupac(c):
    return col(c).rlike("^[ACGTRYSWKMBDHVN]$")


def possible_bases(c):
    """The bases an IUPAC code stands for, in alphabetical order."""
    pairs = [F.lit(x) for kv in IUPAC_BASES.items() for x in (kv[0], "".join(sorted(kv[1])))]
    return F.element_at(F.create_map(*pairs), col(c))


def letters(c):
    """Array of characters; empty for the empty string."""
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def hamming(a, b):
    """Differences on the common prefix of two strings."""
    n = F.least(F.length(col(a)), F.length(col(b)))
    differ = F.zip_with(
        letters(F.substring(col(a), F.lit(1), n)), letters(F.substring(col(b), F.lit(1), n)), lambda x, y: (x != y).cast("int")
    )
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def diff_string(a, b):
    """``.`` where the common prefix agrees, else the first string's letter."""
    n = F.least(F.length(col(a)), F.length(col(b)))
    marks = F.zip_with(
        letters(F.substring(col(a), F.lit(1), n)), letters(F.substring(col(b), F.lit(1), n)),
        lambda x, y: F.when(x == y, ".").otherwise(x),
    )
    return F.array_join(marks, "")


def shared_prefix(a, b):
    """Length of the longest common prefix."""
    n = F.least(F.length(col(a)), F.length(col(b)))
    first = F.array_position(
        F.zip_with(
            letters(F.substring(col(a), F.lit(1), n)), letters(F.substring(col(b), F.lit(1), n)), lambda x, y: x != y
        ), True,
    )
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def kmers(c, k: int):
    """All substrings of length k, in order; empty where the string is shorter."""
    s = col(c)
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>")
    )


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def dust_score(c):
    """Low-complexity score over 3-mers; the last 3-mer is left out, as the
    published scores have it: sum of n(n-1)/2 over 3-mers, by length - 2."""
    s = col(c)
    n = F.length(s)
    used = F.when(n > 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
    used = F.coalesce(used, F.array().cast("array<string>"))
    pairs = F.aggregate(
        F.array_distinct(used), F.lit(0).cast("long"),
        lambda acc, x: acc + _pairs(F.size(F.filter(used, lambda y: y == x))),
    )
    return F.when(n < 3, F.lit(0.0)).otherwise(pairs / (n - 2).cast("double"))


def homopolymer_length(c):
    """Length of the run of equal characters that the string starts with."""
    return F.length(F.regexp_extract(col(c), r"^(.)\1*", 0))


def contains_primer(c, primers: list[str]):
    out = F.lit(False)
    for p in primers:
        out = out | F.contains(col(c), F.lit(p))
    return out


def unquote(c):
    return F.regexp_replace(col(c), "^'(.*)'$", "$1")


def split_key_value(c, sep: str = ":"):
    """(key, value) around the first separator."""
    s = col(c)
    at = F.instr(s, sep)
    return F.struct(
        F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s).alias("key"),
        F.when(at > 0, F.substring(s, at + 1, F.length(s))).alias("value"),
    )


# ---- read pairs and paths --------------------------------------------------


def pair_basename(c):
    """A read's name up to its last slash; the whole name without one."""
    return F.regexp_replace(col(c), "/[^/]*$", "")


def pair_index(c):
    """0 for the first of a pair, 1 for the second, null for neither."""
    last = F.right(col(c), F.lit(1))
    return F.when(last.isin("1", "A", "f"), 0).when(last.isin("2", "B", "r"), 1)


def pair_id(c):
    """The name of the other read of the pair; empty if it is not in a pair."""
    last = F.right(col(c), F.lit(1))
    other = F.concat(F.substring(col(c), F.lit(1), F.length(col(c)) - 1), F.translate(last, "12ABfr", "21BArf"))
    return F.when(last.rlike("[12ABfr]"), other).otherwise("")


def file_extension(c):
    return F.regexp_extract(col(c), r"\.([^./]*)$", 1)


def strip_extension(c):
    return F.regexp_replace(col(c), r"\.[^./]*$", "")


def strip_directory(c):
    return F.regexp_extract(col(c), r"[^/]*$", 0)


def is_gzip(c):
    return file_extension(c) == "gz"


def is_fastq(c):
    base = F.when(is_gzip(c), strip_extension(c)).otherwise(col(c))
    return file_extension(base).isin("fastq", "fq")


# ---- CIGAR -----------------------------------------------------------------


def expand_cigar(c):
    """``3M1D`` as ``MMMD``."""
    ops = F.regexp_extract_all(col(c), F.lit(r"([0-9]+[A-Z=])"), F.lit(1))
    return F.array_join(F.transform(ops, lambda o: F.repeat(F.right(o, F.lit(1)), F.substring(o, F.lit(1), F.length(o) - 1).cast("int"))), "")


def compact_cigar(c):
    """``MMMD`` as ``3M1D``."""
    runs = F.regexp_extract_all(col(c), F.lit(r"((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def unpad(c, gap: str = "-"):
    return F.replace(col(c), F.lit(gap), F.lit(""))


# ---- positions -------------------------------------------------------------


def strand(text):
    """True on the reverse strand (odd texts)."""
    return col(text).bitwiseAND(1) == 1


def contig_of(text):
    return F.shiftright(col(text), 1)


def flip(text, offset, length):
    """The same base on the other strand of a contig of this length."""
    return F.struct(
        col(text).bitwiseXOR(F.lit(1)).alias("text"), (col(length) - col(offset) - 1).alias("offset"),
    )


def contig_offset(text, offset, length):
    """1-based offset from the left of the forward strand."""
    return F.when(strand(text), col(length) - col(offset)).otherwise(col(offset) + 1)


def base_id(cumulative, contig_offset_):
    return col(cumulative) + col(contig_offset_) - 1


def base_name(contig, contig_offset_):
    return F.concat(F.lit("N"), col(contig).cast("string"), F.lit("B"), col(contig_offset_).cast("string"))


def local_shift(offset, by):
    """A place so many letters on along its own text."""
    return col(offset) + by


def global_shift(text, offset, by):
    """A place so many letters on along the forward strand."""
    return F.when(strand(text), col(offset) - by).otherwise(col(offset) + by)


def is_consistent(text, offset, other_text, other_offset, by):
    """Is the other place so many letters on in the same text?"""
    return (col(text) == col(other_text)) & (col(offset) + by == col(other_offset))


def text_position(contig, contig_offset_, backwards, length):
    """Inverse of ``contig_offset``: the position on the wanted strand."""
    rev = col(backwards).cast("boolean")
    return F.struct(
        (F.shiftleft(col(contig), 1) + rev.cast("int")).alias("text"),
        F.when(rev, col(length) - col(contig_offset_)).otherwise(col(contig_offset_) - 1).alias("offset"),
    )


def pack_side(coordinate, face):
    """A coordinate and a face bit in one 64-bit number."""
    return F.shiftleft(col(coordinate), 1).bitwiseOR(col(face).cast("long"))


def unpack_side(side):
    return F.struct(F.shiftrightunsigned(col(side), 1).alias("coordinate"), (col(side).bitwiseAND(1) == 1).alias("face"))


def side_order(coordinate, face):
    """A key by which sides sort: the coordinate, then LEFT before RIGHT."""
    return F.struct(col(coordinate).alias("coordinate"), (col(face) == "RIGHT").alias("right"))


def opposite_face(face):
    """LEFT for RIGHT and RIGHT for LEFT."""
    return F.when(col(face) == "LEFT", "RIGHT").when(col(face) == "RIGHT", "LEFT")


def disambiguate(left_coordinate, left_face, right_coordinate, right_face):
    """One side from a left and a right mapping: both must be opposite faces of
    one base; a lone right one is flipped; disagreement is null."""
    lc, lf, rc, rf = map(col, (left_coordinate, left_face, right_coordinate, right_face))
    agree = (lc == rc) & (lf != rf)
    one = F.struct(lc.alias("coordinate"), lf.alias("face"))
    other = F.struct(rc.alias("coordinate"), opposite_face(rf).alias("face"))
    return F.when(lc.isNotNull() & rc.isNotNull(), F.when(agree, one)).when(lc.isNotNull(), one).when(rc.isNotNull(), other)


# ---- intervals, matches, overlaps ------------------------------------------


def interval_length(start, end):
    """Inclusive ends."""
    return col(end) - col(start) + 1


def intersects(s1, e1, s2, e2):
    return (col(s1) <= col(e2)) & (col(s2) <= col(e1))


def translate_coordinate(x, s1, s2, reverse, length2):
    """Carry a coordinate of one read over a match to the other read."""
    ahead = col(s2) + (col(x) - col(s1))
    return F.when(col(reverse), col(length2) - 1 - ahead).otherwise(ahead)


def complement_interval(start, end, length):
    """The part of a read that a match leaves at the side it does not reach."""
    left = F.struct(F.lit(0).cast("long").alias("start"), (col(start) - 1).cast("long").alias("end"))
    right = F.struct((col(end) + 1).cast("long").alias("start"), (col(length) - 1).cast("long").alias("end"))
    return F.when(col(start) > 0, left).otherwise(right)


def is_containment(s1, e1, l1, s2, e2, l2):
    """Does the overlap use up either read wholly?"""
    return ((col(s1) == 0) & (col(e1) == col(l1) - 1)) | ((col(s2) == 0) & (col(e2) == col(l2) - 1))


# ---- qualities and statistics ----------------------------------------------


def phred(c, offset: int = 33):
    return F.ascii(col(c)) - offset


def phred_to_probability(q):
    return F.pow(F.lit(10.0), -col(q) / 10.0)


def probability_to_phred(p):
    return F.round(-10.0 * F.log10(col(p))).cast("int")


def log_factorial(n):
    """ln n!, as a sum of logarithms."""
    n = col(n).cast("int")
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))).otherwise(0.0)


def log_poisson(k, mean):
    return col(k) * F.log(col(mean)) - col(mean) - log_factorial(k)


def log_binomial(k, n, p):
    return log_factorial(n) - log_factorial(k) - log_factorial(col(n) - col(k)) + col(k) * F.log(col(p)) + (col(n) - col(k)) * F.log(1 - col(p))


def log_beta(a, b):
    """ln B(a, b) of whole numbers."""
    return log_factorial(col(a) - 1) + log_factorial(col(b) - 1) - log_factorial(col(a) + col(b) - 1)


def log_beta_binomial(k, n, a, b):
    return (
        log_factorial(n) - log_factorial(k) - log_factorial(col(n) - col(k))
        + log_beta(col(k) + col(a), col(n) - col(k) + col(b)) - log_beta(a, b)
    )


def required_support(quality, least: int = 3, cutoff: int = 20):
    """Support a base needs to be trusted: less if its quality is high."""
    return F.when(col(quality) >= cutoff, least).otherwise(least + 1)


def vcf_class(ref, alt):
    """SUB, INS, DEL or COMPLEX, by lengths and shared prefix."""
    r, a = col(ref), col(alt)
    same = F.length(r) == F.length(a)
    return (
        F.when(same, "SUB")
        .when((F.length(r) > F.length(a)) & F.startswith(r, a), "DEL")
        .when((F.length(r) < F.length(a)) & F.startswith(a, r), "INS")
        .otherwise("COMPLEX")
    )
