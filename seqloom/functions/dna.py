"""Column functions on nucleotide sequences; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
MAX_QUAL = 93


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def dna_of_text(text: Column) -> Column:
    """Letters a-z of a text dealt over the four bases; other characters go."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def tokenize(base: Column) -> Column:
    """A 0, C 1, G 2, T 3 in either case; -1 for anything else."""
    return F.when(F.length(base) == 1, F.instr(F.lit(BASES), F.upper(base)) - 1).otherwise(-1)


def tokens(seq: Column) -> Column:
    """Array of tokens; an error names a base that is none."""
    bad = F.regexp_extract(seq, "[^ACGTacgt]", 0)
    each = F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), tokenize)
    return F.when(bad != "", F.raise_error(F.concat(F.lit("not a nucleotide: "), bad)).cast("array<int>")).otherwise(each)


def complement(seq: Column) -> Column:
    """Complement of known bases, in upper case; other characters stay."""
    return F.translate(seq, "ACGTacgt", "TGCATGCA")


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def compose(inner: Column, outer: Column) -> Column:
    """Coordinates of ``inner``, an interval on what ``outer`` describes, on outer's own source. 1-based, closed."""
    turned = outer["rev"]
    start = F.when(turned, outer["end"] - inner["end"] + 1).otherwise(inner["start"] + outer["start"] - 1)
    end = F.when(turned, outer["end"] - inner["start"] + 1).otherwise(inner["end"] + outer["start"] - 1)
    both = F.struct(outer["name"].alias("name"), start.alias("start"), end.alias("end"), (inner["rev"] != turned).alias("rev"))
    return F.when(outer.isNull(), inner).otherwise(both)


def kmer_encode(kmer: Column) -> Column:
    """Base-4 number, first base most significant (up to 31 bases)."""
    return F.conv(F.translate(F.upper(kmer), BASES, "0123"), 4, 10).cast("long")


def kmer_decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES)


def number_of_kmers(k: int) -> Column:
    return F.lit(4**k).cast("long")


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none if the sequence is shorter. Cut from the bytes, where a place is found without counting."""
    each = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - k + 1), lambda i: F.substring(b, i, F.lit(k)).cast("string"))
    return F.when(F.length(seq) >= k, let(F.encode(seq, "UTF-8"), each)).otherwise(F.array().cast("array<string>"))


def commonest_base(seq: Column) -> Column:
    """The most frequent base; of equals the first in ACGT."""
    counted = F.array(*(F.struct((F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit("")))).alias("n"), F.lit(-i).alias("first"), F.lit(b).alias("base")) for i, b in enumerate(BASES)))
    return F.array_max(counted)["base"]


def context_kmers(seq: Column, k: int) -> Column:
    """For each position the k bases that end there; before the start stands the commonest base. For k = 0 empty strings."""
    if k == 0:
        return F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.lit(""))
    padded = F.concat(F.repeat(commonest_base(seq), F.lit(k - 1)), seq)
    return F.when(F.length(seq) > 0, let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.substring(p, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def qual_scores(qual: Column) -> Column:
    """Scores 0 to 93 of quality characters."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.least(F.lit(MAX_QUAL), F.greatest(F.lit(0), F.ascii(c) - 33)))


def qual_string(scores: Column) -> Column:
    return F.array_join(F.transform(scores, lambda q: F.char(F.least(F.lit(MAX_QUAL), F.greatest(F.lit(0), q)) + 33)), "")


def has_qual(seq: Column, qual: Column) -> Column:
    return F.coalesce(F.length(qual) == F.length(seq), F.lit(False))


def ungap(row: Column) -> Column:
    return F.regexp_replace(row, "[-.]", "")


def ungap_qual(row: Column, qual: Column) -> Column:
    """Characters of ``qual`` where ``row`` has no gap."""
    pairs = F.arrays_zip(F.split(row, "").alias("r"), F.split(qual, "").alias("q"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: ~p["r"].isin("-", ".", "")), lambda p: p["q"]), "")


def consensus(a: Column, b: Column) -> Column:
    """The base where rows agree, ``:`` where they differ, ``-`` at a gap."""
    gap = lambda c: c.isin("-", ".")
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(gap(x) | gap(y), "-").when(x == y, x).otherwise(":")), "")


def cigar(ref: Column, read: Column, *, op_first: bool = False) -> Column:
    """Run lengths of M, D and I; columns that are gaps in both rows don't count."""
    gap = lambda c: c.isin("-", ".")
    ops = F.zip_with(F.split(ref, ""), F.split(read, ""), lambda x, y: F.when(gap(x) & gap(y), "").when(gap(y), "D").when(gap(x), "I").otherwise("M"))
    start = F.struct(F.lit("").alias("op"), F.lit(0).alias("n"), F.lit("").alias("out"))
    one = lambda s: F.when(s["n"] == 0, F.lit("")).otherwise(F.concat(s["op"], s["n"].cast("string")) if op_first else F.concat(s["n"].cast("string"), s["op"]))
    step = lambda s, op: F.when(s["op"] == op, F.struct(s["op"].alias("op"), (s["n"] + 1).alias("n"), s["out"].alias("out"))).otherwise(F.struct(op.alias("op"), F.lit(1).alias("n"), F.concat(s["out"], one(s)).alias("out")))
    return F.aggregate(F.filter(ops, lambda o: o != ""), start, step, lambda s: F.concat(s["out"], one(s)))


def log_sum_exp(a: Column, b: Column) -> Column:
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def log_sum_exp_agg(x: Column) -> Column:
    """log of the sum of exponentials over a group; null for an empty one."""
    all_x = F.array_agg(x)
    return F.max(x) + F.log(F.aggregate(F.transform(all_x, lambda v: F.exp(v - F.array_max(all_x))), F.lit(0.0), lambda s, v: s + v))


def nb_mean(p: Column, r: Column) -> Column:
    return r * (1 - p) / p


def nb_variance(p: Column, r: Column) -> Column:
    return r * (1 - p) / (p * p)
