"""Sequences: k-mers, base-4 indexes, complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base digits of a k-mer index, and the complement of each IUPAC letter.
BASES, DIGITS = "ATGC", "0123"
LETTERS, COMPLEMENTS = "ACGTUYRKMBDHVNWS", "TGCAARYMKVHDBNWS"


def kmers(sequence: Column, k: int) -> Column:
    """Array of all overlapping k-mers; empty for shorter sequences."""
    last = F.length(sequence) - (k - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_index(kmer: Column) -> Column:
    """Base-4 number of a k-mer, first base most significant; a letter that is no base counts as A."""
    digits = F.translate(F.regexp_replace(kmer, "[^ATGC]", "A"), BASES, DIGITS)
    return F.conv(digits, 4, 10).cast("int")


def core_index(kmer: Column, size: int = 5) -> Column:
    """Index of a 9-mer's middle bases, plus one."""
    return kmer_index(F.substring(kmer, 3, size)) + 1


def residual_index(kmer: Column) -> Column:
    """Index of a 9-mer's outer two bases on both sides, plus one."""
    return kmer_index(F.concat(F.substring(kmer, 1, 2), F.substring(kmer, 8, 2))) + 1


def complement(sequence: Column) -> Column:
    return F.translate(sequence, LETTERS, COMPLEMENTS)


def reverse_complement(sequence: Column, check: bool = True) -> Column:
    """Reverse complement; letters outside the IUPAC code raise unless ``check`` is off."""
    out = F.reverse(complement(sequence))
    if not check:
        return out
    return F.when(sequence.rlike("[^ACGTUYRKMBDHVNWS]"), F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), sequence)).cast("string")).otherwise(out)


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """(kmer_index, kmer) of all 4^k k-mers, generated where they are used."""
    n = F.col("kmer_index")
    digits = F.lpad(F.conv(n.cast("string"), 10, 4), k, "0")
    return spark.range(4**k).select(F.col("id").cast("int").alias("kmer_index")).select("kmer_index", F.translate(digits, DIGITS, BASES).alias("kmer"))


def defined(sequence: Column) -> Column:
    """Whether a sequence is bases only."""
    return sequence.rlike("^[ATGC]+$")


def base_count(sequence: Column, base: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, base, ""))


def thymidine_positions(sequence: Column, half_window: int) -> Column:
    """0-based places of T at least twice the half window away from both ends."""
    margin = 2 * half_window
    last = F.length(sequence) - margin - 1
    places = F.when(last >= margin, F.sequence(F.lit(margin), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(sequence, i + 1, F.lit(1)) == "T")


def padded_signal(samples: Column, depth: int = 20) -> Column:
    """Samples cut or zero-padded to a fixed depth."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), depth)), 1, depth)


def is_thymidine(kmer: Column) -> Column:
    """Whether a 9-mer's centre is T."""
    return F.substring(kmer, 5, 1) == "T"
