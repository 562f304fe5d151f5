"""Column functions of sequences. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop codons read forwards and backwards, and poly-A signals.
STOPS = ("TAA", "TAG", "TGA")
REVERSE_STOPS = ("TTA", "CTA", "TCA")
POLY_A = ("AATAAA", "ATTAAA")


def clean_sequence(seq: Column) -> Column:
    """Without outer white space, in upper case; null if nothing is left."""
    return F.nullif(F.upper(F.btrim(seq, F.lit(" \t\n\r\f\x0b\xa0"))), F.lit(""))


def reverse_complement(seq: Column) -> Column:
    """Other letters than ACGT become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def kmers(seq: Column, k: int) -> Column:
    """All runs of `k` bases in order, none if the sequence is shorter."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    """The smaller of a run of ACGT and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of `width` letters, the last one without a line break."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def unknown(n: Column) -> Column:
    return F.repeat(F.lit("N"), F.greatest(n, F.lit(0)).cast("int"))


def trim_unknown(seq: Column) -> Column:
    """Without leading Ns."""
    return F.ltrim(seq, F.lit("N"))


def bases(kmer_length: Column, k: int) -> Column:
    return kmer_length + (k - 1)


def codon_count(seq: Column, codons: tuple[str, ...], frame: int) -> Column:
    """How many codons of `codons` the sequence has at places that are `frame` modulo 3, counted from 0."""
    places = F.sequence(F.lit(0), F.greatest(F.length(seq) - 3, F.lit(0)))
    hit = lambda i: (i % 3 == frame) & F.substr(seq, i + 1, F.lit(3)).isin(*codons)
    return F.when(F.length(seq) >= 3, F.size(F.filter(places, hit))).otherwise(0).cast("long")


def poly_a_signal(seq: Column) -> Column:
    return seq.contains(POLY_A[0]) | seq.contains(POLY_A[1])


def donor_near(end: Column) -> Column:
    """Whether GT lies in the bases around a junction (`end`: 3 bases before it and 5 after it)."""
    return F.locate("GT", end) > 0


def on_reference(same: Column, low: Column, high: Column, start: Column, finish: Column, positive: Column, k: int) -> tuple[Column, Column]:
    """First and last place on a reference that lies at `start` to `finish`, for its k-mers from `low` to before `high`.

    They run against the reference's places if only one of the two, the mapping (`same`) or the reference (`positive`), is
    turned. The shifts are fixed values.
    """
    first = F.when(same & positive, start + low).when(same, finish - low + (k - 1)).when(positive, start + high + (k - 1)).otherwise(finish - high)
    last = F.when(same & positive, start + high + (k - 2)).when(same, finish - high + 1).when(positive, start + low + 1).otherwise(finish - low + k)
    return first, last


def reference_coordinates(header: Column) -> dict[str, Column]:
    """name, start, finish and positive_strand of a header `name:start-finish`; without places 1, -1 and true."""
    pattern = r"^>?([^:]*):(\d+)-(\d+)"
    has = header.rlike(pattern)
    first, last = (F.regexp_extract(header, pattern, i).try_cast("long") for i in (2, 3))
    return {
        "name": F.when(has, F.regexp_extract(header, pattern, 1)).otherwise(F.regexp_replace(header, "^>", "")),
        "start": F.when(has, F.least(first, last)).otherwise(F.lit(1)),
        "finish": F.when(has, F.greatest(first, last)).otherwise(F.lit(-1)),
        "positive_strand": F.when(has, first <= last).otherwise(F.lit(True)),
    }
