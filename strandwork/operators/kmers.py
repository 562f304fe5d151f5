"""k-mers of reads and the de Bruijn graph of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.shared import Scratch

#: Bases that fit into a LONG by two bits each.
PACKED = 32
#: Bases whose k-mers a task packs at once.
PIECE = 1 << 21


def packed_kmers(text: np.ndarray, k: int) -> np.ndarray:
    """Of each run of `k` letters ACGT in `text` (bytes), two bits a base, the smaller of it and its reverse complement."""
    letters = np.full(256, 4, np.uint8)
    letters[list(b"ACGT")] = range(4)
    codes = letters[text]
    other = np.concatenate([[0], np.cumsum(codes == 4)])
    n = len(text) - k + 1
    forward, back = np.zeros((2, n), np.uint64)
    for i in range(k):
        base = (codes[i : i + n] & 3).astype(np.uint64)
        forward = forward << np.uint64(2) | base
        back |= (np.uint64(3) - base) << np.uint64(2 * i)
    return np.minimum(forward, back)[other[k:] == other[:-k]]


def packed_counts(reads: DataFrame, k: int) -> DataFrame:
    """(code, n): how often each k-mer of at most 32 bases occurs on either strand, packed into a LONG.

    Tasks pack and combine the k-mers of each batch of reads, so what is shuffled is eight bytes a different k-mer, and a
    k-mer of very many reads is no burden. K-mers with other letters than ACGT don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = np.frombuffer("\n".join(batch.column(0).to_pylist()).encode("ascii", "replace"), np.uint8)
            for at in range(0, len(text) - k + 1, PIECE):
                codes, counts = np.unique(packed_kmers(text[at : at + PIECE + k - 1], k), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], names=["code", "n"])

    runs = reads.where(F.length("seq") >= k).select("seq").mapInArrow(run, "code long, n long")
    return runs.groupBy("code").agg(F.sum("n").alias("n"))


def turned(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of packed k-mers."""
    out = ~codes
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0xFFFFFFFF)):
        bits, mask = np.uint64(bits), np.uint64(mask)
        out = (out >> bits) & mask | (out & mask) << bits
    return out >> np.uint64(2 * (PACKED - k))


def spelled(code: Column, k: int) -> Column:
    """The letters of a packed k-mer."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def strand_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, twin, n): how often each k-mer occurs on either strand, with its reverse complement, the smaller first; for any k.

    A read is turned round once; its k-mers' reverse complements are cut from that. Counts are combined in every task
    before the shuffle, so a k-mer of very many reads is no burden. K-mers with other letters than ACGT don't count.
    """
    both = reads.where(F.length("seq") >= k).select("seq", F.reverse(F.translate("seq", "ACGT", "TGCA")).alias("back"), F.length("seq").alias("size"))
    places = both.select("seq", "back", "size", F.explode(F.sequence(F.lit(1), F.col("size") - (k - 1))).alias("at"))
    one, two = F.substr("seq", F.col("at"), F.lit(k)), F.substr("back", F.col("size") - F.col("at") - (k - 2), F.lit(k))
    cut = places.select(one.alias("one"), two.alias("two")).select(F.least("one", "two").alias("kmer"), F.greatest("one", "two").alias("twin"))
    return cut.groupBy("kmer", "twin").agg(F.count("*").alias("n")).where(~F.col("kmer").rlike("[^ACGT]"))


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often each k-mer occurs on either strand; the smaller of it and its reverse complement stands."""
    if k > PACKED:
        return strand_counts(reads, k).select("kmer", "n")
    return packed_counts(reads, k).select(spelled(F.col("code"), k).alias("kmer"), "n")


def kmer_spectrum(counts: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return counts.groupBy("n").agg(F.count("*").alias("kmers"))


def solid_kmers(counts: DataFrame, cutoff: float) -> DataFrame:
    return counts.where(F.col("n") >= cutoff)


def kmer_arcs(reads: DataFrame, k: int, cutoff: float) -> DataFrame:
    """(src, dst, multiplicity): k-mers that follow each other, where both are solid, from either strand.

    An arc is a run of k+1 bases; its two k-mers are checked against the solid ones by joins, once for both strands.
    """
    if k >= PACKED:
        return _long_kmer_arcs(reads, k, cutoff)
    solid = Scratch(reads.sparkSession).keep(solid_kmers(packed_counts(reads, k), cutoff).select("code"))
    mask = (1 << 2 * k) - 1

    def with_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            ends = (code >> np.uint64(2), code & np.uint64(mask))
            columns = [code, turned(code, k + 1), *(np.minimum(end, turned(end, k)) for end in ends)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), batch.column(1)], names=["code", "twin", "end0", "end1", "n"])

    runs = packed_counts(reads, k + 1).mapInArrow(with_ends, "code long, twin long, end0 long, end1 long, n long")
    for end in ("end0", "end1"):
        runs = runs.join(solid.withColumnRenamed("code", end), end, "left_semi")
    strands = F.when(F.col("code") == F.col("twin"), F.array("code")).otherwise(F.array("code", "twin"))
    arcs = runs.select(F.explode(strands).alias("code"), F.col("n").alias("multiplicity"))
    src, dst = F.shiftrightunsigned("code", 2), F.col("code").bitwiseAND(F.lit(mask))
    return arcs.select(spelled(src, k).alias("src"), spelled(dst, k).alias("dst"), "multiplicity")


def _long_kmer_arcs(reads: DataFrame, k: int, cutoff: float) -> DataFrame:
    solid = Scratch(reads.sparkSession).keep(solid_kmers(kmer_counts(reads, k), cutoff).select("kmer"))
    pairs = F.array(F.struct("kmer", "twin"), F.struct(F.col("twin").alias("kmer"), F.col("kmer").alias("twin")))
    one = F.when(F.col("kmer") == F.col("twin"), F.slice(pairs, 1, 1)).otherwise(pairs)
    ends = strand_counts(reads, k + 1).select(F.inline(one), F.col("n").alias("multiplicity"))
    # the reverse complements of both k-mers are the two ends of the twin
    ends = ends.select(
        F.substring("kmer", 1, k).alias("src"), F.substring("kmer", 2, k).alias("dst"), F.substring("twin", 2, k).alias("src_twin"), F.substring("twin", 1, k).alias("dst_twin"), "multiplicity"
    )
    for end in ("src", "dst"):
        ends = ends.withColumn("kmer", F.least(end, f"{end}_twin")).join(solid, "kmer", "left_semi").drop("kmer", f"{end}_twin")
    return ends


def kmer_degrees(arcs: DataFrame) -> DataFrame:
    """(kmer, outdeg, indeg) of each oriented k-mer with an arc."""
    ends = arcs.select(F.col("src").alias("kmer"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        arcs.select(F.col("dst").alias("kmer"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("kmer").agg(F.sum("o").alias("outdeg"), F.sum("i").alias("indeg"))
