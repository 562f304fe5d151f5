"""Queries over reads, k-mers and contig sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import dna
from strandwork.operators import clean, kmers
from strandwork.plans.prelude import K, with_
from strandwork.sources.tables import table


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    return clean.reads(table(spark, folder, "test_reads", "read_id", "mate_id", "category", "seq"))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return clean.nodes(table(spark, folder, "nodes"))


def read_lengths(spark, folder):
    """Length in bases and in k-mers of each read, its library and whether it is paired."""
    rows = _reads(spark, folder).where("seq is not null")
    paired = (F.col("category") % 2 == 1).alias("is_paired")
    return rows.select("read_id", F.length("seq").cast("long").alias("bases"), (F.length("seq") - (K - 1)).cast("long").alias("kmers"), F.floor(F.col("category") / 2).cast("long").alias("library"), paired)


def revcomp_reads(spark, folder):
    return _reads(spark, folder).where("seq is not null").select("read_id", dna.reverse_complement(F.col("seq")).alias("seq"))


def fasta_wrapped(spark, folder):
    return _nodes(spark, folder).where("seq is not null").select("node_id", dna.wrap(F.col("seq")).alias("lines"))


def kmer_counts_canonical(spark, folder):
    return kmers.kmer_counts(_reads(spark, folder), K)


def kmer_spectrum(spark, folder):
    return kmers.kmer_spectrum(kmers.kmer_counts(_reads(spark, folder), K))


def debruijn_arcs(spark, folder):
    return kmers.kmer_arcs(_reads(spark, folder), K, 3)


def kmer_degrees(spark, folder):
    """How many oriented k-mers have each number of arcs out and in."""
    both = kmers.kmer_degrees(kmers.kmer_arcs(_reads(spark, folder), K, 3))
    return both.groupBy("outdeg", "indeg").agg(F.count("*").alias("kmers"))


def detached_pairs(spark, folder):
    """Reads of pairs one of which is shorter than k: both lose their pairing (an even category)."""
    return clean.detached(_reads(spark, folder), K)


def mate_check(spark, folder):
    """Paired reads whose mate does not point back at them, or is missing."""
    reads = _reads(spark, folder).where("mate_id is not null").select("read_id", "mate_id")
    back = reads.select(F.col("read_id").alias("mate_id"), F.col("mate_id").alias("back"))
    return reads.join(back, "mate_id", "left").where("back is null or back <> read_id").select("read_id", "mate_id")


def reference_headers(spark, folder):
    """Name, places and strand of each read's name, read as a reference header `name:start-finish`."""
    names = table(spark, folder, "test_reads", "name", "read_id", "len").where("name is not null and len is not null and read_id is not null")
    header = F.when(F.col("read_id") % 3 == 0, F.concat(F.lit(">"), "name", F.lit(":"), F.col("len"), F.lit("-"), F.lit(1))).when(
        F.col("read_id") % 3 == 1, F.concat(F.lit(">"), "name", F.lit(":1-"), F.col("len"))
    )
    rows = names.select("read_id", F.coalesce(header, F.concat(F.lit(">"), "name")).alias("header")).distinct()
    return rows.select("read_id", *(c.alias(name) for name, c in dna.reference_coordinates(F.col("header")).items()))


def polya_signal(spark, folder):
    return _nodes(spark, folder).where("seq is not null").select("node_id", dna.poly_a_signal(F.col("seq")).alias("forward"), dna.poly_a_signal(dna.reverse_complement(F.col("seq"))).alias("backward"))


QUERIES = {f.__name__: f for f in (read_lengths, revcomp_reads, fasta_wrapped, kmer_counts_canonical, kmer_spectrum, debruijn_arcs, kmer_degrees, detached_pairs, mate_check, reference_headers, polya_signal)}

_COUNTS = f"""kmers as (select unnest(list_transform(range(1, length(seq) - {K} + 2), lambda i: substr(seq, i, {K}))) as kmer from reads where length(seq) >= {K}),
    counts as (select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer, count(*) as n from kmers where not regexp_matches(kmer, '[^ACGT]') group by 1)"""
_ARCS = f"""runs as (select unnest(list_transform(range(1, length(seq) - {K} + 1), lambda i: substr(seq, i, {K + 1}))) as run from reads where length(seq) > {K}),
    run_counts as (select least(run, reverse(translate(run, 'ACGT', 'TGCA'))) as run, count(*) as n from runs where not regexp_matches(run, '[^ACGT]') group by 1),
    oriented as (select run, n from run_counts union all
      select reverse(translate(run, 'ACGT', 'TGCA')), n from run_counts where run <> reverse(translate(run, 'ACGT', 'TGCA'))),
    ends as (select substr(run, 1, {K}) as src, substr(run, 2, {K}) as dst, n as multiplicity from oriented),
    solid as (select kmer from counts where n >= 3),
    karcs as (select * from ends where least(src, reverse(translate(src, 'ACGT', 'TGCA'))) in (select kmer from solid)
      and least(dst, reverse(translate(dst, 'ACGT', 'TGCA'))) in (select kmer from solid))"""

SQL = {
    "read_lengths": f"""{with_('reads')} select read_id, length(seq) as bases, length(seq) - {K - 1} as kmers,
        cast(floor(category / 2) as bigint) as library, category % 2 = 1 as is_paired from reads where seq is not null""",
    "revcomp_reads": f"""{with_('reads')} select read_id, reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) as seq from reads where seq is not null""",
    "fasta_wrapped": f"""{with_('n')} select node_id, rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) as lines from n where seq is not null""",
    "kmer_counts_canonical": f"{with_('reads')}, {_COUNTS} select kmer, n from counts",
    "kmer_spectrum": f"{with_('reads')}, {_COUNTS} select n, count(*) as kmers from counts group by 1",
    "debruijn_arcs": f"{with_('reads')}, {_COUNTS}, {_ARCS} select src, dst, multiplicity from karcs",
    "kmer_degrees": f"""{with_('reads')}, {_COUNTS}, {_ARCS}, deg as (select kmer, cast(sum(o) as bigint) as outdeg, cast(sum(i) as bigint) as indeg from (
        select src as kmer, 1 as o, 0 as i from karcs union all select dst, 0, 1 from karcs) group by 1)
        select outdeg, indeg, count(*) as kmers from deg group by 1, 2""",
    "detached_pairs": f"""{with_('reads')}, pr as (select * from reads where category % 2 = 1 and mate_id is not null),
        short as (select * from pr where coalesce(length(seq), 0) < {K})
        select read_id, cast(category - 1 as smallint) as category from pr where read_id in (select read_id from short union select mate_id from short)""",
    "mate_check": f"""{with_('reads')}, pr as (select read_id, mate_id from reads where mate_id is not null)
        select a.read_id, a.mate_id from pr a left join pr b on b.read_id = a.mate_id where b.mate_id is null or b.mate_id <> a.read_id""",
    "reference_headers": """with h as (select distinct read_id, name, len from test_reads where name is not null and len is not null and read_id is not null)
        select read_id, name, case read_id % 3 when 2 then 1 else least(len, 1) end as start,
        cast(case read_id % 3 when 2 then -1 else greatest(len, 1) end as bigint) as finish,
        case read_id % 3 when 2 then true when 1 then len >= 1 else len <= 1 end as positive_strand from h""",
    "polya_signal": f"""{with_('n')} select node_id, seq like '%AATAAA%' or seq like '%ATTAAA%' as forward,
        reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) like '%AATAAA%'
        or reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) like '%ATTAAA%' as backward from n where seq is not null""",
}
