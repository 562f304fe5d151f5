"""Assemble FASTA reads from the command line: `spark-submit` or `python -m strandwork READS OUT [options]`."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.config import AssemblyOptions
from strandwork.functions.dna import reference_coordinates
from strandwork.operators import graph, transcripts
from strandwork.plans.pipeline import Assembly, assemble, assemble_many, merge
from strandwork.shared import Scratch, tidy
from strandwork.sources import sinks
from strandwork.sources.fasta import pair_up, read_numbered_fasta


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    default = AssemblyOptions()
    p = argparse.ArgumentParser(prog="strandwork", description="Assemble transcripts from FASTA reads (>name, or >name<tab>id<tab>category).")
    p.add_argument("reads", help="FASTA file or folder; reads are numbered in their order unless all have an id")
    p.add_argument("out", help="folder for the exports; must not hold them yet")
    p.add_argument("--k", type=int, nargs="+", default=[default.k], help="odd; several are assembled one by one and merged")
    p.add_argument("--merge-k", type=int, default=27)
    p.add_argument("--insert", nargs="*", default=[], metavar="CATEGORY:MEAN[:SD]", help="insert length of a paired library; sd is a tenth of it if not given")
    p.add_argument("--category", type=int, default=0, help="of reads that have none: odd ones hold pairs, one read after the other, those above 5 references")
    p.add_argument("--merge-only", action="store_true", help="the sequences are transcripts of several assemblies, to be merged at --merge-k")
    p.add_argument("--strand-specific", action="store_true", help="reads tell the strand, so loci are not turned")
    p.add_argument("--coverage-cutoff", type=float, default=default.coverage_cutoff)
    p.add_argument("--edge-fraction-cutoff", type=float, default=default.edge_fraction_cutoff)
    p.add_argument("--min-transcript-length", type=int, default=default.min_transcript_length)
    p.add_argument("--degree-cutoff", type=int, default=default.degree_cutoff)
    p.add_argument("--paired-cutoff", type=float, default=default.paired_cutoff)
    p.add_argument("--min-pair-count", type=int, default=default.min_pair_count)
    p.add_argument("--scaffolding", action="store_true", help="keep connections over gaps")
    p.add_argument("--unused-reads", action="store_true", help="also write the reads of no transcript")
    p.add_argument("--alignments", action="store_true", help="also write where references lie along transcripts")
    p.add_argument("--messages", action="store_true", help="also write the assembly as messages")
    return p.parse_args(given)


def options_of(args: argparse.Namespace) -> AssemblyOptions:
    names = ("coverage_cutoff", "edge_fraction_cutoff", "min_transcript_length", "degree_cutoff", "paired_cutoff", "min_pair_count", "scaffolding")
    return AssemblyOptions(k=args.k[0], double_stranded=not args.strand_specific, **{name: getattr(args, name) for name in names})


def libraries_of(spark: SparkSession, inserts: list[str]) -> DataFrame:
    """(category, mean, sd) of arguments `category:mean[:sd]`."""
    rows = []
    for text in inserts:
        category, mean, *sd = text.split(":")
        rows.append((int(category), float(mean), float(sd[0]) if sd else float(mean) / 10))
    return spark.createDataFrame(rows, "category short, mean double, sd double")


def export(found: Assembly, reads: DataFrame, libraries: DataFrame, out: str, options: AssemblyOptions, unused_reads: bool = False, messages: bool = False, alignments: bool = False) -> None:
    """Write an assembly's transcripts, contig order and report and, if asked for, its unused reads, messages and alignments."""
    laid = transcripts.layout(found.transcripts, found.nodes, options.k)
    used = transcripts.used_reads(found.occurrences, laid, options.min_transcript_length)
    sinks.write_text(sinks.report(graph.stats(found.nodes), reads, used), f"{out}/report.txt", "line")
    numbered = transcripts.numbered(transcripts.lengths(laid), options.min_transcript_length)
    sinks.write_text(sinks.transcripts_fasta(numbered, found.sequences, found.transcripts), f"{out}/transcripts.fa", "locus_id", "j")
    records = sinks.locus_contigs_fasta(found.members, found.nodes).select("locus_id", F.lit(0).alias("j"), "ord", "node_id", "value")
    order = sinks.contig_ordering(numbered, laid, found.transcripts, options.k).withColumns({"ord": F.lit(0), "node_id": F.lit(0)})
    sinks.write_text(records.unionByName(order), f"{out}/contig-ordering.txt", "locus_id", "j", "ord", "node_id")
    if unused_reads:
        sinks.write_text(sinks.reads_fasta(reads.join(used, "read_id", "left_anti")), f"{out}/unused-reads.fa", "read_id")
    if alignments:
        references = reads.where(F.col("category") > 2 * options.categories + 1)
        places = reference_coordinates(F.col("name"))
        named = references.select("read_id", places["name"].alias("name"), places["start"].alias("ref_start"), places["finish"].alias("ref_finish"), places["positive_strand"].alias("positive_strand"))
        mappings = transcripts.read_mappings(laid, found.occurrences.join(references, "read_id", "left_semi"), options.k)
        sinks.write_text(sinks.alignments(mappings, named, numbered, options.k), f"{out}/transcript-alignments.psa", "locus_id", "j", "start")
    if messages:
        sinks.write_text(sinks.messages(libraries, reads, laid.join(numbered.select("transcript_id"), "transcript_id", "left_semi"), found.occurrences, found.nodes, options.k), f"{out}/messages.afg", "kind", "id")


def export_merged(found: DataFrame, sequences: DataFrame, out: str, options: AssemblyOptions) -> None:
    """Write the transcripts of a merged assembly."""
    lengths = found.select("locus_id", "transcript_id").join(sequences.select("transcript_id", F.length("seq").alias("length")), "transcript_id")
    numbered = transcripts.numbered(lengths, options.min_transcript_length)
    sinks.write_text(sinks.transcripts_fasta(numbered, sequences, found), f"{out}/transcripts.fa", "locus_id", "j")


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    options = options_of(args)
    spark = SparkSession.builder.appName("strandwork").getOrCreate()
    with tidy(spark):
        try:
            numbered = Scratch(spark).keep(read_numbered_fasta(spark, args.reads, args.category))
        except AnalysisException as problem:
            raise SystemExit(f"cannot read {args.reads}: {problem.getCondition()}") from problem
        if args.merge_only:
            export_merged(*merge(numbered.select(F.col("id").alias("seq_id"), "seq"), replace(options, k=args.merge_k)), args.out, options)
            return
        reads = pair_up(numbered, "id").select(F.col("id").alias("read_id"), "name", "mate_id", "category", "seq")
        libraries = libraries_of(spark, args.insert)
        if len(args.k) > 1:
            export_merged(*assemble_many(reads, libraries, args.k, args.merge_k, options), args.out, options)
        else:
            export(assemble(reads, libraries, options), reads, libraries, args.out, options, args.unused_reads, args.messages, args.alignments)


if __name__ == "__main__":
    main()
