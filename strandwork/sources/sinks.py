"""Exports as tables of text blocks, and their writers.

Every export is a DataFrame with the column `value`, one block of lines each, and columns to sort by, so that it
can be queried like any table; `write_text` writes the blocks in that order without bringing them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.dna import on_reference, wrap
from strandwork.operators.transcripts import sequences
from strandwork.shared import Scratch, lookup, numbered_within, salted

#: The words of the splicing events in the event export.
EVENT_WORDS = {
    "mutually_exclusive_exons": "MEE",
    "skipped_exon": "SE",
    "alternative_5prime_splice": "a5p",
    "alternative_3prime_splice": "a3p",
    "intron_retention": "IR",
    "alternative_polyA": "aPS",
}


def write_text(blocks: DataFrame, path: str, *order: str) -> None:
    """Write `blocks.value` as text files, in ascending ranges of `order` from file to file."""
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def _line(pattern: str, *columns: Column | str) -> Column:
    return F.format_string(pattern, *columns)


def _head(length: Column | str) -> Column:
    """The header of a transcript; a confidence that is not known is 0, others have three digits, half rounded up."""
    thousandths = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0).otherwise(F.floor(F.col("confidence") * 1000 + 0.5))
    confidence = F.concat(F.floor(thousandths / 1000), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))
    return _line(">Locus_%d_Transcript_%d/%d_Confidence_%s_Length_%d", "locus_id", "j", "n", confidence, length)


def transcripts_fasta(numbered: DataFrame, sequences: DataFrame, confidences: DataFrame, line: int = 60) -> DataFrame:
    """(locus_id, j, value): FASTA records of the numbered transcripts; Length counts the bases that are written."""
    rows = numbered.join(sequences.select("transcript_id", "seq"), "transcript_id").join(confidences.select("transcript_id", "confidence"), "transcript_id")
    head = _head(F.length("seq"))
    return rows.select("locus_id", "j", F.concat_ws("\n", head, wrap(F.col("seq"), line)).alias("value"))


def locus_contigs_fasta(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(locus_id, ord, node_id, value): FASTA records of the contigs of each locus, as they lie in it; those without bases are left out."""
    known = nodes.where("seq is not null").select(F.col("node_id").alias("contig"), "seq")
    rows = lookup(members.withColumn("contig", F.abs("node_id")), known, "contig", "inner")
    bases = F.when(F.col("node_id") > 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
    return rows.select("locus_id", "ord", "node_id", F.concat_ws("\n", _line(">Locus_%d_Node_%d", "locus_id", "contig"), wrap(bases)).alias("value"))


def contig_ordering(numbered: DataFrame, laid: DataFrame, confidences: DataFrame, k: int) -> DataFrame:
    """(locus_id, j, value): a header and the line `node:end-(gap)->...` of each numbered transcript.

    `end` counts bases from the transcript's beginning; a gap shorter than k before a contig of k-1 or more is
    printed as 0, though it counts for the ends. Length is the whole length, unlike that of the FASTA export.
    """
    along = laid.select("transcript_id", "ord", "node_id", "gap", "finish", "len")
    after = F.lead("len").over(Window.partitionBy("transcript_id").orderBy("ord"))
    shown = F.when((F.col("gap") < k) & (after >= k - 1), 0).otherwise(F.col("gap"))
    piece = F.when(after.isNull(), _line("%d:%d", "node_id", "finish")).otherwise(_line("%d:%d-(%d)->", "node_id", F.col("finish") - F.col("gap"), shown))
    lines = along.withColumn("piece", piece).groupBy("transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda s: s["piece"]), "").alias("line"))
    rows = numbered.join(lines, "transcript_id").join(confidences.select("transcript_id", "confidence"), "transcript_id")
    head = _head("length")
    return rows.select("locus_id", "j", F.concat_ws("\n", head, "line").alias("value"))


def reads_fasta(reads: DataFrame) -> DataFrame:
    """(read_id, value): FASTA records with id and category after the name."""
    rows = reads.where("seq is not null")
    return rows.select("read_id", F.concat_ws("\n", _line(">%s\t%d\t%d", "name", "read_id", F.coalesce("category", F.lit(0))), wrap(F.col("seq"))).alias("value"))


def contigs_fasta(nodes: DataFrame) -> DataFrame:
    """(node_id, value): FASTA records of contigs with their length in k-mers and their coverage; those without bases are left out."""
    rows = nodes.where("seq is not null")
    return rows.select("node_id", F.concat_ws("\n", _line(">NODE_%d_Length_%d_Coverage_%d", "node_id", "len", "cov"), wrap(F.col("seq"))).alias("value"))


def locus_graphs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(locus_id, part, value): lines of a GraphViz graph per locus: contigs, then connections with distance and counts.

    Lines are rows, so that a large locus needs no single row or task; inactive connections are marked XXX.
    """
    a = members.select("locus_id", F.col("node_id").alias("src"))
    b = members.select("locus_id", F.col("node_id").alias("to"))
    both = pairs.unionByName(pairs.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    steps = both.withColumn("to", -F.col("dst")).join(a, "src").join(b, ["locus_id", "to"])
    text = F.when(F.col("active"), _line('%d -> %d [label="%d_%d_%d"]', "src", "to", F.floor("distance"), "paired_count", "direct_count"))
    text = F.coalesce(text, _line('%d -> %d [label="XXX"]', "src", "to"))
    lines = members.select("locus_id", F.lit(1).alias("part"), _line("%d", "node_id").alias("value"))
    lines = lines.unionByName(steps.select("locus_id", F.lit(2).alias("part"), text.alias("value")))
    ids = members.select("locus_id").distinct()
    lines = lines.unionByName(ids.select("locus_id", F.lit(0).alias("part"), _line("digraph locus_%d {", "locus_id").alias("value")))
    return lines.unionByName(ids.select("locus_id", F.lit(3).alias("part"), F.lit("}").alias("value")))


def connection_report(tested: DataFrame, kept: DataFrame) -> DataFrame:
    """(src, dst, value): a line per connection with its counts, the expected pairs and whether it is kept."""
    rows = tested.join(kept.select("src", "dst", F.lit(True).alias("ok")), ["src", "dst"], "left")
    verdict = F.when(F.col("ok"), "OK").otherwise("NG")
    line = _line("%d\t%d\t%d\t%d\t%d\t%s", "src", "dst", "direct_count", "paired_count", "expected", verdict)
    return rows.select("src", "dst", line.alias("value"))


def event_lines(events: DataFrame) -> DataFrame:
    """(locus_id, n0, value): a line per splicing event with its word and contigs, `-` for none."""
    word = F.create_map(*(F.lit(x) for pair in EVENT_WORDS.items() for x in pair))[F.col("event")]
    line = _line("[%s] %d %d %d %s", word, "n0", "n1", "n2", F.coalesce(F.col("n3").cast("string"), F.lit("-")))
    return events.select("locus_id", "n0", line.alias("value"))


def mapping_lines(mappings: DataFrame) -> DataFrame:
    """(transcript_id, start, value): tab-separated places of reads along transcripts; the strand is + or -."""
    strand = F.when(F.col("same"), "+").otherwise("-")
    line = _line("%d\t%d\t%d\t%d\t%s", "transcript_id", "start", "finish", "read_id", strand)
    return mappings.select("transcript_id", "start", line.alias("value"))


def report(stats: DataFrame, reads: DataFrame, used: DataFrame) -> DataFrame:
    """(line, value): contigs, their N50, longest and all k-mers, and how many of the reads lie on transcripts."""
    all_, some = reads.agg(F.count("seq").alias("all_reads")), used.agg(F.count("*").alias("used"))
    size = ("contigs", *(F.coalesce(c, F.lit(0)) for c in ("n50", "longest", "kmers")))
    counts = stats.select(F.lit(1).alias("line"), _line("%d contigs, n50 %d, longest %d, %d k-mers", *size).alias("text"))
    share = all_.withColumn("line", F.lit(1)).join(some.withColumn("line", F.lit(1)), "line").select("line", _line("%d of %d reads used", "used", "all_reads").alias("more"))
    return counts.join(share, "line").select("line", F.concat_ws("\n", "text", "more").alias("value"))


def alignments(mappings: DataFrame, references: DataFrame, numbered: DataFrame, k: int) -> DataFrame:
    """(locus_id, j, start, value): of each numbered transcript a header and a line for each place where a reference lies along it.

    A line holds first and last base of the transcript, the reference's name, and first and last place on it. `references`
    is (read_id, name, ref_start, ref_finish, positive_strand). Lines are rows, headers have start 0.
    """
    kept = numbered.select("transcript_id", "locus_id", "j")
    rows = mappings.join(references, "read_id").join(kept, "transcript_id")
    first, last = on_reference(F.col("same"), F.col("low"), F.col("high"), F.col("ref_start"), F.col("ref_finish"), F.col("positive_strand"), k)
    line = _line("%d\t%d\t%s\t%d\t%d", "start", "finish", "name", first, last)
    heads = kept.select("locus_id", "j", F.lit(0).cast("long").alias("start"), _line(">Locus_%d_Transcript_%d", "locus_id", "j").alias("value"))
    return heads.unionByName(rows.select("locus_id", "j", "start", line.alias("value")))


def messages(libraries: DataFrame, reads: DataFrame, laid: DataFrame, occ: DataFrame, nodes: DataFrame, k: int, heavy: list | None = None) -> DataFrame:
    """(kind, id, value): an assembly as messages: LIB, FRG (pairs), RED (reads), CTG (gap-free runs), SCF (transcripts), TLE (read placements).

    Pairs count if their library is known; what is on their reads repeats the bases as qualities, runs have one letter.
    Scaffolds hold a tile a run. Reads are laid on runs by their contig's place, those on its other strand with a clear range
    from end to begin, in messages of their own that name the run. Runs are numbered by locus, transcript and place. The
    reads of a contig with very many (`heavy`) are spread over tasks.
    """
    number = F.floor(F.col("category") / 2) + 1
    lib = libraries.select(F.lit("1LIB").alias("kind"), F.col("category").cast("long").alias("id"), _line("{LIB\niid:%d\n{DST\nmea:%d\nstd:%d\n}\n}", number, F.floor("mean"), F.floor("sd")).alias("value"))
    paired = reads.where("mate_id is not null").join(F.broadcast(libraries.select("category")), "category", "left_semi")
    pairs = paired.where("mate_id > read_id")
    frg = pairs.select(F.lit("2FRG").alias("kind"), F.col("read_id").alias("id"), _line("{FRG\nlib:%d\nrds:%d,%d\neid:%d\niid:%d\ntyp:I\n}", number, "read_id", "mate_id", "read_id", "read_id").alias("value"))
    known = reads.join(F.broadcast(libraries.select("category", F.lit(True).alias("known"))), "category", "left").where("seq is not null")
    fragment = F.when(F.col("known") & F.col("mate_id").isNotNull(), _line("frg:%d\n", F.least("read_id", "mate_id")))
    red = known.select(
        F.lit("3RED").alias("kind"), F.col("read_id").alias("id"), F.concat(_line("{RED\niid:%d\neid:%d\n", "read_id", "read_id"), F.coalesce(fragment, F.lit("")), *(F.concat(F.lit(f"{c}:\n"), wrap(F.col("seq")), F.lit("\n.\n")) for c in ("seq", "qlt")), F.lit("}")).alias("value")
    )
    place = F.col("finish") - F.col("gap") - F.col("len")
    sized = laid.groupBy("locus_id", "transcript_id", "run").agg(F.sum("len").alias("kmers"), F.min(place).alias("begin"), F.min("ord").alias("first"))
    runs = Scratch(laid.sparkSession).keep(numbered_within(sized.withColumn("all", F.lit(0)), "all", "iid", "locus_id", "transcript_id", "run").drop("all"))
    named = laid.join(runs.select("transcript_id", "run", "begin", "first", "iid"), ["transcript_id", "run"])
    pieces = named.select("locus_id", F.col("iid").alias("transcript_id"), (F.col("ord") - F.col("first")).alias("ord"), F.lit(0).cast("long").alias("gap"), "node_id")
    bases = sequences(pieces, nodes, k).select(F.col("transcript_id").alias("iid"), "seq")
    eid = _line("eid:%d-%d-%d\n", "locus_id", "transcript_id", "run")
    ctg = runs.join(bases, "iid").select(
        F.lit("4CTG").alias("kind"), F.col("iid").alias("id"), F.concat(_line("{CTG\niid:%d\n", "iid"), eid, F.lit("seq:\n"), wrap(F.col("seq"), 61), F.lit("\n.\nqlt:\n"), wrap(F.repeat(F.lit("I"), F.length("seq")), 61), F.lit("\n.\n}")).alias("value")
    )
    # every run before has its first k-1 bases besides its k-mers
    start = (F.col("begin") + (F.col("run") - 1) * (k - 1)).cast("long")
    tile = F.struct("run", _line("{TLE\noff:%d\nclr:0,%d\nsrc:%d\n}\n", start, F.col("kmers") + (k - 1), "iid").alias("tile"))
    tiles = runs.groupBy("locus_id", "transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(tile)), lambda s: s["tile"]), "").alias("tiles"))
    scf = tiles.select(F.lit("5SCF").alias("kind"), F.col("transcript_id").alias("id"), F.concat(_line("{SCF\neid:%d-%d\n", "locus_id", "transcript_id"), "tiles", F.lit("}")).alias("value"))
    on = named.select("iid", "node_id", "len", (place - F.col("begin")).alias("at"), F.abs("node_id").alias("contig"))
    spans = reads.select("read_id", F.coalesce(F.length("seq"), F.lit(0)).alias("span"))
    hits = occ.select("read_id", F.col("node_id").alias("hit"), "pos", "off", F.abs("node_id").alias("contig")).join(spans, "read_id", "left")
    span = F.coalesce("span", F.lit(0))
    same = F.col("hit") == F.col("node_id")
    placed = salted(hits, on, "contig", "inner", heavy).select(
        "iid",
        "read_id",
        (F.col("at") + F.when(same, F.col("pos") - F.col("off")).otherwise(F.col("len") - F.col("pos") + F.col("off") - span + k - 1)).alias("off"),
        F.when(same, 0).otherwise(span).alias("clear_from"),
        F.when(same, span).otherwise(0).alias("clear_to"),
    )
    tle = placed.select(F.lit("6TLE").alias("kind"), F.col("iid").alias("id"), _line("{TLE\nctg:%d\nsrc:%d\noff:%d\nclr:%d,%d\n}", "iid", "read_id", "off", "clear_from", "clear_to").alias("value"))
    out = lib
    for part in (frg, red, ctg, scf, tle):
        out = out.unionByName(part)
    return out
