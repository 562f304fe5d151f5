"""Assemblies from reads: of one k, of several, and their merge."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.config import AssemblyOptions
from strandwork.functions.dna import canonical, kmers
from strandwork.operators import clean, compact, graph, kmers as km, loci, scaffold, similarity, transcripts
from strandwork.shared import Scratch, lookup


@dataclass
class Assembly:
    """The tables of one assembly; all have been written, so any of them can be read again and again."""

    nodes: DataFrame
    occurrences: DataFrame
    arcs: DataFrame
    pairs: DataFrame
    members: DataFrame
    transcripts: DataFrame
    sequences: DataFrame


def contigs(reads: DataFrame, options: AssemblyOptions) -> tuple[DataFrame, DataFrame]:
    """(nodes, places): the unbranched chains of solid k-mers, and where each k-mer lies.

    `nodes` is (node_id, seq, len, cov); of a chain and its reverse the one with the smaller sequence stands, and
    ids count up in the order of sequences. `places` is (kmer, node_id, pos), pos counted on the given strand,
    node_id negative where the canonical k-mer lies on the other strand.
    """
    k = options.k
    scratch = Scratch(reads.sparkSession)
    counts = scratch.keep(km.solid_kmers(km.kmer_counts(reads, k), options.coverage_cutoff))
    arcs = scratch.keep(km.kmer_arcs(reads, k, options.coverage_cutoff))
    alone_out = arcs.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").drop("n")
    alone_in = arcs.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").drop("n")
    links = alone_out.join(alone_in, ["src", "dst"]).where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("to"))
    links = scratch.keep(links.where(F.col("node") != F.reverse(F.translate("to", "ACGT", "TGCA"))))
    state = graph.steps_back(scratch, links)
    rings = state.where("not done").select("node", "least")
    cut = scratch.keep(links.join(rings, "node").where("node <> least").select("node", "to"))
    # a ring of both strands is cut at one k-mer per strand
    opened = state.where("done")
    if not cut.isEmpty():
        opened = opened.unionByName(graph.steps_back(scratch, cut))
    both = counts.select(F.col("kmer").alias("node")).unionByName(counts.select(F.reverse(F.translate("kmer", "ACGT", "TGCA")).alias("node")))
    single = both.join(opened.select("node"), "node", "left_anti").select("node", F.col("node").alias("chain"), F.lit(0).alias("step"))
    steps = scratch.keep(opened.select("node", F.col("to").alias("chain"), F.col("far").alias("step")).unionByName(single))
    known = steps.withColumn("kmer", canonical(F.col("node"))).join(counts, "kmer")
    letters = F.struct("step", F.when(F.col("step") == 0, F.col("node")).otherwise(F.right("node", F.lit(1))).alias("letters"))
    spelled = known.groupBy("chain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(letters)), lambda s: s["letters"]), "").alias("seq"), F.count("*").alias("len"), F.sum("n").alias("cov")
    )
    other = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    unique = spelled.where(F.col("seq") <= other)
    begin = scratch.keep(unique.select("chain", "seq", "len", "cov"))
    ids = number(begin.select("seq").distinct(), "seq")
    nodes = scratch.keep(begin.join(ids, "seq").groupBy("node_id", "seq").agg(F.max("len").cast("int").alias("len"), F.max("cov").alias("cov"), F.min("chain").alias("chain")))
    on = steps.join(nodes.select("chain", "node_id"), "chain").withColumn("kmer", canonical(F.col("node")))
    places = on.select("kmer", F.when(F.col("node") == F.col("kmer"), F.col("node_id")).otherwise(-F.col("node_id")).alias("node_id"), F.col("step").alias("pos"))
    return nodes.drop("chain"), scratch.keep(places.dropDuplicates(["kmer"]))


def number(df: DataFrame, order: str) -> DataFrame:
    """`df` with node_id from 1 on, in ranges of `order`: the sizes of the partitions before are added up, not the rows."""
    scratch = Scratch(df.sparkSession)
    ranged = scratch.keep(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    rows = ranged.withColumn("at", inside).join(F.broadcast(before), "part")
    return rows.select(*df.columns, (F.col("at") + F.col("before")).cast("long").alias("node_id"))


def place_reads(reads: DataFrame, nodes: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(read_id, node_id, pos, off): the first place of each read on each contig, in the read's direction.

    A read that comes back to a contig has a place each time. k-mers of very many reads are spread over tasks.
    """
    runs = reads.where("seq is not null").select("read_id", F.posexplode(kmers(F.col("seq"), k)).alias("off", "run"))
    sized = places.join(nodes.select(F.col("node_id").alias("contig"), "len"), F.abs("node_id") == F.col("contig")).drop("contig")
    rows = lookup(runs.withColumn("kmer", canonical(F.col("run"))), sized, "kmer", "inner")
    same = F.col("run") == F.col("kmer")
    signed = F.when(same, F.col("node_id")).otherwise(-F.col("node_id"))
    pos = F.when(signed > 0, F.col("pos")).otherwise(F.col("len") - 1 - F.col("pos"))
    rows = rows.select("read_id", signed.alias("node_id"), pos.cast("long").alias("pos"), F.col("off").cast("long").alias("off"))
    first = F.min(F.struct("off", "pos")).alias("first")
    # what goes on along the contig keeps this difference
    return rows.groupBy("read_id", "node_id", (F.col("pos") - F.col("off")).alias("ahead")).agg(first).select("read_id", "node_id", "first.pos", "first.off")


def corrected(nodes: DataFrame, arcs: DataFrame, occ: DataFrame, options: AssemblyOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, arcs, occ) once similar branches are merged and tips are clipped.

    After every change unbranched contigs are joined, so branches and tips of several contigs are seen whole: a round
    joins, merges what is similar and, where nothing is, takes away the tips, and then merges similar branches that have
    forks of their own. Each round but the last has fewer contigs than the one before.
    """
    scratch = Scratch(nodes.sparkSession)
    while True:
        nodes, arcs, occ, _ = compact.join_chains(nodes, arcs, occ, options.k)
        steps = arcs.select("src", (-F.col("dst")).alias("dst"), F.lit(True).alias("active")).where("src < dst")
        moved = similarity.merge_map(similarity.simple_bubbles(steps, nodes, options.k, options.max_branch), nodes)
        if not moved.isEmpty():
            occ = scratch.keep(similarity.merged_occurrences(occ, nodes, moved))
            nodes = scratch.keep(similarity.merged_nodes(nodes, moved))
            arcs = scratch.keep(similarity.merged_arcs(arcs, moved))
            continue
        short = scratch.keep(graph.tips(nodes, arcs, options.k))
        if not short.isEmpty():
            nodes, arcs, occ = without(short, nodes, arcs, occ)
            continue
        moved, inside = similarity.branch_moves(similarity.branch_bubbles(arcs, nodes, options.k, options.max_branch), nodes)
        if moved.isEmpty():
            return nodes, arcs, occ
        occ = scratch.keep(similarity.merged_occurrences(occ, nodes, moved))
        nodes = scratch.keep(similarity.merged_nodes(nodes, moved))
        arcs = scratch.keep(similarity.merged_arcs(arcs.join(inside, ["src", "dst"], "left_anti"), moved).where("src <> dst"))


def without(dropped: DataFrame, nodes: DataFrame, arcs: DataFrame, occ: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, arcs, occ) without the contigs of `dropped`."""
    scratch = Scratch(nodes.sparkSession)
    gone = dropped.select(F.col("node_id").alias("gone"))
    nodes = nodes.join(gone, F.col("node_id") == F.col("gone"), "left_anti")
    for end in ("src", "dst"):
        arcs = arcs.join(gone, F.abs(end) == F.col("gone"), "left_anti")
    occ = occ.join(gone, F.abs("node_id") == F.col("gone"), "left_anti")
    return scratch.keep(nodes), scratch.keep(arcs), scratch.keep(occ)


def covered(reads: DataFrame, options: AssemblyOptions) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, arcs, occ, dubious): the corrected contigs of all k-mers whose mean coverage reaches the cutoff.

    `dubious` are the reads that lie on a contig dropped for its coverage, or along a weak arc; their places on other contigs stay in `occ`.
    """
    scratch = Scratch(reads.sparkSession)
    raw, places = contigs(reads, replace(options, coverage_cutoff=1))
    raw_occ = scratch.keep(place_reads(reads, raw, places, options.k))
    low = scratch.keep(graph.low_coverage_nodes(raw, options.coverage_cutoff))
    dubious = scratch.keep(graph.dubious_reads(raw_occ, low))
    nodes, arcs, occ = without(low, raw, graph.arcs_of_reads(raw_occ, raw).where("src <> dst"), raw_occ)
    weak = scratch.keep(graph.low_fraction_arcs(arcs, options.edge_fraction_cutoff).select("src", "dst"))
    twins = weak.unionByName(weak.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))).distinct()
    strong = scratch.keep(arcs.join(twins, ["src", "dst"], "left_anti"))
    dubious = scratch.keep(dubious.unionByName(graph.reads_along(occ, twins)).distinct())
    nodes, arcs, occ = corrected(nodes, strong, occ, options)
    return nodes, arcs, occ, dubious


def assemble(reads: DataFrame, libraries: DataFrame, options: AssemblyOptions = AssemblyOptions()) -> Assembly:
    """Contigs, connections, loci and transcripts of `reads` (read_id, mate_id, category, seq).

    Contigs of low mean coverage and weak arcs are dropped, similar branches merged, tips clipped and unbranched contigs
    joined before reads are connected; reads on a contig of low coverage connect nothing, and pairs with a read shorter
    than k count as single reads. Contigs near the same unique one are connected by their arcs. Loci are turned to the
    strand that reads better, unless reads are strand-specific, and similar branches within them merged. Those of a simple
    shape give their one or two transcripts; all others give heaviest paths until every contig is on one, up to
    `max_transcripts`, and contigs that no path explains stand alone.
    """
    scratch = Scratch(reads.sparkSession)
    k = options.k
    single = clean.detached(reads, k).select("read_id", F.col("category").alias("new"))
    reads = scratch.keep(
        reads.join(single, "read_id", "left")
        .withColumn("mate_id", F.when(F.col("new").isNull(), F.col("mate_id")))
        .withColumn("category", F.coalesce("new", "category"))
        .drop("new")
    )
    nodes, arcs, occ, dubious = covered(reads, options)
    unique = graph.unique_nodes(nodes, arcs, options.unique_length, options.degree_cutoff).select("node_id", F.lit(True).alias("u"))
    nodes = scratch.keep(nodes.join(unique, "node_id", "left").withColumn("is_unique", F.coalesce("u", F.lit(False))).drop("u"))

    placed = scratch.keep(scaffold.usable(occ.join(dubious, "read_id", "left_anti"), nodes))
    direct, paired = scaffold.direct_connections(placed), scaffold.paired_connections(placed, reads, libraries)
    merged = scratch.keep(scaffold.merge_connections(direct, paired))
    weighed = scratch.keep(scaffold.connection_weights(merged, direct, paired, options.weight_cap))
    weighed = scratch.keep(scaffold.with_local(weighed, scaffold.local_connections(weighed, arcs, nodes), options.weight_cap))
    density = scratch.keep(scaffold.paired_density(occ, reads, libraries))
    tested = scaffold.reliable(scaffold.expected_connections(weighed, nodes, density, libraries), options.min_pair_count, options.paired_cutoff, options.unique_length)
    pairs = scratch.keep(tested.drop("len_src", "len_dst", "expected").withColumn("active", F.lit(True)))
    if not options.scaffolding:
        wide = scaffold.gapped(pairs, nodes, k).select("src", "dst")
        pairs = scratch.keep(pairs.join(wide, ["src", "dst"], "left_anti"))
    gone = scaffold.transitive_edges(pairs)
    gone = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs = scratch.keep(pairs.join(gone, ["src", "dst"], "left_anti"))

    groups = loci.extended(loci.components(nodes.where("is_unique"), pairs), pairs, nodes)
    members = scratch.keep(loci_on_one_strand(scratch, groups, pairs))
    if options.double_stranded:
        members = scratch.keep(loci.reverted(members, loci.orientations(members, nodes)))
    members, pairs = loci.simplified(members, pairs, nodes, k, options.max_branch)
    edges = scratch.keep(loci.locus_edges(members, pairs))
    shaped = scratch.keep(loci.shapes(loci.degree_histogram(members, edges)))
    simple = transcripts.simple_transcripts(members, edges, shaped)
    hard = shaped.where("shape = 'UNKNOWN'").select("locus_id")
    hard_members, hard_edges = (scratch.keep(df.join(hard, "locus_id", "left_semi")) for df in (members, edges))
    heavy = transcripts.path_cover(hard_members, hard_edges, nodes, options.max_transcripts)
    found = scratch.keep(simple.select("locus_id", "node_path").unionByName(heavy.select("locus_id", "node_path")).distinct())
    alone = transcripts.unexplained_contigs(members, found).select("locus_id", F.array("node_id").alias("node_path"), F.lit(True).alias("alone"))
    rows = number(scratch.keep(found.withColumn("alone", F.lit(False)).unionByName(alone).withColumn("at", F.concat_ws(",", F.lpad(F.col("locus_id").cast("string"), 20, "0"), F.col("node_path").cast("array<string>")))), "at")
    size = members.groupBy("locus_id").agg(F.count("*").alias("contigs"))
    rows = rows.join(size, "locus_id").select("locus_id", F.col("node_id").alias("transcript_id"), "node_path", F.when(F.col("alone"), 1.0).otherwise(F.size("node_path") / F.col("contigs")).alias("confidence"))
    rows = scratch.keep(transcripts.with_gaps(scratch.keep(rows), edges, nodes))
    sequences = scratch.keep(transcripts.sequences(transcripts.layout(rows, nodes, k), nodes, k, gaps_in_kmers=True))
    return Assembly(nodes, occ, arcs, pairs, members, rows, sequences)


def loci_on_one_strand(scratch: Scratch, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """`groups` with signed contigs and their order: all of a locus in the direction of its smallest contig.

    The direction spreads along connections, nearer contigs first; a contig that is reached in both directions
    in one round takes the forward one. `ord` is the round in which it was reached.
    """
    steps = pairs.select("src", (-F.col("dst")).alias("dst"))
    steps = steps.unionByName(pairs.select(F.col("dst").alias("src"), (-F.col("src")).alias("dst")))
    steps = scratch.keep(steps.unionByName(steps.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))).distinct())
    first = groups.groupBy("locus_id").agg(F.min(F.when(F.col("is_long"), F.col("node_id"))).alias("node_id")).where("node_id is not null")
    edge = scratch.keep(first.select("locus_id", "node_id", F.lit(0).alias("ord")))
    reached, before, turn = edge, edge, 0
    ids = scratch.keep(groups)
    while True:
        turn += 1
        forward = edge.join(steps.select(F.col("src").alias("node_id"), F.col("dst").alias("to")), "node_id")
        backward = edge.join(steps.select(F.col("dst").alias("node_id"), F.col("src").alias("to")), "node_id")
        near = forward.unionByName(backward).select("locus_id", F.abs("to").alias("contig"), F.col("to").alias("node_id"))
        near = near.join(ids.select("locus_id", F.col("node_id").alias("contig")), ["locus_id", "contig"], "left_semi")
        # a neighbour of this round's contigs that was reached before is of this round or the last
        fresh = near.join(edge.unionByName(before).select("locus_id", F.abs("node_id").alias("contig")), ["locus_id", "contig"], "left_anti")
        before, edge = edge, scratch.keep(fresh.groupBy("locus_id", "contig").agg(F.max("node_id").alias("node_id")).select("locus_id", "node_id", F.lit(turn).alias("ord")))
        if edge.isEmpty():
            break
        reached = reached.unionByName(edge)
    long_ = ids.select("locus_id", F.col("node_id").alias("contig"), "is_long")
    return reached.withColumn("contig", F.abs("node_id")).join(long_, ["locus_id", "contig"]).select("locus_id", "node_id", "ord", "is_long")


def merge(sequences: DataFrame, options: AssemblyOptions) -> tuple[DataFrame, DataFrame]:
    """(transcripts, sequences) of one merged assembly from the transcripts of several, `sequences` (seq_id, seq).

    The sequences become paths through their common contig graph. Paths within others are dropped; the others are
    grouped by the unique contigs they share, and each is a transcript.
    """
    scratch = Scratch(sequences.sparkSession)
    rows = scratch.keep(sequences.select(F.col("seq_id").alias("read_id"), "seq"))
    nodes, places = contigs(rows, replace(options, coverage_cutoff=1))
    occ = scratch.keep(place_reads(rows, nodes, places, options.k))
    arcs = scratch.keep(graph.arcs_of_reads(occ, nodes))
    unique = graph.unique_nodes(nodes, arcs, options.unique_length, options.degree_cutoff).select("node_id", F.lit(True).alias("is_unique"))
    nodes = scratch.keep(nodes.join(unique, "node_id", "left").withColumn("is_unique", F.coalesce("is_unique", F.lit(False))))
    path = F.transform(F.array_sort(F.collect_list(F.struct("off", "node_id"))), lambda s: s["node_id"])
    paths = scratch.keep(occ.groupBy(F.col("read_id").alias("transcript_id")).agg(path.alias("node_path")))
    kept = scratch.keep(paths.join(transcripts.contained_paths(paths), "transcript_id", "left_anti"))
    groups = loci.components(nodes.where("is_unique"), transcripts.path_links(kept, nodes))
    found = transcripts.merged_transcripts(kept, groups)
    return scratch.keep(found), rows.withColumnRenamed("read_id", "transcript_id").join(found.select("transcript_id", "locus_id"), "transcript_id")


def assemble_many(reads: DataFrame, libraries: DataFrame, ks: range | list[int], merge_k: int, options: AssemblyOptions = AssemblyOptions()) -> tuple[DataFrame, DataFrame]:
    """Assemblies for every odd k of `ks`, merged at `merge_k`: what `merge` returns."""
    all_ = None
    for k in ks:
        one = assemble(reads, libraries, replace(options, k=k)).sequences.select(F.lit(k).alias("k"), "transcript_id", "seq")
        all_ = one if all_ is None else all_.unionByName(one)
    named = all_.select((F.col("transcript_id") * 1000 + F.col("k")).alias("seq_id"), "seq")
    return merge(named, replace(options, k=merge_k))
