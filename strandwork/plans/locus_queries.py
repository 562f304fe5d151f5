"""Queries over loci and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.functions import dna
from strandwork.operators import clean, graph, loci, transcripts
from strandwork.plans.graph_queries import Inputs
from strandwork.plans.prelude import K, with_
from strandwork.sources import sinks


def _active(i: Inputs):
    return i.pairs.where("active")


def loci_components(spark, folder):
    i = Inputs(spark, folder)
    return loci.components(i.nodes, _active(i))


def locus_sizes(spark, folder):
    """How many loci there are of each size."""
    return loci_components(spark, folder).groupBy("locus_id").agg(F.count("*").alias("contigs")).groupBy("contigs").agg(F.count("*").alias("loci"))


def _unique_loci(i: Inputs):
    """Components over unique contigs only."""
    return i.scratch.keep(loci.components(i.nodes.where("is_unique"), _active(i)))


def loci_extended(spark, folder):
    i = Inputs(spark, folder)
    return loci.extended(_unique_loci(i), _active(i), i.nodes)


def extended_sizes(spark, folder):
    i = Inputs(spark, folder)
    return loci.sizes(loci.extended(_unique_loci(i), _active(i), i.nodes))


def stop_codon_counts(spark, folder):
    return loci.stop_codons(Inputs(spark, folder).nodes)


def locus_orientation(spark, folder):
    i = Inputs(spark, folder)
    return loci.orientations(i.members, i.nodes)


def reverted_loci(spark, folder):
    i = Inputs(spark, folder)
    members = i.scratch.keep(i.members)
    return loci.reverted(members, loci.orientations(members, i.nodes)).select("locus_id", "node_id", "ord")


def _edges(i: Inputs):
    members = i.scratch.keep(i.members)
    return members, i.scratch.keep(loci.locus_edges(members, i.pairs))


def locus_edges(spark, folder):
    return _edges(Inputs(spark, folder))[1].select("locus_id", "src", "dst", "distance", "weight")


def locus_degree_histogram(spark, folder):
    return loci.degree_histogram(*_edges(Inputs(spark, folder)))


def locus_shape(spark, folder):
    return loci.shapes(loci.degree_histogram(*_edges(Inputs(spark, folder)))).select("locus_id", "shape")


def nearest_incoming(spark, folder):
    return transcripts.nearest_incoming(_edges(Inputs(spark, folder))[1])


def locus_sinks(spark, folder):
    return transcripts.sinks(*_edges(Inputs(spark, folder))).select("locus_id", "node_id", "number")


def simple_transcripts(spark, folder):
    """Transcripts of loci of the shapes LINEAR, FORK and BUBBLE."""
    members, edges = _edges(Inputs(spark, folder))
    shaped = loci.shapes(loci.degree_histogram(members, edges))
    return transcripts.simple_transcripts(members, edges, shaped)


def dp_heaviest_path(spark, folder):
    i = Inputs(spark, folder)
    members, edges = _edges(i)
    found = transcripts.path_cover(members.join(edges.select("locus_id"), "locus_id", "left_semi"), edges, i.nodes, 1)
    return found.select("locus_id", F.round("score", 4).alias("score"), "node_path")


def dp_transcripts(spark, folder):
    """Heaviest paths of each locus until every contig with coverage is on one, 10 at most."""
    i = Inputs(spark, folder)
    found = transcripts.path_cover(*_edges(i), i.nodes, 10)
    return found.select("locus_id", "turn", F.round("score", 4).alias("score"), "node_path")


def transcript_gaps(spark, folder):
    """The k-mers between the contigs of each given transcript, by the distances of its locus's connections."""
    i = Inputs(spark, folder)
    _, edges = _edges(i)
    return transcripts.with_gaps(i.scratch.keep(i.paths.drop("gaps")), edges, i.nodes).select("locus_id", "transcript_id", "gaps")


def unexplained_contigs(spark, folder):
    i = Inputs(spark, folder)
    return transcripts.unexplained_contigs(i.members, i.paths)


def heaviest_unused_node(spark, folder):
    i = Inputs(spark, folder)
    return transcripts.heaviest_unused(i.members, i.paths, i.nodes)


def _laid(i: Inputs):
    return transcripts.layout(i.paths, i.nodes, K)


def contig_ordering(spark, folder):
    return _laid(Inputs(spark, folder)).select("locus_id", "transcript_id", "ord", "node_id", "gap", "finish")


def gap_runs(spark, folder):
    return transcripts.gap_runs(_laid(Inputs(spark, folder)), K)


def transcript_lengths(spark, folder):
    return transcripts.lengths(_laid(Inputs(spark, folder)))


def numbered_transcripts(spark, folder):
    """Transcripts of 100 bases or more with their number in the locus."""
    return transcripts.numbered(transcripts.lengths(_laid(Inputs(spark, folder))), 100).select("locus_id", "transcript_id", "length", "j", "n")


def transcript_sequences(spark, folder):
    i = Inputs(spark, folder)
    return transcripts.sequences(_laid(i), i.nodes, K)


def contained_paths(spark, folder):
    return transcripts.contained_paths(Inputs(spark, folder).paths)


def orphan_paths(spark, folder):
    i = Inputs(spark, folder)
    return transcripts.orphan_paths(i.paths, i._table("loci", "locus_id"))


def merge_loci(spark, folder):
    i = Inputs(spark, folder)
    return loci.components(i.nodes.where("is_unique"), transcripts.path_links(i.paths, i.nodes))


def merge_transcripts(spark, folder):
    i = Inputs(spark, folder)
    groups = loci.components(i.nodes.where("is_unique"), transcripts.path_links(i.paths, i.nodes))
    return transcripts.merged_transcripts(i.paths, groups)


def used_reads(spark, folder):
    """(used, all_reads, loci): reads on a transcript of 100 bases or more, all reads with a sequence, and loci with such a transcript."""
    i = Inputs(spark, folder)
    used = transcripts.used_reads(i.occ, _laid(i), 100, i.heavy)
    long_ = transcripts.lengths(_laid(i)).where("length >= 100")
    parts = (
        used.agg(F.lit("used").alias("what"), F.count("*").alias("n")),
        i.reads.agg(F.lit("all_reads").alias("what"), F.count("seq").alias("n")),
        long_.agg(F.lit("loci").alias("what"), F.count_distinct("locus_id").alias("n")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*(F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("used", "all_reads", "loci")))


def unused_reads(spark, folder):
    i = Inputs(spark, folder)
    return i.reads.where("seq is not null").join(transcripts.used_reads(i.occ, _laid(i), 100, i.heavy), "read_id", "left_anti").select("read_id", "seq")


def reference_mapping(spark, folder):
    """Where reads of an even category lie on transcripts: runs of consecutive contigs of one read."""
    i = Inputs(spark, folder)
    references = i.mates.where("category % 2 = 0").select("read_id")
    return transcripts.read_mappings(_laid(i), i.occ.join(references, "read_id", "left_semi"), K, i.heavy)


def path_distance_marks(spark, folder):
    i = Inputs(spark, folder)
    return transcripts.distance_marks(i.paths, i.nodes)


def renumbered_loci(spark, folder):
    """Loci without their contigs of low coverage, numbered anew."""
    i = Inputs(spark, folder)
    return loci.renumbered(i.members, graph.low_coverage_nodes(i.nodes, 3.0))


def reference_alignments(spark, folder):
    """Lines of the mappings of `reference_mapping`, with places on the references as the headers of the reads give them."""
    i = Inputs(spark, folder)
    unpaired = i._table("test_reads", "read_id", "name", "category", "len").where("category % 2 = 0 and read_id is not null")
    named = unpaired.groupBy("read_id").agg(F.min("name").alias("name"), F.min("len").alias("len"))
    header = F.when(F.col("read_id") % 4 == 0, F.concat_ws("", "name", F.lit(":"), F.col("len") + 9, F.lit("-10"))).otherwise(F.concat_ws("", "name", F.lit(":5-"), F.col("len") + 4))
    places = dna.reference_coordinates(header)
    references = named.select("read_id", places["name"].alias("name"), places["start"].alias("ref_start"), places["finish"].alias("ref_finish"), places["positive_strand"].alias("positive_strand"))
    laid = i.scratch.keep(_laid(i))
    mappings = transcripts.read_mappings(laid, i.occ.join(references.select("read_id"), "read_id", "left_semi"), K, i.heavy)
    return sinks.alignments(mappings, references, transcripts.numbered(transcripts.lengths(laid), 100), K)


def reference_prefix(spark, folder):
    """How many reads of an even category come before the first of another."""
    return clean.leading_references(Inputs(spark, folder).mates, F.col("category") % 2 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        loci_components, locus_sizes, loci_extended, extended_sizes, stop_codon_counts, locus_orientation, reverted_loci, locus_edges,
        locus_degree_histogram, locus_shape, nearest_incoming, locus_sinks, simple_transcripts, dp_heaviest_path, dp_transcripts, transcript_gaps, unexplained_contigs,
        heaviest_unused_node, contig_ordering, gap_runs, transcript_lengths, numbered_transcripts, transcript_sequences, contained_paths,
        orphan_paths, merge_loci, merge_transcripts, used_reads, unused_reads, reference_mapping, reference_alignments, reference_prefix, path_distance_marks, renumbered_loci,
    )
}


def _components(nodes: str, links: str, name: str = "comp") -> str:
    return f"""{name}_e as (select a, b from ({links}) where a in (select node_id from {nodes}) and b in (select node_id from {nodes}) and a <> b),
    {name}_w as (select node_id, node_id as to_ from {nodes} union select w.node_id, e.b from {name}_w w join (select a, b from {name}_e union all select b, a from {name}_e) e on e.a = w.to_),
    {name} as (select node_id, min(to_) as locus_id from {name}_w group by 1)"""


_ACTIVE = "select abs(src) as a, abs(dst) as b from pairs where active"
_UNIQUE = "u as (select node_id from n where is_unique)"
_STOPS = ", ".join(
    f"cast(len(list_filter(range(0, length(seq) - 2), lambda i: i % 3 = {f} and substr(seq, i + 1, 3) in {codons})) as bigint) as {name}{f}"
    for name, codons in (("f", "('TAA', 'TAG', 'TGA')"), ("r", "('TTA', 'CTA', 'TCA')"))
    for f in range(3)
)
_VOTES = f"""stops as (select node_id, {_STOPS} from n where seq is not null),
    back as (select s.node_id, len, sign(least(f0, f1, f2) - least(r0, r1, r2)) as back from stops s join n using (node_id)),
    votes as (select locus_id, cast(sum(len * back * sign(m.node_id)) as bigint) as votes from m join back on back.node_id = abs(m.node_id) group by 1)"""
_HIST = """ends as (select locus_id, src as node_id, 1 as o, 0 as i from edges union all select locus_id, dst, 0, 1 from edges union all select locus_id, node_id, 0, 0 from m),
    deg as (select locus_id, node_id, least(sum(o), 3) as o, least(sum(i), 3) as i from ends group by 1, 2),
    hist as (select locus_id, """ + ", ".join(f"cast(sum((o = {d})::int + (i = {d})::int) as bigint) as d{d}" for d in range(4)) + " from deg group by 1)"
_LINKS = """path_steps as (select transcript_id, unnest(node_path) as node_id, unnest(range(len(node_path))) as ord from p),
    on_u as (select transcript_id, ord, abs(node_id) as c from path_steps where abs(node_id) in (select node_id from u)),
    links as (select distinct c as a, nxt as b from (select c, lead(c) over (partition by transcript_id order by ord) as nxt from on_u) where nxt is not null and nxt <> c)"""
MAPPED = f"""ref as (select read_id, node_id, min(off) as off, arg_min(pos, (off, pos)) as pos from occ join reads using (read_id) where category % 2 = 0 group by 1, 2),
    hits as (select l.transcript_id, l.ord, l.finish - l.gap - l.len as start, l.finish - l.gap as finish, r.read_id, sign(r.node_id) = sign(l.node_id) as same, r.off, r.off + l.len - r.pos as upto
      from laid l join ref r on abs(r.node_id) = abs(l.node_id)),
    marked as (select *, case when lag(ord) over w = ord - 1 then 0 else 1 end as new from hits window w as (partition by transcript_id, read_id, same order by ord)),
    runs as (select *, sum(new) over (partition by transcript_id, read_id, same order by ord) as run from marked),
    mapped as (select transcript_id, read_id, same, min(start) - {K - 2} as start, max(finish) as finish, count(*) as contigs, min(off) as low, max(upto) as high
      from runs group by transcript_id, read_id, same, run)"""

# every way from a contig without an edge into it; the loci of the tables have no cycles
_WAYS = """weighed as (select locus_id, src, dst, max(coalesce(weight, 0)) as weight from edges where src <> dst group by 1, 2, 3),
    way as (select distinct locus_id, src as node_id, 0.0::double as score, [src] as path from weighed e
        where not exists (select 1 from weighed f where f.locus_id = e.locus_id and f.dst = e.src)
      union all select k.locus_id, e.dst, score + weight, list_append(path, e.dst) from way k join weighed e on e.locus_id = k.locus_id and e.src = k.node_id),
    top as (select locus_id, score, path from (select *, row_number() over (partition by locus_id order by score desc, list_reverse(path)) as r from way) where r = 1)"""


def _cover(most: int) -> str:
    """One group of tables a turn: the contig to go through, the ways through it, and what has been found."""
    parts = [
        """sums as (select locus_id, sum(coalesce(weight, 0)) + 1 as total from edges group by 1),
        open_ as (select locus_id, m.node_id, cov from m join n on n.node_id = abs(m.node_id) where cov > 0),
        found0 as (select locus_id, 0 as turn, score, path from top union all
          select locus_id, 0, null, [arg_max(node_id, (cov, -node_id))] from open_ where locus_id not in (select locus_id from edges) group by 1)"""
    ]
    for t in range(1, most):
        parts.append(f"""on{t} as (select distinct locus_id, abs(unnest(path)) as c from found{t - 1}),
        next{t} as (select locus_id, arg_max(node_id, (cov, -node_id)) as forced from open_ o
          where not exists (select 1 from on{t} x where x.locus_id = o.locus_id and x.c = abs(o.node_id)) group by 1),
        best{t} as (select locus_id, score, path from (
          select *, row_number() over (partition by locus_id order by score desc, list_reverse(path)) as r from (
            select locus_id, path, score + total * coalesce((list_position(path, forced) > 1)::int + (list_position(path, forced) < len(path))::int, 0) as score
            from way join next{t} using (locus_id) join sums using (locus_id))) where r = 1),
        found{t} as (select * from found{t - 1} union all
          select locus_id, {t}, case when list_contains(path, forced) then score end, case when list_contains(path, forced) then path else [forced] end
          from next{t} left join best{t} using (locus_id))""")
    return ",\n".join(parts)


_USED = "used as (select distinct read_id from occ where abs(node_id) in (select abs(node_id) from laid where transcript_id in (select transcript_id from laid group by 1 having max(finish) >= 100)))"

SQL = {
    "loci_components": f"{with_('n', 'pairs', recursive=True)}, {_components('n', _ACTIVE)} select node_id, locus_id from comp",
    "locus_sizes": f"{with_('n', 'pairs', recursive=True)}, {_components('n', _ACTIVE)} select contigs, count(*) as loci from (select locus_id, count(*) as contigs from comp group by 1) group by 1",
    "loci_extended": f"""{with_('n', 'pairs', 'both', recursive=True)}, {_UNIQUE}, {_components('u', _ACTIVE)}
        select locus_id, node_id, true as is_long from comp union
        select distinct locus_id, abs(b.dst), false from both_ways b join comp on comp.node_id = abs(b.src) join n on n.node_id = abs(b.dst) and not n.is_unique where b.active""",
    "extended_sizes": f"""{with_('n', 'pairs', 'both', recursive=True)}, {_UNIQUE}, {_components('u', _ACTIVE)},
        ext as (select locus_id, node_id, true as is_long from comp union
        select distinct locus_id, abs(b.dst), false from both_ways b join comp on comp.node_id = abs(b.src) join n on n.node_id = abs(b.dst) and not n.is_unique where b.active)
        select locus_id, count(*) as contigs, count(*) filter (is_long) as long_contigs from ext group by 1""",
    "stop_codon_counts": f"{with_('n')} select node_id, {_STOPS} from n where seq is not null",
    "locus_orientation": f"{with_('n', 'm')}, {_VOTES} select locus_id, votes, votes > 0 as inverted from votes",
    "reverted_loci": f"{with_('n', 'm')}, {_VOTES} select m.locus_id, case when votes > 0 then -node_id else node_id end as node_id, ord from m left join votes using (locus_id)",
    "locus_edges": f"{with_('m', 'pairs', 'both', 'edges')} select locus_id, src, dst, distance, weight from edges",
    "locus_degree_histogram": f"{with_('m', 'pairs', 'both', 'edges')}, {_HIST} select locus_id, d0, d1, d2, d3 from hist",
    "locus_shape": f"""{with_('m', 'pairs', 'both', 'edges')}, {_HIST} select locus_id, case when d0 = 2 and d2 = 0 and d3 = 0 then 'LINEAR'
        when d0 = 3 and d2 = 1 and d3 = 0 then 'FORK' when d0 = 2 and d2 = 2 and d3 = 0 then 'BUBBLE' else 'UNKNOWN' end as shape from hist""",
    "nearest_incoming": f"""{with_('m', 'pairs', 'both', 'edges')}, r as (select *, row_number() over (partition by locus_id, dst order by distance nulls first, src) as r from edges)
        select locus_id, dst as node_id, max(src) filter (r = 1) as first, max(src) filter (r = 2) as second from r group by 1, 2""",
    "locus_sinks": f"""{with_('m', 'pairs', 'both', 'edges')} select locus_id, node_id, cast(row_number() over (partition by locus_id order by ord, node_id) as int) as number
        from m where not exists (select 1 from edges e where e.locus_id = m.locus_id and e.src = m.node_id)""",
    "dp_heaviest_path": f"{with_('m', 'pairs', 'both', 'edges', recursive=True)}, {_WAYS} select locus_id, round(score, 4) as score, path as node_path from top",
    "dp_transcripts": f"""{with_('n', 'm', 'pairs', 'both', 'edges', recursive=True)}, {_WAYS}, {_cover(10)}
        select locus_id, turn, round(score, 4) as score, path as node_path from found9""",
    "transcript_gaps": f"""{with_('n', 'm', 'p', 'pairs', 'both', 'edges')}, s as (select locus_id, transcript_id, unnest(node_path) as src, unnest(list_append(node_path[2:], null)) as dst, unnest(range(len(node_path))) as ord from p),
        far as (select locus_id, src, dst, min(distance) as distance from edges group by 1, 2, 3),
        g as (select s.*, greatest(0, coalesce(cast(floor(round(distance, 6)) as bigint) - a.len // 2 - b.len // 2 - greatest(a.len % 2, b.len % 2), 0)) as gap
          from s left join far using (locus_id, src, dst) left join n a on a.node_id = abs(s.src) left join n b on b.node_id = abs(s.dst))
        select locus_id, transcript_id, list(gap order by ord) as gaps from g group by 1, 2""",
    "unexplained_contigs": f"""{with_('m', 'p')}, on_ as (select distinct locus_id, abs(unnest(node_path)) as c from p)
        select locus_id, node_id from m where not exists (select 1 from on_ where on_.locus_id = m.locus_id and c = abs(m.node_id))""",
    "heaviest_unused_node": f"""{with_('n', 'm', 'p')}, on_ as (select distinct locus_id, abs(unnest(node_path)) as c from p),
        left_ as (select m.locus_id, m.node_id, n.cov from m join n on n.node_id = abs(m.node_id) where n.cov > 0
          and not exists (select 1 from on_ where on_.locus_id = m.locus_id and c = abs(m.node_id)))
        select locus_id, node_id, cov from (select *, row_number() over (partition by locus_id order by cov desc, node_id) as r from left_) where r = 1""",
    "contig_ordering": f"{with_('n', 'p', 'laid')} select locus_id, transcript_id, ord, node_id, gap, finish from laid",
    "gap_runs": f"{with_('n', 'p', 'laid')} select locus_id, transcript_id, run, count(*) as contigs, cast(sum(len) + {K - 1} as bigint) as length from laid group by 1, 2, 3",
    "transcript_lengths": f"{with_('n', 'p', 'laid')} select locus_id, transcript_id, count(*) as contigs, max(finish) as length from laid group by 1, 2",
    "numbered_transcripts": f"""{with_('n', 'p', 'laid')}, l as (select locus_id, transcript_id, max(finish) as length from laid group by 1, 2 having max(finish) >= 100)
        select locus_id, transcript_id, length, row_number() over (partition by locus_id order by transcript_id desc) as j, count(*) over (partition by locus_id) as n from l""",
    "transcript_sequences": f"""{with_('n', 'p', 'laid')}, o as (select l.locus_id, l.transcript_id, l.ord, lag(l.gap) over (partition by transcript_id order by ord) as before,
          case when l.node_id > 0 then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end as seq, count(seq) over (partition by transcript_id) as have, count(*) over (partition by transcript_id) as all_
        from laid l join n on n.node_id = abs(l.node_id))
        select locus_id, transcript_id, ltrim(string_agg(case when before is null then seq when before > 0 then repeat('N', before) || seq else substr(seq, {K}) end, '' order by ord), 'N') as seq
        from o where have = all_ group by 1, 2""",
    "contained_paths": f"""{with_('p')}, k as (select transcript_id, node_path, array_to_string(node_path, ',') as one, array_to_string(list_reverse(list_transform(node_path, lambda x: -x)), ',') as two from p),
        d as (select least(one, two) as key, min(transcript_id) as kept, any_value(',' || one || ',') as f, any_value(',' || two || ',') as b, any_value(len(node_path)) as n, any_value(abs(node_path[1])) as head,
          any_value(list_transform(node_path, lambda x: abs(x))) as cs from k group by 1),
        e as (select key, f, b, n, unnest(list_distinct(cs)) as c from d),
        inside as (select distinct s.key from d s join e l on l.c = s.head and s.n < l.n and (contains(l.f, s.f) or contains(l.b, s.f)))
        select transcript_id from k join d on d.key = least(one, two) where transcript_id > kept or d.key in (select key from inside)""",
    "orphan_paths": f"{with_('p')} select transcript_id, locus_id from p where locus_id not in (select locus_id from loci where locus_id is not null)",
    "merge_loci": f"{with_('n', 'p', recursive=True)}, {_UNIQUE}, {_LINKS}, {_components('u', 'select a, b from links')} select node_id, locus_id from comp",
    "merge_transcripts": f"""{with_('n', 'p', recursive=True)}, {_UNIQUE}, {_LINKS}, {_components('u', 'select a, b from links')},
        s as (select transcript_id, ord, abs(node_id) as node_id from path_steps),
        first as (select transcript_id, arg_min(locus_id, ord) as locus_id from s join comp using (node_id) group by 1),
        own as (select s.transcript_id, node_id, coalesce(locus_id, -s.transcript_id) as locus_id from s left join first using (transcript_id)),
        size_ as (select locus_id, count(distinct node_id) as all_ from own group by 1)
        select locus_id, transcript_id, count(distinct node_id) as contigs, round(count(distinct node_id) / any_value(all_), 6) as confidence from own join size_ using (locus_id) group by 1, 2""",
    "used_reads": f"""{with_('n', 'p', 'occ', 'reads', 'laid')}, {_USED} select (select count(*) from used) as used, (select count(seq) from reads) as all_reads,
        (select count(distinct locus_id) from (select locus_id, transcript_id from laid group by 1, 2 having max(finish) >= 100)) as loci""",
    "unused_reads": f"{with_('n', 'p', 'occ', 'reads', 'laid')}, {_USED} select read_id, seq from reads where seq is not null and read_id not in (select read_id from used)",
    "reference_mapping": f"{with_('n', 'p', 'occ', 'reads', 'laid')}, {MAPPED} select transcript_id, read_id, same, start, finish, contigs, low, high from mapped",
    "reference_alignments": f"""{with_('n', 'p', 'occ', 'reads', 'laid')}, {MAPPED},
        num as (select locus_id, transcript_id, row_number() over (partition by locus_id order by transcript_id desc) as j
          from (select locus_id, transcript_id from laid group by 1, 2 having max(finish) >= 100)),
        named as (select read_id, coalesce(min(name), '') as name, read_id % 4 <> 0 as positive, case when read_id % 4 = 0 then 10 else 5 end as s, min(len) + case when read_id % 4 = 0 then 9 else 4 end as f
          from test_reads where category % 2 = 0 group by 1),
        lines as (select locus_id, j, start, finish, name, case when same and positive then s + low when same then f - low + {K - 1} when positive then s + high + {K - 1} else f - high end as first,
          case when same and positive then s + high + {K - 2} when same then f - high + 1 when positive then s + low + 1 else f - low + {K} end as last
          from mapped join named using (read_id) join num using (transcript_id))
        select locus_id, j, start, printf('%d' || chr(9) || '%d' || chr(9) || '%s' || chr(9) || '%d' || chr(9) || '%d', start, finish, name, first, last) as value from lines
        union all select locus_id, j, 0, printf('>Locus_%d_Transcript_%d', locus_id, j) from num""",
    "path_distance_marks": f"""{with_('n', 'p')}, s as (select transcript_id, unnest(node_path) as node_id, unnest(range(len(node_path))) as ord from p)
        select transcript_id, cast(ord as int) as ord, s.node_id, cast(sum(coalesce(len, 0)) over (partition by transcript_id order by ord) - coalesce(len, 0) as bigint) as start,
          cast(sum(coalesce(len, 0)) over (partition by transcript_id order by ord) as bigint) as finish from s left join n on n.node_id = abs(s.node_id)""",
    "renumbered_loci": f"""{with_('n', 'm')} select locus_id, node_id, cast(row_number() over (partition by locus_id order by ord, node_id) - 1 as int) as ord, is_long
        from m where abs(node_id) not in (select node_id from n where len > 0 and cov / len < 3.0)""",
    "simple_transcripts": f"""{with_('m', 'pairs', 'both', 'edges', recursive=True)}, {_HIST},
        shaped as (select locus_id, case when d0 = 2 and d2 = 0 and d3 = 0 then 'LINEAR' when d0 = 3 and d2 = 1 and d3 = 0 then 'FORK' when d0 = 2 and d2 = 2 and d3 = 0 then 'BUBBLE' end as shape from hist),
        near as (select locus_id, dst as node_id, max(src) filter (r = 1) as first, max(src) filter (r = 2) as second
          from (select *, row_number() over (partition by locus_id, dst order by distance nulls first, src) as r from edges) group by 1, 2),
        sink as (select locus_id, node_id, row_number() over (partition by locus_id order by ord, node_id) as number
          from m where not exists (select 1 from edges e where e.locus_id = m.locus_id and e.src = m.node_id)),
        tails as (select locus_id, shape, max(node_id) filter (number = 1) as one, max(node_id) filter (number = 2) as two from sink join shaped using (locus_id) where shape is not null group by 1, 2),
        start as (select locus_id, 1 as walk, one as node_id, shape, two from tails
          union all select locus_id, 2, case when shape = 'FORK' and two is not null then two else one end, shape, two from tails
            where shape <> 'LINEAR' and (two is null or shape in ('FORK', 'BUBBLE'))),
        back as (select locus_id, walk, node_id, [node_id] as path, shape = 'FORK' and two is not null as apart from start
          union all select b.locus_id, walk, case when walk = 1 or apart then first else coalesce(second, first) end,
            list_prepend(case when walk = 1 or apart then first else coalesce(second, first) end, path), apart
          from back b join near on near.locus_id = b.locus_id and near.node_id = b.node_id
          where not list_contains(path, case when walk = 1 or apart then first else coalesce(second, first) end))
        select locus_id, walk, arg_max(path, len(path)) as node_path from back group by 1, 2""",
    "reference_prefix": f"""{with_('reads')} select count(*) as "references" from reads
        where read_id < coalesce((select min(read_id) from reads where not coalesce(category % 2 = 0, false)), 9223372036854775807)""",
}
