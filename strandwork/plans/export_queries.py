"""Queries whose rows are the blocks of the text exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import graph, loci, scaffold, splicing, transcripts
from strandwork.plans.graph_queries import _EXPECTED_CTE, Inputs, _expected
from strandwork.plans.locus_queries import MAPPED
from strandwork.plans.prelude import K, with_
from strandwork.sources import sinks
from strandwork.sources.tables import table


def _numbered(i: Inputs):
    laid = i.scratch.keep(transcripts.layout(i.paths, i.nodes, K))
    return laid, transcripts.numbered(transcripts.lengths(laid), 100)


def transcript_fasta(spark, folder):
    i = Inputs(spark, folder)
    laid, numbered = _numbered(i)
    return sinks.transcripts_fasta(numbered, transcripts.sequences(laid, i.nodes, K), i.paths)


def contig_order_lines(spark, folder):
    i = Inputs(spark, folder)
    laid, numbered = _numbered(i)
    return sinks.contig_ordering(numbered, laid, i.paths, K)


def unused_reads_fasta(spark, folder):
    i = Inputs(spark, folder)
    used = transcripts.used_reads(i.occ, transcripts.layout(i.paths, i.nodes, K), 100, i.heavy)
    names = table(spark, folder, "test_reads", "read_id", "name").where("read_id is not null").groupBy("read_id").agg(F.min("name").alias("name"))
    return sinks.reads_fasta(i.reads.join(used, "read_id", "left_anti").join(names, "read_id"))


def removed_contigs_fasta(spark, folder):
    """Contigs that the coverage cutoff takes away."""
    i = Inputs(spark, folder)
    nodes = i.nodes.where((F.col("len") > 0) & (F.col("cov") / F.col("len") < 3.0))
    return sinks.contigs_fasta(nodes)


def locus_contig_records(spark, folder):
    i = Inputs(spark, folder)
    return sinks.locus_contigs_fasta(i.members, i.nodes)


def locus_graphs(spark, folder):
    i = Inputs(spark, folder)
    return sinks.locus_graphs(i.members, i.pairs)


def connection_report(spark, folder):
    i = Inputs(spark, folder)
    tested = i.scratch.keep(_expected(i))
    return sinks.connection_report(tested, scaffold.reliable(tested))


def splice_events(spark, folder):
    i = Inputs(spark, folder)
    return splicing.splice_events(i.scratch.keep(loci.locus_edges(i.members, i.pairs)), i.scratch.keep(i.nodes), K)


def splice_event_lines(spark, folder):
    return sinks.event_lines(splice_events(spark, folder))


def mapping_lines(spark, folder):
    i = Inputs(spark, folder)
    references = i.mates.where("category % 2 = 0").select("read_id")
    laid = transcripts.layout(i.paths, i.nodes, K)
    return sinks.mapping_lines(transcripts.read_mappings(laid, i.occ.join(references, "read_id", "left_semi"), K, i.heavy))


def assembly_messages(spark, folder):
    """How many messages of each kind an export has, and their letters."""
    i = Inputs(spark, folder)
    laid = i.scratch.keep(transcripts.layout(i.paths, i.nodes, K))
    all_ = sinks.messages(i.libraries, i.reads, laid, i.occ, i.nodes, K, i.heavy)
    return all_.groupBy("kind").agg(F.count("*").alias("messages"), F.sum(F.length("value")).alias("letters"))


def assembly_stats(spark, folder):
    """Contigs, their k-mers, the longest, and the length at which half of all k-mers lie in contigs at least as long."""
    return graph.stats(Inputs(spark, folder).nodes)


QUERIES = {
    f.__name__: f
    for f in (transcript_fasta, contig_order_lines, unused_reads_fasta, removed_contigs_fasta, locus_contig_records, locus_graphs, connection_report, splice_events, splice_event_lines, mapping_lines, assembly_messages, assembly_stats)
}

_WRAP = "rtrim(regexp_replace({}, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))"
_NUMBERED = """num as (select *, row_number() over (partition by locus_id order by transcript_id desc) as j, count(*) over (partition by locus_id) as n
    from (select locus_id, transcript_id, max(finish) as length from laid group by 1, 2 having max(finish) >= 100))"""
_MILLI = "case when confidence is null or isnan(confidence) then 0 else cast(floor(confidence * 1000 + 0.5) as bigint) end"
_HEAD = f"printf('>Locus_%d_Transcript_%d/%d_Confidence_%d.%03d_Length_%d', num.locus_id, j, num.n, ({_MILLI}) // 1000, ({_MILLI}) % 1000, {{}}) || chr(10)"
_RC = "reverse(translate(regexp_replace({}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"

_EVENTS = f"""{with_('n', 'm', 'pairs', 'both', 'edges')}, out_ as (select locus_id, src, count(*) as c, min(dst) as one, max(dst) as two from edges group by 1, 2),
        s as (select node_id as id, seq, {_RC.format('seq')} as rc, len from n where seq is not null union all select -node_id, {_RC.format('seq')}, {_RC.format(_RC.format('seq'))}, len from n where seq is not null),
        f as (select o.locus_id, o.src as n0, z.seq as s0, case when b.len > a.len then b else a end as x, case when b.len > a.len then a else b end as y
          from out_ o join s z on z.id = o.src join s a on a.id = o.one join s b on b.id = o.two where o.c = 2),
        g as (select f.*, case when p.one = q.one then p.one end as n3 from f left join out_ p on p.locus_id = f.locus_id and p.src = x.id and p.c = 1
          left join out_ q on q.locus_id = f.locus_id and q.src = y.id and q.c = 1 where x.len >= {2 * K - 1}),
        h as (select g.*, contains(right(s0, 3) || substr(x.seq, {K}, 5), 'GT') as donor, contains(right(t.rc, 3) || substr(x.rc, {K}, 5), 'CA') as acceptor from g left join s t on t.id = n3)
        select locus_id, case when donor and acceptor then 'intron_retention' when donor then 'alternative_5prime_splice' when acceptor then 'alternative_3prime_splice' else 'skipped_exon' end as event,
          n0, x.id as n1, y.id as n2, n3 from h where y.len < {2 * K - 1} and n3 is not null
        union all select locus_id, 'alternative_polyA', n0, x.id, y.id, null from h where y.len >= {2 * K - 1} and regexp_matches(s0, 'AATAAA|ATTAAA') and regexp_matches(x.seq, 'AATAAA|ATTAAA')
        union all select locus_id, 'mutually_exclusive_exons', n0, x.id, y.id, n3 from h where y.len >= {2 * K - 1} and n3 is not null"""

SQL = {
    "transcript_fasta": f"""{with_('n', 'p', 'laid')}, {_NUMBERED}, o as (select l.transcript_id, l.ord, lag(l.gap) over (partition by transcript_id order by ord) as before,
          case when l.node_id > 0 then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end as seq, count(seq) over (partition by transcript_id) as have, count(*) over (partition by transcript_id) as all_
        from laid l join n on n.node_id = abs(l.node_id)),
        s as (select transcript_id, ltrim(string_agg(case when before is null then seq when before > 0 then repeat('N', before) || seq else substr(seq, {K}) end, '' order by ord), 'N') as seq
        from o where have = all_ group by 1)
        select num.locus_id, j, {_HEAD.format('length(seq)')} || {_WRAP.format('seq')} as value
        from num join s using (transcript_id) join p using (transcript_id)""",
    "contig_order_lines": f"""{with_('n', 'p', 'laid')}, {_NUMBERED}, a as (select *, lead(len) over (partition by transcript_id order by ord) as after from laid),
        l as (select transcript_id, string_agg(case when after is null then printf('%d:%d', node_id, finish)
          else printf('%d:%d-(%d)->', node_id, cast(finish - gap as bigint), case when gap < {K} and after >= {K - 1} then 0 else gap end) end, '' order by ord) as line from a group by 1)
        select num.locus_id, j, {_HEAD.format('length')} || line as value
        from num join l using (transcript_id) join p using (transcript_id)""",
    "unused_reads_fasta": f"""{with_('n', 'p', 'occ', 'reads', 'laid')},
        used as (select distinct read_id from occ where abs(node_id) in (select abs(node_id) from laid where transcript_id in (select transcript_id from laid group by 1 having max(finish) >= 100))),
        names as (select read_id, min(name) as name from test_reads where read_id is not null group by 1)
        select read_id, printf('>%s' || chr(9) || '%d' || chr(9) || '%d', name, read_id, coalesce(category, 0)) || chr(10) || {_WRAP.format('seq')} as value
        from reads join names using (read_id) where seq is not null and read_id not in (select read_id from used)""",
    "removed_contigs_fasta": f"""{with_('n')} select node_id, printf('>NODE_%d_Length_%d_Coverage_%d', node_id, len, cov) || chr(10) || {_WRAP.format('seq')} as value
        from n where len > 0 and cov / len < 3.0 and seq is not null""",
    "locus_contig_records": f"""{with_('n', 'm')} select locus_id, ord, m.node_id, printf('>Locus_%d_Node_%d', locus_id, abs(m.node_id)) || chr(10)
          || {_WRAP.format("case when m.node_id > 0 then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end")} as value
        from m join n on n.node_id = abs(m.node_id) where seq is not null""",
    "locus_graphs": f"""{with_('m', 'pairs', 'both')}, s as (select a.locus_id, c.src, -c.dst as to_, c.* exclude (src) from m a join both_ways c on c.src = a.node_id join m b on b.locus_id = a.locus_id and b.node_id = -c.dst)
        select locus_id, 1 as part, cast(node_id as varchar) as value from m
        union all select locus_id, 2, case when active then printf('%d -> %d [label="%d_%d_%d"]', src, to_, cast(floor(distance) as bigint), paired_count, direct_count) else printf('%d -> %d [label="XXX"]', src, to_) end from s
        union all select distinct locus_id, 0, printf('digraph locus_%d {{', locus_id) from m union all select distinct locus_id, 3, '}}' from m""",
    "connection_report": f"""{with_('n', 'occ', 'reads', 'lib', 'pairs')}, {_EXPECTED_CTE}
        select src, dst, concat_ws(chr(9), src, dst, direct_count, paired_count, expected, case when weight >= 0.1 and paired_count + direct_count >= 4
          and case when len_dst <= 50 or expected = 0 then direct_count > 0 else paired_count >= expected * 0.1 end then 'OK' else 'NG' end) as value from expect""",
    "splice_events": _EVENTS,
    "splice_event_lines": f"""select locus_id, n0, printf('[%s] %d %d %d %s', case event when 'mutually_exclusive_exons' then 'MEE' when 'skipped_exon' then 'SE'
          when 'alternative_5prime_splice' then 'a5p' when 'alternative_3prime_splice' then 'a3p' when 'intron_retention' then 'IR' else 'aPS' end,
          n0, n1, n2, coalesce(cast(n3 as varchar), '-')) as value from ({_EVENTS})""",
    "mapping_lines": f"""{with_('n', 'p', 'occ', 'reads', 'laid')}, {MAPPED}
        select transcript_id, start, concat_ws(chr(9), transcript_id, start, finish, read_id, case when same then '+' else '-' end) as value from mapped""",
    "assembly_messages": f"""{with_('n', 'p', 'occ', 'reads', 'lib', 'laid')},
        runs as (select *, row_number() over (order by locus_id, transcript_id, run) as iid from (
          select locus_id, transcript_id, run, sum(len) as kmers, min(finish - gap - len) as begin, min(ord) as first from laid group by 1, 2, 3)),
        named as (select l.*, iid, begin, first, n.seq as given from laid l join runs using (locus_id, transcript_id, run) join n on n.node_id = abs(l.node_id)),
        spelled as (select iid, count(given) = count(*) as whole,
            ltrim(string_agg(substr(case when node_id > 0 then given else reverse(translate(given, 'ACGT', 'TGCA')) end, case when ord = first then 1 else {K} end), '' order by ord), 'N') as seq
          from named group by 1),
        pr as (select r.* from reads r join lib using (category) where mate_id is not null),
        tiled as (select locus_id, transcript_id, string_agg(printf('{{TLE|off:%d|clr:0,%d|src:%d|}}|', cast(begin + (run - 1) * {K - 1} as bigint), cast(kmers + {K - 1} as bigint), iid), '' order by run) as tiles from runs group by 1, 2),
        hits as (select iid, o.read_id, coalesce(length(r.seq), 0) as span, o.node_id = l.node_id as same,
            l.finish - l.gap - l.len - begin + case when o.node_id = l.node_id then pos - off else l.len - pos + off - coalesce(length(r.seq), 0) + {K - 1} end as spot
          from named l join occ o on abs(o.node_id) = abs(l.node_id) left join reads r on r.read_id = o.read_id),
        told as (select '1LIB' as kind, printf('{{LIB|iid:%d|{{DST|mea:%d|std:%d|}}|}}', cast(category // 2 + 1 as bigint), cast(floor(mean) as bigint), cast(floor(sd) as bigint)) as value from lib
          union all select '2FRG', printf('{{FRG|lib:%d|rds:%d,%d|eid:%d|iid:%d|typ:I|}}', cast(category // 2 + 1 as bigint), read_id, mate_id, read_id, read_id) from pr where mate_id > read_id
          union all select '3RED', printf('{{RED|iid:%d|eid:%d|', read_id, read_id) || case when mate_id is not null and category in (select category from lib) then printf('frg:%d|', least(read_id, mate_id)) else '' end
            || 'seq:|' || {_WRAP.format('seq')} || '|.|qlt:|' || {_WRAP.format('seq')} || '|.|}}' from reads where seq is not null
          union all select '4CTG', printf('{{CTG|iid:%d|eid:%d-%d-%d|seq:|', iid, locus_id, transcript_id, run) || {_WRAP.replace('60', '61').format('seq')} || '|.|qlt:|'
            || {_WRAP.replace('60', '61').format("repeat('I', length(seq))")} || '|.|}}' from runs join spelled using (iid) where whole
          union all select '5SCF', printf('{{SCF|eid:%d-%d|', locus_id, transcript_id) || tiles || '}}' from tiled
          union all select '6TLE', printf('{{TLE|ctg:%d|src:%d|off:%d|clr:%d,%d|}}', iid, read_id, spot, case when same then 0 else span end, case when same then span else 0 end) from hits)
        select kind, count(*) as messages, cast(sum(length(value)) as bigint) as letters from told group by 1""",
    "assembly_stats": f"""{with_('n')}, l as (select len, sum(len) over (order by len desc, node_id) as upto, sum(len) over () as total from n where len > 0)
        select count(*) as contigs, cast(sum(len) as bigint) as kmers, cast(max(len) as bigint) as longest, cast(max(len) filter (upto * 2 >= total) as bigint) as n50 from l""",
}
