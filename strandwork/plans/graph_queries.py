"""Queries over the contig graph and the connections between contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import clean, compact, graph, scaffold, similarity
from strandwork.plans.prelude import K, with_
from strandwork.shared import Scratch, heavy_keys
from strandwork.sources.tables import table


class Inputs:
    """The cleaned tables of a folder, each made when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.scratch = spark, folder, Scratch(spark)
        self._heavy: list | None = None

    def _table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    @property
    def reads(self) -> DataFrame:
        return clean.reads(self._table("test_reads", "read_id", "mate_id", "category", "seq"))

    @property
    def mates(self) -> DataFrame:
        """Reads without their sequences."""
        return clean.reads(self._table("test_reads", "read_id", "mate_id", "category").withColumn("seq", F.lit(None).cast("string")))

    @property
    def nodes(self) -> DataFrame:
        return clean.nodes(self._table("nodes"))

    @property
    def occ(self) -> DataFrame:
        return clean.occurrences(self._table("read_occ"))

    @property
    def heavy(self) -> list:
        """The contigs that hold more than a thousandth of the occurrences each."""
        if self._heavy is None:
            self._heavy = heavy_keys(self._table("read_occ", "node_id").where("node_id <> 0").select(F.abs("node_id").alias("contig")), "contig")
        return self._heavy

    @property
    def pairs(self) -> DataFrame:
        return clean.links(self._table("connections"))

    @property
    def libraries(self) -> DataFrame:
        return clean.libraries(self._table("libraries"))

    @property
    def members(self) -> DataFrame:
        return clean.members(self._table("locus_nodes", "locus_id", "node_id", "ord", "is_long"))

    @property
    def paths(self) -> DataFrame:
        return clean.paths(self._table("transcripts", "locus_id", "transcript_id", "node_path", "gaps", "confidence"))

    @property
    def arcs(self) -> DataFrame:
        return self.scratch.keep(graph.arcs_of_reads(self.occ, self.nodes, self.heavy))

    @property
    def placed(self) -> DataFrame:
        return self.scratch.keep(scaffold.usable(self.occ, self.nodes, self.heavy))

    def evidence(self) -> tuple[DataFrame, DataFrame]:
        """Direct and paired connections, row by row."""
        placed = self.placed
        return scaffold.direct_connections(placed), scaffold.paired_connections(placed, self.mates, self.libraries)


def node_arcs(spark, folder):
    return Inputs(spark, folder).arcs


def node_degrees(spark, folder):
    return graph.degrees(Inputs(spark, folder).arcs)


def unique_nodes(spark, folder):
    i = Inputs(spark, folder)
    return graph.unique_nodes(i.nodes, i.arcs)


def coverage_cutoff(spark, folder):
    return graph.low_coverage_nodes(Inputs(spark, folder).nodes, 3.0)


def dubious_reads(spark, folder):
    i = Inputs(spark, folder)
    return graph.dubious_reads(i.occ, graph.low_coverage_nodes(i.nodes, 3.0), i.heavy)


def trusted_occurrences(spark, folder):
    """Occurrences of reads that lie on no node of low coverage, per node."""
    i = Inputs(spark, folder)
    occ = i.scratch.keep(i.occ)
    bad = graph.dubious_reads(occ, graph.low_coverage_nodes(i.nodes, 3.0), i.heavy)
    return occ.join(bad, "read_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("occurrences"))


def low_fraction_arcs(spark, folder):
    return graph.low_fraction_arcs(Inputs(spark, folder).arcs, 0.1).select("src", "dst", "multiplicity", "total")


def tips_round1(spark, folder):
    i = Inputs(spark, folder)
    return graph.tips(i.nodes, i.arcs, K)


def tips_fixpoint(spark, folder):
    i = Inputs(spark, folder)
    return graph.clip_tips(i.nodes, i.arcs, K)


def _long_reads(i: Inputs) -> DataFrame:
    """Reads of an even category, taken for long ones."""
    return i.mates.where("category % 2 = 0").select("read_id")


def coverage_cutoff_keeping_long(spark, folder):
    """Nodes of low coverage that no long read lies on."""
    i = Inputs(spark, folder)
    return graph.low_coverage_nodes(i.nodes, 3.0, graph.nodes_of_reads(i.occ, _long_reads(i)))


def tips_keeping_long(spark, folder):
    i = Inputs(spark, folder)
    return graph.tips(i.nodes, i.arcs, K, graph.nodes_of_reads(i.occ, _long_reads(i)))


def low_fraction_arcs_of_long(spark, folder):
    """Weak arcs that a long read goes along."""
    i = Inputs(spark, folder)
    along = graph.arcs_of_reads(i.occ.join(_long_reads(i), "read_id", "left_semi"), i.nodes, i.heavy)
    return graph.low_fraction_arcs(i.arcs, 0.1, along.select("src", "dst")).select("src", "dst", "multiplicity", "total")


def reads_along_weak_arcs(spark, folder):
    i = Inputs(spark, folder)
    return graph.reads_along(i.scratch.keep(i.occ), i.scratch.keep(graph.low_fraction_arcs(i.arcs, 0.1)))


def total_coverage(spark, folder):
    """Coverage of each node by short reads and by reads of an even category."""
    i = Inputs(spark, folder)
    return graph.total_coverage(i.nodes, i.occ, i.reads.where("category % 2 = 0 and seq is not null"), K)


def seed_order(spark, folder):
    i = Inputs(spark, folder)
    return graph.seed_order(i.nodes, i.arcs)


def minority_tips(spark, folder):
    i = Inputs(spark, folder)
    return graph.minority_tips(i.nodes, i.arcs, K)


def unipaths(spark, folder):
    return graph.chains(Inputs(spark, folder).arcs)


def joined_contigs(spark, folder):
    """Contigs once unbranched chains of them, where they overlap, are one."""
    i = Inputs(spark, folder)
    return compact.join_chains(i.scratch.keep(i.nodes.drop("is_unique")), i.scratch.keep(i.arcs), i.scratch.keep(i.occ), K)[0]


def shared_reads_between_nodes(spark, folder):
    i = Inputs(spark, folder)
    return graph.shared_reads(i.occ, i.pairs)


def read_occurrences(spark, folder):
    return scaffold.occurrences_by_read(Inputs(spark, folder).occ)


def ambiguous_occurrences(spark, folder):
    """Reads that hit a contig more than once, and how often."""
    hits = scaffold.occurrences_by_read(Inputs(spark, folder).occ)
    return hits.where("n > 1").select("read_id", "node_id", "n")


def occurrences_per_read(spark, folder):
    hits = scaffold.occurrences_by_read(Inputs(spark, folder).occ)
    return hits.groupBy("read_id").agg(F.count("*").alias("contigs"), F.sum("n").alias("hits"))


def direct_connections(spark, folder):
    direct, _ = Inputs(spark, folder).evidence()
    return direct.groupBy("src", "dst").agg(F.count("*").alias("reads"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"))


def paired_connections(spark, folder):
    _, paired = Inputs(spark, folder).evidence()
    return paired.groupBy("src", "dst").agg(F.count("*").alias("pairs"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"), F.sum("variance").alias("variances"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def merged_connections(spark, folder):
    return _rounded(scaffold.merge_connections(*Inputs(spark, folder).evidence()), "distance", "variance")


def connection_weights(spark, folder):
    direct, paired = Inputs(spark, folder).evidence()
    merged = scaffold.merge_connections(direct, paired)
    return _rounded(scaffold.connection_weights(merged, direct, paired).select("src", "dst", "weight"), "weight")


def local_connections(spark, folder):
    i = Inputs(spark, folder)
    return _rounded(scaffold.local_connections(i.scratch.keep(i.pairs), i.arcs, i.nodes), "variance")


def paired_read_density(spark, folder):
    i = Inputs(spark, folder)
    return scaffold.paired_density(i.occ, i.mates, i.libraries)


def _expected(i: Inputs) -> DataFrame:
    return scaffold.expected_connections(i.pairs, i.nodes, i.scratch.keep(scaffold.paired_density(i.occ, i.mates, i.libraries)), i.libraries)


def expected_connections(spark, folder):
    return _expected(Inputs(spark, folder)).select("src", "dst", "expected")


def reliable_connections(spark, folder):
    return scaffold.reliable(_expected(Inputs(spark, folder))).select("src", "dst", "direct_count", "paired_count", "expected")


def gapped_connections(spark, folder):
    i = Inputs(spark, folder)
    return _rounded(scaffold.gapped(i.pairs, i.nodes, K).select("src", "dst", "gap"), "gap")


def direct_only_connections(spark, folder):
    return Inputs(spark, folder).pairs.where("direct_count > 0").select("src", "dst", "direct_count")


def connections_by_distance(spark, folder):
    return scaffold.by_distance(Inputs(spark, folder).pairs)


def transitive_edges(spark, folder):
    i = Inputs(spark, folder)
    return scaffold.transitive_edges(i.scratch.keep(i.pairs))


def simple_bubbles(spark, folder):
    i = Inputs(spark, folder)
    return similarity.simple_bubbles(i.scratch.keep(i.pairs), i.nodes, K)


def branch_bubbles(spark, folder):
    """Two ways of one or several contigs between the same two, along active connections."""
    i = Inputs(spark, folder)
    steps = clean.both_ways(i.pairs.where("active")).select("src", (-F.col("dst")).alias("dst"))
    return similarity.branch_bubbles(i.scratch.keep(steps), i.scratch.keep(i.nodes), K)


def _merged(i: Inputs) -> tuple[DataFrame, DataFrame]:
    nodes = i.scratch.keep(i.nodes)
    return nodes, similarity.merge_map(similarity.simple_bubbles(i.scratch.keep(i.pairs), nodes, K), nodes)


def merged_bubbles(spark, folder):
    return _merged(Inputs(spark, folder))[1]


def merged_bubble_nodes(spark, folder):
    """Contigs and their coverage once similar branches are one."""
    return similarity.merged_nodes(*_merged(Inputs(spark, folder))).select("node_id", "len", "cov")


def merged_bubble_occurrences(spark, folder):
    i = Inputs(spark, folder)
    return similarity.merged_occurrences(i.occ, *_merged(i))


QUERIES = {
    f.__name__: f
    for f in (
        node_arcs, node_degrees, unique_nodes, coverage_cutoff, dubious_reads, trusted_occurrences, low_fraction_arcs, tips_round1, tips_fixpoint,
        unipaths, joined_contigs, shared_reads_between_nodes, read_occurrences, ambiguous_occurrences, occurrences_per_read, direct_connections, paired_connections,
        merged_connections, connection_weights, local_connections, paired_read_density, expected_connections, reliable_connections,
        gapped_connections, direct_only_connections, connections_by_distance, transitive_edges, simple_bubbles, branch_bubbles, minority_tips, coverage_cutoff_keeping_long, tips_keeping_long,
        low_fraction_arcs_of_long, reads_along_weak_arcs, total_coverage, seed_order,
        merged_bubbles, merged_bubble_nodes, merged_bubble_occurrences,
    )
}

_ERF = "sign({x}) * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x})))"


def _erf(x: str) -> str:
    return "(" + _ERF.format(x=f"({x})", t=f"(1 / (1 + 0.3275911 * abs({x})))") + ")"


def _overhang(x: str) -> str:
    return f"(0.4 * exp(-{x} * {x} / 2) + {x} * {_erf(f'0.7 * {x}')} / 2)"


_DENSITY_CTE = """on_ as (select distinct read_id, abs(node_id) as node_id from occ),
    dens as (select r.category, o.node_id, count(*) as reads from on_ o join reads r on r.read_id = o.read_id and r.mate_id is not null
      join lib on lib.category = r.category group by 1, 2)"""
_EXPECTED_CTE = f"""{_DENSITY_CTE},
    sized as (select c.*, a.len as len_src, b.len as len_dst from pairs c join n a on a.node_id = abs(c.src) join n b on b.node_id = abs(c.dst)),
    terms as (select s.src, s.dst, least(x.reads / s.len_src, y.reads / s.len_dst) as thin, lib.sd, (g - mean) / sd as near, (g + len_src - mean) / sd as one,
        (g + len_dst - mean) / sd as other, (g + len_src + len_dst - mean) / sd as far
      from (select *, floor(distance) - (len_src + len_dst) // 2 as g from sized) s
      join dens x on x.node_id = abs(s.src) join dens y on y.node_id = abs(s.dst) and y.category = x.category
      join lib on lib.category = x.category where s.len_src > 0 and s.len_dst > 0),
    parts as (select src, dst, thin * sd * ({_overhang('near')} - least({_overhang('one')}, {_overhang('other')}) - greatest({_overhang('one')}, {_overhang('other')}) + {_overhang('far')}) as e from terms),
    summed as (select src, dst, cast(sum(case when e > 0 then floor(e) else 0 end) as bigint) as e from parts group by 1, 2),
    expect as (select s.*, coalesce(e, 0) as expected from sized s left join summed u on u.src = s.src and u.dst = s.dst)"""

# a row of the table of common lengths is the running maximum of what its cells reach by themselves
_COMMON = f"""common as (select source, sink, kept, dropped, a, b, 0 as i, list_transform(range(0, length(b) + 1), lambda j: 0) as cells from two
      union all
      select source, sink, kept, dropped, a, b, i, list_transform(range(1, length(b) + 2), lambda j: list_max(cells[1:j])) from (
        select source, sink, kept, dropped, a, b, i + 1 as i,
          list_transform(range(0, length(b) + 1), lambda j: case when j = 0 then 0 else greatest(cells[j + 1], cells[j] + (substr(a, i + 1, 1) = substr(b, j, 1))::int) end) as cells
        from common where i < length(a))),
    bubbles as (select source, sink, kept, dropped, coalesce(a <> '' and b <> '' and 1 - list_last(cells) / greatest(length(a), length(b)) <= 0.2
        and (least(length(a), length(b)) >= {K} or abs(length(a) - length(b)) <= 3), false) as same from common where i = length(a))"""
# two contigs between the same two
_BUBBLES = f"""next_ as (select src, -dst as dst from both_ways where active),
    inner_ as (select distinct a.src as source, a.dst as via, b.dst as sink from next_ a join next_ b on b.src = a.dst
      where a.src <> b.dst and abs(a.src) <> abs(a.dst) and abs(b.dst) <> abs(a.dst) and a.src <= -b.dst),
    branch as (select source, sink, via, cov, substr(case when via > 0 then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end, {K}) as body,
        row_number() over (partition by source, sink order by cov desc, abs(via), via desc) as place
      from inner_ join n on n.node_id = abs(via) where len <= 100 and seq is not null),
    two as (select x.source, x.sink, x.via as kept, y.via as dropped, x.body as a, y.body as b
      from branch x join branch y on y.source = x.source and y.sink = x.sink and x.place = 1 and y.place > 1 and y.via <> x.via),
    {_COMMON}"""


def _ways(rounds: int) -> str:
    """What comes to each contig in each round, and the ways that go on from there."""
    parts = [
        """next_ as (select distinct src, -dst as dst from both_ways where active),
        front0 as (select src as source, dst as spot, []::bigint[] as way, 0 as size from next_ where abs(src) <> abs(dst) and src in (select src from next_ group by 1 having count(*) > 1)),
        best0 as (select * from front0)"""
    ]
    for r in range(1, rounds + 1):
        parts.append(f"""came{r} as (select * from (
            select source, x.dst as spot, list_append(way, f.spot) as way, size + len as size, cov from front{r - 1} f
            join n on n.node_id = abs(f.spot) and len <= 100 and seq is not null join next_ x on x.src = f.spot)
          where size <= 100 and abs(spot) <> abs(source) and not list_contains(way, spot) and not list_contains(way, -spot)),
        front{r} as (select source, spot, way, size from (select *, row_number() over (partition by source, spot order by cov desc, list_reverse(way) desc) as place from came{r}) c
          where place = 1 and not exists (select 1 from best{r - 1} b where b.source = c.source and b.spot = c.spot)),
        best{r} as (select * from best{r - 1} union all select * from front{r}),
        told{r} as (select source, spot as sink, b.way as one, c.way as other from came{r} c join best{r} b using (source, spot)
          where b.way <> c.way and len(b.way) > 0 and source <= -spot and not list_has_any(list_transform(b.way, lambda x: abs(x)), list_transform(c.way, lambda x: abs(x))))""")
    told = " union all ".join(f"select * from told{r}" for r in range(1, rounds + 1))
    return ",\n".join(parts) + f""",
        told as (select *, row_number() over () as id from ({told})),
        inner_ as (select id, true as first, unnest(one) as via, unnest(range(len(one))) as i from told union all select id, false, unnest(other), unnest(range(len(other))) from told),
        side as (select id, first, round(sum(cov) / sum(len), 6) as mean, string_agg(substr(case when via > 0 then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end, {K}), '' order by i) as body
          from inner_ join n on n.node_id = abs(via) group by 1, 2),
        judged as (select t.*, x.body as one_body, y.body as other_body, x.mean > y.mean or (x.mean = y.mean and one <= other) as stays
          from told t join side x on x.id = t.id and x.first join side y on y.id = t.id and not y.first),
        two as (select source, sink, case when stays then one else other end as kept, case when stays then other else one end as dropped, one_body as a, other_body as b from judged)"""


_MOVED = """alike as (select abs(dropped) as contig, cast(kept * sign(dropped) as bigint) as goes from bubbles where same and abs(kept) <> abs(dropped)),
    first_ as (select contig, arg_max(goes, (cov, -node_id, goes)) as goes from alike join n on n.node_id = abs(goes) group by 1),
    going as (select contig, goes from first_ union all select g.contig, cast(f.goes * sign(g.goes) as bigint) from going g join first_ f on f.contig = abs(g.goes)),
    moved as (select contig, goes from going where abs(goes) not in (select contig from first_))"""

SQL = {
    "node_arcs": f"{with_('n', 'occ', 'arcs')} select src, dst, multiplicity from arcs",
    "node_degrees": f"""{with_('n', 'occ', 'arcs')} select node_id, cast(sum(o) as bigint) as outdeg, cast(sum(i) as bigint) as indeg
        from (select src as node_id, 1 as o, 0 as i from arcs union all select dst, 0, 1 from arcs) group by 1""",
    "unique_nodes": f"""{with_('n', 'occ', 'arcs')}, d as (select node_id, cast(sum(o) as bigint) as outdeg, cast(sum(i) as bigint) as indeg
        from (select src as node_id, 1 as o, 0 as i from arcs union all select dst, 0, 1 from arcs) group by 1)
        select n.node_id, n.len, coalesce(outdeg, 0) as outdeg, coalesce(indeg, 0) as indeg from n left join d using (node_id)
        where n.len > 50 and coalesce(outdeg, 0) <= 3 and coalesce(indeg, 0) <= 3""",
    "coverage_cutoff": f"{with_('n')} select node_id, len, cov from n where len > 0 and cov / len < 3.0",
    "dubious_reads": f"""{with_('n', 'occ')} select distinct read_id from occ join n on n.node_id = abs(occ.node_id) where len > 0 and cov / len < 3.0""",
    "trusted_occurrences": f"""{with_('n', 'occ')}, bad as (select distinct read_id from occ join n on n.node_id = abs(occ.node_id) where len > 0 and cov / len < 3.0)
        select node_id, count(*) as occurrences from occ where read_id not in (select read_id from bad) group by 1""",
    "low_fraction_arcs": f"""{with_('n', 'occ', 'arcs')} select src, dst, multiplicity, total from (select *, cast(sum(multiplicity) over (partition by src) as bigint) as total from arcs)
        where multiplicity < total * 0.1""",
    "tips_round1": f"""{with_('n', 'occ', 'arcs')} select distinct abs(node_id) as node_id from (select node_id, len from n union all select -node_id, len from n)
        where len < {2 * K} and node_id not in (select src from arcs)""",
    "coverage_cutoff_keeping_long": f"""{with_('n', 'occ', 'reads')} select node_id, len, cov from n where len > 0 and cov / len < 3.0
        and node_id not in (select abs(node_id) from occ join reads using (read_id) where category % 2 = 0)""",
    "tips_keeping_long": f"""{with_('n', 'occ', 'reads', 'arcs')} select distinct abs(node_id) as node_id from (select node_id, len from n union all select -node_id, len from n)
        where len < {2 * K} and node_id not in (select src from arcs) and abs(node_id) not in (select abs(node_id) from occ join reads using (read_id) where category % 2 = 0)""",
    "low_fraction_arcs_of_long": f"""{with_('n', 'occ', 'reads', 'arcs')}, along as (select src, dst from (
          select node_id as src, lead(node_id) over (partition by read_id order by off, pos, node_id) as dst from known join reads using (read_id) where category % 2 = 0) where dst is not null)
        select src, dst, multiplicity, total from (select *, cast(sum(multiplicity) over (partition by src) as bigint) as total from arcs) a
        where multiplicity < total * 0.1 and exists (select 1 from along l where (l.src = a.src and l.dst = a.dst) or (l.src = -a.dst and l.dst = -a.src))""",
    "reads_along_weak_arcs": f"""{with_('n', 'occ', 'arcs')}, weak as (select src, dst from (select *, sum(multiplicity) over (partition by src) as total from arcs) where multiplicity < total * 0.1)
        select distinct a.read_id from occ a join weak on weak.src = a.node_id join occ b on b.read_id = a.read_id and b.node_id = weak.dst""",
    "total_coverage": f"""{with_('n', 'occ', 'reads')}, more as (select n.node_id, sum(greatest(least(len - pos, greatest(length(r.seq) - {K - 1}, 0) - off), 0)) as more
          from occ join reads r using (read_id) join n on n.node_id = abs(occ.node_id) where category % 2 = 0 and r.seq is not null group by 1)
        select node_id, cast(cov + coalesce(more, 0) as bigint) as coverage from n left join more using (node_id)""",
    "seed_order": f"""{with_('n', 'occ', 'arcs')}, d as (select node_id, coalesce(indeg, 0) as indeg from (select node_id from n union all select -node_id from n)
          left join (select dst as node_id, count(*) as indeg from arcs group by 1) using (node_id))
        select node_id, indeg, row_number() over (order by indeg, node_id) as place from d""",
    "tips_fixpoint": f"""{with_('n', 'occ', 'arcs', recursive=True)}, rounds as (
          select 0 as r, node_id, len from n
          union all
          select r + 1, node_id, len from rounds c
          where not (len < {2 * K} and (not exists (select 1 from arcs a join rounds d on d.node_id = abs(a.dst) where a.src = c.node_id)
              or not exists (select 1 from arcs a join rounds d on d.node_id = abs(a.dst) where a.src = -c.node_id)))
            and exists (select 1 from rounds t where t.len < {2 * K} and (not exists (select 1 from arcs a join rounds d on d.node_id = abs(a.dst) where a.src = t.node_id)
              or not exists (select 1 from arcs a join rounds d on d.node_id = abs(a.dst) where a.src = -t.node_id))))
        select node_id, len from rounds where r = (select max(r) from rounds)""",
    "unipaths": f"""{with_('n', 'occ', 'arcs', recursive=True)}, links as (select src, dst from arcs where abs(src) <> abs(dst)
          and src in (select src from arcs group by 1 having count(*) = 1) and dst in (select dst from arcs group by 1 having count(*) = 1)),
        walk as (select src as chain, src as node_id, 0 as step from links where src not in (select dst from links)
          union all select chain, dst, step + 1 from walk join links on src = node_id),
        round_ as (select src as chain, src as node_id, 0 as step from links where src not in (select node_id from walk)
          union all select chain, dst, step + 1 from round_ join links on src = node_id where dst <> chain),
        ring as (select chain from round_ group by 1 having chain = min(node_id))
        select node_id, chain, step from walk union all select node_id, chain, step from round_ where chain in (select chain from ring)""",
    "simple_bubbles": f"{with_('n', 'pairs', 'both', recursive=True)}, {_BUBBLES} select source, sink, kept, dropped, same from bubbles",
    "branch_bubbles": f"{with_('n', 'pairs', 'both', recursive=True)}, {_ways(12)}, {_COMMON} select source, sink, kept, dropped, same from bubbles",
    "merged_bubbles": f"{with_('n', 'pairs', 'both', recursive=True)}, {_BUBBLES}, {_MOVED} select contig as dropped, goes as kept from moved",
    "merged_bubble_nodes": f"""{with_('n', 'pairs', 'both', recursive=True)}, {_BUBBLES}, {_MOVED},
        more as (select abs(goes) as node_id, sum(cov) as more from moved join n on n.node_id = contig group by 1)
        select node_id, len, cast(cov + coalesce(more, 0) as bigint) as cov from n left join more using (node_id) where node_id not in (select contig from moved)""",
    "merged_bubble_occurrences": f"""{with_('n', 'occ', 'pairs', 'both', recursive=True)}, {_BUBBLES}, {_MOVED},
        scale as (select contig, goes, a.len as was, b.len as is_ from moved join n a on a.node_id = contig join n b on b.node_id = abs(goes))
        select distinct read_id, cast(case when contig is null then o.node_id else goes * sign(o.node_id) end as bigint) as node_id,
          cast(case when contig is null then pos else greatest(least(floor(pos * is_ / greatest(was, 1)), is_ - 1), 0) end as bigint) as pos, off
        from occ o left join scale on contig = abs(o.node_id)""",
    "minority_tips": f"""{with_('n', 'occ', 'arcs')}, dead as (select node_id from (select node_id, len from n union all select -node_id, len from n)
          where len < {2 * K} and node_id not in (select src from arcs)),
        ranked as (select src, dst, count(*) over (partition by src) as branches, count(*) over (partition by dst) as n,
          row_number() over (partition by src order by multiplicity desc, dst) as place from arcs)
        select distinct abs(node_id) as node_id from dead left join ranked on dst = node_id where dst is null or (n = 1 and branches > 1 and place > 1)""",
    "joined_contigs": f"""{with_('n', 'occ', 'arcs', recursive=True)}, s as (select node_id, seq, len, cov from n
          union all select -node_id, reverse(translate(seq, 'ACGT', 'TGCA')), len, cov from n),
        solo as (select src, dst from arcs where src in (select src from arcs group by 1 having count(*) = 1) and dst in (select dst from arcs group by 1 having count(*) = 1)),
        links as (select src, dst from solo join s a on a.node_id = src join s b on b.node_id = dst
          where abs(src) <> abs(dst) and right(a.seq, {K - 1}) = left(b.seq, {K - 1})),
        walk as (select src as chain, src as node_id, 0 as step from links where src not in (select dst from links)
          union all select chain, dst, step + 1 from walk join links on src = node_id),
        best as (select chain, arg_min(node_id, abs(node_id)) as stays from walk group by 1)
        select stays as node_id, string_agg(case when step = 0 then seq else substr(seq, {K}) end, '' order by step) as seq,
          cast(sum(len) as int) as len, cast(sum(cov) as bigint) as cov from walk join best using (chain) join s using (node_id) where stays > 0 group by 1
        union all select node_id, seq, len, cov from n where node_id not in (select abs(node_id) from walk)""",
    "shared_reads_between_nodes": f"""{with_('occ', 'pairs')}, on_ as (select distinct read_id, abs(node_id) as c from occ),
        common as (select a.c as src, b.c as dst, count(*) as reads from on_ a join on_ b on a.read_id = b.read_id and a.c < b.c group by 1, 2),
        asked as (select distinct least(abs(src), abs(dst)) as src, greatest(abs(src), abs(dst)) as dst from pairs)
        select src, dst, reads from asked join common using (src, dst)""",
    "read_occurrences": f"{with_('n', 'occ', 'usable')} select read_id, node_id, pos, off, n from by_read",
    "ambiguous_occurrences": f"{with_('n', 'occ', 'usable')} select read_id, node_id, n from by_read where n > 1",
    "occurrences_per_read": f"{with_('n', 'occ', 'usable')} select read_id, count(*) as contigs, cast(sum(n) as bigint) as hits from by_read group by 1",
    "direct_connections": f"""{with_('n', 'occ', 'usable', 'direct')} select src, dst, count(*) as reads, min(distance) as nearest, max(distance) as farthest from direct group by 1, 2""",
    "paired_connections": f"""{with_('n', 'occ', 'reads', 'lib', 'usable', 'paired')} select src, dst, count(*) as pairs, min(distance) as nearest,
        max(distance) as farthest, sum(variance) as variances from paired group by 1, 2""",
    "merged_connections": f"""{with_('n', 'occ', 'reads', 'lib', 'usable', 'direct', 'paired', 'merged')}
        select src, dst, round(distance, 6) as distance, round(variance, 6) as variance, direct_count, paired_count from merged""",
    "connection_weights": f"""{with_('n', 'occ', 'reads', 'lib', 'usable', 'direct', 'paired', 'merged')},
        w as (select least(src, dst) as src, greatest(src, dst) as dst, count(*)::double as w from direct group by 1, 2
          union all select m.src, m.dst, sum(0.39894 * exp(-(insert_length - (floor(round(m.distance, 6)) - places)) * (insert_length - (floor(round(m.distance, 6)) - places)) / (2 * exact)))
          from paired p join merged m on m.src = least(p.src, p.dst) and m.dst = greatest(p.src, p.dst) where counts group by 1, 2),
        s as (select src, dst, least(1000.0, sum(w)) as weight from w group by 1, 2)
        select m.src, m.dst, round(coalesce(weight, 0), 6) as weight from merged m left join s using (src, dst)""",
    "local_connections": f"""{with_('n', 'occ', 'arcs', 'pairs', 'both')}, near as (select src as hub, -dst as near from both_ways join n on n.node_id = abs(src) and is_unique)
        select distinct a.src, -a.dst as dst, multiplicity, x.len // 2 + y.len // 2 as distance, round(1 / multiplicity, 6) as variance
        from arcs a join n x on x.node_id = abs(a.src) and not x.is_unique join n y on y.node_id = abs(a.dst) and not y.is_unique
        join near s on s.near = a.src join near t on t.near = a.dst and t.hub = s.hub
        where abs(a.src) <> abs(a.dst) and not exists (select 1 from both_ways b where b.src = a.src and b.dst = -a.dst)""",
    "paired_read_density": f"{with_('occ', 'reads', 'lib')}, {_DENSITY_CTE} select category, node_id, reads from dens",
    "expected_connections": f"{with_('n', 'occ', 'reads', 'lib', 'pairs')}, {_EXPECTED_CTE} select src, dst, expected from expect",
    "reliable_connections": f"""{with_('n', 'occ', 'reads', 'lib', 'pairs')}, {_EXPECTED_CTE} select src, dst, direct_count, paired_count, expected from expect
        where weight >= 0.1 and paired_count + direct_count >= 4 and case when len_dst <= 50 or expected = 0 then direct_count > 0 else paired_count >= expected * 0.1 end""",
    "gapped_connections": f"""{with_('n', 'pairs')} select src, dst, round(gap, 6) as gap from (
        select c.src, c.dst, distance - a.len // 2 - b.len // 2 as gap, direct_count, b.is_unique as u from pairs c join n a on a.node_id = abs(c.src) join n b on b.node_id = abs(c.dst))
        where gap > case when u then {K - 1} else 0 end and direct_count = 0""",
    "direct_only_connections": f"{with_('pairs')} select src, dst, direct_count from pairs where direct_count > 0",
    "connections_by_distance": f"""{with_('pairs', 'both')} select src, dst, distance, cast(row_number() over (partition by src order by distance nulls first, dst) as int) as place from both_ways""",
    "transitive_edges": f"""{with_('pairs', 'both')}, c as (select src as n, -dst as d, distance as c from both_ways),
        gone as (select distinct c1.n, c2.d as d2 from c c1 join c c2 on c2.n = c1.d join c c3 on c3.n = c1.n and c3.d = c2.d
          left join c c4 on c4.n = c2.d and c4.d = c1.d
          where c1.d <> c2.d and c3.c > (c1.c + c2.c) * 0.9
          and not coalesce(c4.c is not null and c1.c > (c3.c + c4.c) * 0.9 and (c3.c < c1.c or (c3.c = c1.c and c2.d < c1.d)), false)),
        nearest as (select n, d as d2 from (select *, row_number() over (partition by n order by c nulls first, d) as r from c) where r = 1)
        select n as src, -d2 as dst from gone where not exists (select 1 from nearest x where x.n = gone.n and x.d2 = gone.d2)""",
}
