"""SQL of the cleaned tables, for the SQL of the queries."""

from __future__ import annotations

K = 21

CTES = {
    "reads": """reads as (select read_id, min(mate_id) as mate_id, min(category) as category,
        min(nullif(upper(trim(seq, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))), '')) as seq
        from test_reads where read_id is not null group by 1)""",
    "n": """n as (select abs(node_id) as node_id, max(seq) as seq, max(len) as len, coalesce(max(cov), 0) as cov,
        coalesce(bool_or(is_unique), false) as is_unique from nodes where node_id is not null and node_id <> 0 group by 1)""",
    "occ": """occ as (select distinct read_id, node_id, node_position as pos, read_offset as off from read_occ
        where read_id is not null and node_id <> 0 and node_position is not null and read_offset is not null
        and not (node_position = -1 and read_offset = -1))""",
    "pairs": """pairs as (select least(src, dst) as src, greatest(src, dst) as dst, min(distance) as distance, min(variance) as variance,
        max(weight) as weight, max(direct_count) as direct_count, max(paired_count) as paired_count, coalesce(bool_or(active), false) as active
        from connections where src <> 0 and dst <> 0 and abs(src) <> abs(dst) group by 1, 2)""",
    "both": """both_ways as (select * from pairs union all select dst as src, src as dst, * exclude (src, dst) from pairs)""",
    "m": """m as (select locus_id, f.node_id as node_id, f.ord as ord, is_long from (
        select locus_id, min({'ord': coalesce(ord, 2147483647), 'node_id': node_id}) as f, coalesce(bool_or(is_long), false) as is_long
        from locus_nodes where locus_id is not null and node_id <> 0 group by locus_id, abs(node_id)))""",
    "p": """p as (select transcript_id, min(locus_id) as locus_id, min(node_path) as node_path, min(gaps) as gaps, min(confidence) as confidence
        from transcripts where locus_id is not null and transcript_id is not null and len(node_path) > 0 group by 1)""",
    "lib": """lib as (select category, cast(max(mean) as double) as mean, coalesce(cast(max(sd) as double), max(mean) / 10) as sd
        from libraries where category is not null and mean > 0 group by 1)""",
    "arcs": """known as (select * from occ where abs(node_id) in (select node_id from n)),
        steps as (select node_id as src, lead(node_id) over (partition by read_id order by off, pos, node_id) as dst from known),
        arcs as (select src, dst, count(*) as multiplicity from (
          select src, dst from steps where dst is not null
          union all select -dst, -src from steps where dst is not null and src <> -dst) group by 1, 2)""",
    "usable": """by_read as (select read_id, node_id, case when count(*) = 1 then min(pos) else -1 end as pos,
          case when count(*) = 1 then min(off) else -1 end as off, count(*) as n from occ group by 1, 2),
        usable as (select read_id, b.node_id, pos, off, len, is_unique from by_read b join n on abs(b.node_id) = n.node_id
          where off >= 0 and not (pos = -1 and off = -1))""",
    "direct": """direct as (select case when a.off < b.off then a.node_id else -a.node_id end as src,
          case when a.off < b.off then -b.node_id else b.node_id end as dst,
          cast(case when a.off < b.off then raw - a.len % 2 else -(raw + b.len % 2) end as double) as distance
        from (select a, b, a.pos - a.off - a.len // 2 - b.pos + b.off + b.len // 2 as raw
              from usable a join usable b on a.read_id = b.read_id and abs(a.node_id) <> abs(b.node_id) and a.is_unique))""",
    "paired": """paired as (select src, dst, floor(mean) + places as distance, floor(sd * sd) as variance, places, floor(mean) as insert_length, sd * sd as exact, counts
        from (select a.node_id as src, b.node_id as dst, mean, sd, a.len as len_a, b.len as len_b, a.pos > 0 and b.pos > 0 as counts,
                (a.pos - a.off - a.len // 2) + (b.pos - b.off - b.len // 2) as places
              from usable a join reads r on r.read_id = a.read_id join lib on lib.category = r.category
              join usable b on b.read_id = r.mate_id
              where a.is_unique and abs(a.node_id) <> abs(b.node_id) and not (b.is_unique and b.node_id < a.node_id))
        where floor(mean) + places - len_a // 2 - len_b // 2 >= -6 * sd and floor(sd * sd) > 0)""",
    "merged": """merged as (select least(src, dst) as src, greatest(src, dst) as dst, sum(distance / variance) / sum(1 / variance) as distance,
          1 / sum(1 / variance) as variance, cast(sum(d) as bigint) as direct_count, cast(sum(q) as bigint) as paired_count
        from (select src, dst, distance, 1.0::double as variance, 1 as d, 0 as q from direct
              union all select src, dst, distance, variance::double, 0, 1 from paired) group by 1, 2)""",
    "edges": """edges as (select a.locus_id, a.node_id as src, b.node_id as dst, c.distance, c.weight
        from m a join both_ways c on c.src = a.node_id and c.active join m b on b.locus_id = a.locus_id and b.node_id = -c.dst)""",
    "laid": f"""steps_of as (select transcript_id, locus_id, gaps, unnest(node_path) as node_id, unnest(range(len(node_path))) as ord, len(node_path) as size from p),
        laid0 as (select s.*, n.len, case when ord < size - 1 then coalesce(gaps[ord + 1], 0) else 0 end as gap, count(n.len) over (partition by transcript_id) as found
          from steps_of s left join n on n.node_id = abs(s.node_id)),
        laid as (select locus_id, transcript_id, cast(ord as int) as ord, node_id, len, gap,
          cast(sum(len + gap) over (partition by transcript_id order by ord rows unbounded preceding) + {K - 1} as bigint) as finish,
          cast(coalesce(sum(case when gap > 0 then 1 else 0 end) over (partition by transcript_id order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as run
          from laid0 where found = size)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(CTES[name] for name in names)
