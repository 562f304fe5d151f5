"""Transcripts: paths through loci, their lengths, layout and sequences."""

from __future__ import annotations

from collections.abc import Iterator
from graphlib import CycleError, TopologicalSorter
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.shared import Scratch, lookup, numbered_within, salted


def nearest_incoming(edges: DataFrame) -> DataFrame:
    """(locus_id, node_id, first, second): where the nearest and the second nearest edge into each contig come from."""
    near = Window.partitionBy("locus_id", "dst").orderBy("distance", "src")
    ranked = edges.withColumn("place", F.row_number().over(near)).where("place <= 2")
    pick = lambda n: F.max(F.when(F.col("place") == n, F.col("src")))
    return ranked.groupBy("locus_id", F.col("dst").alias("node_id")).agg(pick(1).alias("first"), pick(2).alias("second"))


def sinks(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(locus_id, node_id, number): contigs without an edge out, in the order of the locus, from 1."""
    ends = members.join(edges.select("locus_id", F.col("src").alias("node_id")), ["locus_id", "node_id"], "left_anti")
    return numbered_within(ends, "locus_id", "number", "ord", "node_id").withColumn("number", F.col("number").cast("int"))


def walk_back(starts: DataFrame, back: DataFrame, longest: int) -> DataFrame:
    """(locus_id, walk, node_id, step): from each start (locus_id, walk, node_id) along `back` (locus_id, walk, node_id, to).

    In `back` a contig has one `to` at most in a walk. Steps double each round, so a walk of n contigs takes
    log(n) rounds of joins; a walk that comes back to a contig ends before it. `longest` bounds the steps.
    """
    scratch = Scratch(starts.sparkSession)
    jump = scratch.keep(back)
    found = scratch.keep(starts.select("locus_id", "walk", "node_id", F.lit(0).alias("step")))
    far = 1
    while far < longest:
        keys = ["locus_id", "walk", "node_id"]
        ahead = found.join(jump, keys).select("locus_id", "walk", F.col("to").alias("node_id"), (F.col("step") + far).alias("step"))
        fresh = ahead.join(found.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min("step").alias("step"))
        fresh = scratch.keep(fresh)
        if fresh.isEmpty():
            break
        hop = jump.select("locus_id", "walk", F.col("node_id").alias("to"), F.col("to").alias("to2"))
        jump = scratch.keep(jump.join(hop, ["locus_id", "walk", "to"]).select("locus_id", "walk", "node_id", F.col("to2").alias("to")))
        found, far = found.unionByName(fresh), far * 2
    return found


def simple_transcripts(members: DataFrame, edges: DataFrame, shaped: DataFrame) -> DataFrame:
    """(locus_id, walk, node_path) of loci of the shapes LINEAR, FORK and BUBBLE; walk is 1 or 2.

    One sink: the first walk goes back along nearest edges, the second one (not in LINEAR) prefers the second
    nearest. Two sinks: a walk along nearest edges from each of the first two. Loci of another shape have no row.
    """
    scratch = Scratch(members.sparkSession)
    known = shaped.where("shape <> 'UNKNOWN'").select("locus_id", "shape")
    ends = sinks(members, edges).where("number <= 2").join(known, "locus_id")
    two = ends.groupBy("locus_id").agg(F.count("*").alias("ends"))
    ends = scratch.keep(ends.join(two, "locus_id"))
    first = ends.where("number = 1").select("locus_id", F.lit(1).alias("walk"), "node_id")
    other = ends.where("shape <> 'LINEAR' and ((ends = 1 and number = 1) or (shape = 'FORK' and number = 2) or (shape = 'BUBBLE' and number = 1))")
    other = other.groupBy("locus_id").agg(F.max_by("node_id", "number").alias("node_id")).select("locus_id", F.lit(2).alias("walk"), "node_id")
    into = nearest_incoming(edges).join(ends.groupBy("locus_id").agg(F.max((F.col("shape") == "FORK") & (F.col("ends") > 1)).alias("apart")), "locus_id")
    near = into.select("locus_id", F.lit(1).alias("walk"), "node_id", F.col("first").alias("to"))
    second = F.when(F.col("apart"), F.col("first")).otherwise(F.coalesce("second", "first"))
    back = near.unionByName(into.select("locus_id", F.lit(2).alias("walk"), "node_id", second.alias("to")))
    steps = walk_back(first.unionByName(other), back, 1 << 40)
    return to_paths(steps)


def to_paths(steps: DataFrame) -> DataFrame:
    """Walks as arrays from their far end to their start."""
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("at"), "node_id"))), lambda s: s["node_id"])
    return steps.groupBy("locus_id", "walk").agg(path.alias("node_path"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """The rows of `edges` (locus_id, src, dst) that lie on a cycle.

    What has nothing before or nothing behind it is trimmed. Then marks spread, forwards and backwards in turn, and an
    edge between two marks goes, until none does: by then all that hangs together is one cycle or several in one another.
    """
    scratch = Scratch(edges.sparkSession)

    def trimmed(left: DataFrame) -> tuple[DataFrame, int]:
        n = left.count()
        while n:
            inner = left.join(left.select("locus_id", F.col("dst").alias("src")).distinct(), ["locus_id", "src"], "left_semi")
            left = scratch.keep(inner.join(left.select("locus_id", F.col("src").alias("dst")).distinct(), ["locus_id", "dst"], "left_semi"))
            before, n = n, left.count()
            if n == before:
                break
        return left, n

    def same_mark(left: DataFrame, start: str, end: str) -> DataFrame:
        ends = left.select("locus_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        marks = scratch.keep(ends.select("locus_id", "node_id", F.col("node_id").alias("mark"), F.lit(True).alias("grew")))
        while not marks.where("grew").isEmpty():
            sent = marks.where("grew").select("locus_id", F.col("node_id").alias(start), "mark").join(left, ["locus_id", start])
            best = sent.groupBy("locus_id", F.col(end).alias("node_id")).agg(F.max("mark").alias("offer"))
            grew = F.coalesce(F.col("offer") > F.col("mark"), F.lit(False))
            marks = scratch.keep(marks.join(best, ["locus_id", "node_id"], "left").select("locus_id", "node_id", F.greatest("mark", "offer").alias("mark"), grew.alias("grew")))
        a, b = (marks.select("locus_id", F.col("node_id").alias(e), F.col("mark").alias(f"mark_{e}")) for e in ("src", "dst"))
        both = left.join(a, ["locus_id", "src"]).join(b, ["locus_id", "dst"]).where("mark_src = mark_dst")
        return scratch.keep(both.select("locus_id", "src", "dst"))

    left, n = trimmed(scratch.keep(edges.select("locus_id", "src", "dst").distinct()))
    while n:
        before = n
        left, n = trimmed(same_mark(same_mark(left, "src", "dst"), "dst", "src"))
        if n == before:
            break
    return left


def in_path_order(members: DataFrame, edges: DataFrame) -> DataFrame:
    """`members` with an `ord` that every edge follows, but for some that lie on a cycle.

    In each round the contigs that no open edge leads to are next in their locus, all loci at once, so rounds are as
    many as edges on the longest path. Where only cycles and what follows them are left, edges on a cycle that run
    against the given order are taken as not there.
    """
    scratch = Scratch(members.sparkSession)
    left = scratch.keep(edges.where("src <> dst").select("locus_id", "src", "dst").distinct())
    placed, turn = None, 0
    while not left.isEmpty():
        heads = scratch.keep(left.select("locus_id", "src").distinct().join(left.select("locus_id", F.col("dst").alias("src")), ["locus_id", "src"], "left_anti"))
        if heads.isEmpty():
            place = members.select("locus_id", "node_id", F.coalesce("ord", F.lit(2147483647)).alias("ord"))
            a, b = (place.select("locus_id", F.col("node_id").alias(end), F.col("ord").alias(f"at_{end}")) for end in ("src", "dst"))
            round_ = on_cycles(left).join(a, ["locus_id", "src"]).join(b, ["locus_id", "dst"])
            back = round_.where("at_src > at_dst or (at_src = at_dst and src > dst)").select("locus_id", "src", "dst")
            left = scratch.keep(left.join(back, ["locus_id", "src", "dst"], "left_anti"))
            continue
        level = heads.select("locus_id", F.col("src").alias("node_id"), F.lit(turn).alias("level"))
        placed = level if placed is None else placed.unionByName(level)
        after = scratch.keep(left.join(heads, ["locus_id", "src"], "left_anti"))
        scratch.drop(left)
        left, turn = after, turn + 1
    if placed is None:
        return members
    # contigs that lead nowhere come last
    ranked = members.join(placed, ["locus_id", "node_id"], "left").withColumn("ord", F.coalesce("level", F.lit(turn)))
    return scratch.keep(ranked.select(members.columns))


def heaviest_paths(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(locus_id, score, node_path): the path of largest summed weight through each locus with an edge.

    Edges against the order of the locus are left out, so it has to be that of `in_path_order`. Scores run forwards: in each round only
    contigs whose score grew pass it on, all loci at once, so rounds are as many as edges on the longest path
    and a large locus is spread like any other. Ties go to the smaller contig.
    """
    scratch = Scratch(members.sparkSession)
    place = members.select("locus_id", "node_id", "ord")
    a, b = (place.select("locus_id", F.col("node_id").alias(end), F.col("ord").alias(f"at_{end}")) for end in ("src", "dst"))
    ahead = edges.join(a, ["locus_id", "src"]).join(b, ["locus_id", "dst"])
    ahead = ahead.where("at_src < at_dst or (at_src = at_dst and src < dst)").select("locus_id", "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    ahead = scratch.keep(ahead.groupBy("locus_id", "src", "dst").agg(F.max("weight").alias("weight")))
    ends = ahead.select("locus_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    scores = scratch.keep(ends.select("locus_id", "node_id", F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("via"), F.lit(True).alias("grew")))
    while True:
        grown = scores.where("grew").select("locus_id", F.col("node_id").alias("src"), "score")
        offers = grown.join(ahead, ["locus_id", "src"]).select("locus_id", F.col("dst").alias("node_id"), (F.col("score") + F.col("weight")).alias("offer"), "src")
        best = offers.groupBy("locus_id", "node_id").agg(F.max(F.struct("offer", (-F.col("src")).alias("other"))).alias("best"))
        both = scores.join(best, ["locus_id", "node_id"], "left")
        better = (F.col("best.offer") > F.col("score")) | ((F.col("best.offer") == F.col("score")) & (F.col("via").isNull() | (-F.col("best.other") < F.col("via"))))
        better = F.coalesce(better, F.lit(False))
        after = both.select(
            "locus_id",
            "node_id",
            F.when(better, F.col("best.offer")).otherwise(F.col("score")).alias("score"),
            F.when(better, -F.col("best.other")).otherwise(F.col("via")).alias("via"),
            better.alias("grew"),
        )
        kept = scratch.keep(after)
        scratch.drop(scores)
        scores = kept
        if scores.where("grew").isEmpty():
            break
    top = scores.groupBy("locus_id").agg(F.max(F.struct("score", (-F.col("node_id")).alias("other"))).alias("top"))
    starts = top.select("locus_id", F.lit(1).alias("walk"), (-F.col("top.other")).alias("node_id"))
    back = scores.where("via is not null").select("locus_id", F.lit(1).alias("walk"), "node_id", F.col("via").alias("to"))
    paths = to_paths(walk_back(starts, back, 1 << 40))
    return paths.join(top.select("locus_id", "top.score"), "locus_id").select("locus_id", "score", "node_path")


def unexplained_contigs(members: DataFrame, paths: DataFrame) -> DataFrame:
    """Contigs of a locus, long or not, that lie on none of its transcripts, either strand."""
    on = paths.select("locus_id", F.explode("node_path").alias("n")).select("locus_id", F.abs("n").alias("contig")).distinct()
    return members.withColumn("contig", F.abs("node_id")).join(on, ["locus_id", "contig"], "left_anti").select("locus_id", "node_id")


def heaviest_unused(members: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(locus_id, node_id, cov): of the contigs on no transcript, the one with the largest coverage; ties go to the smaller id."""
    on = paths.select("locus_id", F.explode("node_path").alias("n")).select("locus_id", F.abs("n").alias("contig")).distinct()
    left = members.withColumn("contig", F.abs("node_id")).join(on, ["locus_id", "contig"], "left_anti")
    rows = left.join(nodes.select(F.col("node_id").alias("contig"), "cov"), "contig").where("cov > 0")
    best = rows.groupBy("locus_id").agg(F.max(F.struct("cov", (-F.col("node_id")).alias("other"))).alias("best"))
    return best.select("locus_id", (-F.col("best.other")).alias("node_id"), F.col("best.cov").alias("cov"))


def path_cover(members: DataFrame, edges: DataFrame, nodes: DataFrame, most: int, small: int = 100_000) -> DataFrame:
    """(locus_id, turn, score, node_path): the heaviest path of each locus, then heaviest paths through what is on none yet.

    Each turn takes the contig of largest coverage on no path (`heaviest_unused`) and makes its edges weigh more than
    all others of the locus together, for all loci at once that have one, up to `most` paths in each. A contig that has
    no edge stands alone; its score is null, as is that of a turn whose path does not reach its contig.

    Loci without a cycle, of at most `small` contigs and edges, are taken through all their turns by one task each; those
    that are larger or have cycles in rounds of joins, spread like any other rows.
    """
    scratch = Scratch(members.sparkSession)
    cov = members.withColumn("contig", F.abs("node_id")).join(nodes.select(F.col("node_id").alias("contig"), "cov"), "contig", "left")
    contigs = cov.select("locus_id", "node_id", F.coalesce("cov", F.lit(0)).alias("cov"), *(F.lit(None).cast(kind).alias(c) for c, kind in (("src", "long"), ("dst", "long"), ("weight", "double"))))
    links = edges.select("locus_id", *(F.lit(None).cast("long").alias(c) for c in ("node_id", "cov")), "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    both = scratch.keep(contigs.unionByName(links))
    few = scratch.keep(both.groupBy("locus_id").agg(F.count("*").alias("n")).where(F.col("n") <= small).select("locus_id"))
    whole = both.join(few, "locus_id", "left_semi").repartition("locus_id").sortWithinPartitions("locus_id")
    tried = scratch.keep(whole.mapInArrow(_covers(most), "locus_id long, turn int, score double, node_path array<long>"))
    done = few.join(tried.where("node_path is null").select("locus_id"), "locus_id", "left_anti")
    rest = scratch.keep(members.join(done, "locus_id", "left_anti"))
    found = tried.where("node_path is not null")
    if rest.isEmpty():
        return found
    return found.unionByName(_cover_in_rounds(rest, scratch.keep(edges.join(done, "locus_id", "left_anti")), nodes, most))


def _covers(most: int):
    """Covers of the loci of a task, whose rows come locus by locus."""
    schema = pa.schema([("locus_id", pa.int64()), ("turn", pa.int32()), ("score", pa.float64()), ("node_path", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        out: list[tuple] = []
        for locus, group in groupby(rows, key=itemgetter(0)):
            lines = list(group)
            contigs = {node: cov for _, node, cov, *_ in lines if node is not None}
            out += [(locus, *path) for path in small_cover(contigs, [line[3:] for line in lines if line[1] is None], most)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def small_cover(contigs: dict[int, int], edges: list[tuple[int, int, float]], most: int) -> list[tuple]:
    """(turn, score, path) of one locus of `contigs` with their coverage and `edges` (src, dst, weight); a single (0, None, None) if it has a cycle."""
    weights: dict[int, dict[int, float]] = {}
    for src, dst, weight in edges:
        into = weights.setdefault(dst, {})
        into[src] = max(weight, into.get(src, 0.0))
    ends = sorted({n for dst, into in weights.items() for n in (dst, *into) if {dst} != set(into)})
    try:
        order = list(TopologicalSorter({dst: set(into) - {dst} for dst, into in weights.items()}).static_order())
    except CycleError:
        return [(0, None, None)]
    total = sum(weight for *_, weight in edges) + 1
    left = {node: cov for node, cov in contigs.items() if cov > 0}
    out: list[tuple] = []
    for turn in range(most):
        forced = None if turn == 0 and edges else max(left, key=lambda n: (left[n], -n), default=None)
        if turn and forced is None:
            break
        score, via = dict.fromkeys(ends, 0.0), {}
        for node in order:
            for src, weight in sorted(weights.get(node, {}).items()):
                offer = score.get(src, 0.0) + weight + (total if forced in (src, node) else 0.0)
                if src != node and (offer > score[node] or offer == score[node] and node not in via):
                    score[node], via[node] = offer, src
        path = [max(ends, key=lambda n: (score[n], -n))] if ends else []
        while path and path[0] in via:
            path.insert(0, via[path[0]])
        if forced is not None and forced not in path:
            out.append((turn, None, [forced]))
        elif path:
            out.append((turn, score[path[-1]], path))
        gone = {abs(n) for n in out[-1][2]} if out else set()
        left = {n: c for n, c in left.items() if abs(n) not in gone}
    return out


def _cover_in_rounds(members: DataFrame, edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """`path_cover` of loci of any size and shape."""
    scratch = Scratch(members.sparkSession)
    order = in_path_order(members, edges)
    total = scratch.keep(edges.groupBy("locus_id").agg((F.sum(F.coalesce("weight", F.lit(0.0))) + 1).alias("total")))
    found = members.select("locus_id", F.lit(0).alias("turn"), F.lit(0.0).alias("score"), F.array("node_id").alias("node_path")).where("false")
    for turn in range(most):
        forced = heaviest_unused(members, found, nodes).select("locus_id", F.col("node_id").alias("forced"))
        if turn == 0:
            forced = forced.join(total, "locus_id", "left_anti")
        forced = scratch.keep(forced)
        if turn and forced.isEmpty():
            break
        around = edges.join(total, "locus_id").join(forced, "locus_id", "left" if turn == 0 else "inner")
        extra = F.when((F.col("src") == F.col("forced")) | (F.col("dst") == F.col("forced")), F.col("total")).otherwise(0.0)
        around = scratch.keep(around.select("locus_id", "src", "dst", (F.coalesce("weight", F.lit(0.0)) + extra).alias("weight")))
        paths = heaviest_paths(order, around).join(forced, "locus_id", "full")
        through = F.col("forced").isNull() | F.array_contains("node_path", F.col("forced"))
        path = F.when(through, F.col("node_path")).otherwise(F.array("forced"))
        fresh = paths.select("locus_id", F.lit(turn).alias("turn"), F.when(through, F.col("score")).alias("score"), path.alias("node_path"))
        found = scratch.keep(found.unionByName(fresh))
    return found


def with_gaps(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`paths` (locus_id, transcript_id, node_path, ...) with `gaps`: the k-mers between each contig and the next, 0 after the last.

    A gap is what is left of the edge's distance, which is from centre to centre, without the halves of both contigs.
    """
    steps = paths.where("size(node_path) > 1").select("locus_id", "transcript_id", "node_path", F.explode(F.sequence(F.lit(1), F.size("node_path") - 1)).alias("at"))
    steps = steps.select("locus_id", "transcript_id", "at", F.expr("element_at(node_path, at)").alias("src"), F.expr("element_at(node_path, at + 1)").alias("dst"))
    far = edges.groupBy("locus_id", "src", "dst").agg(F.min("distance").alias("distance"))
    rows = steps.join(far, ["locus_id", "src", "dst"], "left")
    for end in ("src", "dst"):
        rows = rows.join(nodes.select(F.col("node_id").alias("contig"), F.col("len").alias(f"len_{end}")), F.abs(end) == F.col("contig"), "left").drop("contig")
    odd = F.when((F.col("len_src") % 2 > 0) | (F.col("len_dst") % 2 > 0), 1).otherwise(0)
    gap = F.floor(F.round("distance", 6)) - F.expr("len_src div 2") - F.expr("len_dst div 2") - odd
    rows = rows.withColumn("gap", F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))).cast("long"))
    gaps = rows.groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "gap"))), lambda s: s["gap"]).alias("gaps"))
    end = F.array(F.lit(0).cast("long"))
    return paths.join(gaps, "transcript_id", "left").withColumn("gaps", F.coalesce(F.concat("gaps", end), end)).select(*paths.columns, "gaps")


def layout(paths: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(locus_id, transcript_id, ord, node_id, len, gap, finish, run): each contig of a transcript in order.

    `finish` is the summed length so far (k-1 and all k-mers and gaps up to and with this one, its own gap
    included); `run` counts the pieces without a positive gap between, from 0. A missing gap is 0; transcripts with a
    contig that is not in `nodes` are left out.
    """
    steps = paths.select("locus_id", "transcript_id", F.size("node_path").alias("n"), "gaps", F.posexplode("node_path").alias("ord", "node_id"))
    gap = F.when(F.col("ord") < F.col("n") - 1, F.coalesce(F.try_element_at("gaps", F.col("ord") + 1), F.lit(0))).otherwise(0)
    known = nodes.select(F.col("node_id").alias("contig"), "len")
    rows = steps.select("locus_id", "transcript_id", "n", "ord", "node_id", gap.cast("long").alias("gap"), F.abs("node_id").alias("contig"))
    rows = rows.join(known, "contig", "left").drop("contig")
    whole = Window.partitionBy("transcript_id")
    rows = rows.withColumn("found", F.count("len").over(whole)).where("found = n").drop("found", "n")
    upto = whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    before = whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns(
        {
            "finish": (F.sum(F.col("len") + F.col("gap")).over(upto) + (k - 1)).cast("long"),
            "run": F.coalesce(F.sum(F.when(F.col("gap") > 0, 1).otherwise(0)).over(before), F.lit(0)).cast("long"),
        }
    )


def distance_marks(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(transcript_id, ord, node_id, start, finish): the k-mers of a path before and up to the end of each contig; unknown contigs have none."""
    steps = paths.select("transcript_id", F.posexplode("node_path").alias("ord", "node_id"))
    sized = steps.join(nodes.select(F.col("node_id").alias("contig"), "len"), F.abs("node_id") == F.col("contig"), "left")
    finish = F.sum(F.coalesce("len", F.lit(0))).over(Window.partitionBy("transcript_id").orderBy("ord"))
    return sized.select("transcript_id", "ord", "node_id", (finish - F.coalesce("len", F.lit(0))).alias("start"), finish.alias("finish"))


def lengths(laid: DataFrame) -> DataFrame:
    """(locus_id, transcript_id, contigs, length) of `layout`."""
    return laid.groupBy("locus_id", "transcript_id").agg(F.count("*").alias("contigs"), F.max("finish").alias("length"))


def gap_runs(laid: DataFrame, k: int) -> DataFrame:
    """(locus_id, transcript_id, run, contigs, length): the pieces of each transcript that have no gap inside."""
    return laid.groupBy("locus_id", "transcript_id", "run").agg(F.count("*").alias("contigs"), (F.sum("len") + (k - 1)).alias("length"))


def numbered(lengths_: DataFrame, least: int) -> DataFrame:
    """Transcripts of at least `least` bases with their place j of n in the locus, the latest first."""
    placed = numbered_within(lengths_.where(F.col("length") >= least), "locus_id", "j", F.desc("transcript_id"))
    # the last place of a locus is how many there are
    total = placed.groupBy("locus_id").agg(F.max("j").alias("n"))
    return salted(placed, total, "locus_id")


def contained_paths(paths: DataFrame) -> DataFrame:
    """(transcript_id): paths that lie whole within another one, in either direction; of equal ones the later goes.

    Where a path goes through a contig that some path begins with, on that strand, its stretches of the lengths of such
    paths are looked up among the whole paths, so no two paths that merely meet are compared. Distinct paths are looked
    up, however many transcripts have the same one.
    """
    text = lambda p: F.array_join(p, ",")
    back = lambda p: F.reverse(F.transform(p, lambda n: -n))
    key = lambda p: F.least(text(p), text(back(p)))
    scratch = Scratch(paths.sparkSession)
    rows = paths.select("transcript_id", "node_path", key(F.col("node_path")).alias("key"))
    firsts = scratch.keep(rows.groupBy("key").agg(F.min("transcript_id").alias("kept"), F.min("node_path").alias("path")))
    later = rows.join(firsts.select("key", "kept"), "key").where("transcript_id > kept").select("transcript_id")
    ends = F.array(F.element_at("path", 1), -F.element_at("path", -1))
    heads = firsts.select(F.explode(ends).alias("node_id"), F.size("path").alias("m")).distinct()
    steps = firsts.where("size(path) > 1").select("kept", F.size("path").alias("n"), F.posexplode("path").alias("at", "node_id"))
    meets = salted(steps, heads, "node_id").where("m < n and at + m <= n")
    spots = meets.groupBy("kept").agg(F.collect_list(F.struct("at", "m")).alias("spots"))
    found = firsts.select("kept", "path").join(spots, "kept").select("path", F.explode("spots").alias("spot"))
    stretches = found.select(key(F.slice("path", F.col("spot.at") + 1, F.col("spot.m"))).alias("key")).distinct()
    inside = rows.join(stretches, "key", "left_semi").select("transcript_id")
    return later.unionByName(inside).distinct()


def orphan_paths(paths: DataFrame, loci: DataFrame) -> DataFrame:
    """Transcripts whose locus is not in `loci`."""
    return paths.join(loci.select("locus_id").distinct(), "locus_id", "left_anti").select("transcript_id", "locus_id")


def path_links(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): each unique contig of a path and the next unique one, signs ignored: the edges of merged loci."""
    steps = paths.select("transcript_id", F.posexplode("node_path").alias("ord", "node_id"))
    unique = nodes.where("is_unique").select(F.col("node_id").alias("contig"))
    on = steps.withColumn("contig", F.abs("node_id")).join(unique, "contig")
    after = F.lead("contig").over(Window.partitionBy("transcript_id").orderBy("ord"))
    return on.select(F.col("contig").alias("src"), after.alias("dst")).where("dst is not null and src <> dst").distinct()


def merged_transcripts(paths: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus_id, transcript_id, contigs, confidence): each path in the locus of its first unique contig.

    `loci` is (node_id, locus_id). A path without a unique contig is its own locus, numbered by its negative id.
    confidence: the path's different contigs by the locus's different contigs.
    """
    steps = paths.select("transcript_id", F.posexplode("node_path").alias("ord", "n")).select("transcript_id", "ord", F.abs("n").alias("node_id"))
    first = steps.join(loci, "node_id").groupBy("transcript_id").agg(F.min_by("locus_id", "ord").alias("locus_id"))
    own = steps.join(first, "transcript_id", "left").withColumn("locus_id", F.coalesce("locus_id", -F.col("transcript_id")))
    of_path = own.groupBy("locus_id", "transcript_id").agg(F.count_distinct("node_id").alias("contigs"))
    of_locus = own.select("locus_id", "node_id").distinct().groupBy("locus_id").agg(F.count("*").alias("all_contigs"))
    return of_path.join(of_locus, "locus_id").select("locus_id", "transcript_id", "contigs", F.round(F.col("contigs") / F.col("all_contigs"), 6).alias("confidence"))


def sequences(laid: DataFrame, nodes: DataFrame, k: int, gaps_in_kmers: bool = False) -> DataFrame:
    """(locus_id, transcript_id, seq): transcripts spelled out, contig after contig, with N in the gaps.

    A contig follows the one before with an overlap of k-1 bases, or after its gap's Ns; leading Ns are cut off. With
    `gaps_in_kmers` (those of `with_gaps`) contigs overlap by what a gap lacks to k-1, and only what it has beyond that
    is Ns, so a sequence is as long as its `finish`. A transcript is spelled from its own contigs only, which are as
    long together as the result.
    """
    seqs = nodes.where("seq is not null").select(F.col("node_id").alias("contig"), "seq")
    rows = laid.withColumn("contig", F.abs("node_id")).join(seqs, "contig")
    forward = F.when(F.col("node_id") > 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
    step = F.struct("ord", "gap", forward.alias("seq"))
    joined = rows.groupBy("locus_id", "transcript_id").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.count("*").alias("n"), F.max("ord").alias("last"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("gap"))
    apart = k - 1 if gaps_in_kmers else 0
    spaced = lambda at, s: F.concat(F.repeat(F.lit("N"), (at["gap"] - apart).cast("int")), F.substr(s["seq"], F.greatest(F.lit(1), F.lit(apart + 1) - at["gap"]).cast("int")))
    piece = lambda at, s: F.when(at["text"] == "", s["seq"]).when(at["gap"] > 0, spaced(at, s)).otherwise(F.substr(s["seq"], F.lit(k)))
    fold = F.aggregate("steps", start, lambda at, s: F.struct(F.concat(at["text"], piece(at, s)).alias("text"), s["gap"].alias("gap")), lambda at: F.ltrim(at["text"], F.lit("N")))
    return joined.where("n = last + 1").select("locus_id", "transcript_id", fold.alias("seq"))


def used_reads(occ: DataFrame, laid: DataFrame, least: int, heavy: list | None = None) -> DataFrame:
    """(read_id): reads that lie on a contig, on either strand, of a transcript of at least `least` bases."""
    long_ = lengths(laid).where(F.col("length") >= least).select("transcript_id")
    contigs = laid.join(long_, "transcript_id", "left_semi").select(F.abs("node_id").alias("contig")).distinct()
    on = occ.select("read_id", F.abs("node_id").alias("contig")).distinct()
    return lookup(on, contigs, "contig", "left_semi", heavy).select("read_id").distinct()


def read_mappings(laid: DataFrame, occ: DataFrame, k: int, heavy: list | None = None) -> DataFrame:
    """(transcript_id, read_id, same, start, finish, contigs, low, high): where reads lie along transcripts.

    Consecutive contigs of a transcript that a read has, all on the same or all on the other strand (`same`), are
    one mapping; a contig that the read has not begins a new one. Places are bases of the transcript, from 1; low and
    high count the k-mers of the read before and up to the end of the mapping. The reads of a contig with very many
    (`heavy`) are spread over tasks.
    """
    rows = laid.select("transcript_id", "ord", "node_id", "len", (F.col("finish") - F.col("gap") - F.col("len")).alias("start"), (F.col("finish") - F.col("gap")).alias("finish"), F.abs("node_id").alias("contig"))
    reads = occ.groupBy("read_id", F.abs("node_id").alias("contig"), (F.col("node_id") > 0).alias("forward")).agg(F.min(F.struct("off", "pos")).alias("first"))
    hits = salted(reads, rows, "contig", "inner", heavy).select(
        "transcript_id", "read_id", ((F.col("node_id") > 0) == F.col("forward")).alias("same"), "ord", "start", "finish", "first.off", (F.col("first.off") + F.col("len") - F.col("first.pos")).alias("upto")
    )
    along = Window.partitionBy("transcript_id", "read_id", "same").orderBy("ord")
    new = F.when(F.lag("ord").over(along) == F.col("ord") - 1, 0).otherwise(1)
    runs = hits.withColumn("new", new).withColumn("run", F.sum("new").over(along))
    grouped = runs.groupBy("transcript_id", "read_id", "same", "run")
    return grouped.agg((F.min("start") - (k - 2)).alias("start"), F.max("finish").alias("finish"), F.count("*").alias("contigs"), F.min("off").alias("low"), F.max("upto").alias("high")).drop("run")
