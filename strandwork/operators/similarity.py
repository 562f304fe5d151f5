"""Similar branches between the same two contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.clean import both_ways
from strandwork.operators.graph import steps_back
from strandwork.shared import Scratch, lookup


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short strings (match 1, mismatch and gap 0).

    A row of the table is an array that is folded over the letters of `a`; it stays inside the JVM.
    """
    letters_b = F.split(b, "")
    zero = F.concat(F.array(F.lit(0)), F.transform(letters_b, lambda _: F.lit(0)))

    def next_row(row: Column, letter: Column) -> Column:
        start = F.array(F.lit(0))
        cell = lambda out, x: F.concat(
            out, F.array(F.greatest(out[F.size(out) - 1], row[F.size(out)], row[F.size(out) - 1] + F.when(x == letter, 1).otherwise(0)))
        )
        return F.aggregate(letters_b, start, cell)

    last = F.aggregate(F.split(a, ""), zero, next_row)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.element_at(last, -1)).otherwise(0)


def similar(a: Column, b: Column, k: int, max_divergence: float = 0.2, max_gaps: int = 3) -> Column:
    """Whether two branches may be merged: at most that part of the longer one differs, and short ones are of like length."""
    longer = F.greatest(F.length(a), F.length(b))
    alike = 1 - common_length(a, b) / longer <= max_divergence
    short = (F.length(a) < k) | (F.length(b) < k)
    fits = ~short | (F.abs(F.length(a) - F.length(b)) <= max_gaps)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), alike & fits).otherwise(False)


def simple_bubbles(pairs: DataFrame, nodes: DataFrame, k: int, max_branch: int = 100) -> DataFrame:
    """(source, sink, kept, dropped, same): two contigs of up to `max_branch` k-mers between the same source and sink.

    `kept` has the larger coverage, of equals the smaller id; `same` says whether they are similar enough to merge.
    Branches of one source and sink are compared with the best of them only, so many branches are no pairs problem.
    A bubble is reported once, from the strand whose source is smaller.
    """
    steps = both_ways(pairs.where("active")).select("src", (-F.col("dst")).alias("dst"))
    into = steps.withColumnRenamed("src", "source").withColumnRenamed("dst", "via")
    out = steps.withColumnRenamed("src", "via").withColumnRenamed("dst", "sink")
    known = nodes.where((F.col("len") <= max_branch) & F.col("seq").isNotNull()).select(F.col("node_id").alias("contig"), "seq", "cov")
    inner = into.join(out, "via").where("source <> sink and abs(source) <> abs(via) and abs(sink) <> abs(via) and source <= -sink")
    inner = inner.distinct().withColumn("contig", F.abs("via")).join(known, "contig")
    read = F.when(F.col("via") > 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
    branch = F.struct("cov", (-F.abs("via")).alias("other"), "via", F.substr(read, F.lit(k)).alias("body"))
    rows = inner.select("source", "sink", branch.alias("branch"))
    best = rows.groupBy("source", "sink").agg(F.max("branch").alias("best"), F.count("*").alias("n")).where("n > 1")
    both = rows.join(best, ["source", "sink"]).where("branch.via <> best.via")
    return both.select(
        "source",
        "sink",
        F.col("best.via").alias("kept"),
        F.col("branch.via").alias("dropped"),
        similar(F.col("best.body"), F.col("branch.body"), k).alias("same"),
    )


def branches(steps: DataFrame, nodes: DataFrame, max_branch: int = 100) -> DataFrame:
    """(source, sink, one, other): two ways from a fork to a contig, of up to `max_branch` k-mers of contigs between, that share none of these.

    `steps` is (src, dst), with the reverse of each step. From all forks at once ways are followed contig by contig; the
    way that comes to a contig first, of several in one round the one through the contig of largest coverage, goes on
    from there, all others are told with it and end. So work grows with what is near a fork, not with the ways there
    are. A way without a contig between is none; told once, from the strand whose source is smaller.
    """
    scratch = Scratch(steps.sparkSession)
    sized = nodes.where((F.col("len") <= max_branch) & F.col("seq").isNotNull()).select(F.col("node_id").alias("contig"), "len", "cov")
    next_ = scratch.keep(steps.select("src", "dst").distinct())
    forks = next_.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")
    nothing = F.array().cast("array<bigint>")
    front = scratch.keep(next_.join(forks, "src").where("abs(src) <> abs(dst)").select(F.col("src").alias("source"), F.col("dst").alias("at"), nothing.alias("way"), F.lit(0).cast("long").alias("size")))
    best = front
    told: list[DataFrame] = []
    while True:
        grown = front.join(sized, F.abs("at") == F.col("contig")).where(F.col("size") + F.col("len") <= max_branch)
        grown = grown.select("source", "at", F.concat("way", F.array("at")).alias("way"), (F.col("size") + F.col("len")).cast("long").alias("size"), "cov")
        moved = grown.join(next_.select(F.col("src").alias("at"), "dst"), "at").where("abs(dst) <> abs(source) and not array_contains(way, dst) and not array_contains(way, -dst)")
        came = scratch.keep(moved.select("source", F.col("dst").alias("at"), "way", "size", "cov"))
        if came.isEmpty():
            break
        first = came.groupBy("source", "at").agg(F.max_by(F.struct("way", "size"), F.struct("cov", F.reverse("way").alias("back"))).alias("w")).select("source", "at", "w.way", "w.size")
        front = scratch.keep(first.join(best.select("source", "at"), ["source", "at"], "left_anti"))
        best = best.unionByName(front)
        both = came.select("source", "at", F.col("way").alias("other")).join(best.select("source", "at", F.col("way").alias("one")), ["source", "at"])
        apart = F.expr("one <> other and size(one) > 0 and not arrays_overlap(transform(one, n -> abs(n)), transform(other, n -> abs(n)))")
        told.append(scratch.keep(both.where(apart & F.expr("source <= -at")).select("source", F.col("at").alias("sink"), "one", "other")))
    none = best.where("false").select("source", F.col("at").alias("sink"), F.col("way").alias("one"), F.col("way").alias("other"))
    for part in told:
        none = none.unionByName(part)
    return none


def branch_bubbles(steps: DataFrame, nodes: DataFrame, k: int, max_branch: int = 100) -> DataFrame:
    """(source, sink, kept, dropped, same): `branches`, the way of larger mean coverage first, of equals that of the smaller contigs.

    `same` says whether the bases between are similar enough to merge.
    """
    found = Scratch(steps.sparkSession).keep(branches(steps, nodes, max_branch).withColumn("id", F.xxhash64("source", "sink", "one", "other")))
    known = nodes.select(F.col("node_id").alias("contig"), "seq", "len", "cov")
    sides = []
    for side in ("one", "other"):
        inner = found.select("id", F.posexplode(side).alias("i", "via")).withColumn("contig", F.abs("via")).join(known, "contig")
        read = F.when(F.col("via") > 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.substr(read, F.lit(k)).alias("b")))), lambda s: s["b"]), "")
        sides.append(inner.groupBy("id").agg(F.struct((F.sum("cov") / F.sum("len")).alias("mean"), body.alias("body")).alias(f"{side}_is")))
    rows = found.join(sides[0], "id").join(sides[1], "id")
    mean = lambda side: F.round(F.col(f"{side}_is.mean"), 6)
    stays = (mean("one") > mean("other")) | ((mean("one") == mean("other")) & (F.col("one") <= F.col("other")))
    pick = lambda a, b: F.when(stays, F.col(a)).otherwise(F.col(b))
    return rows.select("source", "sink", pick("one", "other").alias("kept"), pick("other", "one").alias("dropped"), similar(F.col("one_is.body"), F.col("other_is.body"), k).alias("same"))


def branch_moves(bubbles: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved, inside): of similar ways that do not touch each other, where each dropped contig goes, and the steps of the dropped ways.

    `moved` is (dropped, kept) as that of `merge_map`: a contig goes to the one that lies at the same part of the kept way. Of
    ways that share a contig one is taken, the others can be found again.
    """
    scratch = Scratch(bubbles.sparkSession)
    alike = scratch.keep(bubbles.where("same").withColumn("id", F.xxhash64("source", "sink", "kept", "dropped")))
    touched = alike.select("id", F.explode(F.expr("transform(concat(kept, dropped, array(source, sink)), n -> abs(n))")).alias("contig"))
    least = touched.groupBy("contig").agg(F.min("id").alias("least"))
    beaten = touched.join(least, "contig").where("id <> least").select("id")
    taken = scratch.keep(alike.join(beaten, "id", "left_anti"))
    size = nodes.select(F.col("node_id").alias("contig"), "len")

    def along(side: str) -> DataFrame:
        at = taken.select("id", F.posexplode(side).alias("i", side)).withColumn("contig", F.abs(side)).join(size, "contig")
        way = Window.partitionBy("id")
        upto = F.sum("len").over(way.orderBy("i"))
        return at.select("id", side, ((upto - F.col("len")) / F.sum("len").over(way)).alias(f"from_{side}"), (upto / F.sum("len").over(way)).alias(f"to_{side}"))

    middle = (F.col("from_dropped") + F.col("to_dropped")) / 2
    met = along("dropped").join(along("kept"), "id").where((middle >= F.col("from_kept")) & (middle < F.col("to_kept")))
    moved = met.select(F.abs("dropped").alias("dropped"), (F.col("kept") * F.signum("dropped").cast("long")).alias("kept"))
    whole = taken.select(F.expr("concat(array(source), dropped, array(sink))").alias("way"))
    steps = whole.select(F.explode(F.expr("transform(sequence(1, size(way) - 1), i -> struct(way[i - 1] as src, way[i] as dst))")).alias("s")).select("s.src", "s.dst")
    return scratch.keep(moved), scratch.keep(steps.unionByName(steps.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))).distinct())


def merge_map(bubbles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dropped, kept): every contig that gives way to a similar one, by positive id, and the signed contig that stays for it.

    A contig that is dropped from several bubbles goes to the kept one of largest coverage, of equals the smaller
    id. What it goes to may be dropped elsewhere; then it follows. Kept contigs always rank above dropped ones, so
    there is no circle. A contig that is similar to its own reverse stays. No bubbles give an empty result.
    """
    scratch = Scratch(bubbles.sparkSession)
    alike = bubbles.where("same and abs(kept) <> abs(dropped)")
    moves = alike.select(F.abs("dropped").alias("contig"), (F.col("kept") * F.signum("dropped").cast("long")).alias("to"))
    ranked = moves.join(nodes.select("node_id", "cov"), F.abs("to") == F.col("node_id"))
    one = ranked.groupBy("contig").agg(F.max_by("to", F.struct("cov", (-F.col("node_id")).alias("other"), "to")).alias("to"))
    back = one.select(F.col("contig").alias("node"), "to").unionByName(one.select((-F.col("contig")).alias("node"), (-F.col("to")).alias("to")))
    ends = steps_back(scratch, scratch.keep(back))
    return scratch.keep(ends.where("far > 0 and node > 0").select(F.col("node").alias("dropped"), F.col("to").alias("kept")))


def merged_nodes(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """`nodes` without the dropped contigs of `moved` (see `merge_map`); their coverage is added to those that stay."""
    stay = nodes.join(moved.select(F.col("dropped").alias("node_id")), "node_id", "left_anti")
    came = moved.join(nodes.select(F.col("node_id").alias("dropped"), F.col("cov").alias("more")), "dropped")
    more = came.groupBy(F.abs("kept").alias("node_id")).agg(F.sum("more").alias("more"))
    return stay.join(more, "node_id", "left").withColumn("cov", F.col("cov") + F.coalesce("more", F.lit(0))).select(nodes.columns)


def moved_ends(rows: DataFrame, moved: DataFrame, end: str) -> DataFrame:
    """`rows` with the signed contig in `end` replaced by the one that stays for it."""
    known = rows.withColumn("__contig", F.abs(end))
    both = lookup(known, moved.select(F.col("dropped").alias("__contig"), F.col("kept").alias("__kept")), "__contig")
    return both.withColumn(end, F.coalesce(F.col("__kept") * F.signum(end).cast("long"), F.col(end))).select(rows.columns)


def merged_arcs(arcs: DataFrame, moved: DataFrame) -> DataFrame:
    """(src, dst, multiplicity) between the contigs that stay."""
    ends = moved_ends(moved_ends(arcs, moved, "src"), moved, "dst")
    return ends.groupBy("src", "dst").agg(F.sum("multiplicity").alias("multiplicity"))


def merged_occurrences(occ: DataFrame, nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """(read_id, node_id, pos, off): places of reads on dropped contigs become places on those that stay.

    A place keeps its part of the length, rounded down and within the contig. `nodes` are those before the merge.
    """
    size = nodes.select("node_id", "len")
    scale = moved.join(size.select(F.col("node_id").alias("dropped"), F.col("len").alias("old")), "dropped")
    scale = scale.join(size.select(F.col("node_id").alias("stays"), F.col("len").alias("new")), F.abs("kept") == F.col("stays"))
    scale = scale.select(F.col("dropped").alias("contig"), "kept", "old", "new")
    known = occ.select("read_id", "node_id", "pos", "off", F.abs("node_id").alias("contig"))
    rows = lookup(known, scale, "contig")
    at = F.floor(F.col("pos") * F.col("new") / F.greatest("old", F.lit(1)))
    within = F.greatest(F.least(at, F.col("new") - 1), F.lit(0)).cast("long")
    moved_to = F.col("kept") * F.signum("node_id").cast("long")
    place = F.when(F.col("kept").isNull(), F.col("pos")).otherwise(within)
    return rows.select("read_id", F.coalesce(moved_to, "node_id").alias("node_id"), place.alias("pos"), "off").distinct()
