"""Connections between contigs, from reads and read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.stats import expected_pairs, pair_score
from strandwork.operators.clean import both_ways
from strandwork.shared import heavy_keys, lookup, numbered_within


def occurrences_by_read(occ: DataFrame) -> DataFrame:
    """(read_id, node_id, pos, off, n): one row per read and contig; a read that hits it more than once is marked by -1, -1."""
    hits = occ.groupBy("read_id", "node_id").agg(F.count("*").alias("n"), F.min("pos").alias("p"), F.min("off").alias("o"))
    once = F.col("n") == 1
    return hits.select("read_id", "node_id", F.when(once, F.col("p")).otherwise(-1).alias("pos"), F.when(once, F.col("o")).otherwise(-1).alias("off"), "n")


def usable(occ: DataFrame, nodes: DataFrame, heavy: list | None = None) -> DataFrame:
    """Occurrences that count for connections, with the length and uniqueness of their contig; few contigs a read remain.

    `heavy` are the contigs with very many reads; if not given, they are counted in `occ`.
    """
    heavy = heavy_keys(occ.select(F.abs("node_id").alias("contig")), "contig") if heavy is None else heavy
    rows = occurrences_by_read(occ).where("off >= 0 and not (pos = -1 and off = -1)").drop("n")
    known = nodes.select(F.col("node_id").alias("contig"), "len", "is_unique")
    return lookup(rows.withColumn("contig", F.abs("node_id")), known, "contig", "inner", heavy).drop("contig")


def _sides(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = placed.where("is_unique").select("read_id", *(F.col(c).alias(f"{c}_a") for c in ("node_id", "pos", "off", "len")))
    b = placed.select("read_id", *(F.col(c).alias(f"{c}_b") for c in ("node_id", "pos", "off", "len", "is_unique")))
    return a, b


def direct_connections(placed: DataFrame) -> DataFrame:
    """(src, dst, distance, variance): one row per read and pair of contigs it lies on, the first of them unique.

    `placed` is the result of `usable`. Distances are from centre to centre; the connection leaves the contig
    that the read meets first and its destination is the other one's twin.
    """
    a, b = _sides(placed)
    both = a.join(b, "read_id").where("abs(node_id_a) <> abs(node_id_b)")
    raw = F.expr("pos_a - off_a - len_a div 2 - pos_b + off_b + len_b div 2")
    ahead = F.col("off_a") < F.col("off_b")
    distance = F.when(ahead, raw - F.col("len_a") % 2).otherwise(-(raw + F.col("len_b") % 2))
    src = F.when(ahead, F.col("node_id_a")).otherwise(-F.col("node_id_a"))
    dst = F.when(ahead, -F.col("node_id_b")).otherwise(F.col("node_id_b"))
    return both.select(src.alias("src"), dst.alias("dst"), distance.cast("double").alias("distance"), F.lit(1.0).alias("variance"))


def paired_connections(placed: DataFrame, reads: DataFrame, libraries: DataFrame) -> DataFrame:
    """(src, dst, distance, variance, score_at): one row per read pair and pair of contigs, the first of them unique.

    The few `libraries` with an insert length are broadcast. A pair of unique contigs is counted from the
    smaller one; pairs that would overlap by more than six standard deviations are left out. `score_at` holds
    what the pair's score needs: the distance without its two places, the insert length and the variance.
    """
    a, b = _sides(placed)
    mates = reads.where("mate_id is not null").select("read_id", "mate_id", "category").join(F.broadcast(libraries), "category")
    first = a.join(mates, "read_id")
    both = first.join(b.withColumnRenamed("read_id", "mate_id"), "mate_id").where("abs(node_id_a) <> abs(node_id_b)")
    both = both.where("not (is_unique_b and node_id_b < node_id_a)")
    places = F.expr("(pos_a - off_a - len_a div 2) + (pos_b - off_b - len_b div 2)")
    distance = F.floor("mean") + places
    wide = distance - F.expr("len_a div 2") - F.expr("len_b div 2")
    variance = F.floor(F.col("sd") * F.col("sd"))
    rows = both.where((wide >= -6 * F.col("sd")) & (variance > 0))
    fit = F.struct(places.cast("double").alias("places"), F.floor("mean").cast("double").alias("insert"), (F.col("sd") * F.col("sd")).alias("variance"))
    counts = F.when((F.col("pos_a") > 0) & (F.col("pos_b") > 0), fit)
    return rows.select(F.col("node_id_a").alias("src"), F.col("node_id_b").alias("dst"), distance.cast("double").alias("distance"), variance.cast("double").alias("variance"), counts.alias("score_at"))


def merge_connections(direct: DataFrame, paired: DataFrame) -> DataFrame:
    """(src, dst, distance, variance, direct_count, paired_count) by unordered pair of ends, the least first.

    Distances are averaged by inverse variance; sums only, so each task combines its own rows first.
    """
    rows = direct.select("src", "dst", "distance", "variance", F.lit(1).alias("d"), F.lit(0).alias("p"))
    rows = rows.unionByName(paired.select("src", "dst", "distance", "variance", F.lit(0).alias("d"), F.lit(1).alias("p")))
    grouped = rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    precision = F.sum(1 / F.col("variance"))
    return grouped.agg(
        (F.sum(F.col("distance") / F.col("variance")) / precision).alias("distance"),
        (1 / precision).alias("variance"),
        F.sum("d").alias("direct_count"),
        F.sum("p").alias("paired_count"),
    )


def connection_weights(merged: DataFrame, direct: DataFrame, paired: DataFrame, cap: float = 1000.0) -> DataFrame:
    """`merged` with its weight: 1 per direct read and a Gaussian score per pair, `cap` at most."""
    key = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    ones = direct.groupBy(*key).agg(F.count("*").cast("double").alias("w"))
    fits = paired.where("score_at is not null").select(*key, "score_at").join(merged.select("src", "dst", F.floor(F.round("distance", 6)).alias("d")), ["src", "dst"])
    score = pair_score(F.col("score_at.insert"), F.col("d") - F.col("score_at.places"), F.col("score_at.variance"))
    scores = fits.groupBy("src", "dst").agg(F.sum(score).alias("w"))
    weight = ones.unionByName(scores).groupBy("src", "dst").agg(F.least(F.lit(cap), F.sum("w")).alias("weight"))
    return merged.join(weight, ["src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def local_connections(pairs: DataFrame, arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, multiplicity, distance, variance): arcs between two contigs near the same unique one, not connected yet.

    Both contigs are not unique. Starts from the arcs: the unique contigs near the end that has fewer are looked up
    at the other end, so the connections of a contig with very many are never paired with each other.
    """
    near = both_ways(pairs).join(nodes.where("is_unique").select("node_id"), F.abs("src") == F.col("node_id")).select(F.col("src").alias("hub"), (-F.col("dst")).alias("near"))
    other = nodes.where("not is_unique").select("node_id", "len")
    hubs = near.groupBy("near").agg(F.count("*").alias("hubs"))
    ends = arcs.where("abs(src) <> abs(dst)")
    for end in ("src", "dst"):
        ends = ends.join(other.select(F.col("node_id").alias("id"), F.col("len").alias(f"len_{end}")), F.abs(end) == F.col("id")).drop("id")
        ends = ends.join(hubs.select(F.col("near").alias(end), F.col("hubs").alias(f"hubs_{end}")), end)
    from_src, from_dst = near.withColumnRenamed("near", "src"), near.withColumnRenamed("near", "dst")
    fewer = F.col("hubs_src") <= F.col("hubs_dst")
    first = ends.where(fewer).join(from_src, "src").join(from_dst, ["hub", "dst"], "left_semi")
    second = ends.where(~fewer).join(from_dst, "dst").join(from_src, ["hub", "src"], "left_semi")
    both = first.unionByName(second).select("src", "dst", "multiplicity", "len_src", "len_dst").distinct()
    fresh = both.withColumn("dst", -F.col("dst")).join(both_ways(pairs).select("src", "dst"), ["src", "dst"], "left_anti")
    return fresh.select("src", "dst", "multiplicity", F.expr("len_src div 2 + len_dst div 2").alias("distance"), (1 / F.col("multiplicity")).alias("variance"))


def with_local(weighed: DataFrame, local: DataFrame, cap: float = 1000.0) -> DataFrame:
    """`weighed` and the connections of `local_connections`, which count and weigh as many direct reads as their arcs have."""
    rows = local.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "multiplicity", F.col("distance").cast("double").alias("distance"), "variance")
    one = rows.groupBy("src", "dst").agg(*(F.max(c).alias(c) for c in ("multiplicity", "distance", "variance")))
    counts = (F.col("multiplicity").alias("direct_count"), F.lit(0).cast("long").alias("paired_count"), F.least(F.lit(cap), F.col("multiplicity").cast("double")).alias("weight"))
    return weighed.unionByName(one.select("src", "dst", "distance", "variance", *counts))


def paired_density(occ: DataFrame, reads: DataFrame, libraries: DataFrame) -> DataFrame:
    """(category, node_id, reads): paired reads of libraries with an insert length on each contig."""
    mates = reads.where("mate_id is not null").select("read_id", "category").join(F.broadcast(libraries.select("category")), "category")
    on = occ.select("read_id", F.abs("node_id").alias("node_id")).distinct()
    return on.join(mates, "read_id").groupBy("category", "node_id").agg(F.count("*").alias("reads"))


def expected_connections(pairs: DataFrame, nodes: DataFrame, density: DataFrame, libraries: DataFrame) -> DataFrame:
    """`pairs` with len_src, len_dst and `expected`, the read pairs that all libraries together should give."""
    rows = pairs
    for end in ("src", "dst"):
        rows = rows.join(nodes.select(F.col("node_id").alias("id"), F.col("len").alias(f"len_{end}")), F.abs(end) == F.col("id")).drop("id")
    # a library without reads on both contigs expects nothing, so its pairs need no row
    a, b = (density.select("category", F.col("node_id").alias("id"), F.col("reads").alias(f"reads_{end}")) for end in ("src", "dst"))
    rows = rows.join(a, F.abs("src") == F.col("id"), "left").drop("id")
    b = b.withColumnRenamed("category", "cat")
    rows = rows.join(b, (F.abs("dst") == F.col("id")) & (F.col("category") == F.col("cat")), "left").drop("id", "cat")
    rows = rows.join(F.broadcast(libraries), "category", "left")
    none = F.lit(0)
    one = expected_pairs(F.col("distance"), F.col("len_src"), F.col("len_dst"), F.coalesce("reads_src", none), F.coalesce("reads_dst", none), F.col("mean"), F.col("sd"))
    return rows.groupBy(*pairs.columns, "len_src", "len_dst").agg(F.coalesce(F.sum(one), none).cast("long").alias("expected"))


def reliable(expected: DataFrame, least_pairs: int = 4, paired_cutoff: float = 0.1, short: int = 50) -> DataFrame:
    """The connections of `expected_connections` that enough reads support."""
    enough = (F.col("weight") >= 0.1) & (F.col("paired_count") + F.col("direct_count") >= least_pairs)
    by_pairs = F.when(F.col("expected") == 0, F.col("direct_count") > 0).otherwise(F.col("paired_count") >= F.col("expected") * paired_cutoff)
    return expected.where(enough & F.when(F.col("len_dst") <= short, F.col("direct_count") > 0).otherwise(by_pairs))


def gapped(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Connections over a gap that no read crosses: of more than k-1 if the destination is unique, else of any length."""
    rows = pairs.join(nodes.select(F.col("node_id").alias("id"), F.col("len").alias("len_src")), F.abs("src") == F.col("id")).drop("id")
    rows = rows.join(nodes.select(F.col("node_id").alias("id"), F.col("len").alias("len_dst"), "is_unique"), F.abs("dst") == F.col("id")).drop("id")
    gap = F.col("distance") - F.expr("len_src div 2") - F.expr("len_dst div 2")
    return rows.withColumn("gap", gap).where((F.col("gap") > F.when(F.col("is_unique"), k - 1).otherwise(0)) & (F.col("direct_count") == 0))


def by_distance(pairs: DataFrame) -> DataFrame:
    """(src, dst, distance, place): each contig's connections, nearest first, ties by destination."""
    placed = numbered_within(both_ways(pairs).select("src", "dst", "distance"), "src", "place", "distance", "dst")
    return placed.withColumn("place", F.col("place").cast("int"))


def transitive_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst): connections that two others explain: dst lies behind a nearer contig and at about the summed distance.

    Where either of two could go, the farther one goes; a contig's nearest connection always stays.
    """
    c = both_ways(pairs).select(F.col("src").alias("n"), (-F.col("dst")).alias("d"), F.col("distance").alias("c"))
    c2 = c.select(F.col("n").alias("d"), F.col("d").alias("d2"), F.col("c").alias("c2"))
    c4 = c.select(F.col("n").alias("d2"), F.col("d").alias("d"), F.col("c").alias("c4"))
    out, into = c.groupBy("n").agg(F.count("*").alias("out")), c2.groupBy("d2").agg(F.count("*").alias("into"))
    c3 = c.select("n", F.col("d").alias("d2"), F.col("c").alias("c3")).join(out, "n").join(into, "d2")
    # what lies between is looked for from the end with fewer connections
    first = c3.where("out <= into").join(c, "n").join(c2, ["d", "d2"])
    second = c3.where("out > into").join(c2, "d2").join(c, ["n", "d"])
    far = first.unionByName(second).where("d <> d2 and c3 > (c + c2) * 0.9")
    far = far.join(c4, ["d2", "d"], "left").where("not (c4 is not null and c > (c3 + c4) * 0.9 and (c3 < c or (c3 = c and d2 < d)))")
    gone = far.select("n", "d2").distinct()
    nearest = c.groupBy("n").agg(F.min(F.struct("c", "d")).alias("near")).select("n", F.col("near.d").alias("d2"))
    return gone.join(nearest, ["n", "d2"], "left_anti").select(F.col("n").alias("src"), (-F.col("d2")).alias("dst"))
