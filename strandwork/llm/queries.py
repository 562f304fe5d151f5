"""The registered queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.components import connected_components
from strandwork.llm.frequent import most_frequent
from strandwork.llm.leaks import find_leaks
from strandwork.llm.packing import fill_containers, token_pieces
from strandwork.llm.seen import ChainSettings, seen_before, with_truth
from strandwork.llm.subjects import subject_areas
from strandwork.llm.topn import top_n_per_group
from strandwork.shared import Scratch, heavy_keys, lookup
from strandwork.sources.tables import table


def sequence_key(seq: Column) -> Column:
    """Sequence without outer white space, in upper case; null if nothing is left."""
    return F.nullif(F.upper(F.btrim(seq, F.lit(" \t\n\r\f\x0b\xa0"))), F.lit(""))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chains' answers as they are; of ten million new keys at most one is wrongly said to be seen."""
    reads = table(spark, folder, "test_reads", "read_id", "seq")
    answers = seen_before(reads, "read_id", sequence_key(F.col("seq")), ChainSettings(error=1e-7))
    return answers.where("seen").select(F.col("order").alias("read_id")).distinct()


def p1_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How often the chains' answers are wrong: keys that were new but said to be seen, of all that were new."""
    reads = table(spark, folder, "test_reads", "read_id", "seq")
    checked = with_truth(seen_before(reads, "read_id", sequence_key(F.col("seq"))))
    wrong, missed = F.count_if(F.expr("seen and not repeat")), F.count_if(F.expr("repeat and not seen"))
    new = F.count_if(~F.col("repeat"))
    counts = (F.count("*").alias("answers"), new.alias("new_keys"), wrong.alias("wrongly_seen"), missed.alias("missed"))
    return checked.agg(*counts, (wrong / new).alias("error_rate"), F.max("bound").alias("error_bound"))


def best_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "transcripts", "locus_id", "transcript_id", "confidence").where("confidence > 0 and confidence <= 1")
    return top_n_per_group(rows, "locus_id", "transcript_id", "confidence", 3, 0.0, 1.0)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return best_transcripts(spark, folder).select("locus_id", "transcript_id")


def node_links(spark: SparkSession, folder: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of problem 3. A read is a node of its own among the edges, at odd numbers; contigs have the even ones.

    So reads that lie on many contigs, or hold many rows, cost no more than their rows. Contigs with very many rows are
    found by scans of the one column.
    """
    nodes = scratch.keep(table(spark, folder, "nodes", "node_id").dropna().select(F.abs("node_id").alias("node_id")).where("node_id <> 0").distinct())
    both = table(spark, folder, "connections", "src", "dst", "active").where("active and src <> 0 and dst <> 0")
    ends = both.select(F.abs("src").alias("src"), F.abs("dst").alias("dst")).where("src <> dst")
    for end in ("src", "dst"):
        heavy = heavy_keys(both.select(F.abs(end).alias(end)), end)
        ends = lookup(ends, nodes.withColumnRenamed("node_id", end), end, "left_semi", heavy)
    placed = table(spark, folder, "read_occ").where("read_id is not null and node_id <> 0 and not (node_position = -1 and read_offset = -1)")
    placed = placed.select("read_id", F.abs("node_id").alias("node_id"))
    placed = lookup(placed, nodes, "node_id", "left_semi", heavy_keys(placed, "node_id"))
    edges = ends.select((F.col("src") * 2).alias("a"), (F.col("dst") * 2).alias("b"))
    return nodes, edges.unionByName(placed.select((F.col("node_id") * 2).alias("a"), (F.col("read_id") * 2 + 1).alias("b")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = node_links(spark, folder, Scratch(spark))
    groups = connected_components(nodes.select((F.col("node_id") * 2).alias("node_id")), edges)
    return groups.select((F.col("node") / 2).cast("long").alias("node_id"), (F.col("group") / 2).cast("long").alias("group_id"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    reads = table(spark, folder, "test_reads", "read_id", "seq")
    return most_frequent(reads, sequence_key(F.col("seq")), "read_id", 20).select(F.col("value").alias("seq"), "records")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_counts(spark, folder).select("seq")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 2048)
    return fill_containers(pieces, "doc_id", 2048)


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "subject_labels", "doc_id", "subject")
    return subject_areas(docs, table(spark, folder, "subjects", "subject"), labels)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).select("doc_id", "subject")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each subject has, and its share of all documents."""
    posts = table(spark, folder, "documents", "doc_id").count()
    found = p8_scores(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))
    return found.withColumn("share", F.col("documents") / F.lit(posts))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    posts, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text")
    return find_leaks(posts, items, "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_error_rate": p1_error_rate,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p3_found": p3_found,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}

KEY = r"nullif(upper(regexp_replace(seq, '^\s+|\s+$', '', 'g')), '')"

SQL: dict[str, str] = {
    "p1_found": f"""
        select distinct read_id from (
          select read_id, {KEY} as key, min(read_id) over (partition by {KEY}) as first from test_reads where read_id is not null)
        where key is not null and read_id > first""",
    "p2_found": """
        select locus_id, transcript_id from (
          select locus_id, transcript_id, row_number() over (partition by locus_id order by confidence desc, transcript_id) as place
          from (select distinct locus_id, transcript_id, confidence from transcripts
                where locus_id is not null and confidence > 0 and confidence <= 1 and not isnan(confidence)))
        where place <= 3""",
    "p3_found": """
        with recursive n as (select distinct abs(node_id) as node_id from nodes where node_id <> 0),
        placed as (select distinct read_id, abs(node_id) as c from read_occ where read_id is not null
          and not (node_position = -1 and read_offset = -1) and abs(node_id) in (select node_id from n)),
        links as (select abs(src) as a, abs(dst) as b from connections where active
            and abs(src) in (select node_id from n) and abs(dst) in (select node_id from n)
          union select min(c) over (partition by read_id), c from placed),
        both_ways as (select a, b from links where a <> b union select b, a from links where a <> b),
        walk as (select node_id, node_id as far from n union select w.node_id, e.b from walk w join both_ways e on e.a = w.far)
        select node_id, min(far) as group_id from walk group by 1""",
    "p4_found": f"""
        select seq from (select {KEY} as seq, count(distinct read_id) as records from test_reads group by 1)
        where seq is not null order by records desc, seq limit 20""",
    "p4_counts": f"""
        select seq, records from (select {KEY} as seq, count(distinct read_id) as records from test_reads group by 1)
        where seq is not null order by records desc, seq limit 20""",
}
