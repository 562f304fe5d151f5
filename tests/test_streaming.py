from strandwork.operators.kmers import kmer_counts
from strandwork.streaming.kmers import kmer_counts_stream, read_stream, reads_per_window


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "acgtacgta", 1, "2024-06-01 00:00:00"), (2, "TTTTTNACG", 1, "2024-06-01 00:30:00"), (3, None, 2, "2024-06-01 05:00:00")], "read_id long, seq string, category short, at string")
    rows = rows.selectExpr("read_id", "seq", "category", "cast(at as timestamp) as loaded_at")
    folder = str(tmp_path / "in")
    rows.repartition(2).write.parquet(folder)
    stream = read_stream(spark, folder, rows)
    query = kmer_counts_stream(stream, 3).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, kmer_counts(rows.selectExpr("upper(seq) as seq"), 3).collect()))


def test_windows_count_reads_once(spark, tmp_path):
    rows = spark.sql("select * from values (1L, 1S, timestamp'2024-06-01 00:10:00'), (1L, 1S, timestamp'2024-06-01 00:20:00'), (2L, 1S, timestamp'2024-06-01 00:40:00') as t(read_id, category, loaded_at)")
    folder = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(folder)
    query = reads_per_window(read_stream(spark, folder, rows)).writeStream.outputMode("update").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert [r.reads for r in spark.table("windows").collect()][-1] == 2
