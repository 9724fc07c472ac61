from strandlake.streaming.motifs import motif_counts, new_reads


def test_stream_equals_batch(spark, data, tmp_path):
    path = f"{data}/reads_raw.parquet"
    table = spark.read.parquet(path)
    table.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    counts = motif_counts(stream, ["ACG", "TTA"], late="4000 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("motifs").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(repr, motif_counts(table, ["ACG", "TTA"]).collect()))
    assert sorted(map(repr, spark.table("motifs").collect())) == want and want


def test_new_reads(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/reads_raw.parquet")
    table.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = new_reads(spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in"), "4000 days")
    q = stream.select("record_id").writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == table.select("source_file_id", "bam_offset").distinct().count()
