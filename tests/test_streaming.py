from rasterloom.streaming import scenes


def test_window_statistics(spark, tmp_path):
    source = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts, CAST(id AS DOUBLE) AS v, id DIV 2 AS scene FROM range(48)")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scenes.arriving(spark, str(tmp_path / "in"), source.schema.simpleString()[7:-1].replace(":", " "))
    query = scenes.window_statistics(stream, "ts", "v").writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.n, r.mean) for r in spark.table("stats").collect())
    assert got == [(24, 11.5), (24, 35.5)]
    query = scenes.newest(stream, "ts", "scene").writeStream.format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("newest").count() == 24
