"""The placement monitor gives the same windows on a stream as on a table."""

from __future__ import annotations

from strandlake.streaming.monitor import windowed_rejections


def test_stream_and_batch_agree(spark, tmp_path):
    log = spark.sql("select id as event_id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as ts, cast(-4 as int) as code from range(0, 300, 7)")
    log.write.parquet(str(tmp_path / "log"))
    stream = windowed_rejections(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("monitor").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("monitor").collect())) == sorted(map(tuple, windowed_rejections(log).collect()))
