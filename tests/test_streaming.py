"""Streamed bars equal batch bars."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.config import TREND
from tidemark.sources import bars as src
from tidemark.streaming.bars import streaming_bars


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    ticks = src.event_ticks(spark, str(DATA / "sf0.001")).select("symbol", F.timestamp_micros("ts_us").alias("ts"), F.col("seq.event_id").alias("seq"), "price", "qty")
    ticks.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = streaming_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "1h", 3600)
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = src.resample(src.event_ticks(spark, str(DATA / "sf0.001")), "1h", TREND.ms)
    assert spark.table("bars").exceptAll(want).count() == 0 and want.exceptAll(spark.table("bars")).count() == 0
