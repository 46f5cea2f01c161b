from pyspark.sql import functions as F

from headway.streaming import monthly

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_batches_are_loaded_once(spark, tmp_path):
    events = spark.read.schema(monthly.SCHEMA).parquet(EVENTS)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    events.where("event_id % 2 = 0").write.parquet(source)
    for _ in range(2):
        monthly.load_batches(monthly.event_stream(spark, source), out, f"{tmp_path}/c").awaitTermination()
    events.where("event_id % 2 = 1").write.mode("append").parquet(source)
    monthly.load_batches(monthly.event_stream(spark, source), out, f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == events.count()


def test_hours_close_after_the_watermark(spark, tmp_path):
    spark.read.schema(monthly.SCHEMA).parquet(EVENTS).repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    query = monthly.hourly_counts(monthly.event_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("hours").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hours").where("n < 1").count() == 0
