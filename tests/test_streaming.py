from pyspark.sql import functions as F

from latticework.sources.store import Store
from latticework.streaming import ingest, time_regrid


def test_ingest_and_time_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "arrays"))
    q = ingest(stream.drop("ts"), store, "E", "<value:double null>[user_id=0:*,100,0, event_id=0:*,1000,0]", str(tmp_path / "cp"))
    q.awaitTermination()
    assert store.scan("E").df.count() == events.count() and len(store.versions("E")) == 3

    hours = time_regrid(stream, "ts", "1 hour", "30 days", "sum(value) as s", "count(*) as n")
    w = hours.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    w.awaitTermination()
    got = {r["start"]: (round(r["s"], 6), r["n"]) for r in spark.table("hours").collect()}
    want = {r["start"]: (round(r["s"], 6), r["n"]) for r in time_regrid(events, "ts", "1 hour", "30 days", "sum(value) as s", "count(*) as n").collect()}
    assert got == want and len(got) > 1
