from pyspark.sql import functions as F

from quern.session import table
from quern.streaming import collector

SF = "/root/testdata/sf0.001"


def _run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _stream(spark, tmp_path):
    table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(1).write.parquet(str(tmp_path / "events"))
    batch = spark.read.parquet(str(tmp_path / "events"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    got = _run(spark, collector.windowed_counts(stream), "complete", "windows")
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == sorted((r.start, r.event_type, r.n) for r in collector.windowed_counts(batch).collect())


def test_streak_state(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    got = {r.key: r.streak for r in _run(spark, collector.streak_states(stream), "update", "streaks").collect()}
    want = {}
    for r in batch.orderBy("event_id").collect():
        last, n = want.get(r.user_id, (None, 0))
        want[r.user_id] = (r.event_type, n + 1 if last == r.event_type else 1)
    assert got == {k: v[1] for k, v in want.items()}
