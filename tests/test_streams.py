"""Streaming jobs over several micro-batches against their batch twins."""
import random

from pyspark.sql import functions as F

from riskspark.streaming import stream as ST

SCHEMA = "seq long, ts timestamp, content string"


def arrive(spark, folder, groups):
    """One file for each group of (seq, second, content), in order, and a last one that moves the watermark past all of them."""
    for rows in [*groups, [(10**9, 10**7, "end")]]:
        spark.createDataFrame(rows, "seq long, t long, content string").select("seq", F.timestamp_seconds("t").alias("ts"), "content").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def twin(spark, groups):
    rows = [r for g in groups for r in g]
    df = spark.createDataFrame(rows, "seq long, ts_s long, content string")
    return sorted((r.content_hash, r.ts_s, r.seq) for r in ST.batch_dedup_content(df).collect())


def test_late_and_reordered_rows_over_micro_batches(spark, tmp_path):
    r = random.Random(11)
    rows = [(i, r.randrange(0, 40000), r.choice("aaaabc")) for i in range(400)]
    came = sorted(rows, key=lambda x: x[1] + r.randrange(0, 7000))  # up to 7,000 seconds late
    groups = [came[k::1][:80] for k in range(0, 400, 80)]
    groups[1].append((900, 50, "z"))  # a new content, far older than the last accepted rows of others
    s = arrive(spark, f"{tmp_path}/in", groups)
    ST.stream_dedup_content(s, f"{tmp_path}/out", f"{tmp_path}/log", late="1 day").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("content_hash", "ts_s", "seq").collect()))
    assert got == twin(spark, groups) and len(got) > 20


def test_state_waits_for_the_next_run_and_forgets(spark, tmp_path):
    """Two runs with one log: what waits after the first is decided in the second; null times take no part."""
    spark.createDataFrame([(1, 100, "a"), (2, 3000, "a"), (3, None, "a")], "seq long, t long, content string").select(
        "seq", F.timestamp_seconds("t").alias("ts"), "content").coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: ST.stream_dedup_content(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    run()
    assert ST._written(spark, f"{tmp_path}/out") is None or spark.read.parquet(f"{tmp_path}/out").count() == 0
    groups = [[(4, 3600, "a"), (5, 3701, "a"), (6, 200000, "b")], [(7, 200001, "a")]]
    s = arrive(spark, f"{tmp_path}/in", groups)
    del s
    run()
    got = sorted((r.ts_s, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(100, 1), (3701, 5), (200000, 6), (200001, 7)]


def test_arrivals_take_as_many_files_as_their_rows_fill(spark, tmp_path):
    """A table of many partitions still arrives as one file each four days, and as several where an arrival has more rows than a file takes."""
    import glob
    from types import SimpleNamespace
    from riskspark.plans import q_more
    rows = spark.range(0, 400, 1, 8).selectExpr("id AS seq", "timestamp_seconds(1704067200 + id * 6400) AS ts", "concat('c', id % 7) AS content")
    v = SimpleNamespace(spark=spark)
    for per_file, least, most in ((1000, 8, 10), (20, 18, 40)):
        folder = f"{tmp_path}/in{per_file}"
        s = q_more._arriving_files(v, rows, folder, per_file)
        assert s.isStreaming and s.columns == ["seq", "ts", "content"]
        assert least <= len(glob.glob(f"{folder}/*.parquet")) <= most
        assert sorted(r.seq for r in spark.read.parquet(folder).collect()) == list(range(-1, 400))
