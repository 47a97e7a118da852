"""Structured Streaming jobs with batch twins."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riskspark.functions.text import content_hash
from riskspark.session import stage


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier micro-batches wrote under `path`, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


ACCEPTED = T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("ts_s", T.LongType()), T.StructField("seq", T.LongType())])


class _AcceptByContent(StatefulProcessor):
    """Rows of one content: a list of those that the watermark has not passed, the last accepted time, and timers.

    A timer at the earliest waiting row decides, in time order, all rows that the watermark has passed. Another one at the end of the
    window forgets the last accepted time, so that contents not seen again leave no state.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_s bigint, seq bigint")
        self.last = handle.getValueState("last", "ts_s bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(k)) for part in rows for t, k in zip(part["ts_s"], part["seq"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(new)[0] * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t, k in due:
            if last is None or t > last + self.seconds:
                out.append((key[0], t, k))
                last = t
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] * 1000)
        elif due:
            self.waiting.clear()
        if last is not None and last + self.seconds < now:
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            self.handle.registerTimer((last + self.seconds + 1) * 1000)
        if out:
            yield pd.DataFrame(out, columns=ACCEPTED.names)

    def close(self) -> None:
        pass


def _first_per_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal contents of one second only the first key can be accepted: a hot content leaves its task as few rows."""
    for batch in batches:
        t = pa.table(batch).group_by(["content_hash", "ts_s"]).aggregate([("seq", "min")])
        yield from t.rename_columns(["content_hash", "ts_s", "seq"]).to_batches()


def stream_dedup_content(stream: DataFrame, path: str, checkpoint: str, seconds: int = 3600, content: str = "content", ts: str = "ts", key: str = "seq",
                         late: str = "1 hour") -> StreamingQuery:
    """Accepted rows (content_hash, ts_s, seq), by the rule and with the result of ``batch_dedup_content``, appended to ``path``.

    A row is decided once the watermark, ``late`` behind the newest row, has passed it: rows may come in any order within that
    time, over any number of micro-batches. Rows that come later than that are dropped, as the watermark says. What the watermark has not passed when a
    run ends waits in the state for the next run. ``key`` is an integer; of rows of one second the smallest key is taken.
    """
    d = stream.select(content_hash(F.col(content)).alias("content_hash"), F.unix_timestamp(ts).alias("ts_s"), F.col(key).cast("long").alias("seq")).where("ts_s IS NOT NULL")
    d = d.mapInArrow(_first_per_second, ACCEPTED).withColumn("ts", F.timestamp_seconds("ts_s")).withWatermark("ts", late)
    out = d.groupBy("content_hash").transformWithStateInPandas(_AcceptByContent(seconds), ACCEPTED, "Append", "EventTime")
    conf, provider = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(provider)
    conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # lists and timers need it; read at the start
    try:
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(provider, before)


def batch_dedup_content(df: DataFrame, seconds: int = 3600, content: str = "content", ts: str = "ts_s", key: str = "seq") -> DataFrame:
    """Accepted rows: content is skipped while the last *accepted* copy is at most ``seconds`` old.

    Each time stamp points to the first one more than ``seconds`` later; the accepted ones are those reached from the
    first of their content. Time is cut into buckets one longer than the window, so the pointer leads into the next
    bucket or to the first later one that is not empty, and every partition is (content, bucket). The chain of
    pointers is followed by doubling, in a number of rounds logarithmic in its length.
    """
    return chain_accepted(df.withColumn("content_hash", content_hash(F.col(content))), seconds, ts, key)


def chain_accepted(d: DataFrame, seconds: int, ts: str, key: str) -> DataFrame:
    """Accepted (content_hash, time, first key) of rows that carry their content hash."""
    width = seconds + 1
    times = stage(d.groupBy("content_hash", F.col(ts).alias("t")).agg(F.min(key).alias(key)).withColumn("b", F.floor(F.col("t") / width)))
    per = W.partitionBy("content_hash").orderBy("b")
    buckets = times.groupBy("content_hash", "b").agg(F.min("t").alias("m")).withColumns({
        "nb": F.lead("b").over(per), "nm": F.lead("m").over(per), "nnm": F.lead("m", 2).over(per)})
    probes = times.select("content_hash", (F.col("b") + 1).alias("b"), (F.col("t") + width).alias("p"), F.lit(None).cast("bigint").alias("e"), F.col("t").alias("src"))
    here = times.select("content_hash", "b", F.col("t").alias("p"), F.col("t").alias("e"), F.lit(None).cast("bigint").alias("src"))
    ahead = W.partitionBy("content_hash", "b").orderBy(F.desc("p")).rangeBetween(W.unboundedPreceding, 0)
    found = here.unionByName(probes).withColumn("hit", F.min("e").over(ahead)).where("src IS NOT NULL").select("content_hash", F.col("src").alias("t"), "hit")
    jump = times.join(found, ["content_hash", "t"]).join(buckets, ["content_hash", "b"]).select(
        "content_hash", "t", F.when(F.col("nb") == F.col("b") + 1, F.coalesce("hit", "nnm")).otherwise(F.col("nm")).alias("n"))
    jump = stage(jump.where("n IS NOT NULL"))
    reach = stage(times.groupBy("content_hash").agg(F.min("t").alias("t")))
    while not jump.isEmpty():
        reach = stage(reach.unionByName(reach.join(jump, ["content_hash", "t"]).select("content_hash", F.col("n").alias("t"))).distinct())
        step = jump.select("content_hash", F.col("t").alias("n"), F.col("n").alias("n2"))
        jump = stage(jump.join(step, ["content_hash", "n"]).select("content_hash", "t", F.col("n2").alias("n")))
    return reach.join(times, ["content_hash", "t"]).select("content_hash", F.col("t").alias(ts), key)


def stream_refresh(stream: DataFrame, ledger_path: str, checkpoint: str, report: Callable[[int, int], None] | None = None
                   ) -> StreamingQuery:
    """Append only new signals of every micro-batch to the ledger; a replayed batch adds nothing.

    The ledger is partitioned by the first two digits of the fingerprint, which spreads its files; fingerprints are uniform, so
    a batch of some thousand rows reads the fingerprint column of the whole ledger, with one anti join.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("fingerprint").agg(F.min("seq").alias("seq"))
        fresh = batch.join(first, ["fingerprint", "seq"], "left_semi").dropDuplicates(["fingerprint"]).withColumn("prefix", F.substring("fingerprint", 1, 2))
        stored = _written(spark, ledger_path)
        if stored is not None:
            fresh = fresh.join(stored.select("prefix", "fingerprint"), ["prefix", "fingerprint"], "left_anti")
        fresh = stage(fresh)
        n = fresh.count()
        if n:
            fresh.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(ledger_path)
        if report:
            report(epoch, n)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_place_density(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", place: str = "place", span: str = "24 hours", step: str = "1 hour",
                         late: str = "1 hour") -> StreamingQuery:
    """Events per place in sliding windows, open windows included: every micro-batch writes the counts it changed to `path`/epoch=N.

    Rows later than the watermark are dropped. ``current_density`` merges the epochs by key.
    """
    counts = (stream.withWatermark(ts, late).groupBy(F.window(ts, span, step), place).agg(F.count("*").alias("n_events"))
              .select(F.unix_timestamp("window.start").alias("window_start_s"), place, "n_events"))
    apply = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return counts.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_density(written: DataFrame, place: str = "place") -> DataFrame:
    """The newest count per window and place of what ``stream_place_density`` wrote."""
    return written.groupBy("window_start_s", place).agg(F.max_by("n_events", "epoch").alias("n_events"))


def batch_place_density(df: DataFrame, ts: str = "ts", place: str = "place", span: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """The same windows over complete data."""
    return df.groupBy(F.window(ts, span, step), place).agg(F.count("*").alias("n_events")).select(
        F.unix_timestamp("window.start").alias("window_start_s"), place, "n_events")
