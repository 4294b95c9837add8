"""Pages of facts as a stream: each fact once, windows over late data, and builds that resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def page_stream(spark: SparkSession, folder: str, schema: str, form: str = "parquet", files_per_trigger: int = 4) -> DataFrame:
    """Files of a folder as they come, a few per trigger."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def each_once(stream: DataFrame, id: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each id. With a time column an id is remembered for ``late`` behind the latest time seen, so that what a stream
    keeps is bounded; rows later than that are dropped (``late_apart`` tells them from the others first). Without one every id is kept."""
    if time is None:
        return stream.dropDuplicates([id])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of value in windows; rows later than the watermark no longer change one."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of rows of a key with no gap longer than ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"))


def all_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all there is now, by way of a table. In mode ``complete`` a batch replaces the one before."""
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", sink).outputMode(mode)
    else:
        run = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink))
    run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(sink)


#: Buckets of keys in a ledger.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _replaced(df: DataFrame, path: str, number: int, *by: str) -> None:
    """Writes the rows of a batch in folders ``_batch=<number>``, in place of those of an earlier try of it."""
    df = df.withColumn("_batch", F.lit(number).cast("long"))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "_batch").parquet(path)


def ledger_rows(spark: SparkSession, ledger: str, schema: str, buckets: list[int], before: int) -> DataFrame:
    """Keys that batches before a batch wrote, of some buckets only: the folders of others are not read."""
    rows = spark.read.schema(f"{schema}, _bucket int, _batch long").parquet(ledger)
    return rows.where(F.col("_bucket").isin(buckets) & (F.col("_batch") < before))


def resumable_build(stream: DataFrame, key: str, sink: str, checkpoint: str, run: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> StreamingQuery:
    """Runs what is not in the sink yet, batch by batch; a restart goes on after the last batch that was written.

    What is written is known from a ledger beside the sink (``<sink>-keys``): keys by bucket and batch. A batch reads the buckets of its own
    keys, no others, and never the sink. It replaces what an earlier try of the same batch left in both (the rows first, then the keys), so
    a batch that is made twice leaves its rows once. ``_batch`` is a column of the sink."""
    spark, ledger = stream.sparkSession, f"{sink}-keys"
    kind = f"`{key}` {stream.schema[key].dataType.simpleString()}"

    def step(batch: DataFrame, number: int) -> None:
        todo = batch.dropDuplicates([key]).withColumn("_bucket", _bucket([key], buckets)).persist()
        try:
            used = [r[0] for r in todo.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            if number:  # the first batch finds nothing
                todo = todo.join(ledger_rows(spark, ledger, kind, used, number).select(key, "_bucket"), [key, "_bucket"], "left_anti")
            _replaced(run(todo.drop("_bucket")), sink, number)
            _replaced(todo.select(key, "_bucket"), ledger, number, "_bucket")
        finally:
            todo.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_apart(stream: DataFrame, time: str, late: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Rows in time to ``<sink>/in_time``, rows that come more than ``late`` behind the latest one of the batches before to ``<sink>/late``.

    What is late depends on the batches before alone, whose latest times are a table of one row a batch (``<sink>/latest``); a batch that is
    made again replaces what it wrote. Nothing is dropped: late rows are kept and can be counted."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_late", F.lit(False))
        if number:
            top = spark.read.schema("top timestamp, _batch long").parquet(f"{sink}/latest").where(F.col("_batch") < number).agg(F.max("top").alias("top"))
            rows = batch.join(F.broadcast(top)).withColumn("_late", F.coalesce(F.col(time) < F.col("top") - F.expr(f"interval {late}"), F.lit(False))).drop("top")  # one row
        _replaced(rows.where("not _late").drop("_late"), f"{sink}/in_time", number)
        _replaced(rows.where("_late").drop("_late"), f"{sink}/late", number)
        _replaced(batch.agg(F.max(time).alias("top")), f"{sink}/latest", number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
