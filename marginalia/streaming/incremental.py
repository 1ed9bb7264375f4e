"""Incremental processing: watermarks, event-time windows, and stateful streams with exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators import merge


def watermark(rows: DataFrame, time: str, key: str) -> DataFrame:
    """(at_time, key): the newest time and all keys at it. An aggregate and a join, so no list of keys is gathered."""
    newest = rows.agg(F.max(time).alias("at_time"))
    return rows.join(newest, rows[time] == newest["at_time"]).select("at_time", key).distinct()


def newer_than(rows: DataFrame, mark: DataFrame, time: str, key: str) -> DataFrame:
    """Rows later than the mark, or at its time with a key it lacks; rows without a time are left out. No mark lets all through."""
    newest = mark.agg(F.max("at_time").alias("_at")).withColumn("_one", F.lit(1))
    joined = rows.where(F.col(time).isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one")  # one row
    seen = mark.select(F.col(key), F.lit(True).alias("_seen"))
    return joined.join(seen, key, "left").where(F.col("_at").isNull() | (F.col(time) > F.col("_at")) | ((F.col(time) == F.col("_at")) & F.col("_seen").isNull())).select(*rows.columns)


def guarded_mark(mark: DataFrame, first_scan: bool) -> DataFrame:
    """A mark that must be there: without one everything would count as new, so a first scan has to be asked for."""
    if not first_scan and mark.isEmpty():
        raise ValueError("there is no watermark; ask for a first scan")
    return mark


def windowed_counts(rows: DataFrame, time: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts per event-time window; with ``late`` a stream drops state once events that late can't come any more."""
    source = rows.withWatermark(time, late) if late else rows
    return source.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n_events"))


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Replays of a key within the watermark are dropped; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


BUCKETS = 64


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Each batch is folded into a Parquet table of versions: version n holds anew the buckets of keys that batch n touches.

    A bucket is read from the newest version that holds it, so a batch rewrites what it touches and nothing
    else. A batch that is tried again writes the same version again, so replays leave no trace. Versions
    that no bucket is read from any more are dropped, but for the last one before the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        fresh = merge.last_rows(keyed, keys, order)
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # one row per bucket at most
        old = _read_buckets(spark, table, number - 1, set(touched)) if number else None
        merged = fresh if old is None else merge.last_rows(old.select(*fresh.columns).unionByName(fresh), keys, order)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={number}")
        held = _buckets(spark, table, 1 << 60)
        for version in _versions(spark, table)[:-2]:
            if version not in held.values():
                _file_system(spark, table).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version={version}"), True)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start() if available_now else query.trigger(processingTime="300 seconds").start()


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Versions whose batch has finished, oldest first."""
    fs, path = _file_system(spark, table), spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(path(table)):
        return []
    held = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(table)) if s.getPath().getName().startswith("version=")]
    return sorted(v for v in held if fs.exists(path(f"{table}/version={v}/_SUCCESS")))


def _buckets(spark: SparkSession, table: str, version: int) -> dict[int, int]:
    """The version from which each bucket is read."""
    fs, path = _file_system(spark, table), spark._jvm.org.apache.hadoop.fs.Path
    found: dict[int, int] = {}
    for v in _versions(spark, table):
        if v <= version:
            found |= {int(s.getPath().getName().split("=")[1]): v for s in fs.listStatus(path(f"{table}/version={v}")) if s.getPath().getName().startswith("bucket=")}
    return found


def _read_buckets(spark: SparkSession, table: str, version: int, wanted: set[int] | None = None) -> DataFrame | None:
    paths = [f"{table}/version={v}/bucket={b}" for b, v in _buckets(spark, table, version).items() if wanted is None or b in wanted]
    return spark.read.option("basePath", table).parquet(*paths) if paths else None


def read_versioned(spark: SparkSession, table: str, version: int = 1 << 60) -> DataFrame | None:
    """A version of a table written by ``upsert_stream``, or the newest one before it; None if there is none."""
    rows = _read_buckets(spark, table, version)
    return None if rows is None else rows.drop("bucket", "version")


def emit_once(stream: DataFrame, key: str, time: str, late: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each key is handed to the sink once while the watermark remembers it."""
    return deduplicated(stream, key, time, late).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
