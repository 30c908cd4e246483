"""Standing queries over newly written documents, named channels, and rolling metrics, on Structured Streaming."""

from __future__ import annotations

import fnmatch
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from burrow.functions.predicates import Filter, everything
from burrow.operators.monitor import error_rows


@dataclass
class Taps:
    """Every tap is a streaming query of its own, so any number of them run side by side and none replaces another.

    checkpoints: a folder that all executors share; a tap with the same name continues where it stopped.
    """

    spark: SparkSession
    checkpoints: str
    running: dict[str, StreamingQuery] = field(default_factory=dict)
    schemas: dict[str, StructType] = field(default_factory=dict)

    def _rows(self, channel: str) -> str:
        return f"{self.checkpoints}/rows-{channel}"

    def tap(self, changes: DataFrame, where: Filter | None = None, channel: str = "tap", kind: str = "put", once: bool = False) -> StreamingQuery:
        """Documents of a stream of changes that match a filter go to files of the channel, exactly once.

        If the stream has a column `change` (put or delete), only changes of this kind are looked at. once: handle
        what there is and stop."""
        if channel in self.running and self.running[channel].isActive:
            raise ValueError(f"channel {channel} is taken")
        found = changes.where(F.col("change") == kind) if "change" in changes.columns else changes
        found = found.where((where or everything()).on(found))
        writer = found.writeStream.format("parquet").option("path", self._rows(channel)).queryName(channel).outputMode("append")
        writer = writer.option("checkpointLocation", f"{self.checkpoints}/{channel}")
        self.running[channel] = (writer.trigger(availableNow=True) if once else writer).start()
        self.schemas[channel] = found.schema
        return self.running[channel]

    def publish(self, changes: DataFrame, channel: str, path: str, once: bool = False) -> StreamingQuery:
        """A stream into a channel that other sessions can read: files, exactly once."""
        writer = changes.writeStream.format("parquet").option("path", f"{path}/{channel}").outputMode("append")
        writer = writer.option("checkpointLocation", f"{self.checkpoints}/published-{channel}")
        self.running[f"published-{channel}"] = (writer.trigger(availableNow=True) if once else writer).start()
        return self.running[f"published-{channel}"]

    def published(self, path: str, pattern: str = "*") -> DataFrame:
        """What any session has published below `path` on the channels that match, with the column channel."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in store.listStatus(root) if s.isDirectory())
        parts = [self.spark.read.parquet(f"{path}/{n}").withColumn("channel", F.lit(n)) for n in fnmatch.filter(names, pattern)]
        if not parts:
            raise KeyError(f"no channel matches {pattern}")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def channels(self, pattern: str = "*") -> list[str]:
        """The channels that match a name with a trailing *."""
        return sorted(fnmatch.filter(self.running, pattern))

    def subscribe(self, pattern: str) -> DataFrame:
        """What has arrived so far on all matching channels, with the column channel."""
        names = [c for c in self.channels(pattern) if not c.startswith("published-")]
        parts = [self._arrived(c).withColumn("channel", F.lit(c)) for c in names]
        if not parts:
            raise KeyError(f"no channel matches {pattern}")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def _arrived(self, channel: str) -> DataFrame:
        """The rows of a channel's finished batches; none before the first one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._rows(channel))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schemas[channel])
        return self.spark.read.schema(self.schemas[channel]).parquet(self._rows(channel))

    def unsubscribe(self, channel: str) -> None:
        self.running.pop(channel).stop()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; only one machine can do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = f"file://{tempfile.mkdtemp(prefix='burrow-streams-')}"
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def keep_latest(results: DataFrame, path: str, once: bool = False) -> StreamingQuery:
    """A stream's complete result after every batch, as files: each batch has a folder of its own, numbered."""
    writer = results.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch:012d}"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The result of the newest whole batch of keep_latest()."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in store.listStatus(root) if s.getPath().getName().startswith("batch=")]
    return spark.read.parquet(max(f for f in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))))


def log_stream(errors: DataFrame, path: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Errors of a stream (trace_id_s, ts, message, frames) into the tables `log` and `error` below `path`, a batch a second:
    a document an error, and one a stack frame. A batch that is run again replaces what it wrote."""

    def write(df: DataFrame, batch: int) -> None:
        for name, rows in zip(("log", "error"), error_rows(df), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")

    writer = errors.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def with_event_time(df: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """A stream with a watermark; times without a zone are taken as UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def metric_windows(samples: DataFrame, by: str, value: str, time: str, window: str = "60 seconds", slide: str | None = None) -> DataFrame:
    """Statistics of every metric in windows of event time; the stream needs a watermark."""
    x = F.col(value)
    grouped = samples.groupBy(F.window(time, window, slide), F.col(by).alias("metric"))
    found = grouped.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
    return found.select(F.col("window.start").alias("start"), "metric", "n", "min", "max", "mean", "variance")


def distinct_stream(df: DataFrame, keys: list[str]) -> DataFrame:
    """A stream without repeats of a key within the watermark; the state stays bounded."""
    return df.dropDuplicatesWithinWatermark(keys)
