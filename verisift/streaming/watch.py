"""An upload watcher: new files are analysed as they come, exact copies are seen once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verisift.operators.identity import analyze
from verisift.sources.session import ship

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, path: str, *, max_files: int = 1000) -> DataFrame:
    """A stream of (path, modificationTime, length, content)."""
    ship(spark)
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(max_files)).load(path)


def analyzed(stream: DataFrame, *, skip_metadata: bool = False) -> DataFrame:
    """Result records of a stream of files. Stateless, so any output mode fits."""
    return analyze(stream, skip_metadata=skip_metadata, keep=("modificationTime",) if "modificationTime" in stream.columns else ())


def first_seen(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Files whose content was not seen within ``delay`` before; state is one hash a content, dropped by the watermark."""
    hashed = stream.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", delay)
    return hashed.dropDuplicatesWithinWatermark(["sha256"])


def counts_by_window(results: DataFrame, *, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Files and high risks by type and event-time window; late data is dropped after ``delay``."""
    timed = results.withWatermark("modificationTime", delay)
    return timed.groupBy(F.window("modificationTime", window), "real_type").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("risk_score") > 50).alias("high_risk"))


def run_to(results: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes what is there through ``foreachBatch`` and stops."""
    return results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
