"""Files as rows: path, length, content, and a guard message for paths without bytes."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def empty_files(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Rows of files without bytes, which the binaryFile scan leaves out. The listing is the driver's, as Spark's own is."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    listing = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, recursive)
    found = []
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0 and (not glob or fnmatch(f.getPath().getName(), glob)):
            found.append((f.getPath().toString(), 0, bytearray()))
    return spark.createDataFrame(found, "path string, length bigint, content binary")


def load_files(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = True, with_empty: bool = True) -> DataFrame:
    """All files below a path. ``content`` is read only by plans that use it; filters on ``length`` reach the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = reader.load(path).select("path", "length", "content")
    return out.unionByName(empty_files(spark, path, glob=glob, recursive=recursive)) if with_empty else out


def _plain(path: Column) -> Column:
    """file:/a, file:///a and /a are one path."""
    return F.regexp_replace(path, "^file:/+", "/")


def load_paths(paths: DataFrame, files: DataFrame, *, directories: DataFrame | None = None) -> DataFrame:
    """paths: path. The given files' rows under the names in ``paths``; a path without a file gets the guard's message in ``missing``."""
    found = files.select(_plain(F.col("path")).alias("_p"), "length", "content")
    out = paths.select("path", _plain(F.col("path")).alias("_p")).join(found, "_p", "left")
    message = F.concat(F.lit("File not found: "), F.col("path"))
    if directories is not None:
        out = out.join(directories.select(_plain(F.col("path")).alias("_p"), F.lit(True).alias("_dir")).distinct(), "_p", "left")
        message = F.when(F.col("_dir"), F.concat(F.lit("Path is not a file: "), F.col("path"))).otherwise(message)
    return out.select("path", F.coalesce("length", F.lit(0)).alias("length"), "content", F.when(F.col("length").isNull(), message).alias("missing"))


def text_as_files(df: DataFrame, text: str, path: Column, *keep: str) -> DataFrame:
    """A text column as file-shaped rows, with the columns named in ``keep``. Null text is an empty file."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(*keep, path.alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))


def write_json(results: DataFrame, path: str) -> None:
    """The JSON sink: one object a row."""
    results.write.mode("overwrite").json(path)
