"""Content hashes and exact duplicates of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """struct(sha256, md5, size_bytes); two hashes are equal if their SHA-256 is."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.length(content).cast("long").alias("size_bytes"))


def short_hash(sha256: Column) -> Column:
    return F.concat(F.substring(sha256, 1, 16), F.lit("..."))


def find_duplicates(files: DataFrame, *, order: str = "path", min_size: int = 1, paths: bool = False) -> DataFrame:
    """files: path, length, content and the column ``order``. Groups of two or more equal contents: sha256, size_bytes, count, wasted_bytes, first_path.

    Partial sums, so a group of any size is a row for each task. Members come as rows from ``keep_first``; with ``paths`` as one list
    a group, for groups known to be of modest size. A path listed twice is a duplicate of itself.
    """
    hashed = files.where(F.col("length") >= min_size).select("length", F.sha2("content", 256).alias("sha256"), F.col(order).alias("ord"), F.col("path").cast("string").alias("path"))
    member = F.struct("ord", "path")
    listed = [F.sort_array(F.collect_list(member)).alias("members")] if paths else []
    groups = hashed.groupBy("sha256").agg(F.min("length").alias("size_bytes"), F.count(F.lit(1)).alias("count"), F.min(member).alias("first"), *listed)
    out = groups.where("count >= 2").withColumn("wasted_bytes", F.col("size_bytes") * (F.col("count") - 1))
    return out.select("sha256", "size_bytes", "count", "wasted_bytes", F.col("first.path").alias("first_path"), *([F.col("members.path").alias("paths")] if paths else []))


def wasted_bytes(files: DataFrame, *, min_size: int = 1) -> DataFrame:
    """groups, duplicate_files, wasted_bytes over all groups; counts alone, so a group of any size is two partial sums."""
    counted = files.where(F.col("length") >= min_size).groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min("length").alias("size"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return counted.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("member_files"), F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).alias("wasted_bytes"))


def keep_first(files: DataFrame, *, order: str = "path", min_size: int = 1) -> DataFrame:
    """Members of duplicate groups with action KEEP (the first by ``order``) or DELETE: aggregate, then join back, so that AQE can split a hot group."""
    hashed = files.where(F.col("length") >= min_size).select(F.col(order).alias("ord"), F.col("path").cast("string").alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    firsts = hashed.groupBy("sha256").agg(F.min(F.struct("ord", "path")).alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    keep = F.struct("ord", "path") == F.col("first")
    return hashed.join(firsts, "sha256").select("sha256", F.col("ord"), "path", "size_bytes", F.when(keep, "KEEP").otherwise("DELETE").alias("action"))

