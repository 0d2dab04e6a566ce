"""Exact dedup (native): a log-structured merge index of text digests.

Rows come in BATCHES. A batch is gathered in memtables, one a task: the map side of an aggregation, which holds one entry a digest - smallest
id, number of rows - whatever the digest's share of the rows. They are flushed as a *sorted run*: a table bucketed and sorted by digest, with
Parquet Bloom filters for point lookups. Compaction merges runs two by two: a full outer sort-merge join of two runs bucketed alike, which
reads bucket against bucket, moves no row and keeps the smallest identifier of a digest; its output is a run of the next level.

Rows whose digest has several rows are *hits*. The last level has a Bloom filter of these digests (``filters``); rows that it rejects are alone, and
done. The others meet the level's entries, which settles who is a hit. Hits, and no other texts, are then verified byte by byte: they are fetched by a
filter of their row numbers, and a digest's smallest and largest bytes must be the same. Digests where they aren't (collisions) get classes of their own
by grouping on the bytes.

Equality: texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` becomes one space.

Defined cases: null text counts as empty, so null, "" are one group; " " normalises to one space
and is another. Rows repeated with the same id: all get the same ``keep_id``, and only
one of them (the first by row number) is ``kept``. A null id is larger than all others. An empty
table gives no rows. Extra columns are ignored, whatever their names.

Only DataFrame functions are used: no Python runs on executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, scratch_path, shuffle_parts, stable, table
from .filters import BlockFilter, without_rows

#: Runs that are flushed before compaction. Rows are dealt over them by the partition they come from.
BATCHES = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


class DigestIndex:
    """The merge index. ``ingest`` flushes a batch as a sorted run, ``compact`` merges all runs; ``entries``, ``hits`` and ``get`` read."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.buckets = shuffle_parts(spark)
        self.runs: list[str] = []  # names of bucketed tables
        self.paths: dict[str, str] = {}
        self.flushed = self.most = 0

    def _flush(self, entries: DataFrame, most: int) -> str:
        """Writes entries (one a digest) as a run; most: no more entries than this."""
        self.flushed += 1
        name = f"digest_run_{uuid.uuid4().hex}"
        path = self.paths[name] = f"{self.path}/run-{self.flushed:05d}"
        (
            entries.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option("path", path)
            .option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(most // self.buckets + 1))
            .saveAsTable(name)
        )
        return name

    def ingest(self, rows: DataFrame, most: int) -> None:
        """``rows``: digest, row_key. One job gathers the batch in memtables and flushes a run."""
        self.runs.append(self._flush(rows.groupBy("digest").agg(F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("n")), most))
        self.most = max(most, self.most)

    def compact(self) -> None:
        """Merges runs two by two until one is left."""
        while len(self.runs) > 1:
            level, self.runs, self.most = self.runs, [], 2 * self.most
            for one, other in zip(level[::2], level[1::2]):
                self.runs.append(self._flush(self._merge(one, other), self.most))
                for name in (one, other):
                    self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files are scratch
            self.runs += level[len(level) // 2 * 2:]

    def _merge(self, one: str, other: str) -> DataFrame:
        a, b = self.spark.table(one).alias("a"), self.spark.table(other).alias("b").hint("merge")
        both = lambda c, f: f(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
        return a.join(b, F.col("a.digest") == F.col("b.digest"), "full_outer").select(both("digest", F.coalesce), both("row_key", F.least), both("n", lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))

    def entries(self) -> DataFrame:
        """All entries of all runs."""
        return self.spark.read.schema(self.spark.table(self.runs[0]).schema).parquet(*[self.paths[name] for name in self.runs])

    def get(self, digest: bytes) -> DataFrame:
        """Point lookup: the equality reaches the Parquet readers, whose Bloom filters and statistics skip row groups."""
        return self.entries().where(F.col("digest") == F.lit(bytearray(digest)))

    def close(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return grouped_rows(docs, id_col, text_col, batches).drop("row")


def drop_copies(docs: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    docs = stable(docs)
    return without_rows(docs, grouped_rows(docs, **names).where(~F.col("kept")).select("row"))


def row_digests(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """batch, row_key, digest. row_key orders by id (nulls last) and tells repeated ids apart."""
    row = F.monotonically_increasing_id()
    return docs.select(
        F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), row.alias("row")).alias("row_key"),
        F.unhex(F.sha2(normalised(F.col(text_col).cast("string")).cast("binary"), 256)).alias("digest"),
        F.pmod(F.shiftright(row, 33), F.lit(batches)).cast("int").alias("batch"),
    )


def grouped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """exact_groups with ``row``, the number that monotonically_increasing_id gives to a row of ``docs``."""
    spark, docs = docs.sparkSession, stable(docs)
    base = materialise(row_digests(docs, id_col, text_col, batches), "digests", partition_by=["batch"])
    index = DigestIndex(spark)
    for k in range(batches):
        batch = base.where(F.col("batch") == k).select("digest", "row_key")
        index.ingest(batch, batch.count())
    index.compact()
    shared = materialise(index.entries().where("n > 1").select("digest", F.col("row_key").alias("keep_key"), F.col("n").alias("group_size")), "shared-digests")
    index.close()
    h = F.xxhash64("digest")
    probed = BlockFilter(shared.select(h), shared.count()).probe(base.drop("batch"), h, "maybe")
    # what passed the filter meets the entries; a left join, for what passed it wrongly
    met = materialise(probed.where("maybe").drop("maybe").join(shared, "digest", "left"), "met")
    bad = collided(docs, met, text_col)
    alone = [F.col("row_key").alias("keep_key"), F.lit(1).cast("long").alias("group_size")]
    out = probed.where("not maybe").select("row_key", "digest", *alone).unionByName(
        met.select("row_key", "digest", F.coalesce("keep_key", "row_key").alias("keep_key"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    )
    if bad is not None:
        out = _regroup(out, docs, met, bad, text_col)
    return out.select(
        F.col("row_key.row").alias("row"),
        F.col("row_key.doc_id").alias("doc_id"),
        F.col("keep_key.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_key") == F.col("keep_key")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _fetched(docs: DataFrame, hits: DataFrame, text_col: str) -> DataFrame:
    """row, bytes and the columns of ``hits`` (which has row): the texts of these rows. Other texts stop at the filter."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    wanted = BlockFilter(hits.select(F.xxhash64("row")), hits.count()).probe(rows, F.xxhash64("row"), "wanted").where("wanted")
    return wanted.select("row", normalised(F.col("text")).cast("binary").alias("bytes")).join(hits, "row")


def collided(docs: DataFrame, met: DataFrame, text_col: str) -> DataFrame | None:
    """Byte verification of every hit: the digests under which not all rows have the same bytes."""
    hits = materialise(met.where("keep_key is not null").select(F.col("row_key.row").alias("row"), "digest"), "hits")
    spread = _fetched(docs, hits, text_col).groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    bad = materialise(spread.where(F.col("least") != F.col("most")).select("digest"), "collisions")
    return bad if bad.take(1) else None


def _regroup(out: DataFrame, docs: DataFrame, met: DataFrame, bad: DataFrame, text_col: str) -> DataFrame:
    """Digests with a collision: their classes come from the bytes themselves."""
    hits = materialise(met.join(bad, "digest", "left_semi").select(F.col("row_key.row").alias("row"), "row_key", "digest"), "collided-rows")
    again = materialise(_fetched(docs, hits, text_col), "collided-texts")
    classes = again.groupBy("digest", "bytes").agg(F.min("row_key").alias("keep_key"), F.count(F.lit(1)).alias("group_size"))
    fixed = again.join(classes, ["digest", "bytes"]).select("row_key", "digest", "keep_key", "group_size")
    return out.join(bad, "digest", "left_anti").unionByName(fixed)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over all of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL_OP6 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
