"""Mixing sources to target weights (native): hash-threshold histograms.

Every row gets a 60-bit hash of its id, its text and its number among rows equal in both. Sizes are summed by source and hash bucket (the hash's
top bits); running sums over the bounded histogram name, for each source, the bucket in which its
budget ends. Only the rows of that bucket are summed again by the next bits, and so on, until
the last digit: the result is one hash threshold per source. Rows are then filtered by comparing
their hash with the threshold - nothing is sorted. Thresholds are nested: the rows of a smaller
budget are among those of a larger one.

A target above a source's size is met by whole repeats of all its rows plus a threshold for the
rest. The row at the boundary is taken if half of it or more fits, so a source's words differ
from its target by half a row at most.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the sum
of all sizes; a target stops at ``max_repeats`` times its source's size and the excess is shared again by
weight until none is above (water filling: target = min(cap, level * weight)).

Defined cases: null text has size 0 and takes 0 words, and hashes like an empty one; a null id hashes like an empty one; a null source is a source of its own,
last; rows of a source with the same id are told apart by their text, and rows equal in that, too, by a running number (equal rows are
interchangeable, so which of them has which number doesn't matter, and reruns agree). A source of size 0 gets target 0. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, stable, table

DIGIT_BITS, DIGITS = 12, 5  # 60 bits of hash, five histograms at most of 4096 buckets a source
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash60(*parts: Column) -> Column:
    """The first 15 hex digits of the SHA-256 of the parts, with a colon between them."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame | None:
    """``rows``: source_key, row (monotonically increasing ids), hash. Of rows that share source and hash, all but the first with the hash of
    their running number: row, again. None where no rows do. A group is numbered inside each partition, and its partitions' counts are summed: no task holds it."""
    key = ["source_key", "hash"]
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = materialise(rows.join(repeated, key).select(*key, "row", F.shiftright("row", 33).alias("part")), "repeated")
    if not placed.take(1):
        return None
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy("row"))
    parts = placed.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    number = (F.col("inside") + F.col("before") - 1).cast("long")
    again = placed.withColumn("inside", inside).join(parts.select(*key, "part", before.alias("before")), [*key, "part"]).withColumn("number", number)
    return materialise(again.where("number > 0").select("row", hash60(F.col("hash").cast("string"), F.col("number").cast("string")).alias("again")), "numbered")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` by place in code-point order, nulls last. The order is dealt by ranges, so no task holds all sources."""
    placed = materialise(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = placed.groupBy("part").count().withColumn("base", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    place = inside - 1 + F.coalesce(F.col("base"), F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    return placed.join(before.select("part", "base"), "part").withColumn("weight", weight).drop("part", "base")


def with_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources``: source, source_size. Adds weight and target. Each round caps sources at the current level; a few rounds end it."""
    ranked = materialise(ranked_sources(sources), "ranked")
    cap = F.col("source_size") * max_repeats
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, below = 0.0, None
    while True:  # the level only rises; it stands still once no further source is capped
        held = cap <= F.lit(level) * F.col("weight")
        got = ranked.agg(F.sum(F.when(held, cap)).alias("capped"), F.sum(F.when(~held, F.col("weight"))).alias("open"), F.count(F.when(held, 1)).alias("n")).first()
        if not got["open"] or got["n"] == below:
            break
        level, below = (total - (got["capped"] or 0)) / got["open"], got["n"]
    return ranked.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``rows``: source_key, hash, size; ``budgets``: source_key, budget (words). Returns source_key, threshold:
    the rows with hash < threshold are taken. One pass over the narrow rows for each digit; after the first, only
    rows of a boundary bucket are summed, and a source is settled once that bucket holds a single row."""
    open_ = budgets.select("source_key", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    settled = None
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        inside = rows.withColumn("prefix", F.shiftright("hash", shift + DIGIT_BITS)).join(open_, ["source_key", "prefix"])
        hist = inside.groupBy("source_key", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("left").alias("left")
        )
        before = F.sum("size").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("size")
        edge = (
            hist.withColumn("before", before)
            .where(F.col("before") + F.col("size") > F.col("left"))
            .groupBy("source_key")
            .agg(F.min(F.struct("bucket", "before", "size", "n", "left")).alias("e"))
        )
        step = open_.select("source_key").join(edge, "source_key", "left")
        single = (F.col("e.n") == 1) | F.lit(digit == DIGITS - 1)
        taken = (F.col("e.before") + F.col("e.size") / 2 < F.col("e.left")).cast("long")  # the boundary row itself
        step = materialise(
            step.select(
                "source_key",
                (F.col("e.left") - F.col("e.before")).alias("left"),
                F.col("e.bucket").alias("prefix"),
                F.when(F.col("e").isNull(), F.lit(1 << (DIGIT_BITS * DIGITS)))  # the budget holds all rows
                .when(single, F.shiftleft(F.col("e.bucket") + taken, shift))
                .cast("long")
                .alias("threshold"),
            ),
            "thresholds",
        )
        done = step.where(F.col("threshold").isNotNull()).select("source_key", "threshold")
        settled = done if settled is None else settled.unionByName(done)
        open_ = step.where(F.col("threshold").isNull()).select("source_key", "left", "prefix")
        if not open_.take(1):
            break
    return settled


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies, taken, and the columns named in ``keep`` (as struct ``row``)."""
    docs = stable(docs)
    narrow = [
        F.monotonically_increasing_id().alias("row_number"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("source_key"),
        hash60(_text_of(F.col(id_col)), F.sha2(_text_of(F.col(text_col)).cast("binary"), 256)).alias("hash"),
        words_in(F.col(text_col).cast("string")).alias("size"),
    ]
    rows = docs.select(*narrow, F.struct(*keep).alias("row")) if keep else docs.select(*narrow)
    sized = rows if keep else materialise(rows, "sized")
    summed = sized if not keep else materialise(sized.drop("row"), "sized")
    again = numbered(summed.select("source_key", F.col("row_number").alias("row"), "hash"))
    if again is not None:
        renamed = again.withColumnRenamed("row", "row_number")
        rehash = lambda df: df.join(renamed, "row_number", "left").withColumn("hash", F.coalesce("again", "hash")).drop("again")
        sized, summed = rehash(sized), materialise(rehash(summed), "rehashed")
    per_source = summed.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = with_targets(per_source, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = thresholds(summed.select("source_key", "hash", "size"), plan.select("source_key", "budget"))
    plan = materialise(plan.join(cut, "source_key").select("source_key", "source_size", "target", "whole", "threshold"), "mix-plan")
    mixed = sized.join(plan, "source_key").withColumn("copies", F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if keep else []))


def mixed_rows(docs: DataFrame, **names) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with its own columns."""
    out = mix(docs, keep=docs.columns, **names)
    return out.where(F.col("copies") > 0).select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "row").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4 over all of ``documents``."""
    return mix(table(spark, sf_dir, "documents")).drop("copies")


SQL_OP4 = r"""
WITH d0 AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(coalesce(text, ''))), 1, 15) AS BIGINT) AS h1
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, h1) - 1 AS k FROM d0),
d AS (SELECT *, CASE WHEN k = 0 THEN h1 ELSE CAST('0x' || substr(sha256(CAST(h1 AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 15) AS BIGINT) END AS h FROM n),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM r WINDOW q AS (ORDER BY 3 * source_size / w, source)),
l AS (SELECT arg_min(level, struct_pack(a := 3 * source_size / w, b := source)) AS level FROM o WHERE 3 * source_size > level * w),
t AS (
  SELECT r.source, source_size, least(CAST(3 * source_size AS DOUBLE), level * w) AS target
  FROM r, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) - d.size AS bef
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN bef + size / 2.0 < budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
