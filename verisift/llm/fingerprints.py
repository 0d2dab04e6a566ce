"""Document fingerprints (native): Order MinHash over word k-mers.

Each text becomes its k-mers of K words (a shorter text is one k-mer of all its words). A k-mer's repeats are told apart by
occurrence number; every (k-mer, occurrence) gets a pseudo-random 64-bit value. The value's top bits deal the
pairs into BINS sketches (one hash serves all sketches). A sketch selects its LENGTH smallest values, puts these k-mers
back into text order and hashes that tuple: a slot agrees for two texts when the same k-mers are
minimal *and* stand in the same order, which follows edit distance rather than shared vocabulary.
The fingerprint is the BINS slots of four hex digits ("----" for an empty sketch).

Occurrence numbers come from sorting (hash, position) packed in one long and measuring runs, so a text costs
O(n log n) even if it is one word over and over. Only DataFrame functions are used.

Likeness: equal slots over slots that are filled in either (1 if both fingerprints are empty).

Defined cases: null text is empty, its fingerprint has empty slots only. The next document is that with the next
larger id (null ids count as the largest); after the last comes the first; a lone document follows itself. Rows that share an id are
one document for their predecessor: the row with the fewest code points, then the smallest SHA-256, stands for it. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, table

K, BINS, LENGTH = 3, 64, 2
POS_BITS = 26  # positions of k-mers in a text, packed below their hash
_POS = (1 << POS_BITS) - 1
_BIN_SHIFT = 58  # 64 bins


def _runs(values: Column, key) -> Column:
    """Indexes at which ``key`` of a sorted array changes."""
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | (key(F.get(values, i)) != key(F.get(values, i - 1))))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: the optimizer would copy a plain column into the lambdas that use it."""
    return F.get(F.transform(F.array(value), body), 0)


def slots_of(text: Column, k: int = K, length: int = LENGTH) -> Column:
    """The array of BINS slots of a text (null for an empty slot)."""
    high, pos = F.lit(~_POS).cast("long"), F.lit(_POS).cast("long")
    no_longs = F.array().cast("array<long>")

    def kmer_hashes(w: Column) -> Column:
        n = F.size(w)
        several = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, several).when(n > 0, F.array(F.xxhash64(w))).otherwise(no_longs)

    def occurrences(p: Column, s: Column) -> Column:
        """The occurrence numbers along the sorted array, from the lengths of its runs; null if all are 0."""
        lengths = F.transform(s, lambda x, j: F.coalesce(F.get(s, j + 1), F.size(p)) - x)
        return F.when(F.size(s) < F.size(p), F.flatten(F.transform(lengths, lambda x: F.sequence(F.lit(0), x - 1))))

    def values(p: Column, o: Column) -> Column:
        value = lambda x, i: F.xxhash64(F.shiftright(x, POS_BITS), F.coalesce(F.get(o, i), F.lit(0)))
        return F.sort_array(F.transform(p, lambda x, i: value(x, i).bitwiseAND(high).bitwiseOR(x.bitwiseAND(pos))))

    def slot(h: Column, t: Column, i: Column) -> Column:
        def digits(bin_: Column) -> Column:
            least = F.filter(F.slice(t, i + 1, length), lambda x: F.shiftright(x, _BIN_SHIFT) == bin_)
            kmer = F.transform(F.sort_array(F.transform(least, lambda x: x.bitwiseAND(pos))), lambda q: F.get(h, q.cast("int")))
            return F.struct(bin_.cast("int").alias("bin"), F.lower(F.lpad(F.hex(F.xxhash64(kmer).bitwiseAND(F.lit(0xFFFF).cast("long"))), 4, "0")).alias("digits"))

        return let(F.shiftright(F.get(t, i), _BIN_SHIFT), digits)

    def dense(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda i: F.try_element_at(found, i))

    def sketch(h: Column, t: Column) -> Column:
        return let(F.map_from_entries(F.transform(_runs(t, lambda x: F.shiftright(x, _BIN_SHIFT)), lambda i: slot(h, t, i))), dense)

    def from_hashes(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))
        sorted_values = let(packed, lambda p: let(let(_runs(p, lambda x: F.shiftright(x, POS_BITS)), lambda s: occurrences(p, s)), lambda o: values(p, o)))
        return F.when(F.size(h) > 0, let(sorted_values, lambda t: sketch(h, t))).otherwise(dense(F.create_map().cast("map<int,string>")))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda x: x != "")
    return let(let(words, kmer_hashes), from_hashes)


def as_string(slots: Column) -> Column:
    return F.array_join(slots, "", "----")


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def neighbours(ids: DataFrame) -> DataFrame:
    """ids: no_id, id, n (distinct). Adds the previous id and its n, and the next id. Ordered by ranges: no task holds all ids."""
    placed = materialise(ids.repartitionByRange("no_id", "id").withColumn("part", F.spark_partition_id()), "ids")
    me = F.struct("no_id", "id", "n")
    ends = placed.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))  # one row a range
    by, everything = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lag("last").over(by), F.last("last").over(everything)).alias("before"),
        F.coalesce(F.lead("first").over(by), F.first("first").over(everything)).alias("after"),
    )
    w = Window.partitionBy("part").orderBy("no_id", "id")
    return placed.withColumn("prev", F.lag(me).over(w)).withColumn("next", F.lead(me).over(w)).join(ends, "part").select(
        "no_id", "id",
        F.coalesce("prev", "before").alias("prev"),
        F.coalesce("next", "after").alias("next"),
    )


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    ids = rows.groupBy("no_id", "id").agg(F.max("n_chars").alias("n"))
    near = materialise(neighbours(ids), "neighbours")
    # the text crosses the network once, by id; its head goes on to its predecessor, at the length that is needed there
    placed = rows.join(near, ["no_id", "id"])
    # naming doc_id here, too, leaves both uses of ``placed`` with the same columns, so that they share one exchange of the texts
    stands = F.struct(F.col("n_chars"), F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id"))
    heads = placed.select(
        F.col("prev.no_id").alias("no_id"), F.col("prev.id").alias("id"),
        F.expr("substring(text, 1, cast(prev.n div 4 as int))").alias("head"), stands.alias("order"),
    ).groupBy("no_id", "id").agg(F.min_by("head", "order").alias("head"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.substring(F.col("head"), F.lit(1), quarter))
    both = placed.join(heads, ["no_id", "id"]).withColumn("edited", edited)
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("head", "prev")
    both = both.withColumn("slots", slots_of(F.col("text"))).withColumn("edited_slots", slots_of(F.col("edited"))).drop("text", "edited")
    done = materialise(both.select("no_id", "id", "doc_id", "n_chars", "text_sha256", "edited_sha256", "slots", "edited_slots", "next"), "fingerprints")
    following = done.groupBy(F.col("no_id").alias("next_no_id"), F.col("id").alias("next_id")).agg(F.min_by("slots", F.struct("n_chars", "text_sha256")).alias("next_slots"))
    return done.withColumn("next_no_id", F.col("next.no_id")).withColumn("next_id", F.col("next.id")).join(following, ["next_no_id", "next_id"]).select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("slots")).alias("fingerprint"),
        as_string(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over all of ``documents``."""
    return fingerprints(table(spark, sf_dir, "documents"))
