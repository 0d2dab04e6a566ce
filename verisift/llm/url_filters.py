"""URL filters (native): a temporal join of captures with dated list entries.

A filter list is a history of events (scope, value, action, on_date): scope ``domain`` matches a host
and all hosts below it, scope ``host`` matches one host, scope ``prefix`` matches one host plus the first path
segment. An ``add`` opens an entry, a ``remove`` ends it. Events of an entry become validity intervals
[valid_from, valid_to) with ``lead``; the last one is open. Each capture looks its keys up (its host, each
parent domain, host plus first segment) and meets the entries that were active at its fetch time.

The as-of join is an equi-join on (key, month): intervals are cut at month borders, for the months that have
captures only, so a key with a long history doesn't multiply a busy host's captures by all
its entries; within a month a key's intervals don't overlap. AQE splits a hot host, which is on the probe side.

Defined cases: a URL that is null, empty or without ``scheme://host`` has host null and is allowed; user info (up to the last ``@``),
port and trailing dots are dropped, hosts are lower-cased; an IPv6 host keeps its brackets; IP addresses have no parent domains. URLs of any length are
read whole. Extra columns are ignored, whatever their names. Events of one entry on the same date count as one, ``remove`` last;
a ``remove`` without an ``add`` before it does nothing; entries added again while active stay active. Events with a null in any of
their four columns are ignored. A null fetch time meets no entry. Repeated captures each get a row. Empty tables give no
rows, or only allowed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stable, table

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\[\]/?#@]+\]|[^\[\]/?#:@]+)(?:[:/?#]|\z)"
ADDRESS_PATTERN = r"^(\[.*\]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"
SEGMENT_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
EPOCH = "2024-01-01"
DAYS = 365


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATTERN, 1)), r"\.+$", ""), F.lit(""))


def lookup_keys(url: Column, host: Column) -> Column:
    """host:h, domain:h and domain:parent for each parent (an IP address has none), prefix:h/segment."""
    labels = F.when(host.rlike(ADDRESS_PATTERN), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segment = F.regexp_extract(url, SEGMENT_PATTERN, 1)
    prefix = F.when(segment != "", F.array(F.concat(F.lit("prefix:"), host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefix))


def validity_intervals(events: DataFrame) -> DataFrame:
    """events: scope, value, action, on_date. Returns key, valid_from, valid_to (null: open), one row a stretch of activity."""
    daily = (
        events.where(F.col("scope").isNotNull() & F.col("value").isNotNull() & F.col("action").isin("add", "remove") & F.col("on_date").isNotNull())
        .groupBy(F.concat_ws(":", "scope", F.lower("value")).alias("key"), F.col("on_date").cast("date").alias("on_date"))
        .agg(F.max("action").alias("action"))  # "remove" is the larger word
    )
    w = Window.partitionBy("key").orderBy("on_date")
    changes = daily.withColumn("was", F.lag("action").over(w)).where(F.coalesce(F.col("was") != F.col("action"), F.col("action") == "add"))
    return changes.withColumn("valid_to", F.lead("on_date").over(w)).where(F.col("action") == "add").select("key", F.col("on_date").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures: page_id, url, fetch_date. Returns them with host, n_entries (active entries met), first_entry (smallest key), allowed."""
    captures = stable(captures)
    hosts = captures.select("page_id", "url", F.col("fetch_date").cast("date").alias("fetch_date"), host_of(F.col("url")).alias("host")).withColumn("row", F.monotonically_increasing_id())
    probes = hosts.select("row", "fetch_date", F.trunc("fetch_date", "month").alias("month"), F.explode(F.array_distinct(lookup_keys(F.col("url"), F.col("host")))).alias("key"))
    span = captures.agg(F.min("fetch_date").cast("date").alias("lo"), F.max("fetch_date").cast("date").alias("hi"))
    entries = (
        validity_intervals(events)
        .join(F.broadcast(span))  # one row
        .where((F.col("valid_from") <= F.col("hi")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("lo"))))
        .select(
            "key", "valid_from", "valid_to",
            F.explode(F.sequence(F.trunc(F.greatest("valid_from", "lo"), "month"), F.trunc(F.least(F.coalesce("valid_to", "hi"), F.col("hi")), "month"), F.expr("interval 1 month"))).alias("month"),
        )
    )
    met = (
        probes.join(entries, ["key", "month"])
        .where((F.col("fetch_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to"))))
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_entries"), F.min("key").alias("first_entry"))
    )
    return hosts.join(met, "row", "left").select(
        "page_id", "host", "fetch_date", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "first_entry", F.col("n_entries").isNull().alias("allowed")
    )


def _number(c: Column) -> Column:
    """The first eight hex digits of the MD5 of a value's text, which SQL knows too."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch times: page_id fixes one, within DAYS days of EPOCH."""
    return pages.select("page_id", "url", F.date_add(F.lit(EPOCH).cast("date"), F.pmod(_number(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(DAYS)).cast("int")).alias("fetch_date"))


def derived_events(pages: DataFrame) -> DataFrame:
    """``pages`` has no list either: every third host, fifth parent domain and fourth host prefix was listed on a day
    that its MD5 fixes; some were removed 90 days later and some of those added again after 60 more."""
    host = host_of(F.col("url"))
    segment = F.regexp_extract("url", SEGMENT_PATTERN, 1)
    names = pages.select(host.alias("host"), segment.alias("segment")).where(F.col("host").isNotNull()).distinct()
    hosts = names.select("host").distinct()
    dot = F.locate(".", F.col("host"))
    listed = (
        hosts.where(_number(F.col("host")) % 3 == 0).select(F.lit("host").alias("scope"), F.col("host").alias("value"))
        .unionByName(hosts.where((dot > 0) & ~F.col("host").rlike(ADDRESS_PATTERN)).select(F.lit("domain").alias("scope"), F.substring(F.col("host"), dot + 1, F.length("host")).alias("value")).distinct().where(_number(F.col("value")) % 5 == 0))
        .unionByName(names.where(F.col("segment") != "").select(F.lit("prefix").alias("scope"), F.concat_ws("/", "host", "segment").alias("value")).where(_number(F.col("value")) % 4 == 0))
    )
    start = F.date_add(F.lit(EPOCH).cast("date"), F.pmod(_number(F.col("value")), F.lit(300)).cast("int"))
    kind = _number(F.concat(F.lit("k"), F.col("value"))) % 3  # 0: stays, 1: removed, 2: removed and added again
    steps = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("on_date")),
        F.when(kind >= 1, F.struct(F.lit("remove").alias("action"), F.date_add(start, 90).alias("on_date"))),
        F.when(kind == 2, F.struct(F.lit("add").alias("action"), F.date_add(start, 150).alias("on_date"))),
    )
    return listed.select("scope", "value", F.inline(F.array_compact(steps)))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` against the derived list (see derived_events). The SQL cuts hosts by string functions, not by the pattern used here."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_captures(derived_captures(pages), derived_events(pages)).withColumn("fetch_date", F.col("fetch_date").cast("string"))


SQL_OP9 = f"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS r, strpos(url, '://') AS colon FROM pages),
cut AS (
  SELECT *, substr(url, colon + 3) AS rest, replace(replace(substr(url, colon + 3), '?', '/'), '#', '/') AS slashed FROM u
  WHERE colon > 1 AND regexp_full_match(substr(url, 1, colon - 1), '[A-Za-z][A-Za-z0-9+.-]*')),
parts AS (SELECT *, string_split(slashed, '/')[1] AS authority FROM cut),
named AS (
  SELECT *, string_split(authority, '@')[-1] AS name, substr(rest, length(authority) + 1, 1) = '/' AS pathed, string_split(slashed, '/')[2] AS first FROM parts),
hosted AS (
  SELECT r, CASE WHEN pathed THEN coalesce(first, '') ELSE '' END AS segment,
         CASE WHEN starts_with(name, '[') THEN CASE WHEN strpos(name, ']') > 2 AND strpos(substr(name, 2, strpos(name, ']') - 2), '[') = 0 AND substr(name, strpos(name, ']') + 1, 1) IN ('', ':') THEN substr(name, 1, strpos(name, ']')) END
              WHEN strpos(string_split(name, ':')[1], '[') + strpos(string_split(name, ':')[1], ']') = 0 THEN string_split(name, ':')[1] END AS name
  FROM named),
p AS (SELECT page_id, url, nullif(rtrim(lower(name), '.'), '') AS host, coalesce(segment, '') AS segment, r FROM u LEFT JOIN hosted USING (r)),
ip AS (SELECT DISTINCT host FROM p WHERE starts_with(host, '[') OR (len(string_split(host, '.')) = 4 AND list_bool_and([regexp_full_match(x, '[0-9]+') FOR x IN string_split(host, '.')]))),
cap AS (SELECT *, DATE '{EPOCH}' + CAST(CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {DAYS} AS INTEGER) AS fetch_date FROM p),
names AS (SELECT DISTINCT host, segment FROM p WHERE host IS NOT NULL),
raw AS (
  SELECT DISTINCT 'host' AS scope, host AS value, 3 AS every FROM names
  UNION ALL SELECT DISTINCT 'domain', substr(host, strpos(host, '.') + 1), 5 FROM names ANTI JOIN ip USING (host) WHERE strpos(host, '.') > 0
  UNION ALL SELECT DISTINCT 'prefix', host || '/' || segment, 4 FROM names WHERE segment <> ''),
listed AS (
  SELECT scope, value, DATE '{EPOCH}' + CAST(CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) % 300 AS INTEGER) AS d, CAST('0x' || substr(md5('k' || value), 1, 8) AS BIGINT) % 3 AS kind
  FROM raw WHERE CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) % every = 0),
spans AS (
  SELECT scope || ':' || value AS key, d AS valid_from, CASE WHEN kind >= 1 THEN d + 90 END AS valid_to FROM listed
  UNION ALL SELECT scope || ':' || value, d + 150, NULL FROM listed WHERE kind = 2),
keys AS (
  SELECT r, fetch_date, 'host:' || host AS key FROM cap WHERE host IS NOT NULL
  UNION SELECT r, fetch_date, 'domain:' || array_to_string(l[i:], '.') FROM (SELECT r, fetch_date, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, fetch_date, CASE WHEN host IN (SELECT host FROM ip) THEN [host] ELSE string_split(host, '.') END AS l FROM cap WHERE host IS NOT NULL))
  UNION SELECT r, fetch_date, 'prefix:' || host || '/' || segment FROM cap WHERE host IS NOT NULL AND segment <> ''),
met AS (
  SELECT r, count(*) AS n, min(k.key) AS first_entry FROM keys k JOIN spans s ON k.key = s.key AND k.fetch_date >= s.valid_from AND (s.valid_to IS NULL OR k.fetch_date < s.valid_to) GROUP BY r)
SELECT page_id, host, CAST(fetch_date AS VARCHAR) AS fetch_date, coalesce(n, 0) AS n_entries, first_entry, n IS NULL AS allowed FROM cap LEFT JOIN met USING (r)
"""
