"""URL filters as a temporal join: every capture against the list entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import hashed, settle

#: Days of a bucket of time. Part of the join key, so that one busy pattern is spread over time.
BUCKET = 30
#: The address of a URL: host and path.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"
#: Kinds of entries by how closely they fit; of two active ones the closer counts, then the longer.
CLOSENESS = {"domain": 1, "host": 2, "path": 3}


def host_of(url: Column) -> Column:
    """The host in lower case, empty for what is no URL."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until) of every blocking interval, from dated entries (kind, pattern, day, action).

    An entry holds until the next one for the same pattern; `drop` ends a block. Of several entries for a pattern on one day a
    block wins. until is null where nothing follows. Entries with a null in any column are void.
    """
    dated = (
        entries.where("kind is not null and pattern is not null and day is not null and action is not null")
        .groupBy("kind", "pattern", "day")
        .agg(F.max((F.col("action") == "block").cast("int")).alias("blocks"))
    )
    # A row per pattern and day at most, however many entries there are.
    following = F.lead("day").over(Window.partitionBy("kind", "pattern").orderBy("day"))
    return dated.withColumn("until", following).where("blocks = 1").select("kind", "pattern", F.col("day").alias("since"), "until")


def candidates(captures: DataFrame, depth: int) -> DataFrame:
    """captures (url, day) once for every pattern that can match them: the host, its domains, and paths of up to *depth* parts."""
    host, parts = F.col("host"), F.col("parts")
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    paths = F.transform(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(parts), F.lit(depth)), F.lit(1))),
        lambda i: F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern")),
    )
    same = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return (
        captures.withColumn("host", host_of(F.col("url")))
        .where("host <> ''")
        .withColumn("parts", F.split(F.rtrim(F.regexp_extract("url", PATH, 1), F.lit("/")), "/"))
        .select("url", "day", F.explode(F.array_distinct(F.concat(same, domains, paths))).alias("x"))
        .select("url", "day", "x.kind", "x.pattern")
    )


def blocked(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, day, kind, pattern, since): the closest entry active at fetch time, for each different (url, day) that has one.

    Intervals and captures meet by pattern and bucket of time, an ordinary join that Spark can split where one pattern is busy;
    a pattern's intervals do not overlap, so a capture meets each pattern once.
    """
    wanted = captures.where("url is not null and day is not null").select("url", "day").distinct()
    periods = settle(validity(entries))
    bounds = periods.agg(F.max(F.when(F.col("kind") == "path", F.size(F.split("pattern", "/")) - 1)).alias("depth")).first()
    last = captures.agg(F.max("day").alias("last")).first()["last"] or 0  # two numbers
    ends = F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))
    spread = (
        periods.withColumn("end", ends)
        .where("since <= end")
        .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("since") / BUCKET), F.floor(F.col("end") / BUCKET))))
        .select("kind", "pattern", "bucket", "since", "until")
    )
    asked = candidates(wanted, bounds["depth"] or 1).withColumn("bucket", F.floor(F.col("day") / BUCKET))
    active = asked.join(spread, ["kind", "pattern", "bucket"]).where("since <= day and (until is null or day < until)")
    closeness = F.element_at(F.create_map(*[F.lit(x) for kv in CLOSENESS.items() for x in kv]), F.col("kind"))
    best = F.max(F.struct(closeness.alias("c"), F.length("pattern").alias("l"), "kind", "pattern", "since")).alias("best")
    return active.groupBy("url", "day").agg(best).select("url", "day", "best.kind", "best.pattern", "best.since")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """captures with blocked, list_kind, list_pattern and list_since, one row for each row given.

    captures: a URL and the day of the fetch as a whole number. entries: (kind, pattern, day, action), kind one of domain (the
    host ends with it), host and path (host and leading parts of the path), action block or drop. A null URL or day, and a
    URL without a host, is not blocked. Repeated rows and URLs are answered alike. Columns of these names are replaced.
    """
    names = ["blocked", "list_kind", "list_pattern", "list_since"]
    rest = captures.drop(*names)
    thin = rest.select(F.col(url_col).alias("url"), F.col(day_col).alias("day"))
    hits = blocked(thin, entries).toDF("_url", "_day", *names[1:])
    joined = rest.join(hits, (F.col(url_col) == F.col("_url")) & (F.col(day_col) == F.col("_day")), "left")
    return joined.select(*rest.columns, F.col("list_kind").isNotNull().alias("blocked"), *names[1:])


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for hosts of the pages, as their hashes have it: some hosts, domains and first parts of paths are
    blocked on a day of the two years, half of them dropped later, and some blocked again."""
    seen = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", PATH, 1).alias("path")).where("host <> ''")
    by_host = seen.groupBy("host").agg(F.min(F.substring_index("path", "/", 1)).alias("part")).withColumn("h", hashed(F.col("host"), 12))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("host", "host", "domain", "path", "", "", "", "")]), (F.col("h") % 8 + 1).cast("int"))
    pattern = (
        F.when(F.col("kind") == "path", F.concat("host", F.lit("/"), "part"))
        .when(F.col("kind") == "domain", F.regexp_replace("host", r"^[^.]*\.", ""))
        .otherwise(F.col("host"))
    )
    listed = by_host.withColumn("kind", kind).where("kind <> ''").withColumn("pattern", pattern)
    first = F.floor(F.col("h") / 8) % 400
    second, third = first + 1 + F.floor(F.col("h") / 4096) % 150, first + 200 + F.floor(F.col("h") / 65536) % 100
    event = lambda day, action: F.struct(day.cast("int").alias("day"), F.lit(action).alias("action"))
    events = F.concat(
        F.array(event(first, "block")),
        F.when(F.floor(F.col("h") / 16777216) % 2 == 1, F.array(event(second, "drop"))).otherwise(F.array().cast("array<struct<day:int,action:string>>")),
        F.when(F.floor(F.col("h") / 33554432) % 3 == 1, F.array(event(third, "block"))).otherwise(F.array().cast("array<struct<day:int,action:string>>")),
    )
    return listed.select("kind", "pattern", F.explode(events).alias("e")).select("kind", "pattern", "e.day", "e.action")


def op10(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", (hashed(F.col("page_id")) % 730).cast("int"))
    return filter_captures(captures, derived_entries(pages))


QUERIES = {"op10_temporal_url_lists": op10}

SQL = {
    "op10_temporal_url_lists": r"""
WITH c AS (
  SELECT page_id, url, (('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 730)::INT AS day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
h AS (
  SELECT host, min(split_part(path, '/', 1)) AS part, ('0x' || substr(md5(host), 1, 12))::BIGINT AS h
  FROM c WHERE host <> '' GROUP BY host),
k AS (
  SELECT *, CASE h % 8 WHEN 0 THEN 'host' WHEN 1 THEN 'host' WHEN 2 THEN 'domain' WHEN 3 THEN 'path' END AS kind,
    (h // 8) % 400 AS first FROM h),
p AS (
  SELECT *, CASE kind WHEN 'path' THEN host || '/' || part WHEN 'domain' THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS pattern
  FROM k WHERE kind IS NOT NULL),
e AS (
  SELECT kind, pattern, first AS day, 1 AS blocks FROM p
  UNION ALL SELECT kind, pattern, first + 1 + (h // 4096) % 150, 0 FROM p WHERE (h // 16777216) % 2 = 1
  UNION ALL SELECT kind, pattern, first + 200 + (h // 65536) % 100, 1 FROM p WHERE (h // 33554432) % 3 = 1),
d AS (SELECT kind, pattern, day, max(blocks) AS blocks FROM e GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day) AS until FROM d),
m AS (
  SELECT c.page_id, v.kind, v.pattern, v.day AS since,
    row_number() OVER (PARTITION BY c.page_id ORDER BY CASE v.kind WHEN 'path' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC,
      length(v.pattern) DESC, v.pattern DESC, v.day DESC) AS r
  FROM c JOIN v ON v.blocks = 1 AND v.day <= c.day AND (v.until IS NULL OR c.day < v.until) AND (
    v.kind = 'host' AND v.pattern = c.host OR v.kind = 'domain' AND c.host LIKE '%.' || v.pattern OR
    v.kind = 'domain' AND c.host = v.pattern OR
    v.kind = 'path' AND starts_with(c.host || '/' || rtrim(c.path, '/') || '/', v.pattern || '/')))
SELECT c.page_id, c.url, c.day, m.kind IS NOT NULL AS blocked, m.kind AS list_kind, m.pattern AS list_pattern, m.since::INT AS list_since
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.r = 1
"""
}
