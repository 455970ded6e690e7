"""URL filters with dated lists (operator 3), in DataFrame functions only.

Entries of a block list are dated: a pattern is added to a category at one time, removed at another, perhaps added again.
Each pattern's entries become validity intervals, from an addition to the pattern's next entry. A capture is tested against the entries
that were active when it was fetched: its URL gives keys (the host; the host and each of its parent
domains; the host with each leading part of the path), which are joined with the intervals by equal key and month and by the time inside the interval.
Intervals are cut at months, inside the span of the captures, so that a key with a long history and many captures
meets only what is near in time, and a hot key is spread over its months; what is left of skew is split by adaptive joins.

Kinds: host (that host alone), domain (the host and all below it), prefix (host and path up to a /). An interval holds
from its start (included) to its end (excluded). Of entries of one time for one pattern and category the removal comes last.

Nulls: a capture without URL or time, or whose URL has no host, is not blocked; entries with a null pattern, time or
action have no effect. Repeated captures have equal results; repeated entries count once. An empty list blocks nothing. Hosts are compared in lower case and without
a last dot, ports are not compared. Of several categories the least is told. A very long URL has a key for each part of its path. Other columns stay as they are; the result's name
is lengthened where captures has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.llm import common

HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """In lower case, without the dot that may end it; an IPv6 address in its brackets."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def pattern_of(kind: Column, pattern: Column) -> Column:
    """A listed pattern as keys_of() makes them: its host in lower case and without a last dot, a path without slashes at its end."""
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, r"^(\[[^\]]*\]|[^/]*)", 1)), r"\.$", "")
    path = F.filter(F.slice(F.split(pattern, "/"), 2, 1 << 30), lambda x: x != "")
    return F.when(kind == "prefix", F.concat_ws("/", F.concat(F.array(host), path))).otherwise(host)


def keys_of(url: Column) -> Column:
    """An array of (kind, pattern) under which a URL can be listed."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.concat(F.array(host), F.slice(parts, 1, i))).alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(F.length(host) > 0, F.concat(own, domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (kind, pattern, category, action add or remove, dated) -> kind, pattern, category, start, end: end is null where nothing follows."""
    e = common.plain(entries, "kind", "pattern", "category", "action", "dated").dropna(subset=["kind", "pattern", "action", "dated"])
    e = e.withColumn("pattern", pattern_of(F.col("kind"), F.col("pattern"))).distinct()
    w = Window.partitionBy("kind", "pattern", "category").orderBy("dated", "action")
    e = e.withColumn("end", F.lead("dated").over(w)).filter("action = 'add'")
    return e.select("kind", "pattern", "category", F.col("dated").alias("start"), "end").filter("end IS NULL OR start < end")


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def active(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct captures (url, fetched) that meet active entries: n_entries, and the least category."""
    c = captures.select("url", "fetched").dropna().distinct()
    span = c.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi")).collect()[0]
    if span["lo"] is None:
        return c.select("url", "fetched", F.lit(0).cast("long").alias("n_entries"), F.lit("").alias("category"))
    lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    cut = intervals(entries).filter((F.col("start") <= hi) & (F.col("end").isNull() | (F.col("end") > lo)))
    months = F.sequence(_month(F.greatest("start", lo)), _month(F.least(F.coalesce("end", hi), hi)))
    cut = cut.withColumn("month", F.explode(months))
    keyed = c.select("url", "fetched", _month(F.col("fetched")).alias("month"), F.explode(keys_of(F.col("url"))).alias("k")).select("url", "fetched", "month", "k.*")
    met = keyed.join(cut, ["kind", "pattern", "month"]).filter((F.col("fetched") >= F.col("start")) & (F.col("end").isNull() | (F.col("fetched") < F.col("end"))))
    return met.groupBy("url", "fetched").agg(F.count("*").alias("n_entries"), F.min("category").alias("category"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with a struct column listed of n_entries, category and blocked; the struct's name is lengthened where captures has it."""
    name = common.fresh(captures, "listed")
    thin = captures.select(F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("fetched"))
    u, f, e = (common.fresh(captures, x) for x in ("__u", "__f", "__e"))
    found = active(thin, entries).select(F.col("url").alias(u), F.col("fetched").alias(f), F.struct("n_entries", "category").alias(e))
    out = captures.join(found, (F.col(f"`{url}`") == F.col(u)) & (F.col(f"`{fetched}`") == F.col(f)), "left")
    n = F.coalesce(f"{e}.n_entries", F.lit(0).cast("long"))
    return out.withColumn(name, F.struct(n.alias("n_entries"), F.col(f"{e}.category").alias("category"), (n > 0).alias("blocked"))).drop(u, f, e)


# --- the query: the test tables have neither list nor times, so both are derived from the pages ---------

#: Days between the first and the last fetch, and first day.
DAYS, FIRST = 730, "2024-01-01 00:00:00"


def captures_of(pages: DataFrame) -> DataFrame:
    minutes = F.col("page_id") * 7919 % (DAYS * 1440)
    return pages.select("page_id", "url", (F.lit(FIRST).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list with a history: from the hash of a host (and of a URL, for prefixes) come kind, category and the days of two additions and a removal."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    parts = F.split(F.regexp_extract("url", PATH, 1), "/")
    sites = pages.select(F.concat_ws("/", host_of(F.col("url")), F.element_at(parts, 2)).alias("pattern")).filter(F.col("pattern").contains("/")).distinct()
    every = hosts.select(F.when(F.substring(F.md5("host"), 4, 1) < "8", "domain").otherwise("host").alias("kind"), F.when(F.substring(F.md5("host"), 4, 1) < "8", F.regexp_replace("host", r"^(www|m)\.", "")).otherwise(F.col("host")).alias("pattern"), F.md5("host").alias("h"))
    every = every.unionByName(sites.select(F.lit("prefix").alias("kind"), "pattern", F.md5("pattern").alias("h")))
    day = F.conv(F.substring("h", 9, 3), 16, 10).cast("int") % 500
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day"), (F.substring("h", 1, 1) < "6").alias("on")),
        F.struct(F.lit("remove").alias("action"), (day + 30 + F.conv(F.substring("h", 12, 2), 16, 10).cast("int")).alias("day"), (F.substring("h", 2, 1) < "a").alias("on")),
        F.struct(F.lit("add").alias("action"), (day + 400).alias("day"), (F.substring("h", 3, 1) < "4").alias("on")),
    )
    e = every.select("kind", "pattern", F.when(F.substring("h", 5, 1) < "8", "adult").otherwise("spam").alias("category"), F.explode(steps).alias("s"))
    return e.filter("s.on").select("kind", "pattern", "category", "s.action", (F.lit(FIRST).cast("timestamp_ntz") + F.make_dt_interval(F.col("s.day"))).alias("dated"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, fetched_at, n_entries, category, blocked of every page."""
    pages = common.plain(common.read(spark, sf_dir, "pages"), "page_id", "url")
    found = filter_urls(captures_of(pages), entries_of(pages))
    return found.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at", "listed.n_entries", "listed.category", "listed.blocked")


SQL = rf"""
WITH c AS (SELECT page_id, url, TIMESTAMP '{FIRST}' + to_minutes((page_id * 7919 % ({DAYS} * 1440))::INTEGER) AS fetched_at,
                  regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\.$', '') AS host, list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') AS parts FROM pages),
hosts AS (SELECT DISTINCT host FROM c WHERE host <> ''),
sites AS (SELECT DISTINCT host || '/' || string_split(regexp_extract(url, '{PATH}', 1), '/')[2] AS pattern FROM c WHERE len(string_split(regexp_extract(url, '{PATH}', 1), '/')) > 1),
x AS (SELECT CASE WHEN md5(host)[4] < '8' THEN 'domain' ELSE 'host' END AS kind, CASE WHEN md5(host)[4] < '8' THEN regexp_replace(host, '^(www|m)\.', '') ELSE host END AS pattern, md5(host) AS h FROM hosts
      UNION ALL SELECT 'prefix', pattern, md5(pattern) FROM sites),
y AS (SELECT kind, pattern, CASE WHEN h[5] < '8' THEN 'adult' ELSE 'spam' END AS category, h, ('0x' || h[9:11])::INTEGER % 500 AS day FROM x),
e AS (SELECT DISTINCT * FROM (
  SELECT kind, pattern, category, 'add' AS action, day FROM y WHERE h[1] < '6' UNION ALL
  SELECT kind, pattern, category, 'remove', day + 30 + ('0x' || h[12:13])::INTEGER FROM y WHERE h[2] < 'a' UNION ALL
  SELECT kind, pattern, category, 'add', day + 400 FROM y WHERE h[3] < '4')),
i AS (SELECT kind, pattern, category, TIMESTAMP '{FIRST}' + to_days(day) AS s, TIMESTAMP '{FIRST}' + to_days(nxt) AS e FROM
  (SELECT *, lead(day) OVER (PARTITION BY kind, pattern, category ORDER BY day, action) AS nxt FROM e) WHERE action = 'add' AND (nxt IS NULL OR day < nxt)),
k AS (SELECT DISTINCT url, fetched_at, 'host' AS kind, host AS pattern FROM c WHERE host <> ''
  UNION SELECT DISTINCT url, fetched_at, 'domain', array_to_string(string_split(host, '.')[n:], '.') FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS n FROM c WHERE host <> '')
  UNION SELECT DISTINCT url, fetched_at, 'prefix', array_to_string([host] || parts[1:n], '/') FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS n FROM c WHERE host <> '')),
m AS (SELECT url, fetched_at, count(*) AS n, min(category) AS category FROM k JOIN i ON k.kind = i.kind AND k.pattern = i.pattern AND fetched_at >= s AND (e IS NULL OR fetched_at < e) GROUP BY ALL)
SELECT page_id, host, c.fetched_at, coalesce(n, 0)::BIGINT AS n_entries, category, coalesce(n, 0) > 0 AS blocked FROM c LEFT JOIN m ON c.url = m.url AND c.fetched_at = m.fetched_at
"""
