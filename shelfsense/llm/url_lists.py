"""URL filters as they stood when a page was fetched, with DataFrame functions only.

A list is a log of dated entries that add or remove a key: a host (which covers
its subdomains) or a host with the first folders of a path.  The entries of a
key become validity intervals, each from an addition to the next entry of that
list and key.  A capture has one candidate key for each suffix of its host and
each folder of its path; an equality join on the key with a range condition on
the date finds the entries in force on the day of the fetch.

A key's entries are few, whatever the number of captures; a host with a third of
all captures is a hot key of the capture side only, which the adaptive join
splits.  Nothing is broadcast by force.

Defined results: of entries of one list, key and day, a removal comes last;
repeated entries count once.  A null url or date matches nothing.  Scheme, user,
port, query and fragment of a url are ignored, hosts are lower-cased.  Every
capture row gets a row, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, valid_from, valid_to (exclusive, null if open) from ``entries`` (list, key, action, dated)."""
    day = entries.groupBy("list", "key", "dated").agg(F.max("action").alias("action"))   # 'remove' after 'add'
    w = Window.partitionBy("list", "key").orderBy("dated")
    return (day.where("key is not null and dated is not null").withColumn("valid_to", F.lead("dated").over(w)).where("action = 'add'")
               .select("list", "key", F.col("dated").alias("valid_from"), "valid_to"))


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: str) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(host: str, path: str) -> Column:
    """Candidate keys: all suffixes of the host, and the host with each leading folder of the path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda i: F.concat(F.col(host), F.lit("/"), F.array_join(F.slice(folders, 1, i), "/")))
    return F.when(F.col(host) != "", F.concat(suffixes, F.when(F.size(folders) > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_on) with n_entries, blocked, lists and listed_since as of the fetch."""
    rows = captures.groupBy("page_id", "url", "fetched_on").agg(F.count(F.lit(1)).alias("copies"))
    asked = rows.withColumn("_host", host("url")).withColumn("_path", path("url"))
    asked = asked.select("page_id", "url", "fetched_on", "copies", F.explode_outer(keys("_host", "_path")).alias("key"))
    valid = intervals(entries)
    in_force = (asked["key"] == valid["key"]) & (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    hits = asked.join(valid, in_force, "left").select("page_id", "url", "fetched_on", "copies", "list", "valid_from")
    out = hits.groupBy("page_id", "url", "fetched_on", "copies").agg(
        F.count("list").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("listed_since"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("page_id", "url", "fetched_on", "n_entries", (F.col("n_entries") > 0).alias("blocked"), "lists", "listed_since")


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and a day of 2024 for each page: the tables hold no fetch times, so the id gives one."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts and first folders that occur in ``pages``; what and when follows from the name's MD5.

    Hosts with a telling word are on the list ``unsafe`` all year but for some
    weeks; some others are on ``reported`` for a while; some folders are on ``folders``.
    """
    hosts = pages.select(host("url").alias("host")).where("host != ''").distinct().withColumn("digest", F.md5("host"))
    folders = (pages.select(F.concat(host("url"), F.lit("/"), F.regexp_extract(path("url"), "^/([^/]+)", 1)).alias("key")).where("key rlike '^[^/]+/.'").distinct()
                    .withColumn("digest", F.md5("key")))

    def entry(of: DataFrame, name: str, key: Column, when: Column, *dated: tuple[str, str]) -> DataFrame:
        return of.where(when).select(F.lit(name).alias("list"), key.alias("key"), F.explode(F.array(*[
            F.struct(F.lit(a).alias("action"), F.lit(d).cast("date").alias("dated")) for a, d in dated])).alias("x")).select("list", "key", "x.action", "x.dated")

    first = F.substring("digest", 1, 1)
    telling = F.col("host").rlike("casino|adult|pills|bets|spam|ads-")
    parent = F.regexp_replace("host", r"^(www|m|blog)\.", "")
    return (entry(hosts, "unsafe", parent, telling, ("add", "2023-06-01"), ("remove", "2024-05-01"), ("add", "2024-05-20"))
            .unionByName(entry(hosts, "reported", F.col("host"), first.isin("0", "1", "2", "3"), ("add", "2024-02-10"), ("remove", "2024-03-15"), ("add", "2024-09-01")))
            .unionByName(entry(hosts, "reported", parent, first.isin("4", "5"), ("add", "2024-07-04"), ("remove", "2024-07-04"), ("add", "2024-11-11")))
            .unionByName(entry(folders, "folders", F.col("key"), first.isin("a", "b", "c"), ("add", "2024-04-01"), ("remove", "2024-10-01"))))


ORACLE = r"""
WITH cap AS (
  SELECT page_id, url, date '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         row_number() OVER () AS rid
  FROM pages),
hosts AS (SELECT DISTINCT host, substr(md5(host), 1, 1) AS c, regexp_replace(host, '^(www|m|blog)\.', '') AS parent FROM cap WHERE host <> ''),
folders AS (SELECT DISTINCT key, substr(md5(key), 1, 1) AS c FROM (
  SELECT host || '/' || regexp_extract(path, '^/([^/]+)', 1) AS key FROM cap) WHERE regexp_matches(key, '^[^/]+/.')),
raw AS (
  SELECT 'unsafe' AS list, parent AS key, a.action, a.dated FROM hosts,
    (VALUES ('add', date '2023-06-01'), ('remove', date '2024-05-01'), ('add', date '2024-05-20')) a(action, dated)
    WHERE regexp_matches(host, 'casino|adult|pills|bets|spam|ads-')
  UNION ALL SELECT 'reported', host, a.action, a.dated FROM hosts,
    (VALUES ('add', date '2024-02-10'), ('remove', date '2024-03-15'), ('add', date '2024-09-01')) a(action, dated) WHERE c IN ('0','1','2','3')
  UNION ALL SELECT 'reported', parent, a.action, a.dated FROM hosts,
    (VALUES ('add', date '2024-07-04'), ('remove', date '2024-07-04'), ('add', date '2024-11-11')) a(action, dated) WHERE c IN ('4','5')
  UNION ALL SELECT 'folders', key, a.action, a.dated FROM folders,
    (VALUES ('add', date '2024-04-01'), ('remove', date '2024-10-01')) a(action, dated) WHERE c IN ('a','b','c')),
ent AS (SELECT list, key, dated, max(action) AS action FROM raw GROUP BY ALL),
iv AS (SELECT list, key, dated AS f, nxt AS t FROM (
  SELECT *, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS nxt FROM ent) WHERE action = 'add'),
lab AS (SELECT rid, fetched_on, host, string_split(host, '.') AS l, [x for x in string_split(path, '/') if x <> ''] AS p FROM cap WHERE host <> ''),
asked AS (
  SELECT rid, fetched_on, array_to_string(l[i:len(l)], '.') AS key FROM (SELECT rid, fetched_on, l, unnest(range(1, len(l) + 1)) AS i FROM lab)
  UNION ALL
  SELECT rid, fetched_on, host || '/' || array_to_string(p[1:i], '/') FROM (SELECT rid, fetched_on, host, p, unnest(range(1, len(p) + 1)) AS i FROM lab)),
hit AS (
  SELECT a.rid, count(*) AS n, string_agg(DISTINCT iv.list, ',' ORDER BY iv.list) AS lists, min(iv.f) AS since
  FROM asked a JOIN iv ON a.key = iv.key AND a.fetched_on >= iv.f AND (iv.t IS NULL OR a.fetched_on < iv.t) GROUP BY a.rid)
SELECT c.page_id, c.url, CAST(c.fetched_on AS DATE) AS fetched_on, coalesce(h.n, 0) AS n_entries, coalesce(h.n, 0) > 0 AS blocked,
       coalesce(h.lists, '') AS lists, h.since AS listed_since
FROM cap c LEFT JOIN hit h USING (rid)
"""
