"""URL filters over time: dated list entries become validity intervals, joined as of each capture's fetch.

An entry names a host, a domain (the host and all below it) or a path prefix of a host, and a
category; one value may be listed under several categories, each with its own spells. A capture's
host is that of its URL without user name, password, port and closing dots, in lower case. What an
entry says of a capture follows from (URL, fetch time) alone, so each such pair is asked once: it is
joined by equality on the few keys its URL can match, never by comparing all entries. Keys that very
many captures have are salted, with their entries copied to each salt; others aren't.

Defined results for odd rows: a null URL, or one without a host, matches nothing and is kept; a
null fetch time matches nothing; of equal-dated events of one entry the removal counts as last;
repeated events change nothing; a null category is one of its own; captures with one id and
different URLs or times are judged each by its own, null ids too; equal captures get equal results;
columns n_active, entry, category and kept of the captures are replaced, other extra columns pass
through; an empty list keeps all and no captures give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of a hot key's intervals, over which its captures are dealt, and the share of all captures that makes a key hot.
SALTS, HOT = 16, 1000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"


def host_of(url: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.+$", ""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(events: DataFrame) -> DataFrame:
    """Turn (kind, value, category, action, listed_at) into (key, category, valid_from, valid_to).

    An addition holds until the next removal of its value under its category; the end is exclusive
    and null while it holds.
    """
    w = Window.partitionBy("kind", "value", "category").orderBy("listed_at", F.when(F.col("action") == "add", 0).otherwise(1))
    removed = F.min(F.when(F.col("action") == "remove", F.col("listed_at"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.lag("action").over(w)
    listed = events.where(F.col("value").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("add", "remove"))
    return (
        listed.withColumn("value", F.lower(F.regexp_replace("value", r"\.+$", "")))
        .withColumns({"valid_to": removed, "__tl_before": before})
        .where((F.col("action") == "add") & (F.coalesce(F.col("__tl_before"), F.lit("remove")) == "remove"))
        .select(F.concat_ws(":", "kind", "value").alias("key"), "category", F.col("listed_at").alias("valid_from"), "valid_to")
        .where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    )


def depth(events: DataFrame) -> int:
    """Path segments of the longest prefix entry."""
    return events.where("kind = 'prefix'").agg(F.max(F.size(segments(F.col("value"))) - 1)).first()[0] or 0


def keys(url: str, deep: int) -> Column:
    """All entry keys that the URL can match, with prefixes of so many segments at most, the most specific first."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    path = F.slice(segments(F.regexp_extract(url, PATH, 1)), 1, max(deep, 1))
    none = F.array().cast("array<string>")
    each = F.transform(F.sequence(F.size(path), F.lit(1), F.lit(-1)), lambda k: F.concat(F.lit("prefix:"), host, F.lit("/"), F.lower(F.array_join(F.slice(path, F.lit(1), k), "/"))))
    prefixes = F.when(F.size(path) > 0, each).otherwise(none) if deep else none
    above = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, k, n), ".")))
    domains = F.when(n > 1, above).otherwise(none)
    return F.when(host != "", F.concat(prefixes, F.array(F.concat(F.lit("host:"), host)), domains)).otherwise(none)


def as_of(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """One row per (url, at) with any active entry: n_active and the most specific entry with its category."""
    listed = intervals(events)
    pairs = captures.select(F.col(url).alias("url"), F.col(at).alias("at")).where(F.col("url").isNotNull() & F.col("at").isNotNull()).distinct()
    asked = pairs.select("url", "at", F.posexplode(keys("url", depth(events))).alias("rank", "key"))
    # A capture has a handful of keys, so hot ones are some thousands at most and may be broadcast.
    cut = max(HOT, captures.count() // HOT)
    hot = F.broadcast(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cut).select("key", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("url", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = asked.join(hot, "key", "left").select("url", "at", "rank", "key", salt.alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = listed.join(hot, "key", "left").select("key", "category", "valid_from", "valid_to", F.explode(salts).alias("salt"))
    hit = dealt.join(copied, ["key", "salt"]).where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    first = F.min(F.struct("rank", "category", "key"))
    return hit.groupBy("url", "at").agg(F.countDistinct(F.struct("key", "category")).alias("n_active"), first.alias("first")).select(
        "url", "at", "n_active", F.col("first.key").alias("entry"), F.col("first.category").alias("category")
    )


def filtered(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The captures with n_active (active entries), the most specific entry, its category, and kept.

    Captures that match nothing for a null are dealt by id_col in the join; it needn't tell rows apart.
    """
    found = as_of(captures, events, url, at)
    found = found.select(F.xxhash64("url", "at").alias("__tl_found"), F.col("url").alias("__tl_url"), F.col("at").alias("__tl_at"), "n_active", "entry", "category")
    whole = F.col(url).isNotNull() & F.col(at).isNotNull()
    out = captures.drop("n_active", "entry", "category", "kept").withColumn("__tl_key", F.when(whole, F.xxhash64(url, at)).otherwise(F.xxhash64(id_col)))
    same = (F.col("__tl_key") == F.col("__tl_found")) & (F.col(url) == F.col("__tl_url")) & (F.col(at) == F.col("__tl_at"))
    out = out.join(found, same, "left").drop("__tl_key", "__tl_found", "__tl_url", "__tl_at")
    return out.withColumns({"n_active": F.coalesce("n_active", F.lit(0).cast("long")), "kept": F.col("entry").isNull()})


def _number(text: Column) -> Column:
    """A number of 28 bits from a text, alike in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def sample_events(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts, domains and sections.

    About a quarter of the hosts and a tenth of the domains and sections are listed for a spell;
    a third of those come back later for good.
    """
    host, path = host_of("url"), segments(F.regexp_extract("url", PATH, 1))
    names = pages.select(
        F.explode(
            F.array(
                F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(4).alias("one_of")),
                F.struct(F.lit("domain").alias("kind"), F.substring_index(host, ".", -3).alias("value"), F.lit(10).alias("one_of")),
                F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.get(path, 0)).alias("value"), F.lit(10).alias("one_of")),
            )
        ).alias("e")
    ).select("e.*").where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    n = _number(F.concat_ws(":", "kind", "value"))
    listed = names.withColumn("__tl_n", n).where(F.pmod("__tl_n", F.col("one_of")) == 0)
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int"))
    start = F.pmod(F.col("__tl_n"), F.lit(200))
    spell = 20 + F.pmod(F.col("__tl_n"), F.lit(97))
    event = lambda action, at: F.struct(F.lit(action).alias("action"), day(at).alias("listed_at"))
    events = F.when(F.pmod("__tl_n", F.lit(3)) == 0, F.array(event("add", start), event("remove", start + spell), event("add", start + 2 * spell))).otherwise(
        F.array(event("add", start), event("remove", start + spell))
    )
    return listed.select("kind", "value", F.concat(F.lit("list-"), F.pmod("__tl_n", F.lit(5)).cast("string")).alias("category"), F.explode(events).alias("e")).select(
        "kind", "value", "category", "e.*"
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages have no fetch time of their own: one day of 2024 follows from each page's id."""
    from tallyline.session import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    return filtered(captures, sample_events(pages)).select("page_id", "n_active", "entry", "category", "kept")


_HOST = HOST.replace("'", "''")
ORACLE = rf"""
WITH p AS (SELECT page_id, url, date '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
  lower(regexp_replace(regexp_extract(url, '{_HOST}', 1), '\.+$', '')) AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS path FROM pages),
names AS (
  SELECT DISTINCT 'host' AS kind, host AS value, 4 AS one_of FROM p
  UNION ALL SELECT DISTINCT 'domain', array_to_string(string_split(host, '.')[-3:], '.'), 10 FROM p
  UNION ALL SELECT DISTINCT 'prefix', host || '/' || path[1], 10 FROM p WHERE len(path) > 0),
listed AS (SELECT * FROM (SELECT *, CAST('0x' || substr(md5(kind || ':' || value), 1, 7) AS BIGINT) AS n FROM names WHERE value <> '') WHERE n % one_of = 0),
spells AS (
  SELECT kind || ':' || value AS key, 'list-' || (n % 5) AS category, n % 200 AS f, n % 200 + 20 + n % 97 AS t FROM listed
  UNION ALL SELECT kind || ':' || value, 'list-' || (n % 5), n % 200 + 2 * (20 + n % 97), NULL FROM listed WHERE n % 3 = 0),
asked AS (
  SELECT page_id, fetched, 'prefix:' || host || '/' || lower(array_to_string(path[1:k], '/')) AS key, 2 - k AS rank FROM (SELECT *, unnest(range(1, least(len(path), 2) + 1)) AS k FROM p)
  UNION ALL SELECT page_id, fetched, 'host:' || host, 10 FROM p WHERE host <> ''
  UNION ALL SELECT page_id, fetched, 'domain:' || array_to_string(l[k:], '.'), 10 + k FROM (SELECT page_id, fetched, l, unnest(range(1, len(l))) AS k FROM (SELECT *, string_split(host, '.') AS l FROM p))),
hit AS (SELECT page_id, count(DISTINCT key) AS n_active, arg_min(key, rank) AS entry, arg_min(category, rank) AS category FROM asked JOIN spells USING (key)
  WHERE fetched >= date '2024-01-01' + CAST(f AS INTEGER) AND (t IS NULL OR fetched < date '2024-01-01' + CAST(t AS INTEGER)) GROUP BY page_id)
SELECT p.page_id, coalesce(n_active, 0) AS n_active, entry, category, entry IS NULL AS kept FROM p LEFT JOIN hit USING (page_id)
"""
