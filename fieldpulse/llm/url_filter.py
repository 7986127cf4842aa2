"""URL filters: a temporal list join (DataFrame functions only).

A list log holds dated entries: on ``listed_at`` a key is added to or removed
from a list.  Per (list, kind, key) the entries become validity intervals, from
an addition to the next removal.  An as-of join evaluates every capture against
the entries that were active at its fetch time.

Keys: ``host`` (the host itself), ``domain`` (the host and all hosts under it)
and ``prefix`` (host and leading path segments).  A capture is allowed if an
``allow`` entry is the most specific active one, blocked if a ``block`` entry
is; specificity is prefix (longer first), host, domain (longer first); at equal
specificity ``block`` wins.

The join key carries a salt: captures of one host are dealt over ``SALTS``
parts and the list's intervals are copied to each, so a host that holds a third
of all captures is no hot key.  Neither side is broadcast by hand.

Defined results: a null URL or one without a host has a null host and the
verdict ``no_host``; a null fetch time is ``undated``; a host without active
entries is ``unlisted``; an entry counts from its date on, a removal ends it at
its date; entries with a null in list, kind, key, action or date are left out;
of entries of one key at one date the removal comes last; every row is a capture
of its own, judged by its own URL at its own time, rows that repeat an id and
null ids included; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, null without one."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.lower(found))


def path_of(url: Column) -> Column:
    """The path of an absolute URL, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(log: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_to): when each entry was active; valid_to is null while it still is."""
    entries = (log.select("list", "kind", F.lower("key").alias("key"), "action", "listed_at")
               .dropna().filter(F.col("action").isin("add", "remove")).distinct())
    order = Window.partitionBy("list", "kind", "key").orderBy("listed_at", F.col("action") == "remove")
    changes = (entries.withColumn("before", F.coalesce(F.lag("action").over(order), F.lit("remove")))
               .filter(F.col("before") != F.col("action")))
    return (changes.withColumn("valid_to", F.lead("listed_at").over(order)).filter("action = 'add'")
            .select("list", "kind", "key", F.col("listed_at").alias("valid_from"), "valid_to")
            .filter("valid_to is null or valid_to > valid_from"))


def prefix_depth(log: DataFrame) -> int:
    """How many path segments the longest prefix entry has (0 without one)."""
    segments = F.size(F.split("key", "/")) - 1
    return log.filter("kind = 'prefix' and key is not null").agg(F.max(segments)).first()[0] or 0


def _keys(host: Column, path: Column, depth: int) -> Column:
    """An array of (kind, key, rank) that a capture can be listed under; a higher rank is more specific."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - i + 1, i), ".").alias("key"),
        i.cast("int").alias("rank")))
    parts = F.slice(F.array_remove(F.split(path, "/"), ""), 1, depth)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        F.when(i == 0, "host").otherwise("prefix").alias("kind"),
        F.when(i == 0, host).otherwise(F.lower(F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")))).alias("key"),
        (i + 1000).cast("int").alias("rank")))
    return F.concat(domains, prefixes)


def evaluate(captures: DataFrame, log: DataFrame, capture_id: str = "page_id", url: str = "url",
             fetched_at: str = "fetched_at") -> DataFrame:
    """(capture id, host, fetched_at, verdict, listed_by, active_since, n_active) of every capture."""
    rows = (captures.select(F.col(capture_id).alias("id"), F.col(url).cast("string").alias("url"),
                            F.col(fetched_at).alias("at"))
            .withColumn("host", host_of(F.col("url"))))
    distinct = (rows.filter("host is not null and at is not null").select("id", "url", "at").distinct()
                .select("id", "url", "at", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    salt = F.pmod(F.xxhash64("id", "url", "at"), F.lit(SALTS).cast("long"))
    keyed = (distinct.select("id", "url", "at", F.explode(_keys(F.col("host"), F.col("path"), prefix_depth(log))).alias("k"))
             .select("id", "url", "at", "k.kind", "k.key", "k.rank", salt.alias("salt")))
    valid = intervals(log).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    active = (keyed.join(valid, ["kind", "key", "salt"])
              .filter("valid_from <= at and (valid_to is null or at < valid_to)"))
    # the most specific entry; a block entry before an allow entry
    best = F.max(F.struct("rank", (F.col("list") == "block").alias("blocks"), "kind", "key", "valid_from"))
    verdicts = (active.groupBy(F.col("id").alias("vid"), F.col("url").alias("vurl"), F.col("at").alias("vat"))
                .agg(best.alias("best"), F.count("*").alias("n_active")))
    return (rows.join(verdicts, F.expr("id <=> vid and url <=> vurl and at <=> vat"), "left")
            .select(F.col("id").alias(capture_id), "host", F.col("at").alias(fetched_at),
                    F.when(F.col("host").isNull(), "no_host").when(F.col("at").isNull(), "undated")
                    .when(F.col("best").isNull(), "unlisted").when(F.col("best.blocks"), "blocked")
                    .otherwise("allowed").alias("verdict"),
                    F.concat_ws(":", "best.kind", "best.key").alias("listed_by"),
                    F.col("best.valid_from").alias("active_since"),
                    F.coalesce("n_active", F.lit(0)).alias("n_active")))
