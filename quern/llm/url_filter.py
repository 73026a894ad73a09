"""URL filters as a temporal list join.

A list is dated entries: (list, kind, key, date, action), kind being domain (the host or any host
below it), host (that host alone) or prefix (host and leading path segments), action add or remove.
Entries of one key become validity intervals [from, to) by a window over their dates. A capture
belongs to a list if, for one of the keys that its URL stands for, the as-of interval at its fetch
time is an added one.

Every URL stands for a few keys (its host's suffixes and its path's prefixes up to the deepest
listed), so the join is an equality on the key plus the interval. The interval side is broadcast when
its measured bytes allow it; beyond that, intervals are repeated under SALTS salts and captures pick one, so a
host with a third of all captures is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import BROADCAST_BYTES

SALTS = 16
FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and trailing dot; null if the URL has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    host = F.lower(F.regexp_replace(bare, r"\.+$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, no leading slash."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, valid_from, valid_to, added: what each entry means until the next one of its key.

    Several entries of one key at one time: a removal wins. Entries with a null in key or date are void.
    """
    of_key = Window.partitionBy("list", "kind", "key")
    clean = entries.filter("key is not null and date is not null and list is not null and kind is not null").groupBy("list", "kind", F.lower("key").alias("key"), F.col("date").cast("timestamp").alias("date"))
    states = clean.agg((F.max(F.when(F.col("action") == "remove", 1).otherwise(0)) == 0).alias("added"))
    to = F.coalesce(F.lead("date").over(of_key.orderBy("date")), F.lit(FOREVER).cast("timestamp"))
    return states.select("list", "kind", "key", F.col("date").alias("valid_from"), to.alias("valid_to"), "added")


def _keys(host: Column, path: Column, depth: int) -> Column:
    """array<struct<kind, key>> of what a URL stands for; path prefixes up to `depth` segments."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    found = F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"))), domains)
    if depth:
        parts = F.slice(F.filter(F.split(F.lower(path), "/"), lambda p: p != ""), 1, depth)
        prefixes = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(depth)), lambda i: (i > 0) & (i <= F.size(parts))),
            lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key")),
        )
        found = F.concat(found, prefixes)
    return found


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetch_time", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per capture: id_col, url_col, time_col, host, lists, matched, blocked.

    lists are the names of the lists that hold the capture at its fetch time, sorted and distinct;
    matched are the entries (kind:key, sorted) that say so. A URL without a host or a null fetch time
    is on no list. Repeated captures are judged alike, one row each; an entry's date itself is
    inside its interval. Of a URL of any length the host and the first folder count. No captures, no rows;
    no entries, nothing is blocked. Other columns aren't read.
    """
    spans = intervals(entries).filter("added").select("list", "kind", "key", "valid_from", "valid_to")
    # Driver-side facts about the list, two numbers: how many bytes its intervals have, how deep its prefixes are.
    width = F.octet_length("list") + F.octet_length("kind") + F.octet_length("key") + 64
    facts = spans.agg(F.sum(width).alias("bytes"), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("key", "/")) - 1)).alias("depth")).first()
    host = host_of(F.col(url_col))
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("at"), host.alias("host"))
    keys = F.when(F.col("host").isNotNull(), F.array_distinct(_keys(F.col("host"), path_of(F.col("url")), facts["depth"] or 0)))
    probes = rows.select("*", F.explode_outer(keys).alias("k")).select("row", "id", "url", "at", "host", "k.kind", "k.key")
    on = ["kind", "key"]
    if (facts["bytes"] or 0) <= broadcast_bytes:
        side = F.broadcast(spans)
    else:
        side, on = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["kind", "key", "salt"]
        probes = probes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    active = [probes[c] == side[c] for c in on] + [probes["at"] >= side["valid_from"], probes["at"] < side["valid_to"]]
    hits = probes.join(side, active, "left").select("row", "id", "url", "at", "host", "list", F.when(F.col("list").isNotNull(), F.concat_ws(":", probes["kind"], probes["key"])).alias("entry"))
    # A row's keys and the lists of a key are few, so both sets are small.
    return hits.groupBy(F.col("row"), F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), "host").agg(
        F.sort_array(F.collect_set("list")).alias("lists"), F.sort_array(F.collect_set("entry")).alias("matched")
    ).select(id_col, url_col, time_col, "host", "lists", "matched", (F.size("lists") > 0).alias("blocked"))
