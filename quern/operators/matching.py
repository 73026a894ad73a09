"""Sessions matched to threads: by a digest of the first text, else by time, model and client family.

A session is matched only if exactly one thread fits, so what the join needs of the threads is a count and
a smallest id. Time is cut into dyadic bins (level, second >> level): an interval is the disjoint union of
at most two bins a level, and a second lies in one bin of each level, so an interval and a second inside
it share exactly one bin. Threads are summed up by bin, model and family before they meet a session; a bin
with any number of threads is one row, and no pair is made twice. Joins are plain equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import attach, cut, hot_keys

#: Seconds around a session in which its thread was last updated, and around the activity that a thread encloses.
OVERLAP, ENCLOSE = 30 * 60, 5 * 60
ANONYMOUS, HASHED = "no-session:", "fh:"
NONE, MANY = "no_matching_thread_candidate", "ambiguous_thread_candidates"


def first_text_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the first 200 bytes, null for empty texts."""
    return F.when(F.length(text) > 0, F.left(F.sha2(F.substring(text.cast("binary"), 1, 200), 256), F.lit(16)))


def bins_of_interval(low: Column, high: Column, levels: int) -> Column:
    """The bins whose disjoint union is the whole numbers from low to high, none if low > high."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
        first, end = F.ceil(low / size), F.floor((high + 1) / size)
        left = F.when((first < end) & (F.pmod(first, F.lit(2)) == 1), F.struct(level.cast("int").alias("level"), first.cast("long").alias("bin")))
        right = F.when((first < end) & (F.pmod(end, F.lit(2)) == 1), F.struct(level.cast("int").alias("level"), (end - 1).cast("long").alias("bin")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda b: b.isNotNull())


def bins_of_second(second: Column, levels: int) -> Column:
    """The bins that hold a whole number, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.cast("int").alias("level"), F.floor(second / F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))).cast("long").alias("bin")))


def _levels(intervals: DataFrame) -> int:
    """Enough levels for the longest interval."""
    longest = intervals.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    return max(1, int(longest or 0) + 1).bit_length() + 1


def _key() -> Column:
    return F.struct("at", "bin").alias("key")


def _name(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _kept(model: Column, family: Column) -> Column:
    """Under which names a thread is summed up: its own and all, for model and family."""
    both = lambda c: F.array(F.concat(F.lit("="), c), F.lit("*"))
    return F.flatten(F.transform(both(model), lambda m: F.transform(both(family), lambda f: F.struct(m.alias("model"), f.alias("family")))))


def _wanted(model: Column, family: Column, any_family: list[str]) -> Column:
    """Where a session looks: its model and threads without one, or all; its family, or all."""
    models = F.when(model == "", F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), model), F.lit("=")))
    which = F.when(family.isin("", *any_family), F.lit("*")).otherwise(F.concat(F.lit("="), family))
    return F.transform(models, lambda m: F.struct(m.alias("model"), which.alias("family")))


def _lookup(sessions: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """session, n and thread from the sums (key, n, thread) of the keys that sessions look up; hot keys are broadcast."""
    counts = cut(sessions.groupBy(key).agg(F.count(F.lit(1)).alias("rows")))
    return attach(sessions, sums, key, hot_keys(counts, key)).select("session", "n", "thread")


def _sums(threads: DataFrame, key: str) -> DataFrame:
    return threads.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("thread").alias("thread"))


def _in_time(sessions: DataFrame, threads: DataFrame, overlap: int) -> DataFrame:
    """Threads last updated from `overlap` seconds before a session to as many after it; where a time is missing, any."""
    known = sessions.filter("first is not null and last is not null")
    ranges = known.select("session", "at", F.ceil(F.col("first") - overlap).alias("low"), F.floor(F.col("last") + overlap).alias("high"))
    levels = _levels(ranges)
    asked = ranges.select("session", "low", "high", F.explode("at").alias("at")).withColumn("bin", F.explode(bins_of_interval(F.col("low"), F.col("high"), levels)))
    # Threads of one second are summed up before they go into the bins of all levels.
    timed = threads.filter("updated is not null").select("thread", "updated", F.explode("at").alias("at")).groupBy("at", "updated").agg(F.count(F.lit(1)).alias("n"), F.min("thread").alias("thread"))
    binned = timed.withColumn("bin", F.explode(bins_of_second(F.col("updated"), levels))).select(_key(), "n", "thread")
    found = _lookup(asked.select("session", _key()), binned.groupBy("key").agg(F.sum("n").alias("n"), F.min("thread").alias("thread")), "key")
    each = lambda rows: rows.select("session", F.explode("at").alias("key"))
    named = threads.select("thread", "updated", F.explode("at").alias("key"))
    untimed = _lookup(each(known), _sums(named.filter("updated is null"), "key"), "key")
    free = _lookup(each(sessions.filter("first is null or last is null")), _sums(named, "key"), "key")
    return found.unionByName(untimed).unionByName(free)


def _enclosing(sessions: DataFrame, threads: DataFrame, margin: int) -> DataFrame:
    """Threads created by `margin` seconds after a session's first request and updated from as many before its last one.

    Threads are intervals, a session the second `first + margin` inside them. Of each bin only the two
    threads that were updated last matter: if one of them fits, it counts, and no answer needs a third.
    """
    asked = sessions.filter("first is not null and last is not null and first <= last").select("session", "at", F.floor(F.col("first") + margin).alias("second"), F.ceil(F.col("last") - margin).alias("until"))
    # until <= updated and second - until is at most twice the margin, so the second lies in the interval.
    spans = threads.filter("created is not null and updated is not null").select("thread", "at", "updated", F.col("created").alias("low"), (F.col("updated") + 2 * margin + 1).alias("high"))
    levels = _levels(spans)
    binned = spans.select("thread", "updated", F.explode("at").alias("at"), "low", "high").withColumn("bin", F.explode(bins_of_interval(F.col("low"), F.col("high"), levels)))
    binned = cut(binned.select(_key(), F.struct("updated", "thread").alias("row")))
    top = cut(binned.groupBy("key").agg(F.max("row").alias("top"), F.count(F.lit(1)).alias("rows")))
    second = attach(binned, top.filter("rows > 1").select("key", "top"), "key", hot_keys(top.select("key", "rows"), "key")).filter("row < top").groupBy("key").agg(F.max("row").alias("row"))
    both = top.select("key", F.col("top").alias("row")).unionByName(second)
    best = both.groupBy("key").agg(F.collect_list("row").alias("rows"))  # two at most
    each = asked.select("session", "until", "second", F.explode("at").alias("at"))
    points = each.withColumn("bin", F.explode(bins_of_second(F.col("second"), levels))).select("session", "until", _key())
    counts = cut(points.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    met = attach(points, best, "key", hot_keys(counts, "key")).select("session", "until", F.explode("rows").alias("row")).filter("row.updated >= until")
    return met.select("session", F.lit(1).cast("long").alias("n"), F.col("row.thread").alias("thread"))


def match_threads(sessions: DataFrame, threads: DataFrame, overlap: int = OVERLAP, enclose: int = ENCLOSE, any_family: tuple[str, ...] = ("codex",)) -> DataFrame:
    """session, thread, how (hash, time) and reason, a row per session.

    sessions: session, first, last (Unix seconds as double, may be null), model, family. threads: thread,
    first_text, created, updated (whole Unix seconds, may be null), model, family. A session `fh:<digest>`
    takes the only thread whose first text has that digest. Else one thread must fit: its model is the
    session's where both have one, its family is the session's unless that is empty or in `any_family`,
    and its times fit: a session `no-session:...` lies within the thread's life (`enclose` seconds of
    tolerance, times that are missing don't fit), any other one is within `overlap` seconds of the thread's
    last update (times that are missing fit). No thread or several give the reason. Sessions and threads
    are unique by id; empty tables give no rows, or no matches.
    """
    named = lambda rows, keys: rows.withColumn("at", keys(_name(F.col("model")), _name(F.col("family"))))
    who = named(sessions.select("session", "first", "last", "model", "family"), lambda m, f: _wanted(m, f, list(any_family)))
    own = cut(who.withColumn("anonymous", F.trim("session").startswith(ANONYMOUS)))
    all_threads = cut(named(threads.select("thread", "created", "updated", "model", "family", first_text_hash(F.col("first_text")).alias("hash")), _kept))
    digests = all_threads.filter("hash is not null").groupBy("hash").agg(F.min("thread").alias("by_hash"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    wanted = F.regexp_replace(F.trim("session"), f"^{HASHED}", "")
    hashed = own.select("session", wanted.alias("hash")).join(digests, "hash").select("session", "by_hash")
    rest = own.join(hashed, "session", "left_anti")
    candidates = _in_time(rest.filter("not anonymous"), all_threads, overlap).unionByName(_enclosing(rest.filter("anonymous"), all_threads, enclose))
    found = candidates.groupBy("session").agg(F.sum("n").alias("n"), F.min("thread").alias("by_time"))
    out = own.select("session").join(hashed, "session", "left").join(found, "session", "left")
    one = F.col("by_hash").isNull() & (F.col("n") == 1)
    return out.select(
        "session",
        F.coalesce("by_hash", F.when(one, F.col("by_time"))).alias("thread"),
        F.when(F.col("by_hash").isNotNull(), "hash").when(one, "time").alias("how"),
        F.when(F.col("by_hash").isNotNull() | one, "").when(F.col("n") > 1, MANY).otherwise(NONE).alias("reason"),
    )
