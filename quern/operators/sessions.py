"""Ordered operators over keyed rows: streaks, re-reads, superseded and obsolete rows, stability, cohorts.

All are windows over (session, position), so a session is sorted once and spills if it must. Every
order names a tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import jaccard, trim_all, words
from quern.operators.prefix import prefix_sums
from quern.session import attach, cut, hot_keys


def streaks(rows: DataFrame, session: str, order: list[str], key: str) -> DataFrame:
    """rows with streak: how many rows up to this one have the same key without a break."""
    at = Window.partitionBy(session).orderBy(*order)
    new = (~F.col(key).eqNullSafe(F.lag(key).over(at))) | (F.row_number().over(at) == 1)
    return rows.withColumn("__run", F.sum(new.cast("int")).over(at)).withColumn("streak", F.row_number().over(Window.partitionBy(session, "__run").orderBy(*order)).cast("long")).drop("__run")


def longest_streaks(rows: DataFrame, session: str, order: list[str], key: str) -> DataFrame:
    return streaks(rows, session, order, key).groupBy(session).agg(F.max("streak").alias("longest"))


def rereads(rows: DataFrame, session: str, order: list[str], key: str, within: int = 10) -> DataFrame:
    """rows with turn (place in the session) and reread: the key was seen in the last `within` turns."""
    turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))
    before = F.lag("turn").over(Window.partitionBy(session, key).orderBy("turn"))
    return turned.withColumn("reread", F.coalesce(F.col("turn") - before <= within, F.lit(False)))


def superseded(rows: DataFrame, session: str, order: list[str], key: str) -> DataFrame:
    """rows with superseded: a later row of the session has the same key. The last row of a key is a combined aggregate, so a key of any size is."""
    keyed = rows.withColumn("__key", F.struct(session, key)).withColumn("__at", F.struct(*order))
    last = cut(keyed.groupBy("__key").agg(F.max("__at").alias("__last"), F.count(F.lit(1)).alias("rows")))
    found = attach(keyed, last.select("__key", "__last"), "__key", hot_keys(last, "__key"))
    return found.withColumn("superseded", F.col("__at") != F.col("__last")).select(*rows.columns, "superseded")


def obsolete(rows: DataFrame, session: str, order: list[str], is_read: Column, is_write: Column) -> DataFrame:
    """Reads with write_at: the place in the session of the first later write, null if none comes."""
    at = Window.partitionBy(session).orderBy(*order)
    placed = rows.withColumn("at", F.row_number().over(at).cast("long"))
    # Backwards, so that it is a running minimum.
    back = Window.partitionBy(session).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("write_at", F.min(F.when(is_write, F.col("at"))).over(back)).filter(is_read)


def repeated_calls(rows: DataFrame, session: str, order: list[str], call: str, result: str) -> DataFrame:
    """rows with repeated: the same call came before and its first result was the same."""
    at = Window.partitionBy(session, call).orderBy(*order)
    return rows.withColumn("repeated", (F.row_number().over(at) > 1) & F.first(result).over(at).eqNullSafe(F.col(result)))


def compressible_prefix(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", k: int = 2) -> DataFrame:
    """turns with compressible: it comes before the k-th last user turn; all are if there is no user turn."""
    back = Window.partitionBy(session).orderBy(F.desc(order))
    users = F.count_if(F.col(role) == "user")
    since, total = users.over(back.rowsBetween(Window.unboundedPreceding, -1)), users.over(Window.partitionBy(session))
    return turns.withColumn("compressible", F.when(total == 0, True).otherwise(F.coalesce(since, F.lit(0)) >= k))


def loop_streaks(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", least: float = 0.75) -> DataFrame:
    """Longest run of user turns of which each is about the one before: session, longest."""
    at = Window.partitionBy(session).orderBy(order)
    mine = turns.filter(F.col(role) == "user").select(session, order, F.array_distinct(words(F.lower(text))).alias("w")).withColumn("b", F.lag("w").over(at))
    new = F.coalesce(jaccard(F.col("w"), F.col("b")) < least, F.lit(True)).cast("int")
    runs = mine.withColumn("run", F.sum(new).over(at)).groupBy(session, "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(session).agg(F.max("n").alias("longest"))


def next_after(rows: DataFrame, session: str, time: str, is_error: Column, is_retry: Column, seconds: int, id_col: str) -> DataFrame:
    """Forward as-of join: each error with the first later retry of its session inside a window of seconds."""
    back = Window.partitionBy(session).orderBy(F.desc(time), F.desc(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    found = F.min(F.when(is_retry, F.struct(time, id_col))).over(back)
    out = rows.withColumn("__next", found).filter(is_error)
    near = F.unix_micros(F.col(f"__next.{time}").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")) <= seconds * 1_000_000
    return out.withColumn("retry_id", F.when(near, F.col(f"__next.{id_col}"))).drop("__next")


def rolling_rate(rows: DataFrame, session: str, order: list[str], hit: Column, size: int = 50) -> DataFrame:
    """rows with rate: the share of hits in the last `size` rows, null before there are as many."""
    at = Window.partitionBy(session).orderBy(*order).rowsBetween(-(size - 1), 0)
    return rows.withColumn("rate", F.when(F.count(F.lit(1)).over(at) == size, F.avg(hit.cast("double")).over(at)))


def cohort_rates(rows: DataFrame, unit: str, failed: Column, least: int = 50, margin: float = 0.05) -> DataFrame:
    """Failure rates of two cohorts (first hex digit of sha2 of the unit: 0-7 control) and whether the treatment fails by more than the margin."""
    cohort = F.when(F.substring(F.sha2(F.col(unit).cast("string"), 256), 1, 1) < "8", "control").otherwise("treatment")
    sums = rows.groupBy(cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"))
    rate = sums.withColumn("rate", F.round(F.col("failures") / F.col("n"), 9))
    both = rate.agg(
        F.max(F.when(F.col("cohort") == "control", F.col("rate"))).alias("c"), F.max(F.when(F.col("cohort") == "treatment", F.col("rate"))).alias("t"), F.max(F.when(F.col("cohort") == "treatment", F.col("n"))).alias("tn")
    )
    return rate.crossJoin(F.broadcast(both)).select("cohort", "n", "failures", "rate", F.coalesce((F.col("tn") >= least) & (F.col("t") - F.col("c") > margin), F.lit(False)).alias("rollback"))


def cohort_latch(rows: DataFrame, order: list[str], treated: Column, failed: Column, least: int = 50, margin: float = 0.05) -> DataFrame:
    """One row: counts and failures of both cohorts, and whether the treatment failed by more than the margin at any prefix.

    A prefix counts once the treatment has `least` rows and the control has one. Prefix sums over the
    whole table, in ranges of the order.
    """
    part = lambda test: F.when(test, 1).otherwise(0)
    sums = {"treated": part(treated), "treated_failed": part(treated & failed), "control": part(~treated), "control_failed": part(~treated & failed)}
    running = prefix_sums(rows, [], [F.col(c) for c in order], sums)
    over = (F.col("treated") >= least) & (F.col("control") > 0) & (F.try_divide("treated_failed", "treated") - F.try_divide("control_failed", "control") > margin)
    return running.agg(*[F.max(c).cast("long").alias(c) for c in sums], F.coalesce(F.bool_or(over), F.lit(False)).alias("rolled_back"))


def stale_reads(calls: DataFrame, session: str = "session", at: str = "at", path: str = "path", gap: int = 3) -> DataFrame:
    """Reads with latest (the place of the last read of the path in the session) and stale: it is `gap` or more places later."""
    latest = F.max(at).over(Window.partitionBy(session, path))
    return calls.withColumn("latest", latest).withColumn("stale", F.col("latest") - F.col(at) >= gap)


def mentions(messages: DataFrame, session: str = "session", at: str = "at", text: str = "text") -> DataFrame:
    """session, number (text), last: the last place whose text mentions a message by number, as `message N`, `msg N` or `[N]`.

    The first two are found by substring, so message 1 is also meant by `message 12`: every beginning of a number counts.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    said = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"(?:message|msg) ([0-9]+)"), F.lit(1)), lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda k: F.substring(n, F.lit(1), k))))
    numbers = F.array_distinct(F.concat(said, F.regexp_extract_all(low, F.lit(r"\[([0-9]+)\]"), F.lit(1))))
    return messages.select(session, at, F.explode(numbers).alias("number")).groupBy(session, "number").agg(F.max(at).alias("last"))


def redundant_reads(calls: DataFrame, session: str = "session", at: str = "at", path: str = "path", op: str = "op", text: str = "text") -> DataFrame:
    """Reads of a path that is edited and read again later: session, at, path, edit_at, read_at (the next of each).

    The next read need not follow the edit. A read whose message a later message mentions stays.
    """
    back = Window.partitionBy(session, path).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    is_read, is_edit = F.col(op) == "read", F.col(op).isin("edit", "write")
    next_of = lambda test: F.min(F.when(test, F.col(at))).over(back)
    seen = calls.filter(is_read | is_edit).withColumn("edit_at", next_of(is_edit)).withColumn("read_at", next_of(is_read))
    found = seen.filter(is_read & F.col("edit_at").isNotNull() & F.col("read_at").isNotNull()).select(session, at, path, "edit_at", "read_at")
    told = mentions(calls, session, at, text).withColumnRenamed("number", "__n")
    kept = found.withColumn("__n", F.col(at).cast("string")).join(told, [session, "__n"], "left").filter(F.col("last").isNull() | (F.col("last") <= F.col(at)))
    return kept.select(session, at, path, "edit_at", "read_at")


def paired_results(uses: DataFrame, results: DataFrame, session: str = "session") -> DataFrame:
    """results (result_id, use_id) with the tool of the call that they answer: by result_id, else use_id; of repeated call ids the last counts.

    uses: session, use_id, at, tool.
    """
    last = uses.groupBy(session, F.col("use_id").alias("__id")).agg(F.max_by("tool", "at").alias("tool"))
    return results.withColumn("__id", F.coalesce(F.nullif("result_id", F.lit("")), F.col("use_id"))).join(last, [session, "__id"], "left").drop("__id")


def duplicate_notes(messages: DataFrame, session: str = "session", at: str = "at", text: str = "text") -> DataFrame:
    """messages with first (place of the first equal text of the session) and shown: the text, or a note where it repeats."""
    norm = F.sha2(trim_all(F.coalesce(F.col(text), F.lit(""))), 256)
    keyed = messages.withColumn("__key", F.struct(F.col(session).alias("s"), norm.alias("d")))
    first = cut(keyed.groupBy("__key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("rows")))
    found = attach(keyed, first.select("__key", "first"), "__key", hot_keys(first, "__key"))
    note = F.concat(F.lit("[Duplicate of message "), F.col("first"), F.lit(" - omitted at message "), F.col(at), F.lit("]"))
    return found.withColumn("shown", F.when(F.col(at) > F.col("first"), note).otherwise(F.col(text))).select(*messages.columns, "first", "shown")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and without blanks; other texts as they are."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def identical_notes(calls: DataFrame, session: str = "session", at: str = "at", tool: str = "tool", call: str = "input", result: str = "output") -> DataFrame:
    """calls with shown: a note if the call came before with the same result as its first time, and the note is shorter."""
    key = F.struct(F.col(session).alias("s"), F.col(tool).alias("t"), canonical_json(F.col(call)).alias("i"))
    first = Window.partitionBy("__key").orderBy(at)
    keyed = calls.withColumn("__key", F.sha2(F.to_json(key), 256)).withColumn("__first", F.first(F.struct(at, result)).over(first))
    note = F.concat(F.lit("[Identical to "), F.col(tool), F.lit(" result in message "), F.col(f"__first.{at}"), F.lit("]"))
    again = (F.col(at) > F.col(f"__first.{at}")) & F.col(result).eqNullSafe(F.col(f"__first.{result}")) & (F.octet_length(note) < F.octet_length(F.col(result)))
    return keyed.withColumn("shown", F.when(again, note).otherwise(F.col(result))).drop("__key", "__first")


def unchanged_reads(reads: DataFrame, session: str = "session", at: str = "at", path: str = "path", text: str = "output") -> DataFrame:
    """reads with decision: allow for the first of a path or a changed one, block-unchanged if the content is that of the read before."""
    before = F.lag(F.sha2(text, 256)).over(Window.partitionBy(session, path).orderBy(at))
    return reads.withColumn("decision", F.when(before == F.sha2(text, 256), F.lit("block-unchanged")).otherwise(F.lit("allow")))


def seen_sets(lists: DataFrame, session: str = "session", turn: str = "turn", folder: str = "folder", paths: str = "paths", at: str = "at") -> DataFrame:
    """lists with fingerprint (of their sorted distinct paths, ./ off) and seen: the same set of the folder came before in the turn."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(paths), lambda p: F.regexp_replace(F.btrim(p), r"^(?:\./)+", "")), lambda p: p != "")))
    marked = lists.withColumn("fingerprint", F.sha2(F.array_join(clean, "\0"), 256))
    return marked.withColumn("seen", F.row_number().over(Window.partitionBy(session, turn, folder, "fingerprint").orderBy(at)) > 1)


def idle_tools(uses: DataFrame, session: str = "session", turn: str = "turn", tool: str = "tool", threshold: int = 5, floor: int = 0) -> DataFrame:
    """By session and tool: last turn used and idle (more than `threshold` turns ago); the `floor` most recently used stay active."""
    last = uses.groupBy(session, tool).agg(F.max(turn).alias("last"))
    of = Window.partitionBy(session)
    ranked = last.withColumn("now", F.max("last").over(of)).withColumn("__rank", F.row_number().over(of.orderBy(F.desc("last"), tool)))
    return ranked.withColumn("idle", (F.col("now") - F.col("last") > threshold) & (F.col("__rank") > floor)).drop("__rank", "now")


def recent_percentiles(samples: DataFrame, key: str, order: str, value: str, last: int = 200) -> DataFrame:
    """By key: the interpolated median and 95th percentile of the last samples, and count, mean and largest of all; only positive samples."""
    rows = samples.filter(F.col(value) > 0)
    recent = rows.withColumn("__back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__back") <= last)
    near = recent.groupBy(key).agg(F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.95)").alias("p95"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest")).join(near, key)


def turn_rereads(reads: DataFrame, session: str, at: str, turn: str, key: str, within: int = 10) -> DataFrame:
    """reads with turn_no (it moves on when the turn's id changes or is blank) and reread: the key came in the last `within` turns."""
    of = Window.partitionBy(session).orderBy(at)
    new = F.coalesce((F.col(turn) != F.lag(turn).over(of)) | (F.col(turn) == ""), F.lit(True)).cast("int")
    numbered = reads.withColumn("__new", new).withColumn("turn_no", F.sum("__new").over(of)).drop("__new")
    before = F.lag("turn_no").over(Window.partitionBy(session, key).orderBy(at))
    return numbered.withColumn("reread", F.coalesce(F.col("turn_no") - before <= within, F.lit(False)))
