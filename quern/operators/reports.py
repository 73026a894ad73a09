"""Reports over request, run and event rows: each a combined aggregation, few rows out.

Columns are named as in the callers' tables; amounts are tokens unless said otherwise.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import attach, cut, hot_keys

from quern.operators.prefix import prefix_sums

# Parser families in their order and the parts of a command that name them.
FAMILIES: list[tuple[str, list[str]]] = [
    ("svelte", ["svelte"]),
    ("typescript", ["typescript", "tsc", "tsx", "tsserver", "vue-tsc"]),
    ("javascript", ["javascript", "node", "bun", "npm", "pnpm", "yarn", "vite", "next", "react", "jest", "vitest", "playwright", "eslint", "biome", "oxlint", "turbo", "nx", "lerna"]),
    ("zig", ["zig"]),
    ("sql", ["sql", "psql", "sqlite", "mysql", "mariadb", "migration", "prisma", "drizzle", "sqlfluff", "sqruff"]),
    ("markdown", ["markdown", "mdformat"]),
    ("rust", ["cargo", "rust", "clippy", "rustfmt"]),
    ("go", ["go ", "go-", "gopls"]),
    ("python", ["python", "pytest", "unittest", "mypy", "ruff", "pylint", "flake8", "pyright", "basedpyright", "uv ", "[uv]", "poetry"]),
    ("jvm_mobile_php", ["javac", "java ", "kotlinc", "kotlin", "gradle", "mvn ", "mvnw", "maven", "sbt", "scalac", "swift", "xcodebuild", "dart", "flutter", "php", "phpunit", "phpstan", "psalm", "composer"]),
    ("c_cpp_build", ["gcc", "g++", "clang", "clang++", "cmake", "ninja", "make"]),
    ("container", ["docker", "podman", "nerdctl", "kubectl", "kube", "oc ", "[oc]", "helm", "hadolint"]),
    ("hcl", ["terraform", "tofu", "hcl"]),
    ("git", ["git"]),
    ("ruby", ["ruby"]),
    ("shell", ["shell", "bash", "zsh", "shfmt"]),
]
#: The share of net cache reads that counts as saved.
READ_DISCOUNT = 0.9
#: Tokens a second that an upstream reads.
PREFILL_SPEED = 3000


def any_of(text: Column, parts: list[str]) -> Column:
    """The text holds one of the parts."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def parser_family(command: Column) -> Column:
    c, out = F.lower(command), F
    for name, parts in FAMILIES:
        out = out.when(any_of(c, parts), F.lit(name))
    return out.otherwise(F.lit("other"))


def total(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def usd(saved: Column, per_million: float) -> Column:
    """Estimated price of saved tokens; 0 without a rate."""
    return saved / 1e6 * per_million if per_million > 0 else F.lit(0.0)


def in_project(path: Column, root: str) -> Column:
    """No root, or the path (either slash) is the root or below it."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lit(True) if not root else (path == root) | F.startswith(unix, F.lit(root.rstrip("/") + "/"))


def provider_flight(provider: Column, source: Column) -> Column:
    return ~provider.isin("", "local", "unknown") & source.isin("", "proxy", "transparent_connect")


_RUN_SUMS = lambda: [F.count(F.lit(1)).alias("runs"), total("original").alias("input"), total("final").alias("output"), total(F.col("original") - F.col("final")).alias("saved")]


def runs_total(runs: DataFrame) -> DataFrame:
    return runs.agg(*_RUN_SUMS())


def runs_by_command(runs: DataFrame, per_million: float = 0.0) -> DataFrame:
    """command, runs, input, output, saved, usd; the most saved first, then by name."""
    return runs.groupBy("command").agg(*_RUN_SUMS()).withColumn("usd", usd(F.col("saved"), per_million)).orderBy(F.desc("saved"), "command")


def runs_by_parser(runs: DataFrame, per_million: float = 0.0) -> DataFrame:
    """The same by the family of the command's parser: commands are combined first, then families."""
    commands = runs.groupBy("command").agg(*_RUN_SUMS()).withColumn("parser", parser_family(F.col("command")))
    return commands.groupBy("parser").agg(*[F.sum(c).alias(c) for c in ("runs", "input", "output", "saved")]).withColumn("usd", usd(F.col("saved"), per_million)).orderBy(F.desc("saved"), "parser")


def observed_commands(rows: DataFrame, limit: int = 20) -> DataFrame:
    """command, outcome, runs, input, output of the `limit` groups with most input (at least 20 if limit is below 1)."""
    sums = rows.groupBy("command", "outcome").agg(F.count(F.lit(1)).alias("runs"), total("original").alias("input"), total("final").alias("output"))
    return sums.orderBy(F.desc("input"), F.desc("runs"), "command", "outcome").limit(limit if limit >= 1 else 20)


def event_fold(events: DataFrame) -> DataFrame:
    """One row of counters over all events. A layer's savings may be negative, the saved total counts gains only; both kinds of cache hits count."""
    request = F.col("kind") == "request"
    saved = F.col("original") - F.col("final")
    when = lambda test, value: total(F.when(test, value))
    return events.agg(
        F.count_if(request).alias("requests"),
        when(request, F.col("original")).alias("input"),
        when(request, F.col("output")).alias("output"),
        when(request & (saved > 0), saved).alias("saved"),
        when(request & (F.col("layer") == 1), saved).alias("layer1_saved"),
        when(request & F.col("layer").isin(2, 3), saved).alias("layer2_saved"),
        F.count_if((request & F.col("hit")) | (F.col("kind") == "cache_hit")).alias("cache_hits"),
        F.count_if(request & ~F.col("hit")).alias("cache_misses"),
        F.count_if(request & (F.col("cache_read") > 0)).alias("read_requests"),
        when(request, F.col("cache_read")).alias("cache_read"),
        when(request, F.col("cache_create")).alias("cache_create"),
        when(F.col("kind") == "secret", F.col("secrets")).alias("secrets"),
        F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_if(F.col("kind").isin("rate_limit_retry", "overflow_retry")).alias("retries"),
        F.count_if(F.col("kind") == "rate_limit_retry").alias("rate_limit_retries"),
        F.count_if(F.col("kind") == "overflow_retry").alias("overflow_retries"),
    )


def snapshot(fold: DataFrame, tokens_per_request: int = 1000, prefill_speed: int = PREFILL_SPEED) -> DataFrame:
    """The fold with its ratios; nothing is divided by zero."""
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return fold.withColumns(
        {
            "ratio": share(F.col("saved"), F.col("input")),
            "extra_messages": F.expr(f"saved div {max(tokens_per_request, 1)}"),
            "ttft_seconds": share(F.col("saved"), F.col("requests")) / prefill_speed if prefill_speed > 0 else F.lit(0.0),
            "read_rate": share(F.col("read_requests"), F.col("requests")),
        }
    )


def provider_stats(events: DataFrame) -> DataFrame:
    """provider, messages, input, saved, ratio, latency of the request events.

    latency is a running mean that moves by 1/n at the provider's n-th request if its latency is
    positive. Unrolled, each such request weighs 1/n times the product of the later (1 - 1/m), which
    running sums of logarithms give for providers of any size.
    """
    rows = events.filter("kind = 'request'").select("provider", "id", "original", "final", "latency")
    n = prefix_sums(rows, ["provider"], [F.col("id")], {"n": F.lit(1)}).drop("n_all")
    moving = n.withColumn("fall", F.when((F.col("latency") > 0) & (F.col("n") > 1), F.log(1 - 1 / F.col("n"))).otherwise(0.0))
    fallen = prefix_sums(moving, ["provider"], [F.col("id")], {"fallen": F.col("fall")})
    part = F.when(F.col("latency") > 0, F.col("latency") / F.col("n") * F.exp(F.col("fallen_all") - F.col("fallen"))).otherwise(0.0)
    saved = F.col("original") - F.col("final")
    sums = fallen.groupBy("provider").agg(F.count(F.lit(1)).alias("messages"), total("original").alias("input"), total(F.when(saved > 0, saved)).alias("saved"), F.sum(part).alias("latency"))
    return sums.withColumn("ratio", F.when(F.col("input") > 0, F.col("saved") / F.col("input")).otherwise(0.0))


def cache_discount(read: Column, create: Column) -> Column:
    """Net cache reads at the discount, never below 0."""
    return F.floor(F.greatest(read - create, F.lit(0)) * READ_DISCOUNT).cast("long")


def prompt_cache_report(events: DataFrame) -> DataFrame:
    """One row: requests, those with reads, tokens read and created, hit rate, saved estimate."""
    sums = events.filter("kind = 'request'").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("cache_read") > 0).alias("read_requests"), total("cache_read").alias("cache_read"), total("cache_create").alias("cache_create"))
    rate = F.when(F.col("requests") > 0, F.col("read_requests") / F.col("requests")).otherwise(0.0)
    return sums.withColumns({"hit_rate": rate, "saved": cache_discount(F.col("cache_read"), F.col("cache_create"))})


def _counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column) != "").groupBy(F.lit(column).alias("dimension"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def output_reduce_report(events: DataFrame) -> DataFrame:
    """One row: requests, applied, skipped, outputs and overhead with their means."""
    skipped = ~F.col("applied") & (F.col("reason") != "")
    sums = events.filter("kind = 'request'").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("applied").alias("applied"), F.count_if(skipped).alias("skipped"), total("output").alias("output"),
        total(F.when(F.col("applied"), F.col("output"))).alias("applied_output"), total(F.when(F.col("applied"), F.col("added"))).alias("overhead"),
    )
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.withColumns({"mean_output": mean("output", "requests"), "mean_applied_output": mean("applied_output", "applied"), "mean_overhead": mean("overhead", "applied")})


def output_reduce_counts(events: DataFrame) -> DataFrame:
    """dimension, value, n: how often each profile, shape and reason occurs; blank ones aren't counted."""
    rows = events.filter("kind = 'request'")
    return _counts(rows, "profile").unionByName(_counts(rows, "shape")).unionByName(_counts(rows, "reason"))


def output_reduce_profiles(events: DataFrame) -> DataFrame:
    """Requests that say anything about the reduction, by provider, model, profile and shape; the most first."""
    rows = events.filter((F.col("kind") == "request") & (F.col("applied") | (F.col("profile") != "") | (F.col("shape") != "") | (F.col("reason") != "")))
    named = lambda c, other: F.when(F.trim(c) == "", F.lit(other)).otherwise(F.trim(c)).alias(c)
    sums = rows.select("provider", named("model", "unknown"), named("profile", "none"), named("shape", "unknown"), "applied", "reason", "output", "added").groupBy("provider", "model", "profile", "shape").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied") & (F.col("reason") != "")).alias("skipped"),
        total("output").alias("output"), total(F.when(F.col("applied"), F.col("added"))).alias("overhead"),
    )
    return sums.withColumn("mean_output", F.col("output") / F.col("requests")).orderBy(F.desc("requests"), F.desc("applied"), F.desc("output"), "provider", "model", "shape", "profile")


def flight_summary(rows: DataFrame) -> DataFrame:
    """One row over the flights of real providers: tokens before and after, cache reads with the cached ones, their net and discount, output or its estimate."""
    read = F.col("cached") + F.col("cache_read")
    sums = rows.filter(provider_flight(F.col("provider"), F.col("source"))).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("local_hits"), total("original").alias("original"), total("final").alias("final"),
        total(read).alias("cache_read"), total("cache_create").alias("cache_create"), total(read - F.col("cache_create")).alias("cache_net"), F.count_if(read < F.col("cache_create")).alias("negative_net"),
        total(F.col("original") - F.col("final")).alias("billable"), total(F.when(F.col("output") > 0, F.col("output")).otherwise(F.col("estimated_output"))).alias("output"),
    )
    return sums.withColumn("discount", cache_discount(F.col("cache_read"), F.col("cache_create"))).withColumn("net_billable", F.col("billable") + F.col("discount"))


def cache_heat(rows: DataFrame) -> DataFrame:
    """Flights of real providers by their stable prefix: requests, hints, longest prefix, cache tokens; the most cached first."""
    sums = rows.filter(provider_flight(F.col("provider"), F.col("source")) & (F.col("prefix") != "")).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("hint").alias("hints"), F.count_if(~F.col("hint") & (F.col("hint_reason") != "")).alias("skipped"), F.max("prefix_tokens").alias("longest"),
        total("cached").alias("cached"), total("cache_read").alias("cache_read"), total("cache_create").alias("cache_create"), total(F.col("cached") + F.col("cache_read") - F.col("cache_create")).alias("net"),
    )
    return sums.orderBy(F.desc("cached"), F.desc("cache_read"), F.desc("hints"), F.desc("requests"), "prefix")


def session_rollup(snapshots: DataFrame) -> DataFrame:
    """By session: first and last time, and what its last snapshot's cumulative counters (requests, input, saved, output) say."""
    last = snapshots.groupBy("session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max_by(F.struct("requests", "input", "saved", "output"), F.struct("ts", "id")).alias("last"))
    rows = last.select("session", "start", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("micros"), "last.*").withColumn("compressed", F.greatest(F.col("input") - F.col("saved"), F.lit(0)))
    mean = F.expr("CASE WHEN requests > 0 AND compressed > 0 THEN compressed div requests ELSE 0 END")
    return rows.withColumns(
        {
            "ratio": F.when(F.col("input") > 0, F.col("compressed") / F.col("input")).otherwise(1.0),
            "extra_messages": F.when(mean > 0, F.floor(F.col("saved") / mean)).otherwise(0).cast("long"),
            "ttft_seconds": F.when((F.col("requests") > 0) & (F.col("saved") > 0), F.col("saved") / F.col("requests") / PREFILL_SPEED).otherwise(0.0),
        }
    )


def layer_combinations(rows: DataFrame, layers: list[tuple[str, Column]]) -> DataFrame:
    """layers (names of those that are active, in their order, joined by +, or none), requests, original, saved, output, errors."""
    names = F.array_join(F.array_compact(F.array(*[F.when(active, F.lit(name)) for name, active in layers])), "+")
    sums = rows.groupBy(F.when(names == "", F.lit("none")).otherwise(names).alias("layers"))
    return sums.agg(F.count(F.lit(1)).alias("requests"), total("original").alias("original"), total(F.col("original") - F.col("final")).alias("saved"), total("output").alias("output"), F.count_if(F.col("kind") == "error").alias("errors"))


def sublayer_totals(rows: DataFrame, breakdown: str) -> DataFrame:
    """key, blocks, saved over a map column of struct<blocks, saved>."""
    parts = rows.select(F.explode(breakdown).alias("key", "value"))
    return parts.groupBy("key").agg(total("value.blocks").alias("blocks"), total("value.saved").alias("saved"))


def mechanisms(rows: DataFrame, parts: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Requests by mechanism (name, active, saved, added): how many, tokens saved, added and net, for the active ones."""
    each = F.array_compact(F.array(*[F.when(active, F.struct(F.lit(name).alias("name"), saved.cast("long").alias("saved"), added.cast("long").alias("added"))) for name, active, saved, added in parts]))
    listed = rows.select(F.explode(each).alias("m")).select("m.*")
    return listed.groupBy("name").agg(F.count(F.lit(1)).alias("requests"), total("saved").alias("saved"), total("added").alias("added"), total(F.col("saved") - F.col("added")).alias("net"))


def filter_observability(calls: DataFrame) -> DataFrame:
    """By filter: attempts, calls, misses, panics, bytes, hit rate, mean milliseconds, and the labels of the last call that has any."""
    saved = F.when(F.col("matched") & (F.col("in_bytes") > F.col("out_bytes")), F.col("in_bytes") - F.col("out_bytes"))
    labelled = F.when((F.col("action") != "") | (F.col("reason") != ""), F.struct(F.trim("action").alias("action"), F.trim("reason").alias("reason")))
    sums = calls.groupBy("name").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("matched").alias("calls"), F.count_if(~F.col("matched") & ~F.col("panicked")).alias("misses"), F.count_if("panicked").alias("panics"),
        total("in_bytes").alias("bytes_in"), total("out_bytes").alias("bytes_out"), total(saved).alias("bytes_saved"), (F.sum("elapsed_ns") / F.count(F.lit(1)) / 1e6).alias("mean_ms"),
        F.max_by(labelled, F.when(labelled.isNotNull(), F.col("id"))).alias("last"),
    )
    return sums.select("name", "attempts", "calls", "misses", "panics", "bytes_in", "bytes_out", "bytes_saved", (F.col("calls") / F.col("attempts")).alias("hit_rate"), "mean_ms", F.coalesce("last.action", F.lit("")).alias("last_action"), F.coalesce("last.reason", F.lit("")).alias("last_reason"))


def repetitions(outputs: DataFrame) -> DataFrame:
    """By session, tool and output (trimmed): hits, first and last id; the upserts of a counter as one aggregation."""
    sha = F.sha2(F.btrim("output", F.lit(" \t\n\r\x0b\f")), 256)
    return outputs.groupBy("session", "tool", sha.alias("output_sha")).agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def repetition_snapshot(counters: DataFrame) -> DataFrame:
    return counters.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("session").alias("sessions"), F.coalesce(F.max("hits"), F.lit(0)).alias("most"))


def mirror_report(blocks: DataFrame) -> DataFrame:
    """By kind of block: blocks and bytes, and of those what an earlier request of the session had already sent.

    A block counts as sent if its text came in a request before; repeats inside one request are `same`.
    """
    said = blocks.filter("text <> ''").select(F.struct("session", F.sha2("text", 256).alias("sha")).alias("key"), "request", "pos", "kind", F.octet_length("text").cast("long").alias("bytes"))
    # A request's copies of a text are combined before anything is joined; a text that all requests repeat is attached by broadcast.
    rows = cut(said.groupBy("key", "request", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.first("bytes").alias("bytes")))
    first = rows.groupBy("key").agg(F.min("request").alias("first_request"), F.count(F.lit(1)).alias("rows"))
    opened = rows.groupBy("key", "request").agg(F.min_by("kind", "pos").alias("opened"))
    known = attach(rows, first.select("key", "first_request"), "key", hot_keys(first, "key")).join(opened, ["key", "request"])
    sent = F.when(F.col("first_request") < F.col("request"), F.col("n")).otherwise(0)
    same = F.col("n") - (F.col("kind") == F.col("opened")).cast("long")
    return known.groupBy("kind").agg(
        F.sum("n").alias("blocks"), total(F.col("bytes") * F.col("n")).alias("bytes"), F.sum(sent).cast("long").alias("sent"), total(F.col("bytes") * sent).alias("sent_bytes"),
        F.sum(same).cast("long").alias("same"), total(F.col("bytes") * same).alias("same_bytes"),
    )


def route_rollup(rows: DataFrame) -> DataFrame:
    """Totals by route and model, by route, and over all: sessions, requests, original, final."""
    sums = rows.rollup("route", "model").agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("requests"), total("original").alias("original"), total("final").alias("final"), F.grouping_id().cast("int").alias("level"))
    return sums


def scorecard(fold: DataFrame) -> DataFrame:
    """One row from event_fold: billed tokens with the cache discount, what they would have been, and three rates."""
    billed = F.greatest(F.col("input") - F.col("saved") + F.col("output") - cache_discount(F.col("cache_read"), F.col("cache_create")), F.lit(0))
    would = F.col("input") + F.col("output")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return fold.select(billed.alias("billed"), would.alias("counterfactual"), share(would - billed, would).alias("effective_rate"), share(F.col("saved"), F.col("input")).alias("input_rate"), share(F.col("cache_read"), F.col("input")).alias("cache_rate"))


def tallies(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """dimension, value, n over several columns or arrays of values at once; blank values aren't counted."""
    each = F.array(*[F.struct(F.lit(name).alias("dimension"), values.alias("values")) for name, values in dimensions.items()])
    flat = rows.select(F.explode(each).alias("d")).select("d.dimension", F.explode("d.values").alias("value"))
    return flat.filter("value <> ''").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def opportunities(rows: DataFrame) -> DataFrame:
    """By shape and kind: rows, bytes, headroom (what isn't saved yet) and the distinct blockers, sorted."""
    return rows.groupBy("shape", "kind").agg(
        F.count(F.lit(1)).alias("rows"), total("original").alias("original"), total(F.greatest(F.col("final"), F.lit(0))).alias("headroom"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))), ",").alias("blockers")
    )

