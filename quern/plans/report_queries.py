"""Queries of the reports over requests made of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import reports as R
from quern.plans.base import REQUESTS, cte, query, view

_Q = f"WITH {cte('q', REQUESTS)}"
_SUMS = "count(*) AS runs, coalesce(sum(original), 0)::BIGINT AS input, coalesce(sum(final), 0)::BIGINT AS output, coalesce(sum(original - final), 0)::BIGINT AS saved"
_FAMILY = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(lower(command), '{pattern}') THEN '{name}'"
        for name, pattern in [
            ("svelte", "svelte"),
            ("typescript", "typescript|tsc|tsx|tsserver"),
            ("javascript", "javascript|node|bun|npm|pnpm|yarn|vite|next|react|jest|playwright|eslint|biome|oxlint|turbo|nx|lerna"),
            ("zig", "zig"),
            ("sql", "sql|mariadb|migration|prisma|drizzle|sqruff"),
            ("markdown", "markdown|mdformat"),
            ("rust", "cargo|rust|clippy"),
            ("go", "go |go-|gopls"),
            ("python", r"python|pytest|unittest|mypy|ruff|pylint|flake8|pyright|uv |\[uv\]|poetry"),
            ("jvm_mobile_php", "javac|java |kotlin|gradle|mvn |mvnw|maven|sbt|scalac|swift|xcodebuild|dart|flutter|php|psalm|composer"),
            ("c_cpp_build", r"gcc|g\+\+|clang|cmake|ninja|make"),
            ("container", r"docker|podman|nerdctl|kube|oc |\[oc\]|helm|hadolint"),
            ("hcl", "terraform|tofu|hcl"),
            ("git", "git"),
            ("ruby", "ruby"),
            ("shell", "shell|bash|zsh|shfmt"),
        ]
    )
    + " ELSE 'other' END"
)


def _rows(spark, sf):
    return view(spark, sf, REQUESTS)


@query(f"{_Q} SELECT {_SUMS} FROM q WHERE project IN ('', '/home/u/app') OR starts_with(replace(project, chr(92), '/'), '/home/u/app/')")
def gain_total(spark, sf):
    """Runs of a project or without one."""
    rows = _rows(spark, sf)
    return R.runs_total(rows.filter((F.col("project") == "") | R.in_project(F.col("project"), "/home/u/app")))


@query(f"{_Q} SELECT command, {_SUMS}, round(sum(original - final) / 1e6 * 3.0, 9) AS usd FROM q GROUP BY command")
def gain_by_command(spark, sf):
    return R.runs_by_command(_rows(spark, sf), 3.0).withColumn("usd", F.round("usd", 9))


@query(f"{_Q} SELECT {_FAMILY} AS parser, {_SUMS}, round(sum(original - final) / 1e6 * 3.0, 9) AS usd FROM q GROUP BY 1")
def gain_by_parser(spark, sf):
    return R.runs_by_parser(_rows(spark, sf), 3.0).withColumn("usd", F.round("usd", 9))


@query(f"{_Q} SELECT command, outcome, count(*) AS runs, sum(original)::BIGINT AS input, sum(final)::BIGINT AS output FROM q GROUP BY ALL ORDER BY input DESC, runs DESC, command, outcome LIMIT 20")
def observed_commands(spark, sf):
    return R.observed_commands(_rows(spark, sf), 0)


_FOLD = """SELECT count(*) FILTER (kind = 'request') AS requests, sum(original) FILTER (kind = 'request')::BIGINT AS input, sum(output) FILTER (kind = 'request')::BIGINT AS output,
  sum(greatest(original - final, 0)) FILTER (kind = 'request')::BIGINT AS saved, sum(original - final) FILTER (kind = 'request' AND layer = 1)::BIGINT AS layer1_saved,
  sum(original - final) FILTER (kind = 'request' AND layer IN (2, 3))::BIGINT AS layer2_saved, count(*) FILTER (kind = 'cache_hit' OR kind = 'request' AND hit) AS cache_hits,
  count(*) FILTER (kind = 'request' AND NOT hit) AS cache_misses, count(*) FILTER (kind = 'request' AND cache_read > 0) AS read_requests, sum(cache_read) FILTER (kind = 'request')::BIGINT AS cache_read,
  sum(cache_create) FILTER (kind = 'request')::BIGINT AS cache_create, sum(secrets) FILTER (kind = 'secret')::BIGINT AS secrets, count(*) FILTER (kind = 'error') AS errors,
  count(*) FILTER (kind IN ('rate_limit_retry', 'overflow_retry')) AS retries, count(*) FILTER (kind = 'rate_limit_retry') AS rate_limit_retries, count(*) FILTER (kind = 'overflow_retry') AS overflow_retries FROM q"""


@query(f"{_Q}, f AS ({_FOLD}) SELECT *, saved / input AS ratio, saved // 1000 AS extra_messages, saved / requests / 3000 AS ttft_seconds, read_requests / requests AS read_rate FROM f")
def analytics_snapshot(spark, sf):
    return R.snapshot(R.event_fold(_rows(spark, sf)))


@query(f"""{_Q}, f AS ({_FOLD}), s AS (SELECT *, greatest(input - saved + output - floor(greatest(cache_read - cache_create, 0) * 0.9), 0)::BIGINT AS billed, input + output AS would FROM f)
SELECT billed, would AS counterfactual, (would - billed) / would AS effective_rate, saved / input AS input_rate, cache_read / input AS cache_rate FROM s""")
def savings_scorecard(spark, sf):
    return R.scorecard(R.event_fold(_rows(spark, sf)))


@query(f"""WITH RECURSIVE {cte('q', REQUESTS)}, n AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY id) AS n FROM q WHERE kind = 'request'),
c(provider, n, latency) AS (
  SELECT provider, 0::BIGINT, 0.0::DOUBLE FROM n GROUP BY provider
  UNION ALL SELECT n.provider, n.n, CASE WHEN n.latency <= 0 THEN c.latency WHEN n.n = 1 THEN n.latency ELSE c.latency + (n.latency - c.latency) / n.n END FROM c JOIN n ON n.provider = c.provider AND n.n = c.n + 1
)
SELECT provider, count(*) AS messages, sum(original)::BIGINT AS input, sum(greatest(original - final, 0))::BIGINT AS saved, round((SELECT arg_max(latency, c.n) FROM c WHERE c.provider = n.provider), 6) AS latency,
  sum(greatest(original - final, 0)) / sum(original) AS ratio FROM n GROUP BY provider""")
def provider_latency(spark, sf):
    return R.provider_stats(_rows(spark, sf)).withColumn("latency", F.round("latency", 6))


@query(f"""{_Q}, s AS (SELECT count(*) AS requests, count(*) FILTER (cache_read > 0) AS read_requests, sum(cache_read)::BIGINT AS cache_read, sum(cache_create)::BIGINT AS cache_create FROM q WHERE kind = 'request')
SELECT *, read_requests / requests AS hit_rate, CASE WHEN cache_read > cache_create THEN floor((cache_read - cache_create) * 0.9)::BIGINT ELSE 0 END AS saved FROM s""")
def prompt_cache_report(spark, sf):
    return R.prompt_cache_report(_rows(spark, sf))


@query(f"""{_Q}, s AS (SELECT count(*) AS requests, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied AND reason <> '') AS skipped, sum(output)::BIGINT AS output,
  sum(output) FILTER (applied)::BIGINT AS applied_output, sum(added) FILTER (applied)::BIGINT AS overhead FROM q WHERE kind = 'request')
SELECT *, output / requests AS mean_output, applied_output / applied AS mean_applied_output, overhead / applied AS mean_overhead FROM s""")
def output_reduce_report(spark, sf):
    return R.output_reduce_report(_rows(spark, sf))


@query(f"""{_Q} SELECT dimension, value, count(*) AS n FROM (SELECT 'profile' AS dimension, profile AS value FROM q WHERE kind = 'request' UNION ALL SELECT 'shape', shape FROM q WHERE kind = 'request'
UNION ALL SELECT 'reason', reason FROM q WHERE kind = 'request') WHERE value <> '' GROUP BY ALL""")
def output_reduce_counts(spark, sf):
    return R.output_reduce_counts(_rows(spark, sf))


@query(f"""{_Q} SELECT provider, coalesce(nullif(trim(model), ''), 'unknown') AS model, coalesce(nullif(profile, ''), 'none') AS profile, coalesce(nullif(shape, ''), 'unknown') AS shape, count(*) AS requests,
  count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied AND reason <> '') AS skipped, sum(output)::BIGINT AS output, coalesce(sum(added) FILTER (applied), 0)::BIGINT AS overhead, sum(output) / count(*) AS mean_output
FROM q WHERE kind = 'request' AND (applied OR profile <> '' OR shape <> '' OR reason <> '') GROUP BY 1, 2, 3, 4""")
def output_reduce_profiles(spark, sf):
    return R.output_reduce_profiles(_rows(spark, sf))


_FLIGHT = "provider NOT IN ('', 'local', 'unknown') AND source IN ('', 'proxy', 'transparent_connect')"


@query(f"""{_Q}, s AS (SELECT count(*) AS requests, count(*) FILTER (hit) AS local_hits, sum(original)::BIGINT AS original, sum(final)::BIGINT AS final, sum(cached + cache_read)::BIGINT AS cache_read, sum(cache_create)::BIGINT AS cache_create,
  sum(cached + cache_read - cache_create)::BIGINT AS cache_net, count(*) FILTER (cached + cache_read < cache_create) AS negative_net, sum(original - final)::BIGINT AS billable,
  sum(CASE WHEN output > 0 THEN output ELSE estimated_output END)::BIGINT AS output FROM q WHERE {_FLIGHT})
SELECT *, floor(greatest(cache_read - cache_create, 0) * 0.9)::BIGINT AS discount, billable + floor(greatest(cache_read - cache_create, 0) * 0.9)::BIGINT AS net_billable FROM s""")
def flight_summary(spark, sf):
    return R.flight_summary(_rows(spark, sf))


@query(f"""{_Q} SELECT prefix, count(*) AS requests, count(*) FILTER (hint) AS hints, count(*) FILTER (NOT hint AND hint_reason <> '') AS skipped, max(prefix_tokens) AS longest, sum(cached)::BIGINT AS cached, sum(cache_read)::BIGINT AS cache_read,
  sum(cache_create)::BIGINT AS cache_create, sum(cached + cache_read - cache_create)::BIGINT AS net FROM q WHERE {_FLIGHT} AND prefix <> '' GROUP BY prefix""")
def cache_heat(spark, sf):
    return R.cache_heat(_rows(spark, sf))


@query(f"""{_Q}, s AS (SELECT session, min(ts) AS start, max(ts) AS "end", epoch_us(max(ts)) - epoch_us(min(ts)) AS micros, max((ts, id, id % 90, original * 10, greatest(original * 10 - final * 9, 0), output)) AS l FROM q GROUP BY session),
l AS (SELECT session, start, micros, l[3] AS requests, l[4] AS input, l[5] AS saved, l[6] AS output, greatest(l[4] - l[5], 0) AS compressed FROM s)
SELECT session, start, micros, requests, input, saved, output, compressed, CASE WHEN input > 0 THEN compressed / input ELSE 1.0 END AS ratio,
  CASE WHEN requests > 0 AND compressed > 0 AND compressed // requests > 0 THEN saved // (compressed // requests) ELSE 0 END::BIGINT AS extra_messages,
  CASE WHEN requests > 0 AND saved > 0 THEN saved / requests / 3000 ELSE 0.0 END AS ttft_seconds FROM l""")
def session_rollup(spark, sf):
    rows = _rows(spark, sf).select("session", "ts", "id", (F.col("id") % 90).alias("requests"), (F.col("original") * 10).alias("input"), F.greatest(F.col("original") * 10 - F.col("final") * 9, F.lit(0)).alias("saved"), "output")
    return R.session_rollup(rows)


@query(f"""{_Q}, c AS (SELECT *, concat_ws('+', CASE WHEN layer = 0 OR original > final + 300 THEN 'L0' END, CASE WHEN layer = 1 OR l1_saved > 0 THEN 'L1' END, CASE WHEN layer = 2 OR cache_read > 0 THEN 'L2' END, CASE WHEN applied THEN 'L3' END, CASE WHEN contains(route, 'websocket') THEN 'WS' END) AS l FROM q)
SELECT CASE WHEN l = '' THEN 'none' ELSE l END AS layers, count(*) AS requests, sum(original)::BIGINT AS original, sum(original - final)::BIGINT AS saved, sum(output)::BIGINT AS output, count(*) FILTER (kind = 'error') AS errors FROM c GROUP BY 1""")
def layer_combinations(spark, sf):
    c = F.col
    layers = [("L0", (c("layer") == 0) | (c("original") > c("final") + 300)), ("L1", (c("layer") == 1) | (c("l1_saved") > 0)), ("L2", (c("layer") == 2) | (c("cache_read") > 0)), ("L3", c("applied")), ("WS", F.contains("route", F.lit("websocket")))]
    return R.layer_combinations(_rows(spark, sf), layers)


@query(f"""{_Q} SELECT key, sum(blocks)::BIGINT AS blocks, sum(saved)::BIGINT AS saved FROM (SELECT 'dedup' AS key, layer AS blocks, l1_saved AS saved FROM q WHERE layer > 0 UNION ALL SELECT 'ansi', 1, added FROM q WHERE layer <> 2) GROUP BY key""")
def sublayer_totals(spark, sf):
    one = lambda blocks, saved: F.struct(blocks.cast("long").alias("blocks"), saved.cast("long").alias("saved"))
    entries = F.array_compact(F.array(F.when(F.col("layer") > 0, F.struct(F.lit("dedup"), one(F.col("layer"), F.col("l1_saved")))), F.when(F.col("layer") != 2, F.struct(F.lit("ansi"), one(F.lit(1), F.col("added"))))))
    return R.sublayer_totals(_rows(spark, sf).select(F.map_from_entries(entries).alias("parts")), "parts")


@query(f"""{_Q}, m AS (SELECT 'layer1' AS name, l1_saved AS saved, 0 AS added FROM q WHERE l1_saved > 0 UNION ALL SELECT 'output_reduce', 0, added FROM q WHERE applied UNION ALL SELECT 'prompt_cache', cache_read, cache_create FROM q WHERE cache_read + cache_create > 0)
SELECT name, count(*) AS requests, sum(saved)::BIGINT AS saved, sum(added)::BIGINT AS added, sum(saved - added)::BIGINT AS net FROM m GROUP BY name""")
def mechanism_totals(spark, sf):
    c, zero = F.col, F.lit(0)
    return R.mechanisms(_rows(spark, sf), [("layer1", c("l1_saved") > 0, c("l1_saved"), zero), ("output_reduce", c("applied"), zero, c("added")), ("prompt_cache", c("cache_read") + c("cache_create") > 0, c("cache_read"), c("cache_create"))])


@query(f"""{_Q}, s AS (SELECT command AS name, count(*) AS attempts, count(*) FILTER (hit) AS calls, count(*) FILTER (NOT hit AND kind <> 'error') AS misses, count(*) FILTER (kind = 'error') AS panics, sum(original)::BIGINT AS bytes_in, sum(final)::BIGINT AS bytes_out,
  coalesce(sum(original - final) FILTER (hit AND original > final), 0)::BIGINT AS bytes_saved, round(sum(latency * 1000) / count(*) / 1e6, 9) AS mean_ms, arg_max((outcome, reason), id) FILTER (reason <> '' OR outcome <> '') AS l FROM q GROUP BY command)
SELECT name, attempts, calls, misses, panics, bytes_in, bytes_out, bytes_saved, calls / attempts AS hit_rate, mean_ms, l[1] AS last_action, l[2] AS last_reason FROM s""")
def filter_observability(spark, sf):
    c = F.col
    rows = _rows(spark, sf).select("id", c("command").alias("name"), c("hit").alias("matched"), (c("kind") == "error").alias("panicked"), c("original").alias("in_bytes"), c("final").alias("out_bytes"), (c("latency") * 1000).alias("elapsed_ns"), c("outcome").alias("action"), "reason")
    return R.filter_observability(rows).withColumn("mean_ms", F.round("mean_ms", 9))


@query(f"{_Q} SELECT session, command AS tool, sha256(trim(outcome, E' \\t\\n\\r')) AS output_sha, count(*) AS hits, min(id) AS first_id, max(id) AS last_id FROM q GROUP BY 1, 2, 3")
def repetition_counter(spark, sf):
    return R.repetitions(_rows(spark, sf).select("session", "id", F.col("command").alias("tool"), F.concat(F.lit(" "), F.col("outcome"), F.lit("\n")).alias("output")))


@query(f"{_Q}, c AS (SELECT session, command, outcome, count(*) AS hits FROM q GROUP BY 1, 2, 3) SELECT count(*) AS rows, count(DISTINCT session) AS sessions, max(hits) AS most FROM c")
def repetition_snapshot(spark, sf):
    return R.repetition_snapshot(R.repetitions(_rows(spark, sf).select("session", "id", F.col("command").alias("tool"), F.col("outcome").alias("output"))))


@query(f"""{_Q}, b AS (SELECT session, id // 3 AS request, id % 3 AS pos, provider AS kind, command AS text, strlen(command) AS bytes, min(id // 3) OVER (PARTITION BY session, command) AS fr, min(id % 3) OVER (PARTITION BY session, command, id // 3) AS fp FROM q)
SELECT kind, count(*) AS blocks, sum(bytes)::BIGINT AS bytes, count(*) FILTER (fr < request) AS sent, coalesce(sum(bytes) FILTER (fr < request), 0)::BIGINT AS sent_bytes, count(*) FILTER (fp < pos) AS same, coalesce(sum(bytes) FILTER (fp < pos), 0)::BIGINT AS same_bytes FROM b GROUP BY kind""")
def server_mirror(spark, sf):
    rows = _rows(spark, sf).select("session", F.expr("id div 3").alias("request"), (F.col("id") % 3).alias("pos"), F.col("provider").alias("kind"), F.col("command").alias("text"))
    return R.mirror_report(rows)


@query(f"{_Q} SELECT route, model, count(DISTINCT session) AS sessions, count(*) AS requests, sum(original)::BIGINT AS original, sum(final)::BIGINT AS final, grouping(route) * 2 + grouping(model) AS level FROM q GROUP BY ROLLUP (route, model)")
def route_rollup(spark, sf):
    return R.route_rollup(_rows(spark, sf))


@query(f"""{_Q} SELECT dimension, value, count(*) AS n FROM (SELECT 'class' AS dimension, profile AS value FROM q UNION ALL SELECT 'action', reason FROM q UNION ALL SELECT 'signal', unnest([shape, outcome]) FROM q) WHERE value <> '' GROUP BY 1, 2""")
def evidence_tallies(spark, sf):
    return R.tallies(_rows(spark, sf), {"class": F.array("profile"), "action": F.array("reason"), "signal": F.array("shape", "outcome")})


@query(f"""{_Q} SELECT shape, kind, count(*) AS rows, sum(original)::BIGINT AS original, sum(greatest(final, 0))::BIGINT AS headroom, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (reason <> ''), '') AS blockers FROM q GROUP BY 1, 2""")
def opportunity_rows(spark, sf):
    return R.opportunities(_rows(spark, sf))
