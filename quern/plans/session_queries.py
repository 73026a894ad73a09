"""Queries over the calls of sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import sessions as S
from quern.plans.base import CALLS, REQUESTS, cte, query, view

_C = f"WITH {cte('e', CALLS)}, c AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY id) - 1 AS pos FROM e)"


def _calls(spark, sf):
    """Calls with their place in the session, from 0."""
    from pyspark.sql import Window

    rows = view(spark, sf, CALLS)
    return rows.withColumn("at", (F.row_number().over(Window.partitionBy("session").orderBy("id")) - 1).cast("long"))


@query(f"{_C}, r AS (SELECT * FROM c WHERE op = 'read') SELECT session, pos, path, max(pos) OVER (PARTITION BY session, path) AS latest, max(pos) OVER (PARTITION BY session, path) - pos >= 3 AS stale FROM r")
def stale_reads(spark, sf):
    return S.stale_reads(_calls(spark, sf).filter("op = 'read'")).select("session", F.col("at").alias("pos"), "path", "latest", "stale")


@query(f"""{_C}, f AS (
  SELECT r.session, r.pos, r.path, (SELECT min(w.pos) FROM c w WHERE w.session = r.session AND w.path = r.path AND w.pos > r.pos AND w.op IN ('edit', 'write')) AS edit_at,
    (SELECT min(n.pos) FROM c n WHERE n.session = r.session AND n.path = r.path AND n.pos > r.pos AND n.op = 'read') AS read_at
  FROM c r WHERE r.op = 'read'
)
SELECT * FROM f WHERE edit_at IS NOT NULL AND read_at IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM c m WHERE m.session = f.session AND m.pos > f.pos AND (contains(lower(m.said), 'message ' || f.pos) OR contains(lower(m.said), 'msg ' || f.pos) OR contains(lower(m.said), '[' || f.pos || ']')))""")
def redundant_reads(spark, sf):
    """Reads that a later edit and a later read make worthless, unless a later message mentions them."""
    return S.redundant_reads(_calls(spark, sf), text="said").select("session", F.col("at").alias("pos"), "path", F.col("edit_at"), "read_at")


@query(f"""{_C}, u AS (SELECT session, id // 4 AS use_id, arg_max(op, pos) AS tool FROM c WHERE id % 2 = 0 GROUP BY 1, 2),
r AS (SELECT session, id, CASE WHEN id % 3 = 0 THEN '' ELSE (id // 4)::VARCHAR END AS result_id, (id // 4)::VARCHAR AS use_id FROM c WHERE id % 2 = 1)
SELECT r.session, r.id, u.tool FROM r LEFT JOIN u ON u.session = r.session AND u.use_id::VARCHAR = coalesce(nullif(r.result_id, ''), r.use_id)""")
def paired_results(spark, sf):
    rows = _calls(spark, sf).withColumn("use_id", F.expr("id div 4").cast("string"))
    results = rows.filter("id % 2 = 1").select("session", "id", F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("use_id")).alias("result_id"), "use_id")
    return S.paired_results(rows.filter("id % 2 = 0").select("session", "use_id", "at", F.col("op").alias("tool")), results).select("session", "id", "tool")


@query(f"""{_C}, f AS (SELECT session, pos, output, min(pos) OVER (PARTITION BY session, trim(output, E' \\t\\n\\r')) AS first FROM c)
SELECT session, pos, first, CASE WHEN pos > first THEN '[Duplicate of message ' || first || ' - omitted at message ' || pos || ']' ELSE output END AS shown FROM f""")
def duplicate_notes(spark, sf):
    return S.duplicate_notes(_calls(spark, sf).select("session", "at", "output"), text="output").select("session", F.col("at").alias("pos"), "first", "shown")


@query(f"""{_C}, f AS (SELECT session, pos, command, output, first_value(pos) OVER w AS fa, first_value(output) OVER w AS fo FROM c WINDOW w AS (PARTITION BY session, command, id % 5 ORDER BY pos))
SELECT session, pos, CASE WHEN pos > fa AND fo IS NOT DISTINCT FROM output AND strlen('[Identical to ' || command || ' result in message ' || fa || ']') < strlen(output) THEN '[Identical to ' || command || ' result in message ' || fa || ']' ELSE output END AS shown
FROM (SELECT session, pos, command, fa, CASE WHEN pos % 2 = 0 THEN repeat('y', 60) ELSE output END AS output, fo FROM (SELECT session, pos, command, output, first_value(pos) OVER w AS fa, first_value(CASE WHEN pos % 2 = 0 THEN repeat('y', 60) ELSE output END) OVER w AS fo FROM c WINDOW w AS (PARTITION BY session, command, id % 5 ORDER BY pos)))""")
def identical_notes(spark, sf):
    """Repeated calls by canonical JSON: two spellings of one input are one call."""
    rows = _calls(spark, sf).withColumn("output", F.when(F.col("at") % 2 == 0, F.repeat(F.lit("y"), 60)).otherwise(F.col("output")))
    return S.identical_notes(rows, tool="command").select("session", F.col("at").alias("pos"), "shown")


@query(f"{_C} SELECT session, pos, CASE WHEN lag(output) OVER (PARTITION BY session, path ORDER BY pos) = output THEN 'block-unchanged' ELSE 'allow' END AS decision FROM c WHERE op = 'read'")
def unchanged_reads(spark, sf):
    return S.unchanged_reads(_calls(spark, sf).filter("op = 'read'")).select("session", F.col("at").alias("pos"), "decision")


@query(f"""{_C}, p AS (SELECT session, pos, pos // 6 AS turn, command AS folder, CASE WHEN id % 3 = 0 THEN 'a' || chr(0) || 'b' WHEN id % 3 = 1 THEN 'a' || chr(0) || 'b' ELSE 'c' END AS s FROM c)
SELECT session, pos, sha256(s) AS fingerprint, row_number() OVER (PARTITION BY session, turn, folder, s ORDER BY pos) > 1 AS seen FROM p""")
def seen_path_sets(spark, sf):
    paths = F.when(F.col("id") % 3 == 0, F.array(F.lit("./b"), F.lit("a"), F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"), F.lit(" b "), F.lit(""))).otherwise(F.array(F.lit("c")))
    rows = _calls(spark, sf).select("session", "at", F.expr("at div 6").alias("turn"), F.col("command").alias("folder"), paths.alias("paths"))
    return S.seen_sets(rows).select("session", F.col("at").alias("pos"), "fingerprint", "seen")


@query(f"""{_C}, l AS (SELECT session, path AS tool, max(pos // 3) AS last FROM c GROUP BY 1, 2)
SELECT session, tool, last, max(last) OVER (PARTITION BY session) - last > 2 AND row_number() OVER (PARTITION BY session ORDER BY last DESC, tool) > 2 AS idle FROM l""")
def idle_tools(spark, sf):
    return S.idle_tools(_calls(spark, sf).select("session", F.expr("at div 3").alias("turn"), F.col("path").alias("tool")), threshold=2, floor=2)


@query(f"WITH {cte('q', REQUESTS)}, r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY id DESC) AS back FROM q WHERE latency > 0) SELECT provider, count(*) AS n, round(avg(latency), 6) AS mean, max(latency) AS largest, round(quantile_cont(latency, 0.5) FILTER (back <= 200), 6) AS p50, round(quantile_cont(latency, 0.95) FILTER (back <= 200), 6) AS p95 FROM r GROUP BY provider")
def recent_percentiles(spark, sf):
    out = S.recent_percentiles(view(spark, sf, REQUESTS), "provider", "id", "latency")
    return out.select("provider", "n", F.round("mean", 6).alias("mean"), "largest", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(f"""{_C}, t AS (SELECT session, pos, path, CASE WHEN id % 5 = 0 THEN '' ELSE (pos // 4)::VARCHAR END AS turn FROM c WHERE op = 'read'),
n AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY pos) AS turn_no FROM (SELECT *, CASE WHEN lag(turn) OVER (PARTITION BY session ORDER BY pos) IS NULL OR turn <> lag(turn) OVER (PARTITION BY session ORDER BY pos) OR turn = '' THEN 1 ELSE 0 END AS new FROM t))
SELECT session, pos, turn_no::BIGINT AS turn_no, coalesce(turn_no - lag(turn_no) OVER (PARTITION BY session, path ORDER BY pos) <= 3, false) AS reread FROM n""")
def turn_rereads(spark, sf):
    rows = _calls(spark, sf).filter("op = 'read'").withColumn("turn", F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.expr("at div 4").cast("string")))
    return S.turn_rereads(rows, "session", "at", "turn", "path", 3).select("session", F.col("at").alias("pos"), "turn_no", "reread")


@query(f"""WITH {cte('q', REQUESTS)}, r AS (SELECT id, sum((session % 2 = 1)::INT) OVER w AS treated, sum((session % 2 = 1 AND kind = 'error')::INT) OVER w AS treated_failed, sum((session % 2 = 0)::INT) OVER w AS control, sum((session % 2 = 0 AND kind = 'error')::INT) OVER w AS control_failed FROM q WINDOW w AS (ORDER BY id))
SELECT max(treated)::BIGINT AS treated, max(treated_failed)::BIGINT AS treated_failed, max(control)::BIGINT AS control, max(control_failed)::BIGINT AS control_failed, bool_or(treated >= 50 AND control > 0 AND treated_failed / treated - control_failed / control > 0.05) AS rolled_back FROM r""")
def cohort_latch(spark, sf):
    """The rollback latch at any prefix."""
    return S.cohort_latch(view(spark, sf, REQUESTS).select("id", "session", "kind"), ["id"], F.col("session") % 2 == 1, F.col("kind") == "error")


@query(f"""{_C}, m AS (SELECT *, regexp_matches(lower(command), '^(git status|cargo test|ls )') AS can FROM c)
SELECT session, pos, can AND pos < max(pos) OVER (PARTITION BY session, command) AS pruned FROM m""")
def superseded_commands(spark, sf):
    """Outputs of repeatable commands that a later run of the session replaces."""
    from quern.functions.commands import repeatable

    rows = S.superseded(_calls(spark, sf).select("session", "at", "command"), "session", ["at"], "command")
    return rows.select("session", F.col("at").alias("pos"), (repeatable(F.col("command")) & F.col("superseded")).alias("pruned"))
