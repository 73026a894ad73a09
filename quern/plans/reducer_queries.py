"""Queries of the reducers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import neardup
from quern.operators import reducers as R
from quern.plans.base import CALLS, REQUESTS, cte, query, view
from quern.session import table

#: Outputs of builds, linters, listings, logs and searches made of events.
TEXTS = {
    "id": "event_id",
    "text": """CASE event_id % 5
 WHEN 0 THEN repeat('Compiling a v1' || chr(10) || 'some long detail of a step' || chr(10), 2) || repeat('error: bad thing' || chr(13) || chr(10) || 'note of it' || chr(10), CAST(event_id % 70 AS INT)) || 'Finished'
 WHEN 1 THEN repeat('src/a.ts:10:2 error no-x' || chr(10) || '    explanation' || chr(10), CAST(event_id % 90 AS INT)) || '3 problems'
 WHEN 2 THEN repeat('-rw-r--r-- 1 u g 10 f.txt' || chr(10), CAST(event_id % 30 AS INT)) || 'drwxr-xr-x 2 u g 10 d'
 WHEN 3 THEN repeat('2024-01-01T10:00:0' || event_id % 10 || 'Z tick' || chr(10) || '2024-01-01 10:00:09.5 tick' || chr(10), 3) || 'end ' || event_id
 ELSE 'b.go:12:x' || chr(10) || 'a.go:' || event_id % 9 || ':an error' || chr(10) || 'a.go:10:y' || chr(10) || 'none' || chr(10) || 'a.go:2:z' END""",
}
#: What the reducers read: those outputs, and all documents and pages.
_T = f"""WITH {cte('made', TEXTS)}, t AS (SELECT id, text FROM made UNION ALL SELECT -1 - doc_id, coalesce(text, '') FROM documents UNION ALL SELECT -1000000000 - page_id, coalesce(html, '') FROM pages)"""
_ROWS = "list_transform(string_split(text, chr(10)), lambda x: rtrim(x, chr(13)))"


def _texts(spark, sf):
    docs = table(spark, sf, "documents").select((-1 - F.col("doc_id")).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    pages = table(spark, sf, "pages").select((-1000000000 - F.col("page_id")).cast("long").alias("id"), F.coalesce("html", F.lit("")).alias("text"))
    return view(spark, sf, TEXTS).select(F.col("id").cast("long").alias("id"), "text").unionByName(docs).unionByName(pages)


@query(_T + rf""", r AS (SELECT id, text, list_filter({_ROWS}, lambda x: regexp_matches(x, '(?i)(error:|: error |^error\[)|(warning:|: warning )')) AS e, list_filter({_ROWS}, lambda x: NOT regexp_matches(x, '(?i)(error:|: error |^error\[)|(warning:|: warning )') AND regexp_matches(x, '(?i)(^Compiling|^Finished|^Running|^Building)')) AS i FROM t),
m AS (SELECT id, text, array_to_string(list_concat(e[1:50], CASE WHEN len(e) >= 50 THEN ['[...additional errors omitted]'] ELSE [] END, i), chr(10)) AS made FROM r)
SELECT id, md5(CASE WHEN made <> '' AND strlen(made) < strlen(text) THEN made ELSE text END) AS reduced FROM m""")
def build_output(spark, sf):
    return _texts(spark, sf).select("id", F.md5(R.build_output(F.col("text"))).alias("reduced"))


@query(_T + rf""", r AS (SELECT id, text, list_filter({_ROWS}, lambda x: regexp_matches(x, '[a-zA-Z0-9_./\\]+:\d+:\d+.*(error|warning|info)')) AS e, list_filter({_ROWS}, lambda x: NOT regexp_matches(x, '[a-zA-Z0-9_./\\]+:\d+:\d+.*(error|warning|info)') AND regexp_matches(x, '(?i)(\d+\s+(error|warning|problem)|✖|✓)')) AS i FROM t),
m AS (SELECT id, text, array_to_string(list_concat(e[1:60], CASE WHEN len(e) >= 60 THEN ['[60 violations shown, remainder omitted]'] ELSE [] END, i), chr(10)) AS made FROM r)
SELECT id, md5(CASE WHEN made <> '' AND strlen(made) < strlen(text) THEN made ELSE text END) AS reduced FROM m""")
def lint_output(spark, sf):
    return _texts(spark, sf).select("id", F.md5(R.lint_output(F.col("text"))).alias("reduced"))


@query(_T + rf""", r AS (SELECT id, text, list_filter({_ROWS}, lambda x: x <> '' AND NOT starts_with(x, 'total ')) AS rows FROM t),
n AS (SELECT id, text, len(list_filter(rows, lambda x: starts_with(x, 'd') AND regexp_matches(x, '{R.DIR_ENTRY}'))) AS dirs,
  len(list_filter(rows, lambda x: NOT (starts_with(x, 'd') AND regexp_matches(x, '{R.DIR_ENTRY}')) AND (regexp_matches(x, '{R.DIR_ENTRY}') OR regexp_matches(x, '^\S')))) AS files FROM r),
m AS (SELECT *, '[directory: ' || files || ' files, ' || dirs || ' dirs]' AS made FROM n)
SELECT id, md5(CASE WHEN files + dirs > 20 AND strlen(made) < strlen(text) THEN made ELSE text END) AS reduced FROM m""")
def dir_output(spark, sf):
    return _texts(spark, sf).select("id", F.md5(R.dir_output(F.col("text"))).alias("reduced"))


@query(_T + rf""", l AS (SELECT id, unnest({_ROWS}) AS line, unnest(range(len({_ROWS}))) AS pos FROM t),
f AS (SELECT id, regexp_replace(line, '{R.LOG_TIME}', '<T>', 'g') AS form, min(pos) AS pos, arg_min(line, pos) AS line, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank, count(*) OVER (PARTITION BY id) AS forms FROM f),
m AS (SELECT id, string_agg(line || CASE WHEN n > 1 THEN ' [x' || n || ']' ELSE '' END, chr(10) ORDER BY rank) || CASE WHEN max(forms) > 80 THEN chr(10) || '[...' || (max(forms) - 80) || ' more unique log lines omitted]' ELSE '' END AS made FROM k WHERE rank <= 80 GROUP BY id)
SELECT t.id, md5(CASE WHEN made <> '' AND strlen(made) < strlen(text) THEN made ELSE text END) AS reduced FROM t JOIN m USING (id)""")
def log_output(spark, sf):
    return R.log_output(_texts(spark, sf)).select("id", F.md5("reduced").alias("reduced"))


@query(_T + r""", l AS (SELECT id, unnest(string_split(text, chr(10))) AS row FROM t),
m AS (SELECT id, regexp_extract(row, '^([^:]+):(\d+):(.*)$', 1) AS file, regexp_extract(row, '^([^:]+):(\d+):(.*)$', 2)::BIGINT AS line, regexp_extract(row, '^([^:]+):(\d+):(.*)$', 3) AS content FROM l WHERE regexp_matches(row, '^([^:]+):(\d+):(.*)$')),
r AS (SELECT *, count(*) OVER (PARTITION BY id, file) AS file_matches, row_number() OVER (PARTITION BY id, file ORDER BY line, content) AS a, row_number() OVER (PARTITION BY id, file ORDER BY line DESC, content DESC) AS z FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY id, file ORDER BY (a = 1 OR z = 1) DESC, contains(content, 'error') DESC, line, content) AS rank FROM r)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY file, line, content) AS place, file, line, content, file_matches FROM k WHERE rank <= 2""")
def search_top(spark, sf):
    """Canonical matches, two of each file, of all files; what stands before the first colon is the file, and lines are whole."""
    return R.search_top_of(_texts(spark, sf), per_file=2, files=None, match=r"(?d)^([^:]+):(\d+):(.*)$", ends=False)


_LINT = {"id": "event_id", "n": "CAST(event_id % 30 AS INT)", "w": "CAST(event_id % 7 AS INT)"}


@query(f"""WITH {cte('e', _LINT)}, p AS (SELECT id, 'a.js' AS file, i AS line, 'error' AS severity, 'no-x' AS rule, n AS errors, w AS warnings, n AS total, i AS k, 20 AS room FROM e, range(1, 31) g(i) WHERE i <= n
UNION ALL SELECT id, 'b.js', i, 'warning', '-', n, w, w, i, greatest(20 - least(n, 20), 0) FROM e, range(1, 8) g(i) WHERE i <= w)
SELECT id, file, line::INT AS line, severity, rule, errors::BIGINT AS errors, warnings::BIGINT AS warnings, room > 0 AND (total <= room OR k <= room - least(4, room) OR k > total - least(4, room)) AS kept FROM p""")
def lint_json(spark, sf):
    item = lambda rule, severity: lambda i: F.struct(F.lit(rule).alias("ruleId"), F.lit(severity).alias("severity"), F.lit("m").alias("message"), i.alias("line"), F.lit(1).alias("column"))
    listed = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), f)
    files = F.array(F.struct(F.lit("a.js").alias("filePath"), listed(F.col("n"), item("no-x", 2)).alias("messages")), F.struct(F.lit("b.js").alias("filePath"), listed(F.col("w"), item("", 1)).alias("messages")))
    return R.lint_json(view(spark, sf, _LINT).select("id", F.to_json(files).alias("text"))).select("id", "file", "line", "severity", "rule", "errors", "warnings", "kept")


@query(r"""
WITH p AS (SELECT conv_id, role, CASE WHEN role = 'user' AND turn > 0 THEN 'do the same thing again ' || turn % 2 ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
u AS (SELECT conv_id, pos, list_distinct(list_filter(regexp_split_to_array(coalesce(lower(text), ''), '[ \t\n\r]+'), lambda x: x <> '')) AS w FROM p WHERE role = 'user'),
l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY pos) AS b FROM u),
j AS (SELECT *, CASE WHEN b IS NULL OR len(list_distinct(list_concat(w, b))) = 0 THEN 1 WHEN len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) < 0.7 THEN 1 ELSE 0 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM j),
s AS (SELECT conv_id, pos, min(pos) OVER (PARTITION BY conv_id, run) AS first, count(*) OVER (PARTITION BY conv_id, run) AS streak FROM r)
SELECT p.conv_id, p.pos::INT AS pos, s.streak, md5(CASE WHEN s.streak >= 2 AND p.pos > s.first THEN '[Near-duplicate of message ' || s.first || ' - collapsed at message ' || p.pos || ']' ELSE p.text END) AS shown FROM p LEFT JOIN s USING (conv_id, pos)""")
def collapsed_loops(spark, sf):
    """User turns that say the same again; here from two on and at a similarity of 0.7, as conversations are short."""
    said = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.concat(F.lit("do the same thing again "), F.col("turn") % 2)).otherwise(F.col("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", said.alias("text"))
    return R.collapsed_loops(turns, least=0.7, streak=2).select("conv_id", "pos", "streak", F.md5("shown").alias("shown"))


@query(f"""WITH {cte('e', CALLS)}, c AS (SELECT session, id, CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END AS role, id % 3 = 2 AS result, repeat('x', (id * 97 % 6000)::INT) AS text, row_number() OVER (PARTITION BY session ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM e),
s AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY session) // 4 >= 1024 AS long, CASE WHEN n > 1 THEN i * 100 // (n - 1) ELSE 0 END + CASE role WHEN 'user' THEN 70 WHEN 'assistant' THEN 90 ELSE 80 END + CASE WHEN result AND strlen(text) >= 5120 THEN 1000 + strlen(text) // 1024 WHEN strlen(text) > 1024 THEN strlen(text) // 2048 ELSE 0 END AS score FROM c)
SELECT session, id, long AND row_number() OVER (PARTITION BY session ORDER BY score DESC, i DESC) <= 4 AS breakpoint FROM s""")
def cache_breakpoints(spark, sf):
    role = F.when(F.col("id") % 3 == 0, "user").when(F.col("id") % 3 == 1, "assistant").otherwise("tool")
    rows = view(spark, sf, CALLS).select("session", "id", role.alias("role"), F.when(F.col("id") % 3 == 2, "tool_result").otherwise("text").alias("kind"), F.repeat(F.lit("x"), (F.col("id") * 97 % 6000).cast("int")).alias("text"))
    return R.cache_breakpoints(rows, at="id").select("session", "id", "breakpoint")


@query(f"""WITH {cte('q', REQUESTS)} SELECT id, CASE WHEN id % 12 < 8 THEN 6 ELSE greatest(3, least(12, 6 + round((0.3 * least(greatest((id % 20 - 1) / 14.0, 0), 1) + 0.3 * least(greatest((id % 9 - 1) / 7.0, 0), 1) + 0.4 * ((id % 11) / 10.0)) * 4) - 2)) END::INT AS size,
  id % 8 >= 5 AND (id % 4) / nullif(id % 8, 0) >= 1 - least(greatest((id % 15) / 10.0, 0), 1) AS full_pass,
  CASE WHEN original < 60 THEN original || 's' WHEN original * 9 < 3600 THEN (original * 9) // 60 || 'm ' || (original * 9) % 60 || 's' ELSE (original * 9) // 3600 || 'h ' || (original * 9) // 60 % 60 || 'm' END AS took,
  format('{{:,}}', original * 1000) AS tokens, sha256(strlen(provider) || ':' || provider || strlen(route) || ':' || route || strlen(command) || ':' || command) AS key FROM q""")
def request_facts(spark, sf):
    """Window size, break-even, formats and the key of a request."""
    c = F.col("id")
    rows = view(spark, sf, REQUESTS)
    return rows.select(
        "id",
        R.window_size(c % 12, c % 20, c % 9, (c % 11) / 10.0).alias("size"),
        R.full_pass(c % 8, c % 4, (c % 15) / 10.0).alias("full_pass"),
        R.duration(F.col("original") * 9).alias("took"),
        R.thousands(F.col("original") * 1000).alias("tokens"),
        R.request_key(F.col("provider"), F.col("route"), F.col("command")).alias("key"),
    )


@query()
def near_leaders(spark, sf):
    """Turns that repeat earlier ones of their source's documents, exactly or nearly, by ordered leaders."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    return neardup.leaders(docs, "source", "doc_id")
