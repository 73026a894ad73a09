"""Queries over tool results: types, and the reducers of version control and tests, with SQL of their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import tool_results as T
from quern.plans.base import cte, query, view
from quern.plans.reducer_queries import TEXTS
from quern.session import table

#: Outputs of version control and tests made of events.
RESULTS = {
    "id": "event_id",
    "text": """CASE event_id % 6
 WHEN 0 THEN 'commit 12ab34f' || chr(10) || 'Author: a' || chr(10) || 'Date: today' || chr(10) || chr(10) || '    message ' || event_id || chr(10) || 'diff --git a/x b/x' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || repeat('+line' || chr(13) || chr(10), CAST(event_id % 90 AS INT)) || ' 3 files changed, 2 insertions(+)' || chr(10) || 'rename a => b' || chr(10) || 'left out'
 WHEN 1 THEN 'On branch main' || chr(10) || 'Changes not staged for commit:' || chr(10) || '  (use git add)' || chr(10) || repeat('        modified: f' || chr(10), CAST(event_id % 9 AS INT))
 WHEN 2 THEN repeat('--- PASS: TestA (0.0s)' || chr(10) || 'noise of it' || chr(10), CAST(event_id % 5 AS INT)) || '--- FAIL: TestB (0.1s)' || chr(10) || repeat('    x_test.go:9: bad' || chr(10), CAST(event_id % 70 AS INT)) || 'FAIL' || chr(9) || 'pkg' || chr(10) || 'ok  	other 0.2s' || chr(10) || 'trailer'
 WHEN 3 THEN '12 passed, ' || event_id % 7 || ' failed' || chr(10) || repeat('dots', CAST(event_id % 40 AS INT))
 WHEN 4 THEN 'src/a.go:3:4: undefined' || chr(10) || 'more'
 ELSE 'E0' || (event_id % 900 + 100) || ' no-unused' END""",
}
_ALL = f"""WITH {cte('made', RESULTS)}, {cte('other', TEXTS)}, t AS (SELECT 'result' AS kind, id, text FROM made UNION ALL SELECT 'output', id, text FROM other UNION ALL SELECT 'document', doc_id, coalesce(text, '') FROM documents
  UNION ALL SELECT 'page', page_id, coalesce(html, '') FROM pages UNION ALL SELECT 'turn', conv_id * 1000 + turn, coalesce(text, '') FROM conversations)"""


def _texts(spark, sf):
    one = lambda name, kind, key, text: table(spark, sf, name).select(F.lit(kind).alias("kind"), key.cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    out = None
    for kind, columns in (("result", RESULTS), ("output", TEXTS)):
        rows = view(spark, sf, columns).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "text")
        out = rows if out is None else out.unionByName(rows)
    for args in (("documents", "document", F.col("doc_id"), "text"), ("pages", "page", F.col("page_id"), "html"), ("conversations", "turn", F.col("conv_id") * 1000 + F.col("turn"), "text")):
        out = out.unionByName(one(*args))
    return out


def _keyed(spark, sf):
    """The texts under one id, the kind in front."""
    return _texts(spark, sf).select(F.concat("kind", F.lit(" "), F.col("id").cast("string")).alias("id"), "text")


_TRIM = r"trim(text, E' \t\n\r\f' || chr(11))"


@query(_ALL + rf""", s AS (SELECT kind, id, text, {_TRIM} AS t FROM t)
SELECT kind, id, CASE WHEN t = '' THEN 'command_output' WHEN regexp_matches(t, '^[{{\[]') AND json_valid(t) THEN 'json_data' WHEN regexp_matches(t, '(?m){T.GIT_BRANCH}') OR regexp_matches(text, '(?m){T.GIT_DIFF}') THEN 'git_output'
  WHEN regexp_matches(text, '(?m){T.TESTED}') THEN 'test_output' WHEN regexp_matches(text, '(?m){T.BUILT}') THEN 'build_output' WHEN regexp_matches(text, '(?m){T.LINTED}') THEN 'lint_output'
  WHEN regexp_matches(t, '(?m){T.LISTED}') THEN 'dir_listing' WHEN regexp_matches(t, '(?m){T.LOGGED}') THEN 'log_output' ELSE 'command_output' END AS type FROM s""")
def result_types(spark, sf):
    """The type of outputs, documents, pages and turns."""
    return _texts(spark, sf).select("kind", "id", T.result_type(F.col("text")).alias("type"))


_LINES = r", x AS (SELECT kind || ' ' || id AS id, text, string_split(text, chr(10)) AS rows FROM t), l AS (SELECT id, rtrim(unnest(rows), chr(13)) AS line, unnest(range(len(rows))) AS pos FROM x)"
_MADE = "SELECT x.id, md5(CASE WHEN coalesce(made, '') <> '' AND strlen(made) < strlen(text) THEN made ELSE text END) AS reduced FROM x LEFT JOIN m USING (id)"


@query(_ALL + _LINES + rf""",
k AS (SELECT *, CASE WHEN regexp_matches(line, '{T.COMMIT}') OR regexp_matches(line, '{T.BRANCH}') THEN 0 WHEN regexp_matches(line, '{T.STATS}') THEN 4 WHEN regexp_matches(line, '{T.FILES}') THEN 1 WHEN regexp_matches(line, '{T.MARK}') THEN 2 END AS kind FROM l),
g AS (SELECT *, count(*) FILTER (kind IN (0, 1, 2)) OVER (PARTITION BY id ORDER BY pos) AS block FROM k),
d AS (SELECT *, coalesce(kind = 2 OR kind IS NULL AND max(CASE WHEN kind IN (0, 1, 2) THEN kind END) OVER (PARTITION BY id, block) = 2, false) AS diff FROM g),
n AS (SELECT *, count(*) FILTER (diff) OVER (PARTITION BY id ORDER BY pos) AS nth FROM d),
s AS (SELECT id, CASE WHEN kind IN (0, 1, 4) THEN kind WHEN diff AND nth <= 60 THEN 2 END AS section, pos, line FROM n UNION ALL SELECT id, 3, 0, '[diff truncated, 60 lines shown]' FROM n WHERE diff AND nth = 60),
m AS (SELECT id, string_agg(line, chr(10) ORDER BY section, pos) AS made FROM s WHERE section IS NOT NULL GROUP BY id) {_MADE}""")
def git_output(spark, sf):
    """Version control's output reduced; other texts have little that stays."""
    return T.git_output(_keyed(spark, sf)).select("id", F.md5("reduced").alias("reduced"))


@query(_ALL + _LINES + rf""",
k AS (SELECT *, CASE WHEN regexp_matches(line, '{T.SUMMARY}') THEN 'summary' WHEN regexp_matches(line, '{T.FAILED}') THEN 'fail' WHEN regexp_matches(line, '{T.PASSED}') THEN 'pass' END AS kind FROM l),
g AS (SELECT *, count(kind) OVER (PARTITION BY id ORDER BY pos) AS block FROM k),
f AS (SELECT *, coalesce(max(kind) OVER (PARTITION BY id, block) = 'fail', false) AS failure FROM g),
n AS (SELECT *, count(*) FILTER (failure) OVER (PARTITION BY id ORDER BY pos) AS nth FROM f),
s AS (SELECT id, CASE WHEN kind = 'summary' THEN 1 WHEN kind IS NOT NULL OR failure AND nth <= 40 THEN 0 END AS section, pos, line FROM n),
m AS (SELECT id, string_agg(line, chr(10) ORDER BY section, pos) AS made FROM s WHERE section IS NOT NULL GROUP BY id) {_MADE}""")
def test_output(spark, sf):
    """Test output reduced to failures and summaries."""
    return T.test_output(_keyed(spark, sf)).select("id", F.md5("reduced").alias("reduced"))


test_output.__test__ = False
