"""The register of queries, and views of the test tables in the shapes that the operators read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Request rows made of events: columns as expressions that Spark and DuckDB read alike.
REQUESTS = {
    "id": "event_id",
    "session": "user_id",
    "ts": "ts",
    "kind": "CASE event_id % 9 WHEN 0 THEN 'cache_hit' WHEN 1 THEN 'secret' WHEN 2 THEN 'error' WHEN 3 THEN 'rate_limit_retry' WHEN 4 THEN 'overflow_retry' ELSE 'request' END",
    "provider": "CASE event_type WHEN 'view' THEN 'anthropic' WHEN 'click' THEN 'openai' WHEN 'purchase' THEN 'google' WHEN 'signup' THEN 'local' ELSE '' END",
    "source": "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'proxy' WHEN 2 THEN 'transparent_connect' ELSE 'hook' END",
    "model": "CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'small' WHEN 2 THEN 'large' ELSE 'middle' END",
    "route": "CASE event_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'websocket' ELSE '' END",
    "original": "200 + event_id * 37 % 1000",
    "final": "260 + event_id * 37 % 1000 - event_id * 13 % 500",
    "output": "event_id * 11 % 300",
    "estimated_output": "event_id * 7 % 200",
    "latency": "CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END",
    "hit": "event_id % 6 = 0",
    "cache_read": "CASE WHEN event_id % 3 = 0 THEN event_id * 17 % 900 ELSE 0 END",
    "cache_create": "CASE WHEN event_id % 8 = 0 THEN event_id * 19 % 700 ELSE 0 END",
    "cached": "event_id * 5 % 60",
    "layer": "event_id % 5",
    "l1_saved": "event_id * 3 % 40 - 10",
    "secrets": "event_id % 4",
    "applied": "event_id % 4 = 1",
    "reason": "CASE event_id % 4 WHEN 1 THEN 'fits' WHEN 2 THEN 'too_short' WHEN 3 THEN 'excluded' ELSE '' END",
    "profile": "CASE event_id % 6 WHEN 0 THEN 'terse' WHEN 1 THEN 'plain' ELSE '' END",
    "shape": "CASE event_id % 10 WHEN 0 THEN 'review' WHEN 5 THEN 'planning' ELSE '' END",
    "added": "event_id % 25",
    "prefix": "CASE WHEN event_id % 5 = 0 THEN '' ELSE 'p' || event_id % 17 END",
    "prefix_tokens": "event_id * 23 % 5000",
    "hint": "event_id % 3 = 1",
    "hint_reason": "CASE WHEN event_id % 3 = 2 THEN 'cold' ELSE '' END",
    "command": "CASE event_id % 12 WHEN 0 THEN 'git status' WHEN 1 THEN 'cargo test' WHEN 2 THEN 'npm run build' WHEN 3 THEN 'go test ./...' WHEN 4 THEN 'pytest -q' WHEN 5 THEN 'docker ps' WHEN 6 THEN 'make all' WHEN 7 THEN 'ls -la' WHEN 8 THEN 'psql -c x' WHEN 9 THEN 'terraform plan' WHEN 10 THEN 'tsc --noEmit' ELSE 'bash run.sh' END",
    "project": "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/home/u/app' ELSE '\\home\\u\\app\\sub' END",
    "outcome": "CASE event_id % 3 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'matched' ELSE 'failed' END",
}
#: Tool calls made of events: reads, edits and runs of a session.
CALLS = {
    "id": "event_id",
    "session": "user_id",
    "op": "CASE event_type WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'write' WHEN 'error' THEN 'run' ELSE 'read' END",
    "path": "'src/f' || event_id % 3 || '.go'",
    "command": "CASE event_id % 4 WHEN 0 THEN 'git status' WHEN 1 THEN 'cargo test' WHEN 2 THEN 'date' ELSE 'ls' END",
    "output": "CASE WHEN event_id % 6 = 0 THEN '  ' || props || ' ' ELSE props END",
    "input": "CASE WHEN event_id % 2 = 0 THEN '{\"b\":1,\"a\":' || event_id % 5 || '}' ELSE '{ \"a\" : ' || event_id % 5 || ', \"b\" : 1 }' END",
    "said": "CASE WHEN event_id % 50 = 0 THEN 'see Message ' || event_id % 20 WHEN event_id % 77 = 0 THEN 'as in [' || event_id % 9 || ']' ELSE 'done' END",
}


def _java(expression: str) -> str:
    return expression.replace("\\", "\\\\")


def columns(expressions: dict[str, str]) -> list[str]:
    """The columns of one of the above as Spark reads them."""
    return [f"{_java(e)} AS {name}" for name, e in expressions.items()]


def view(spark: SparkSession, sf: str, expressions: dict[str, str]) -> DataFrame:
    """events with the columns of one of the above."""
    return table(spark, sf, "events").selectExpr(*columns(expressions))


def cte(name: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM events)"
