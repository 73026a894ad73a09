"""Request bodies, event streams, packed payloads and folders of texts as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>"
_MESSAGE = "struct<role:string,content:string,type:string,name:string,arguments:string,output:string,call_id:string,tool_call_id:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>"


def messages(bodies: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """id_col, msg, block, role, type, text, tool_name, tool_input, tool_use_id of every content block of request bodies.

    A body holds `messages` with a string or a list of blocks as content, or `input`: a string or items of
    kind message, function_call and function_call_output. A message's `tool_calls` are blocks behind its
    text (an empty one if it has none); calls without an id or a name are left out. A message of role
    `tool` is the result of its `tool_call_id`. Bodies that aren't JSON have no rows.
    """
    body = F.col(body_col)
    listed = F.coalesce(F.get_json_object(body, "$.messages"), F.get_json_object(body, "$.input"))
    whole = F.from_json(listed, f"array<{_MESSAGE}>")
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("user").alias("role"), listed.alias("content"))), _MESSAGE))
    items = bodies.select(F.col(id_col), F.posexplode(F.when(F.startswith(F.trim(listed), F.lit("[")), whole).when(listed.isNotNull(), plain)).alias("msg", "m"))
    content = F.col("m.content")
    blocks = F.from_json(content, f"array<{_BLOCK}>")
    made = lambda **v: F.struct(*[v.get(n, F.lit(None).cast("string")).alias(n) for n in ("type", "text", "id", "name", "input", "tool_use_id", "content")])
    named = F.filter("m.tool_calls", lambda c: (F.coalesce(c["id"], F.lit("")) != "") & (F.coalesce(c["function"]["name"], F.lit("")) != ""))
    calls = F.transform(named, lambda c: made(type=F.lit("tool_use"), id=c["id"], name=c["function"]["name"], input=c["function"]["arguments"]))
    item = (
        F.when(F.col("m.type") == "function_call", F.array(made(type=F.lit("tool_use"), id=F.col("m.call_id"), name=F.col("m.name"), input=F.col("m.arguments"))))
        .when(F.col("m.type") == "function_call_output", F.array(made(type=F.lit("tool_result"), tool_use_id=F.col("m.call_id"), content=F.col("m.output"))))
        .when((F.col("m.role") == "tool") & F.col("m.tool_call_id").isNotNull(), F.array(made(type=F.lit("tool_result"), tool_use_id=F.col("m.tool_call_id"), content=content)))
        .when(F.size("m.tool_calls") > 0, F.concat(F.array(made(type=F.lit("text"), text=content)), calls))
        .when(F.startswith(F.trim(content), F.lit("[")) & blocks.isNotNull(), blocks)
        .otherwise(F.array(made(type=F.lit("text"), text=content)))
    )
    role = F.when(F.col("m.type") == "function_call", F.lit("assistant")).when(F.col("m.type") == "function_call_output", F.lit("tool")).otherwise(F.col("m.role"))
    flat = items.select(id_col, "msg", role.alias("role"), F.posexplode(item).alias("block", "b"))
    kind = F.when(F.col("b.type").isin("input_text", "output_text"), F.lit("text")).otherwise(F.col("b.type"))
    return flat.select(id_col, "msg", "block", "role", kind.alias("type"), F.coalesce("b.text", "b.content", F.lit("")).alias("text"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"), F.coalesce("b.tool_use_id", "b.id").alias("tool_use_id"))


def bodies(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The inverse: id_col and a body of messages with their blocks in order. A request is one row, so its blocks meet in one task."""
    block = F.struct("type", "text", F.col("tool_name").alias("name"), F.col("tool_input").alias("input"), "tool_use_id")
    by_message = rows.groupBy(id_col, "msg").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("block", block.alias("b")))).alias("bs"))
    message = F.struct("msg", F.struct("role", F.transform("bs", lambda x: x["b"]).alias("content")).alias("m"))
    return by_message.groupBy(id_col).agg(F.sort_array(F.collect_list(message)).alias("ms")).select(id_col, F.to_json(F.struct(F.transform("ms", lambda x: x["m"]).alias("messages"))).alias("body"))


def has_type(blocks: Column, kind: str) -> Column:
    """Some block of an array of blocks is of the kind."""
    return F.exists(blocks, lambda b: b["type"] == kind)


def text_of(blocks: Column) -> Column:
    """The texts of text blocks that aren't empty, one below the other."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"]), "\n")


def server_events(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """event and data of the lines of a server-sent event stream that carry data; the closing mark isn't one."""
    data = F.btrim(F.regexp_extract(F.col(line_col), r"^data:(.*)$", 1))
    rows = lines.filter(F.startswith(F.col(line_col), F.lit("data:"))).select(*[c for c in lines.columns if c != line_col], data.alias("data"))
    return rows.filter((F.col("data") != "") & (F.col("data") != "[DONE]")).withColumn("event", F.get_json_object("data", "$.type"))


def unpack(packed: Column) -> Column:
    """The text of a gzip stream in base64; null if it isn't one."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        import base64
        import gzip

        def one(x):
            try:
                return gzip.decompress(base64.b64decode(x, validate=True)).decode("utf-8", "replace")
            except (ValueError, OSError, EOFError, TypeError):
                return None

        return column.map(one, na_action="ignore")

    return run(packed)


def corpus(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, bytes and text of every file below a folder, of those whose name fits if a pattern is given."""
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))


def period_bounds(period: str, now: Column) -> tuple[Column, Column]:
    """First and last time of a period, both inclusive: today from midnight, week and month 7 and 30 days back, all from the epoch."""
    starts = {"today": F.date_trunc("day", now), "week": now - F.expr("INTERVAL 7 DAYS"), "month": now - F.expr("INTERVAL 30 DAYS"), "all": F.lit("1970-01-01").cast("timestamp")}
    if period not in starts:
        raise ValueError(f"unknown period {period}")
    return starts[period], now


def read_days(spark: SparkSession, path: str, period: str, today: str) -> DataFrame:
    """The lines of the days (folders dt=...) of a period; days without a folder have none. Only the period's folders are read."""
    days = {"today": 0, "week": 6, "month": 29}
    rows = spark.read.option("basePath", path).text(path)
    if period == "all":
        return rows
    first = F.date_sub(F.lit(today).cast("date"), days[period])
    return rows.filter(F.col("dt").cast("date").between(first, F.lit(today).cast("date")))


def append_log(rows: DataFrame, path: str, session: str = "session") -> None:
    """Append decision rows as JSON lines, a folder per session, as replay reads them."""
    rows.write.mode("append").partitionBy(session).json(path)


def drift(a: str, b: str, columns: list[str]) -> Column:
    """array<struct<field, before, after>> of the columns in which two struct columns differ, nulls being values."""
    left, right = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return F.array_compact(F.array(*[F.when(~left(c).eqNullSafe(right(c)), F.struct(F.lit(c).alias("field"), left(c).cast("string").alias("before"), right(c).cast("string").alias("after"))) for c in columns]))


def cache_safe(body: Column) -> Column:
    """A request may be answered from a cache: temperature is 0 and said, no tools, no stream, at most one answer, no server state."""
    field = lambda p: F.get_json_object(body, p)
    none = lambda p: F.coalesce(field(p), F.lit("[]")).isin("[]", "null")
    return F.coalesce(
        (field("$.temperature").cast("double") == 0) & none("$.tools") & (F.coalesce(field("$.stream"), F.lit("false")) == "false") & (F.coalesce(field("$.n").cast("int"), F.lit(1)) <= 1) & field("$.previous_response_id").isNull(),
        F.lit(False),
    )
