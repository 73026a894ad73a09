"""Reducers of command output and of conversations: Columns where a text is enough, DataFrames where rows meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import jaccard, words
from quern.session import cut

# What the lines of outputs look like.
BUILD_PROBLEM = r"(?i)(error:|: error |^error\[)|(warning:|: warning )"
BUILD_INFO = r"(?i)(^Compiling|^Finished|^Running|^Building)"
LINT_PROBLEM = r"[a-zA-Z0-9_./\\]+:\d+:\d+.*(?:error|warning|info)"
LINT_SUMMARY = r"(?i)(\d+\s+(?:error|warning|problem)|✖|✓)"
LOG_TIME = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
DIR_ENTRY = r"^[-dlcbsp][rwx-]{9}\s"
MATCH = r"(?d)^((?:[A-Za-z]:[\\/])?[^:]+):(\d+):(.*)$"
# The same over whole texts, lines ending with a newline only: entries of a listing, and folders among them
# (a carriage return counts as a blank if something follows it, as those at the end of a line are cut off).
LISTED_ROW, LISTED_FOLDER = r"(?md)^(?!total )[^ \t\n\f\r]", r"(?md)^d[rwx-]{9}(?:[ \t\f]|\r+[^\r\n])"
#: Whether a line has a LINT_PROBLEM; one character in front of the colon is enough to tell.
LINT_PLACE = r"(?d)[a-zA-Z0-9_./\\]:\d+:\d.*(?:error|warning|info)"
#: Roles by the bonus of a cache breakpoint.
ROLE_BONUS = {"assistant": 90, "tool": 80, "user": 70, "system": 40}
#: Characters of a token, tokens of the shortest prefix, breakpoints, and characters of a large tool result.
CHARS, PREFIX_TOKENS, BREAKPOINTS, LARGE_RESULT = 4, 1024, 4, 5120


def named(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), make)[0]


def shorter(made: Column, text: Column) -> Column:
    """What was made of a text if there is something and it has fewer bytes."""
    return named(made, lambda m: F.when((m != "") & (F.octet_length(m) < F.octet_length(text)), m).otherwise(text))


def rows_of(text: Column, ends: bool = True) -> Column:
    """The lines of a text, without carriage returns at their ends (with them if not `ends`)."""
    lines = F.split(text, "\n")
    if not ends:
        return lines
    return F.when(F.contains(text, F.lit("\r")), F.transform(lines, lambda x: F.rtrim(x, F.lit("\r")))).otherwise(lines)


def by_id(texts: DataFrame, id_col: str, alone: Callable[[DataFrame], DataFrame], together: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """alone(texts) of the texts whose id no other text has: a text is one row there and isn't shuffled. together(texts)
    of the others, if there are any. Ids are counted by their hashes, so only numbers are shuffled for that."""
    key = F.xxhash64(id_col)
    many = texts.select(key.alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__key")
    if many.isEmpty():
        return alone(texts)
    keyed, many = texts.withColumn("__key", key), cut(many)
    return alone(keyed.join(many, "__key", "left_anti").drop("__key")).unionByName(together(keyed.join(many, "__key", "left_semi").drop("__key")))


def _capped(rows: Column, cap: int, note: str) -> Column:
    return F.concat(F.slice(rows, 1, cap), F.when(F.size(rows) >= cap, F.array(F.lit(note))).otherwise(F.array().cast("array<string>")))


def _problems(text: Column, problem: str, info: str, cap: int, note: str, infos: bool = True) -> Column:
    """The problem lines, `cap` at most, then the others that tell something; each line is tried once a pattern, texts without either not at all."""
    kinds = lambda x: F.struct(x.alias("x"), F.when(x.rlike(problem), 0).when(x.rlike(info), 1).alias("k"))
    pick = lambda rows, k: F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["x"])
    made = named(F.filter(F.transform(rows_of(text), kinds), lambda r: r["k"].isNotNull()), lambda rows: named(pick(rows, 0), lambda p: F.array_join(F.concat(_capped(p, cap, note), pick(rows, 1)) if infos else _capped(p, cap, note), "\n")))
    return F.when(text.rlike(f"(?m){problem}") | text.rlike(f"(?m){info}"), shorter(made, text)).otherwise(text)


def build_output(text: Column, old: bool = False) -> Column:
    """Errors and warnings of a build (50 at most, 20 if old), then what it did (not if old)."""
    return _problems(text, BUILD_PROBLEM, BUILD_INFO, 20 if old else 50, "[...additional errors omitted]", infos=not old)


def lint_output(text: Column, old: bool = False) -> Column:
    """Violations of a linter (60 at most, 20 if old) and its summary lines."""
    cap = 20 if old else 60
    return _problems(text, LINT_PLACE, LINT_SUMMARY, cap, f"[{cap} violations shown, remainder omitted]")


def dir_output(text: Column, old: bool = False) -> Column:
    """How many files and folders a listing has, if they are over 20 or the listing is old."""
    counts = F.struct(F.regexp_count(text, F.lit(LISTED_ROW)).alias("all"), F.regexp_count(text, F.lit(LISTED_FOLDER)).alias("folders"))
    made = lambda n: F.concat(F.lit("[directory: "), n["all"] - n["folders"], F.lit(" files, "), n["folders"], F.lit(" dirs]"))
    return named(counts, lambda n: F.when(F.lit(old) | (n["all"] > 20), shorter(made(n), text)).otherwise(text))


def log_output(texts: DataFrame, id_col: str = "id", text_col: str = "text", old: bool = False) -> DataFrame:
    """id_col and reduced: lines that differ in their times only once, with [xN], 80 of them (30 if old), if that is shorter.

    A text is reduced in its row; only texts that share an id, whose lines are one output, are taken apart.
    """
    limit = 30 if old else 80

    def alone(some: DataFrame) -> DataFrame:
        text = F.col(text_col)
        # No time spans lines, so all are replaced at once.
        staged = some.select(id_col, text_col, rows_of(text).alias("__rows"), rows_of(F.regexp_replace(text, LOG_TIME, "<T>")).alias("__forms"))
        staged = staged.withColumn("__distinct", F.array_distinct("__forms"))
        times = lambda f: F.size(F.filter("__forms", lambda x: x == f))
        line = lambda f: F.element_at("__rows", F.array_position("__forms", f).cast("int"))
        shown = lambda f: named(times(f), lambda n: F.when(n > 1, F.concat(line(f), F.lit(" [x"), n, F.lit("]"))).otherwise(line(f)))
        some = F.when(F.size("__distinct") == F.size("__forms"), F.slice("__rows", 1, limit)).otherwise(F.transform(F.slice("__distinct", 1, limit), shown))
        more = F.when(F.size("__distinct") > limit, F.array(F.concat(F.lit("[..."), F.size("__distinct") - limit, F.lit(" more unique log lines omitted]")))).otherwise(F.array().cast("array<string>"))
        return staged.select(id_col, shorter(F.coalesce(F.array_join(F.concat(some, more), "\n"), F.lit("")), text).alias("reduced"))

    return by_id(texts, id_col, alone, lambda some: _log_output(some, id_col, text_col, limit))


def _log_output(texts: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """log_output over rows of lines."""
    rows = texts.select(id_col, F.posexplode(rows_of(F.col(text_col))).alias("pos", "line"))
    forms = rows.groupBy(id_col, F.regexp_replace("line", LOG_TIME, "<T>").alias("form")).agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(id_col)
    ranked = forms.withColumn("rank", F.row_number().over(of.orderBy("pos"))).withColumn("all", F.count(F.lit(1)).over(of)).filter(F.col("rank") <= limit)
    shown = F.when(F.col("n") > 1, F.concat("line", F.lit(" [x"), "n", F.lit("]"))).otherwise(F.col("line"))
    made = ranked.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", shown.alias("s")))).alias("rows"), F.first("all").alias("all"))
    more = F.when(F.col("all") > limit, F.array(F.concat(F.lit("[..."), F.col("all") - limit, F.lit(" more unique log lines omitted]")))).otherwise(F.array().cast("array<string>"))
    joined = made.select(id_col, F.array_join(F.concat(F.transform("rows", lambda r: r["s"]), more), "\n").alias("made"))
    return texts.select(id_col, text_col).join(joined, id_col, "left").select(id_col, shorter(F.coalesce("made", F.lit("")), F.col(text_col)).alias("reduced"))


def search_matches(texts: DataFrame, id_col: str = "id", text_col: str = "text", match: str = MATCH, ends: bool = True) -> DataFrame:
    """id_col, pos, file, line (number), content of every `file:line:content` line (three groups of `match`)."""
    rows = texts.select(id_col, F.posexplode(rows_of(F.col(text_col), ends)).alias("pos", "row")).filter(F.col("row").rlike(match))
    part = lambda k: F.regexp_extract("row", match, k)
    return rows.select(id_col, "pos", part(1).alias("file"), part(2).cast("long").alias("line"), part(3).alias("content"))


def search_top(matches: DataFrame, id_col: str = "id", per_file: int = 20, files: int | None = 30, important: str = r"(?i)error|fail|panic|todo|fixme") -> DataFrame:
    """The matches that stay: of each file the first, the last, then important ones, then the earliest; of a text the files with most matches.

    With file_matches (how many a file has) and place (canonical: by file, line number, content).
    """
    of_file = Window.partitionBy(id_col, "file")
    order = ["line", "content", "pos"]
    placed = matches.withColumn("__first", F.row_number().over(of_file.orderBy(*order))).withColumn("__last", F.row_number().over(of_file.orderBy(*[F.desc(c) for c in order]))).withColumn("file_matches", F.count(F.lit(1)).over(of_file))
    ends = (F.col("__first") == 1) | (F.col("__last") == 1)
    kept = placed.withColumn("__rank", F.row_number().over(of_file.orderBy(F.desc(ends), F.desc(F.col("content").rlike(important)), *order))).filter(F.col("__rank") <= per_file)
    of_text = Window.partitionBy(id_col)
    some = kept if files is None else kept.withColumn("__file", F.dense_rank().over(of_text.orderBy(F.desc("file_matches"), "file"))).filter(F.col("__file") <= files)
    return some.withColumn("place", F.row_number().over(of_text.orderBy("file", *order))).select(id_col, "place", "file", "line", "content", "file_matches")


def search_top_of(texts: DataFrame, id_col: str = "id", text_col: str = "text", per_file: int = 20, files: int | None = 30, important: str = r"(?i)error|fail|panic|todo|fixme", match: str = MATCH, ends: bool = True) -> DataFrame:
    """search_top (of all files if `files` is None) of the search_matches of texts. A text's matches are sorted and ranked in its row, in runs of a file;
    only those of texts that share an id meet by windows."""

    def alone(some: DataFrame) -> DataFrame:
        part = lambda x, k: F.regexp_extract(x, match, k)
        lines = F.filter(F.transform(rows_of(F.col(text_col), ends), lambda x, i: F.struct(x.alias("x"), i.alias("pos"))), lambda r: r["x"].rlike(match))
        found = F.transform(lines, lambda r: F.struct(part(r["x"], 1).alias("file"), part(r["x"], 2).cast("long").alias("line"), part(r["x"], 3).alias("content"), r["pos"].alias("pos")))
        staged = some.filter(F.col(text_col).rlike(r":\d+:")).select(id_col, F.sort_array(found).alias("__all"))
        # A run begins where the file isn't that of the match before.
        begins = F.filter(F.transform("__all", lambda m, i: F.when((i == 0) | (F.get("__all", i - 1)["file"] != m["file"]), i)), lambda i: i.isNotNull())
        staged = staged.withColumn("__begins", begins)
        closes = F.slice(F.concat("__begins", F.array(F.size("__all"))), F.lit(2), F.size("__begins"))
        groups = F.zip_with("__begins", closes, lambda a, z: F.slice("__all", a + 1, z - a))
        rank = lambda m, inner: F.struct(inner.alias("inner"), (~m["content"].rlike(important)).alias("plain"), m["line"].alias("line"), m["content"].alias("content"), m["pos"].alias("pos"), m["file"].alias("file"))
        best = lambda g: F.slice(F.sort_array(F.transform(g, lambda m, i: rank(m, (i > 0) & (i < F.size(g) - 1)))), 1, per_file)
        kept = F.transform(groups, lambda g: F.struct((-F.size(g)).alias("less"), g[0]["file"].alias("file"), best(g).alias("rows")))
        flat = F.flatten(F.transform(F.slice(F.sort_array(kept), 1, files) if files else kept, lambda f: F.transform(f["rows"], lambda m: F.struct(m["file"].alias("file"), m["line"].alias("line"), m["content"].alias("content"), m["pos"].alias("pos"), (-f["less"]).cast("long").alias("file_matches")))))
        out = staged.select(id_col, F.posexplode(F.sort_array(flat)).alias("__i", "m"))
        return out.select(id_col, (F.col("__i") + 1).alias("place"), "m.file", "m.line", "m.content", "m.file_matches")

    return by_id(texts, id_col, alone, lambda some: search_top(search_matches(some, id_col, text_col, match, ends), id_col, per_file, files, important))


def lint_json(texts: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = 20, tail: int = 4) -> DataFrame:
    """The problems of JSON lint reports (an array of files with messages): id_col, file, line, column, severity, rule, message, errors, warnings, kept.

    Errors go before warnings; of either the first and the last `tail` within the limit are kept. Texts that aren't such reports have no rows.
    """
    schema = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>>>"
    files = texts.select(id_col, F.posexplode(F.from_json(text_col, schema)).alias("f", "file"))
    rows = files.select(id_col, "f", F.col("file.filePath").alias("file"), F.posexplode("file.messages").alias("m", "p"))
    flat = rows.select(id_col, "f", "m", "file", "p.line", "p.column", F.when(F.col("p.severity") == 2, "error").otherwise("warning").alias("severity"), F.coalesce(F.nullif("p.ruleId", F.lit("")), F.lit("-")).alias("rule"), "p.message")
    of = Window.partitionBy(id_col, "severity")
    counts = {"errors": "error", "warnings": "warning"}
    ranked = flat.withColumn("__n", F.row_number().over(of.orderBy("f", "m"))).withColumn("__all", F.count(F.lit(1)).over(of))
    for name, severity in counts.items():
        ranked = ranked.withColumn(name, F.count_if(F.col("severity") == severity).over(Window.partitionBy(id_col)))
    room = F.when(F.col("severity") == "error", F.lit(limit)).otherwise(F.greatest(F.lit(limit) - F.least("errors", F.lit(limit)), F.lit(0)))
    last = F.least(F.lit(tail), room)
    kept = (F.col("__all") <= room) | (F.col("__n") <= room - last) | (F.col("__n") > F.col("__all") - last)
    return ranked.select(id_col, "file", "line", "column", "severity", "rule", "message", "errors", "warnings", ((room > 0) & kept).alias("kept"))


def collapsed_loops(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", least: float = 0.75, streak: int = 4) -> DataFrame:
    """turns with pos (from 0), streak (of user turns about the same) and shown: a note for those after the first of a streak of at least `streak`."""
    placed = turns.withColumn("pos", F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1)
    mine = placed.filter(F.col(role) == "user").select(session, "pos", F.array_distinct(words(F.lower(text))).alias("w"))
    at = Window.partitionBy(session).orderBy("pos")
    near = mine.withColumn("b", F.lag("w").over(at))
    runs = near.withColumn("run", F.sum(F.coalesce(jaccard(F.col("w"), F.col("b")) < least, F.lit(True)).cast("int")).over(at))
    of = Window.partitionBy(session, "run")
    marked = runs.select(session, "pos", F.min("pos").over(of).alias("first"), F.count(F.lit(1)).over(of).alias("streak"))
    out = placed.join(marked, [session, "pos"], "left")
    note = F.concat(F.lit("[Near-duplicate of message "), F.col("first"), F.lit(" - collapsed at message "), F.col("pos"), F.lit("]"))
    return out.withColumn("shown", F.when((F.col("streak") >= streak) & (F.col("pos") > F.col("first")), note).otherwise(F.col(text))).drop("first")


def cache_breakpoints(messages: DataFrame, session: str = "session", at: str = "at", hot: bool = False) -> DataFrame:
    """messages (role, kind, text of a stable prefix, a block each) with breakpoint: the next request should be cached up to here.

    None if the prefix has under 1024 tokens. Hot: the four latest that aren't empty. Else the four best by
    place, role and size (a large tool result counts most), later ones first among equals.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    of = Window.partitionBy(session)
    known = messages.withColumn("__size", size).withColumn("__all", F.sum("__size").over(of)).withColumn("__n", F.count(F.lit(1)).over(of)).withColumn("__i", F.row_number().over(of.orderBy(at)) - 1)
    bonus = F
    for role, value in ROLE_BONUS.items():
        bonus = bonus.when(F.col("role") == role, value)
    large = (F.col("kind") == "tool_result") & (F.col("__size") >= LARGE_RESULT)
    score = F.when(F.col("__n") > 1, F.expr("__i * 100 div (__n - 1)")).otherwise(0) + bonus.otherwise(0) + F.when(large, 1000 + F.expr("__size div 1024")).when(F.col("__size") > 1024, F.expr("__size div 2048")).otherwise(0)
    full = F.col("__size") > 0 if hot else F.lit(True)
    best = [F.desc(full), F.desc("__i")] if hot else [F.desc(score), F.desc("__i")]
    rank = F.row_number().over(of.orderBy(*best))
    return known.withColumn("breakpoint", (F.expr(f"__all div {CHARS}") >= PREFIX_TOKENS) & full & (rank <= BREAKPOINTS)).drop("__size", "__all", "__n", "__i")


def window_size(n: Column, paths: Column, tools: Column, anchors: Column, base: int = 6, low: int = 3, high: int = 12) -> Column:
    """Messages that stay whole: the base, moved by how many paths and tools the last ten name and how dense their anchors are."""
    norm = lambda v, lo, hi: F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    score = 0.3 * norm(paths, 1, 15) + 0.3 * norm(tools, 1, 8) + 0.4 * anchors
    moved = F.lit(base) + F.round(score * 4) - 2
    return F.when(n < base + 2, F.lit(base)).otherwise(F.least(F.greatest(moved, F.lit(low)), F.lit(high))).cast("int")


def full_pass(applied: Column, refetched: Column, ratio: Column, least: int = 5) -> Column:
    """Compacting doesn't pay: after `least` times, so many were fetched again that nothing is left of the saving."""
    share = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    return (applied >= least) & (F.try_divide(refetched, applied) >= 1 - share)


def duration(seconds: Column) -> Column:
    """42s, 3m 20s, 2h 5m."""
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s / 60) % 60, F.lit("m")))
    )


def thousands(n: Column) -> Column:
    """1,234,567."""
    return F.format_number(n, 0)


def request_key(*parts: Column) -> Column:
    """SHA-256 of parts with their lengths before them, so no two lists of parts share a text."""
    each = [F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.sha2(F.concat(*each), 256)
