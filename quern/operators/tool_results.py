"""The type of a tool's result, and the reducers of version-control and test output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.commands import _is_json, _trim
from quern.operators.reducers import by_id, named, rows_of, shorter

# Tools by type, and patterns of contents in the order in which they are tried.
READERS, SEARCHERS, LISTERS = ["read", "view", "readfile", "cat"], ["grep", "glob", "search", "find"], ["ls", "list"]
GIT_BRANCH = r"^(On branch|HEAD detached|nothing to commit|Changes (?:not staged|to be committed)|Your branch)"
GIT_DIFF = r"^(diff --git\s|commit [0-9a-f]{6,40}\s*$|Author:\s|Date:\s)"
TESTED = r"(^(?:PASS|FAIL|ok\s+\S)|\d+\s+(?:passed|failed|skipped)|^---\s+(?:PASS|FAIL):|^test result:|^\s*\d+\s+tests?\s+(?:passed|failed))"
BUILT = r"([a-zA-Z0-9_./\\]+\.(?:go|rs|ts|js|cpp|c|java):\d+:\d+:\s|error\[E\d+\]|error TS\d+|^\s*\^\s*error:)"
LINTED = r"(no-[a-z][\w-]{2,}|[A-Z]\d{3,4}\b|@[\w-]+/[\w-]+\s+error|warning\[clippy::)"
LISTED = r"^(total \d+$|[-dlcbsp][rwx-]{9}\s+\d+\s+\w+)"
LOGGED = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}"
# Lines of version control, and of tests.
COMMIT = r"^(commit [0-9a-f]{6,40}|Author:|Date:|Merge:)"
BRANCH = r"^(On branch|HEAD detached|Your branch|nothing to commit|Changes)"
STATS = r"\d+ files? changed"
FILES = r"^(create mode|delete mode|rename |mode change )"
MARK = r"^(diff --git|--- |\+\+\+ )"
SUMMARY = r"(?i)(^\s*\d+\s+tests?\s+(?:passed|failed|skipped)|^ok\s+|^FAIL\s+|^test result:|\d+\s+passed,\s+\d+\s+failed)"
FAILED = r"(^---\s+FAIL:|^FAIL\t|^\s+Error:|panic:|\bFAILED\b)"
PASSED = r"^---\s+PASS:"
DIFF_LINES, FAILURE_LINES = 60, 40

#: Lines end with a newline only.
_M = "(?md)"


def result_type(text: Column, tool: Column | None = None) -> Column:
    """One of ten types of a result, by the tool's name if that tells, else by the text; null texts are empty."""
    t = F.coalesce(text, F.lit(""))
    trimmed = _trim(t)
    name = F.lower(F.coalesce(tool, F.lit(""))) if tool is not None else F.lit("")
    says = lambda x, p: x.rlike(_M + p)
    return (
        F.when(name.isin(READERS), "file_read")
        .when(name.isin(SEARCHERS), "search_result")
        .when(name.isin(LISTERS), "dir_listing")
        .when(trimmed == "", "command_output")
        .when(trimmed.rlike(r"^[{\[]") & _is_json(trimmed), "json_data")
        .when(says(trimmed, GIT_BRANCH) | says(t, GIT_DIFF), "git_output")
        .when(says(t, TESTED), "test_output")
        .when(says(t, BUILT), "build_output")
        .when(says(t, LINTED), "lint_output")
        .when(says(trimmed, LISTED), "dir_listing")
        .when(says(trimmed, LOGGED), "log_output")
        .otherwise("command_output")
    )


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.rtrim("line", F.lit("\r")))


def _joined(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """id and reduced: the kept lines (section, pos, line) of each text in order, where that is shorter."""
    made = kept.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "pos", "line"))), lambda x: x["line"]), "\n").alias("made"))
    return texts.join(made, "id", "left").select("id", shorter(F.coalesce("made", F.lit("")), F.col("text")).alias("reduced"))


def _marked(texts: DataFrame, kind: Column, any_of: list[str]) -> DataFrame:
    """id, text, __lines (struct pos, kind, line of each line), __marks (those that have a kind) and __end, of texts that
    hold a line of one of the patterns; null for others, whose lines aren't looked at. kind is a Column over `line`."""
    says = F.lit(False)
    for p in any_of:
        says = says | F.col("text").rlike(p.replace("(?i)", "(?mdi)", 1) if p.startswith("(?i)") else _M + p)
    lines = F.transform(F.when(says, rows_of(F.col("text"))), lambda x, i: F.struct(i.alias("pos"), kind(x).alias("kind"), x.alias("line")))
    return texts.select("id", "text", lines.alias("__lines"))


def _runs(lines: str, marks: Column, first: Column) -> Column:
    """The lines from each mark to the next one, of the marks whose kind is `first`."""
    pair = lambda m, z: F.struct(m["kind"].alias("kind"), m["pos"].alias("a"), F.coalesce(z["pos"], F.size(lines)).alias("z"))
    spans = named(marks, lambda all: F.zip_with(all, F.slice(all, F.lit(2), F.size(all)), pair))
    return F.flatten(F.transform(F.filter(spans, lambda s: s["kind"] == first), lambda s: F.slice(lines, s["a"] + 1, s["z"] - s["a"])))


def git_output(texts: DataFrame, aggressive: bool = False) -> DataFrame:
    """id and reduced: headers, file modes, the first DIFF_LINES lines of diffs (none if aggressive), and totals.

    texts: id, text. A line between is part of a diff from its file header to the next commit or mode line.
    A text is reduced in its row; only texts that share an id, whose lines are one output, are taken apart.
    """
    kind = lambda x: F.when(x.rlike(COMMIT) | x.rlike(BRANCH), 0).when(x.rlike(STATS), 4).when(x.rlike(FILES), 1).when(x.rlike(MARK), 2)

    def alone(some: DataFrame) -> DataFrame:
        staged = _marked(some, kind, [COMMIT, BRANCH, STATS, FILES, MARK])
        marks = F.filter("__lines", lambda r: r["kind"].isin(0, 1, 2))
        diffs = F.filter(_runs("__lines", marks, F.lit(2)), lambda r: r["kind"].isNull() | (r["kind"] == 2))
        staged = staged.withColumn("__diffs", diffs if not aggressive else F.slice(diffs, 1, 0))
        of = lambda rows: F.transform(rows, lambda r: r["line"])
        section = lambda k: of(F.filter("__lines", lambda r: r["kind"] == k))
        note = F.when(F.size("__diffs") >= DIFF_LINES, F.array(F.lit(f"[diff truncated, {DIFF_LINES} lines shown]"))).otherwise(F.array().cast("array<string>"))
        made = F.array_join(F.concat(section(0), section(1), of(F.slice("__diffs", 1, DIFF_LINES)), note, section(4)), "\n")
        return staged.select("id", shorter(F.coalesce(made, F.lit("")), F.col("text")).alias("reduced"))

    return by_id(texts, "id", alone, lambda some: _git_output(some, kind(F.col("line")), aggressive))


def _git_output(texts: DataFrame, kind: Column, aggressive: bool) -> DataFrame:
    """git_output over rows of lines."""
    at = Window.partitionBy("id").orderBy("pos")
    rows = _lines(texts).withColumn("kind", kind)
    inside = F.last(F.when(F.col("kind").isin(0, 1), False).when(F.col("kind") == 2, True), ignorenulls=True).over(at)
    rows = rows.withColumn("diff", (F.col("kind") == 2) | (F.col("kind").isNull() & F.coalesce(inside, F.lit(False))))
    rows = rows.withColumn("diff", F.coalesce("diff", F.lit(False))).withColumn("nth", F.sum(F.col("diff").cast("int")).over(at))
    section = F.when(F.col("kind").isin(0, 1, 4), F.col("kind")).when(F.col("diff") & (F.col("nth") <= DIFF_LINES) & F.lit(not aggressive), 2)
    kept = rows.select("id", section.alias("section"), "pos", "line", "nth").filter("section is not null")
    note = kept.filter(f"section = 2 and nth = {DIFF_LINES}").select("id", F.lit(3).alias("section"), F.lit(0).alias("pos"), F.lit(f"[diff truncated, {DIFF_LINES} lines shown]").alias("line"))
    return _joined(texts, kept.drop("nth").unionByName(note))


def test_output(texts: DataFrame, aggressive: bool = False) -> DataFrame:
    """id and reduced: failures with what follows them (FAILURE_LINES lines in all), passes (not if aggressive), then summaries. texts: id, text.

    A text is reduced in its row; only texts that share an id, whose lines are one output, are taken apart.
    """
    kind = lambda x: F.when(x.rlike(SUMMARY), "summary").when(x.rlike(FAILED), "fail").when(x.rlike(PASSED), "pass")

    def alone(some: DataFrame) -> DataFrame:
        staged = _marked(some, kind, [SUMMARY, FAILED, PASSED])
        failures = _runs("__lines", F.filter("__lines", lambda r: r["kind"].isNotNull()), F.lit("fail"))
        kept = named(failures, lambda all: F.filter(all, lambda r, i: (r["kind"] == "fail") | (i < FAILURE_LINES)))
        passes = F.filter("__lines", lambda r: (r["kind"] == "pass") & F.lit(not aggressive))
        of = lambda rows: F.transform(rows, lambda r: r["line"])
        made = F.array_join(F.concat(of(F.sort_array(F.concat(kept, passes))), of(F.filter("__lines", lambda r: r["kind"] == "summary"))), "\n")
        return staged.select("id", shorter(F.coalesce(made, F.lit("")), F.col("text")).alias("reduced"))

    return by_id(texts, "id", alone, lambda some: _test_output(some, kind(F.col("line")), aggressive))


def _test_output(texts: DataFrame, kind: Column, aggressive: bool) -> DataFrame:
    """test_output over rows of lines."""
    at = Window.partitionBy("id").orderBy("pos")
    rows = _lines(texts).withColumn("kind", kind)
    failing = F.coalesce(F.last(F.when(F.col("kind").isNotNull(), F.col("kind") == "fail"), ignorenulls=True).over(at), F.lit(False))
    rows = rows.withColumn("failure", failing).withColumn("nth", F.sum(F.col("failure").cast("int")).over(at))
    section = F.when(F.col("kind") == "summary", 1).when((F.col("kind") == "fail") | ((F.col("kind") == "pass") & F.lit(not aggressive)) | (F.col("kind").isNull() & F.col("failure") & (F.col("nth") <= FAILURE_LINES)), 0)
    return _joined(texts, rows.select("id", section.alias("section"), "pos", "line").filter("section is not null"))


test_output.__test__ = False
