"""Class and signals of outputs, in staged columns: each stage is computed once and read by the next ones.

Rules over whole texts come first; lines are looked at only in texts that can have one to be found, in one pass over their array,
so the work grows with the text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.commands import ANALYZED, KEYWORDS, _analyzed, _any, _is_json, _path_start, _trim

#: Fixed values of the rules.
TESTERS = ["go", "pytest", "cargo", "npm", "pnpm", "yarn", "bun", "vitest", "jest"]
SEARCHERS, VERSIONERS = ["rg", "grep", "ag", "ack"], ["git", "jj", "hg", "svn"]
DATED, DATED_BYTES, OUTLIER, REPEATED, TIMES = r"^[0-9]{4}-[\s\S]{2}-", 10, 240, 8, 3
LEVELS = r"^(?:error |warn )| level=(?:error|warn)"
PATHS = r"\.(?:go|ts|py):"
#: White space at the ends of texts and lines.
BLANK = " \t\n\r\x0b\f"
#: What diffs, stack traces, code and logs begin a line with, lower-cased: a text without it has no such line.
BEGINNINGS = r"\n(?:@@ |\+\+\+ |--- |    at |\tat |func |package |import |class |const |export |[ \t\r\x0B\f]*(?:error |warn |[0-9]{4}-))"
#: A word's characters one by one: Java tests a listed class by a bit, one of ranges by nested calls in which the tasks of a JVM hinder each other.
WORD = "abcdefghijklmnopqrstuvwxyz0123456789_"


def _words(tokens: list[str]) -> str:
    """A pattern that finds one of the tokens as a word of a lower-cased text that has a line break put before it."""
    heads = "".join(f"[{''.join(sorted({t[i] for t in tokens}))}]" for i in range(min(3, *map(len, tokens))))
    return rf"[^{WORD}](?={heads})(?:{_any(tokens)})(?:\z|[\x00-\x2F\x3A-\x5E\x60\x7B-\x7F])"


def _bare(x: Column) -> Column:
    """_trim of a column or lambda's variable that copies only what has white space at an end."""
    ends = [F.startswith(x, F.lit(c)) | F.endswith(x, F.lit(c)) for c in BLANK]
    return F.when(reduce(or_, ends), _trim(x)).otherwise(x)


def _json(t: Column) -> Column:
    """_is_json of a trimmed text; only what has the ends of a value is parsed, as any other text costs two exceptions."""
    ends = lambda a, b: F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b))
    like = ends("{", "}") | ends("[", "]") | ends('"', '"') | t.rlike(r"^(?:-?[0-9][0-9.eE+-]*|true|false|null)\z")
    return like & _is_json(t)


def with_evidence(rows: DataFrame, text: str = "text", head: Column | None = None, args: Column | None = None, column: str = "evidence", bound: int | None = ANALYZED) -> DataFrame:
    """rows with `column`: struct<class, signals>, one of nine classes of an output and the signals in it, sorted.

    head is the command's name (null or empty: none), args its words. Null texts are empty. The first
    `bound` bytes of a text are read, by default the rule's own 64 KiB; None reads whole texts.
    """
    t, low, lines = F.col("__t"), F.col("__low"), F.col("__rows")
    has = lambda s, x=t: F.contains(x, F.lit(s))
    any_of = lambda found, x=t: reduce(or_, [has(s, x) for s in found])
    name = F.lower(F.coalesce(head, F.lit(""))) if head is not None else F.lit("")
    words = F.transform(args, lambda a: F.lower(_trim(a))) if args is not None else F.array().cast("array<string>")
    part, long = _analyzed(F.col(text).cast("string"), bound)
    staged = rows.withColumns({"__part": part, "__long": long, "__name": name, "__words": words})
    staged = staged.withColumn("__t", _bare(F.col("__part")))
    staged = staged.withColumns({"__low": F.lower(t), "__rows": F.split(t, "\n"), "__colon": has(":"), "__count": t.rlike(r"\p{Nd}")})
    lowered = F.concat(F.lit("\n"), low)
    staged = staged.withColumns(
        {
            "__begun": lowered.rlike(BEGINNINGS),
            "__said": lowered.rlike(_words([w for found in KEYWORDS.values() for w in found])),
            "__fail": has("fail", low),
            # Lines of REPEATED bytes in sorted order: one that comes TIMES times equals the one two places on.
            "__sorted": F.when(F.size(lines) >= TIMES, F.sort_array(F.filter(F.transform(lines, _bare), lambda x: F.octet_length(x) >= REPEATED))),
        }
    )
    begun, fail, ordered = F.col("__begun"), F.col("__fail"), F.col("__sorted")
    dated = lambda x: (F.octet_length(x) >= DATED_BYTES) & x.rlike(DATED)
    fields = lambda x: has(":", F.btrim(x, F.lit(BLANK + ":")))  # noqa: E731  two or more between colons that aren't blank
    pathish = lambda x: any_of([".", "/", "\\"], x)
    twice = lambda some, f: (F.size(lines) >= 2) & (F.size(F.filter(some, f)) >= 2)
    whole = ~F.col("__colon") & ~(F.col("__count") & has("-"))  # no line has a separator, so each is all head
    staged = staged.withColumns(
        {
            "__diff": F.startswith(t, F.lit("@@ ")) | has("diff --git ") | (begun & (has("\n@@ ") | (has("\n+++ ") & has("\n--- ")))),
            "__trace": has("Traceback (most recent call last):") | has("stack trace", low) | (has("goroutine ", low) & has(".go:")) | (begun & any_of(["\n    at ", "\n\tat "])),
            "__searched": F.col("__colon") & twice(lines, lambda x: has(":", x) & pathish(x) & fields(x) & _path_start(x)),
            "__logged": (begun | has(" level=", low)) & twice(F.transform(lines, _bare), lambda x: F.lower(x).rlike(LEVELS) | dated(x)),
            "__tested": fail & (any_of(["--- FAIL:", "FAIL\t"]) | any_of(["tests failed", "failed tests"], low) | (has("passed", low) & has("failed", low))),
            "__coded": begun & (any_of(["\nfunc ", "\npackage ", "\nimport "]) | any_of(["\nclass ", "\nconst ", "\nexport "], low)),
            "__path": pathish(t) & (whole | F.exists(lines, lambda x: pathish(x) & (_path_start(x) | x.rlike(PATHS)))),
            "__outlier": (F.octet_length(t) >= OUTLIER) & F.exists(lines, lambda x: F.octet_length(x) >= OUTLIER),
            "__dedupe": F.when(F.size(ordered) >= TIMES, F.exists(F.zip_with(ordered, F.slice(ordered, TIMES, F.size(ordered)), lambda a, b: a.eqNullSafe(b)), lambda same: same)).otherwise(False),
            "__exit": (has("exit ", low) & any_of(["exit status", "exit code"], low)) | has("returned non-zero", low) | (fail & has("command failed", low)),
        }
        | {f"__{s}": F.col("__said") & lowered.rlike(_words(w)) for s, w in KEYWORDS.items()}
    )
    spoken = lambda w: F.array_contains("__words", w)
    command = F.col("__name")
    ladder = [
        ("test", command.isin(TESTERS) & (spoken("test") | has("FAIL"))),
        ("search", command.isin(SEARCHERS)),
        ("diff", command.isin(VERSIONERS) & (spoken("diff") | spoken("show") | F.col("__diff"))),
        ("plain", t == ""),
        ("json", F.when(F.col("__long"), t.rlike(r"^[{\[]")).otherwise(_json(t))),
        ("stacktrace", F.col("__trace")),
        ("diff", F.col("__diff")),
        ("search", F.col("__searched")),
        ("test", F.col("__tested")),
        ("log", F.col("__logged")),
        ("code", F.col("__coded")),
        ("plain", command != ""),
    ]
    staged = staged.withColumn("__class", F.coalesce(*[F.when(c, F.lit(k)) for k, c in ladder], F.lit("unknown")))
    kind = F.col("__class")
    signals = {s: F.col(f"__{s}") for s in KEYWORDS} | {
        "stacktrace": F.col("__trace") | (kind == "stacktrace"),
        "outlier": F.col("__outlier"),
        "dedupe": F.col("__dedupe"),
        "count": F.col("__count"),
        "exit_status": F.col("__exit"),
        "first_last": t != "",
        "recency": t != "",
        "changed_hunk": kind == "diff",
        "path": F.col("__path"),
    }
    found = F.array_compact(F.array(*[F.when(signals[s], F.lit(s)) for s in sorted(signals)]))
    return staged.select(*rows.columns, F.struct(kind.alias("class"), found.alias("signals")).alias(column))
