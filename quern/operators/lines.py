"""Operators over the lines of texts: one row per line, windows per text, no text is collected again unless asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.commands import strip_escapes
from quern.functions.text import IMPORTANT, strip_ansi


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, pos (from 0), line."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Consecutive equal lines as one row: id_col, pos of the first, line, times."""
    at = Window.partitionBy(id_col).orderBy("pos")
    marked = lines(docs, id_col, text_col).withColumn("new", F.coalesce(F.col("line") != F.lag("line").over(at), F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(at))
    return runs.groupBy(id_col, "run").agg(F.min("pos").alias("pos"), F.min("line").alias("line"), F.count(F.lit(1)).alias("times")).drop("run")


def dedup_log_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that differ in digits only as one row: the first line, its pos and how often."""
    normal = lines(docs, id_col, text_col).withColumn("form", F.regexp_replace("line", "[0-9]+", "#"))
    return normal.groupBy(id_col, "form").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.count(F.lit(1)).alias("times")).drop("form")


def evidence_top_k(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", important: str = IMPORTANT) -> DataFrame:
    """The first k lines with important ones going first, in text order: id_col, pos, line, dropped."""
    rows = lines(docs, id_col, text_col).withColumn("important", F.col("line").rlike(important))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("important"), "pos"))
    total = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    return rows.withColumn("rank", rank).withColumn("dropped", F.greatest(F.lit(0), total - k).cast("long")).filter(F.col("rank") <= k).select(id_col, "pos", "line", "dropped")


def _replacing(pattern: str, to: str):
    return lambda x: F.regexp_replace(x, pattern, to)


@dataclass(frozen=True)
class Rule:
    """A declarative line rule; compiled to one Column, stages in the order of the fields."""

    strip_ansi: bool = True
    replace: list[tuple[str, str]] = field(default_factory=list)
    short_circuit: list[tuple[str, str, str | None]] = field(default_factory=list)  # (pattern, message, unless)
    drop: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    max_width: int | None = None
    head: int | None = None
    tail: int | None = None
    on_empty: str | None = None
    max_lines: int | None = None
    #: Head, tail and max_lines cut one after the other; otherwise head and tail are kept side by side.
    chained: bool = False
    all_escapes: bool = False

    def column(self, text: Column) -> Column:
        t = F.coalesce(text, F.lit(""))
        if self.strip_ansi:
            t = strip_escapes(t) if self.all_escapes else strip_ansi(t)
        rows = F.split(t, "\n")
        for pattern, to in self.replace:
            rows = F.transform(rows, _replacing(pattern, to))
        whole = F.array_join(rows, "\n")
        if self.drop:
            rows = F.filter(rows, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in self.drop)))
        if self.keep:
            rows = F.filter(rows, lambda x: x.rlike("|".join(f"(?:{p})" for p in self.keep)))
        if self.max_width:
            rows = F.transform(rows, lambda x: F.left(x, F.lit(self.max_width)))
        n = F.size(rows)
        if self.chained:
            if self.head:
                rows = F.slice(rows, 1, self.head)
            if self.tail:
                rows = F.slice(rows, F.greatest(F.lit(1), F.size(rows) - self.tail + 1), F.lit(self.tail))
        elif self.head is not None and self.tail is not None:
            cut = F.concat(F.slice(rows, F.lit(1), F.lit(self.head)), F.slice(rows, F.greatest(F.lit(1), n - self.tail + 1), F.lit(self.tail)))
            rows = F.when(n > self.head + self.tail, cut).otherwise(rows)
        elif self.head is not None:
            rows = F.slice(rows, F.lit(1), F.lit(self.head))
        elif self.tail is not None:
            rows = F.slice(rows, F.greatest(F.lit(1), n - self.tail + 1), F.lit(self.tail))
        if self.max_lines:
            rows = F.slice(rows, 1, self.max_lines)
        out = F.array_join(rows, "\n")
        if self.on_empty is not None:
            out = F.when(F.trim(out) == "", F.lit(self.on_empty)).otherwise(out)
        for pattern, message, unless in reversed(self.short_circuit):
            hit = whole.rlike(pattern) if unless is None else whole.rlike(pattern) & ~whole.rlike(unless)
            out = F.when(hit, F.lit(message)).otherwise(out)
        return out


def load_rules(text: str) -> list[tuple[str, str, Rule]]:
    """(name, pattern of its commands, rule) of every filter of a TOML rule file."""
    import tomllib

    out = []
    for name, f in tomllib.loads(text).get("filters", {}).items():
        rule = Rule(
            strip_ansi=f.get("strip_ansi", False), all_escapes=True, chained=True,
            replace=[(r["pattern"], r.get("replacement", "")) for r in f.get("replace", [])],
            short_circuit=[(m["pattern"], m["message"], m.get("unless") or None) for m in f.get("match_output", [])],
            drop=f.get("strip_lines_matching", []), keep=f.get("keep_lines_matching", []), max_width=f.get("truncate_lines_at") or None,
            head=f.get("head_lines") or None, tail=f.get("tail_lines") or None, max_lines=f.get("max_lines") or None, on_empty=f.get("on_empty") or None,
        )
        out.append((name, f.get("match_command", ""), rule))
    return out


def apply_rules(docs: DataFrame, rules: list[tuple[Column, str, Rule]], text_col: str = "text") -> DataFrame:
    """docs with rule (name of the first whose condition holds) and reduced (its output if shorter, else the text)."""
    name, out = F, F
    for test, label, rule in rules:
        name, out = name.when(test, F.lit(label)), out.when(test, rule.column(F.col(text_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = F.coalesce(out.otherwise(text), text)
    return docs.withColumn("rule", name.otherwise(F.lit(None).cast("string"))).withColumn("reduced", F.when(F.octet_length(made) < F.octet_length(text), made).otherwise(text))
