"""Path dictionary coding: long paths that a text repeats become short codes, with a legend in front.

All of it is column expressions: paths are found by a pattern, counted and ordered by their first place
with array functions, and replaced one after the other, a bounded number of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rule: entries, occurrences, characters of a path, and bytes that have to be saved.
ENTRIES, OCCURRENCES, LENGTH, GAIN = 8, 3, 24, 16
#: Where absolute paths of interest begin.
ROOTS = ("/Users/", "/private/", "/var/", "/tmp/", "/opt/", "/usr/", "/home/", "/root/", "/Volumes/", "/Applications/")
PATH = r"((?:/[A-Za-z0-9._%+@=\-]+){3,})"
_OPEN, _CLOSE = "[path dictionary]\n", "[/path dictionary]\n"


def repeated_paths(text: Column) -> Column:
    """The paths that go into the dictionary, by first place: array<string>.

    The pattern takes paths from the left, each as long as it goes; one behind a colon doesn't count, as
    it is part of an address.
    """
    found = F.regexp_extract_all(text, F.lit(r"(:?(?:/[A-Za-z0-9._%+@=\-]+){3,})"), 1)
    ours = F.filter(found, lambda p: reduce(Column.__or__, [p.startswith(r) for r in ROOTS]) & (F.length(p) >= LENGTH))
    often = F.filter(F.array_distinct(ours), lambda p: F.size(F.filter(ours, lambda q: q == p)) >= OCCURRENCES)
    return F.slice(often, 1, ENTRIES)


def coded(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `coded` (the text with codes, or as it was) and `saved` bytes (0 without a gain).

    A path is replaced wherever its characters stand, as in the rule, so also inside a longer one; codes
    are [P1], [P2] and so on. A text that holds a code or the legend's marks itself isn't coded, so that
    every coded text can be read back. Null texts stay null.
    """
    paths = repeated_paths(F.col("__text"))
    staged = rows.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("__paths", F.when(~F.col("__text").rlike(r"\[P[1-8]\]|\[/?path dictionary\]"), paths).otherwise(F.array().cast("array<string>")))
    out = F.col("__text")
    for k in range(ENTRIES):
        path = F.get("__paths", F.lit(k))
        out = F.when(path.isNotNull(), F.replace(out, path, F.lit(f"[P{k + 1}]"))).otherwise(out)
    legend = F.concat(F.lit(_OPEN), F.array_join(F.transform("__paths", lambda p, k: F.concat(F.lit("[P"), (k + 1).cast("string"), F.lit("]="), p, F.lit("\n"))), ""), F.lit(_CLOSE))
    staged = staged.withColumn("__coded", F.concat(legend, out))
    saved = (F.octet_length("__text") - F.octet_length("__coded")).cast("long")
    gain = (F.size("__paths") > 0) & (saved >= GAIN)
    return staged.select(*rows.columns, F.when(gain, F.col("__coded")).otherwise(F.col(text)).alias("coded"), F.when(gain, saved).otherwise(0).cast("long").alias("saved"))


def expanded(coded_text: Column) -> Column:
    """The text that was coded."""
    body = F.substring_index(coded_text, _CLOSE, -1)
    legend = F.substring_index(F.substring_index(coded_text, _CLOSE, 1), _OPEN, -1)
    pairs = F.filter(F.split(legend, "\n"), lambda line: line != "")
    whole = F.aggregate(F.reverse(pairs), body, lambda text, line: F.replace(text, F.substring_index(line, "=", 1), F.substring(line, F.instr(line, "=") + 1, F.length(line))))
    return F.when(coded_text.startswith(_OPEN), whole).otherwise(coded_text)
