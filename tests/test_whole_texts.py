"""Queries on made tables beside their SQL: texts over the bounds of rules, repeated ids, odd lines."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from quern.functions import commands
from quern.operators import deltas, neardup, reducers
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


def _tables(spark, folder, documents):
    """The small tables, with other documents."""
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    rows = [(i, text, "en", f"src{i % 2}", len(text or "")) for i, text in documents]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _same(spark, name, folder):
    ok, say = compare(e.queries()[name](spark, folder), e.oracle_sql()[name], folder)
    assert ok, say


def test_evidence_reads_past_64_kib(spark, tmp_path):
    filler = "\n".join(f"plain words {i}" for i in range(6000))
    tail = "\nthe same line\nthe same line\nthe same line\n" + "y" * 300 + "\nsome/path.go:3: an error, exit code 1"
    docs = [(0, filler + tail), (1, filler + "\nTraceback (most recent call last):"), (2, "[" + "1, " * 40000 + "1]"), (3, "[" + "1, " * 40000), (4, None), (5, " " * 70000 + "warning")]
    _same(spark, "content_evidence", _tables(spark, tmp_path, docs))


def test_evidence_of_odd_texts(spark, tmp_path):
    ends = ["an error\u2028", "warn\u0085", "a todo\u2029\n", "the secret\u2028\u2028", "fail\u212a", "erroré", "éerror", "_error", "error_", "fix", "fixme", "prefix", "timed out", "a\ntimed  out"]
    lines = ["a: :b", "::a/b::c\n:a/b:c:\nx", "a/b:c\n./d:e", "C:\\x\nd:/y:z", "a-1/b\na/b-1:2\nc.d-2:3", "a:b/c\nd:e.f", ".go:", "x\u0660-./", "x-\u0660./", "a-5/", "a/-5"]
    logs = ["error a\n\t warn b", "error \nwarn ", "x level=errors\ny level=warn", "2024-é-1\n 2024-01-1", "a\n2024-ab-\n2024-ab-cd\r\n2024-01-02", "@@ x", "a\n@@ x", "--- a\n+++ b", "a\n--- a\n+++ b", "\nfunc x", "x\nfunc x", "x\n\tat y", "x\n    AT y"]
    values = ["{}", "{} {}", "[1],[2]", "1],[2", '"a"', '"a" "', "-1.5e3", "1.", "01", "+1", "true", "truefalse", "null", "{", "[1, 2", '{"a": [1]}\n', "TRUE"]
    twice = ["a line of it\n b\na line of it", "a line of it\n a line of it\r\na line of it\x0b", "seven b\n" * 3, "eight by\n" * 3, "\n" * 9 + "x" * 239, "x\n" + "é" * 120]
    _same(spark, "content_evidence", _tables(spark, tmp_path, enumerate(ends + lines + logs + values + twice)))


def test_evidence_tests_words_by_bits_and_spreads_texts_of_events(spark):
    """Ranges in a negated class take calls in which tasks of one JVM hinder each other (some 600 ns a byte on 8 cores)."""
    plan = e.queries()["content_evidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9_]" not in plan and "[^abcdefghijklmnopqrstuvwxyz0123456789_]" in plan
    assert re.search(r"Repartition .*\n.*Project \[event_id", plan)  # ids alone are dealt out, texts are made after it


ODD = [
    "commit 12ab34f\nAuthor: a\n\ndiff --git a/x b/x\n--- a/x\r\n+++ b/x\n" + "+line\r\n" * 70 + " 3 files changed\nstill diff\nrename a => b\nout\n--- a\nin\ncommit abcdef1\nout",
    "--- a\n" + "x\n" * 59 + "tail that is long enough to be left out\n" * 9,
    "--- FAIL: A\n" + "  at it\n" * 45 + "--- PASS: B\nnoise\n--- FAIL: C\nfollows\nok  \tpkg 0.1s\nnot a failure\n12 passed, 1 failed\r\r\n" * 3,
    "panic: x\r\n\r\n12 tests passed\n" + "z\n" * 90,
    "d123\ndrwxr-xr-x\x0bx\ndrwxr-xr-x 2\rx\ndrwxr-xr-x\r\r\n" + "total 9\n\r\n -x\n" + "drwxr-xr-x\rq\n\x0bq\n" * 15 + "f\n" * 20,
    "\n".join(f"2024-01-01T10:00:0{i % 10}Z tick {i % 95}" for i in range(300)),
    "a\nb\r\na\r\n2024-01-01 10:00:00.5 x\n2024/01/02 10:00:00 x\n\n\n",
    "src/a.ts:10:2 \x85 error\n" + "A:1:2 info\r\nwords\n" * 65 + "5 problems\n✖ 3",
    "Compiling x\nerror: a\r\n" + "warning: b\nother\n" * 60 + "Finished",
    "b.go:12:x\na.go:3:an error\na.go:10:y\na.go:3:an error\nnone\na.go:2:z\na.go:44:last\nc:1:one",
    "C:\\x.go:3:error\nx:4:a\r\r\n" + "\n".join(f"f{i % 45}:{i}:{'todo error'[: i % 11]}" for i in range(300)),
    "", None, "\n", "\r",
]


@pytest.mark.parametrize("name", ["git_output", "test_output", "dir_output", "lint_output", "log_output", "search_top", "build_output"])
def test_reducers_of_odd_texts_do_not_shuffle_lines(spark, tmp_path, name):
    folder = _tables(spark, tmp_path, enumerate(ODD))
    _same(spark, name, folder)
    plan = e.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Join" not in plan


def test_texts_that_share_an_id(spark):
    texts = [(1, "a\nb\na"), (1, "a\nb\na"), (2, "x 1\nx 1\nx 1"), (3, None)]
    rows = spark.createDataFrame(texts, "id long, text string")
    assert sorted(map(tuple, reducers.log_output(rows).collect()), key=str) == sorted([(1, "a\nb\na"), (1, "a\nb\na"), (2, "x 1 [x3]"), (3, None)], key=str)
    found = [(1, "a:3:x\na:1:error\na:5:y"), (1, "a:4:fail\nb:1:z"), (2, "c:1:p\nc:2:q")]
    rows = spark.createDataFrame(found, "id long, text string")
    want = [(1, 1, "a", 1, "error", 4), (1, 2, "a", 4, "fail", 4), (1, 3, "a", 5, "y", 4), (1, 4, "b", 1, "z", 1), (2, 1, "c", 1, "p", 2), (2, 2, "c", 2, "q", 2)]
    assert sorted(map(tuple, reducers.search_top_of(rows, per_file=3).collect())) == want
    assert sorted(map(tuple, reducers.search_top_of(rows, per_file=3, files=1).collect())) == [r for r in want if r[2] != "b"]


def _slow_signature(text):
    """The rule byte by byte."""
    out = [(1 << 64) - 1] * neardup.DIMENSIONS
    for part in set(neardup.shingles(text)):
        for d in range(neardup.DIMENSIONS):
            h = neardup.FNV_START
            for byte in part + (d + 1).to_bytes(8, "little"):
                h = (h ^ byte) * neardup.FNV_FACTOR & (1 << 64) - 1
            out[d] = min(out[d], h)
    return out


@pytest.mark.parametrize("least", [0.01, 0.5, 0.85, 0.9, 1.0])
def test_leaders_compare_only_those_that_share_a_band(least):
    rng = np.random.default_rng(5)
    sigs = list(rng.integers(-(1 << 62), 1 << 62, (400, neardup.DIMENSIONS)))
    for k in range(400):  # copies with just as many numbers changed as the rule allows, and one more or less
        copy = sigs[k].copy()
        most = int(neardup.DIMENSIONS * (1 - least)) + rng.integers(-1, 2)
        copy[rng.permutation(neardup.DIMENSIONS)[: max(0, most)]] += 1
        sigs.append(copy)
    leaders, plain = neardup.Leaders(least), []
    for place, sig in enumerate(sigs):
        want = next((p for p, s in plain if (s == sig).mean() >= least), None)
        assert leaders.find(sig, place) == want
        if want is None:
            leaders.add(sig, place)
            plain.append((place, sig))
    assert leaders.compared <= 2 * len(sigs)


def test_signature_equals_the_rule():
    for text in ("one two three four", "a", " ".join(f"w{i % 5000}é" for i in range(5000))[:9000]):
        assert neardup.signature(text).tolist() == _slow_signature(text)


def test_pattern_of_tokens_finds_the_same(spark):
    for tokens in (commands.IMPORTANT_LOG, [*commands.IMPORTANT_LOG, *commands.IMPORTANT_RULE], ["a.b", "a", "(x"]):
        ours, plain = re.compile(commands._one_of(tokens)), re.compile(commands._any(tokens))
        for t in tokens:
            for x in (t, t[1:], t[:-1], f"xx{t}yy", t.replace(" ", ""), t[::-1], t[:2] + t):
                assert bool(ours.search(x)) == bool(plain.search(x)), (tokens, x)
    plan = commands.important_log_line(F.col("x"))._jc.toString()
    assert "(?=[" in plan


def test_deltas_carry_only_texts_that_are_compared(spark):
    rows = spark.createDataFrame([(1, 0, "a\nb\n" * 9), (1, 1, "a\nb\n" * 9), (1, 2, "a\nb\n" * 9 + "é"), (2, 0, None), (2, 1, "")], "key long, idx int, text string")
    got = {(r.key, r.idx): (r.prev, r.bytes, r.delta is None) for r in deltas.deltas(rows, share=9.0).collect()}
    assert got == {(1, 0): (None, 36, True), (1, 1): (0, 36, True), (1, 2): (0, 38, False), (2, 0): (None, 0, True), (2, 1): (0, 0, True)}
