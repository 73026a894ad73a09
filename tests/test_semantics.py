"""Operators on small rows with expected values by hand or by a plain loop."""

import base64
import gzip
import random

from pyspark.sql import functions as F

from quern.functions import commands as C
from quern.operators.evidence import with_evidence
from quern.operators import chunks, echo, lines, prefix, reports, sessions
from quern.session import attach, hot_keys
from quern.sources import bodies, logs


def _column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", make(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def _plain_cuts(data):
    """The chunker byte by byte."""
    table, x, m = [], 0x9E3779B97F4A7C15, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & m
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
        table.append(z ^ z >> 31)
    out, start = [], 0
    while start < len(data):
        n = len(data) - start
        end = n
        if n > 512:
            end, h = min(n, 8192), 0
            for i in range(512, min(n, 8192)):
                h = (h * 2 + table[data[start + i]]) & m
                if h & ((1 << (13 if i < min(2048, n) else 9)) - 1) == 0:
                    end = i + 1
                    break
        out.append(start + end)
        start += end
    return out or [0]


def test_cuts_are_those_of_the_plain_loop():
    rng = random.Random(7)
    for n in (0, 1, 511, 512, 513, 520, 2048, 2060, 9000, 60_000):
        for alphabet in (256, 3):
            data = bytes(rng.randrange(alphabet) for _ in range(n))
            assert chunks.cuts(data) == _plain_cuts(data)


def test_repeated_chunks_equal_a_plain_loop(spark):
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcdefghij \n") for _ in range(3000)) for _ in range(4)]
    rows = [(i, f"s{i % 2}", "".join(rng.choice(parts) for _ in range(3))) for i in range(12)] + [(None, "s0", parts[0]), (50, None, parts[1]), (51, "s1", None)]
    got = {(r.source, r.doc_id): (r.chunks, r.bytes, r.repeated_bytes) for r in chunks.repeated_chunks(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    import hashlib

    of = {}
    for i, s, t in rows:
        data, ends = (t or "").encode(), chunks.cuts((t or "").encode())
        of[(s, i)] = [(hashlib.sha256(data[a:b]).hexdigest(), b - a) for a, b in zip([0, *ends], ends)]
    first = {}
    for (s, i), cs in of.items():
        for c, _ in cs:
            if i is not None:
                first[(s, c)] = min(first.get((s, c), i), i)
    want = {k: (len(cs), sum(n for _, n in cs), sum(n for c, n in cs if k[1] is not None and first[(k[0], c)] < k[1])) for k, cs in of.items()}
    assert got == want


def test_prefix_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for n in (1, 7, 40):
        got = {r.i: (r.s, r.s_all) for r in prefix.prefix_sums(df.repartition(5), ["k"], [F.col("i")], {"s": F.col("v")}, n).collect()}
        run, want = {}, {}
        for k, i, v in rows:
            run[k] = run.get(k, 0) + v
            want[i] = (run[k], sum(w for q, _, w in rows if q == k))
        assert got == want
    assert prefix.prefix_sums(df.limit(0), [], [F.col("i")], {"s": F.col("v")}).count() == 0


def test_hot_keys_are_attached_like_others(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    hot = hot_keys(counts, "k")
    assert [r.k for r in hot.collect()] == [0] and hot_keys(counts.filter("k > 0"), "k") is None
    got = attach(rows, counts, "k", hot)
    assert got.count() == 2000 and got.filter("k = 0 and rows = 1000").count() == 1000


def test_million_rows_of_one_session_take_linear_windows(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("s"), "id", F.when(F.col("id") % 1000 == 999, "w").otherwise("r").alias("op"))
    out = sessions.obsolete(rows, "s", ["id"], F.col("op") == "r", F.col("op") == "w")
    assert out.agg(F.sum(F.col("write_at") - F.col("at"))).first()[0] == sum(range(1, 1000)) * 300


def test_important_lines_and_comments(spark):
    log = ["An ERROR", "Permission denied", "crashloop", "cannot open", "fine"]
    assert _column(spark, log, C.important_log_line) == [True, True, True, False, False]
    assert _column(spark, log, C.important_rule_line) == [True, True, True, True, False]
    assert _column(spark, ["// SAFETY: x", "# TODO(critical): y", "# todo", "Copyright 2020", "MYSAFETY: no"], C.kept_comment) == [True, True, False, True, False]


def test_all_escape_forms(spark):
    texts = ["\x1b[1;31mred\x1b[0m", "\x1b]0;title\x07x", "\x1b]8;;u\x1b\\link", "\x1bPq..\x1b\\y", "\x1bMz", "\x1b7w", "50%\r100%\r\n", "\x1b[?25lx"]
    assert _column(spark, texts, C.strip_escapes) == ["red", "x", "link", "y", "z", "w", "50%100%\n", "x"]


def test_evidence_classes_and_signals(spark):
    cases = [
        ("", None, "plain", []),
        ('{"a": 1}', None, "json", ["count", "first_last", "recency"]),
        ("[not json]", None, "unknown", ["first_last", "recency"]),
        ("goroutine 1 [running]:\nmain.go:12 x", None, "stacktrace", None),
        ("x.go:10:bad\ny/z.go:7:worse", None, "search", None),
        ("--- FAIL: TestX", None, "test", None),
        ("3 passed, 1 failed", None, "test", ["count", "error_keyword", "first_last", "recency"]),
        ("2024-01-01 a\n2024-01-02 b", None, "log", None),
        ("2024-01-\n2024-02-", None, "unknown", None),
        ("x\nfunc main() {}", None, "code", None),
        ("a line of it\nb\na line of it\n a line of it", None, "unknown", ["dedupe", "first_last", "recency"]),
        ("words only", "ls", "plain", ["first_last", "recency"]),
        ("anything", "rg", "search", None),
        ("a failing autho word", None, "unknown", ["first_last", "recency"]),
        ("the auth_token and secret.", None, "unknown", ["first_last", "path", "recency", "security"]),
    ]
    rows = spark.createDataFrame([(i, t, h) for i, (t, h, _, _) in enumerate(cases)], "i int, t string, h string")
    for r in with_evidence(rows, "t", F.col("h"), column="e").collect():
        _, _, kind, signals = cases[r.i]
        assert r.e["class"] == kind, (cases[r.i], r.e)
        assert signals is None or r.e["signals"] == signals, (cases[r.i], r.e)


def test_log_shapes(spark):
    texts = ["2024-01-01T10:00 a\nx", "2024-01-01T10:00 a\n2024-01-01 10:01 b\nx", '{"a":1}\n{"b":2}', '{"a":1} {"b":2}', "[INFO] a\nb", "a ERROR\nb\nc", "", "plain"]
    got = _column(spark, texts, lambda x: C.log_shape(x)["shape"])
    assert got == ["none", "iso8601", "jsonlines", "none", "bracketed", "bracketed", "none", "none"]


def test_success_lines(spark):
    pad = "." * 80
    texts = [f"{pad}\nBUILD SUCCESSFUL", f"{pad}\nTests: 12 passed, 0 failed", f"{pad}\n0 errors", f"BUILD SUCCESSFUL\nerror 3 {pad}", "PASS", f"{pad}\nPASS"]
    assert [bool(x) for x in _column(spark, texts, C.success_line)] == [True, True, True, False, False, True]


def test_languages_and_commands(spark):
    assert _column(spark, ["a/b.GO", "Dockerfile", "x/.sql", "Makefile.md", "noext", "a.b/c"], C.language_of_path) == ["go", "dockerfile", "sql", "markdown", "", ""]
    assert _column(spark, ["git status -s", "watch git status", "make all", "mymake all", "Cargo Test"], C.repeatable) == [True, False, True, False, True]
    assert _column(spark, ["rm -rf /", "rm -rf ./x", "dd if=/dev/zero of=x", " ", "ls"], C.denied) == ["destructive", "", "destructive", "", ""]
    assert _column(spark, [" a b/c ", "", None, "ok_1-2"], C.safe_id) == ["a_b_c", "anonymous", "anonymous", "ok_1-2"]
    assert _column(spark, ["vue-tsc", "npm run x", "go vet", "uv pip", "kubectl get", "git log", "top"], reports.parser_family) == ["typescript", "javascript", "go", "python", "container", "git", "other"]


def test_rule_files_and_their_stages(spark):
    text = """
[filters.make]
match_command = "^make\\\\b"
strip_lines_matching = ["^make\\\\[\\\\d+\\\\]:", "^\\\\s*$"]
max_lines = 2
on_empty = "make: ok"
[filters.seq]
strip_ansi = true
head_lines = 3
tail_lines = 2
truncate_lines_at = 4
[[filters.seq.match_output]]
pattern = "all fine"
message = "fine"
unless = "but"
"""
    rules = {name: (pattern, rule) for name, pattern, rule in lines.load_rules(text)}
    make, seq = rules["make"][1], rules["seq"][1]
    assert rules["make"][0] == "^make\\b"
    assert _column(spark, ["make[1]: Entering\ngcc a\n\ngcc b\ngcc c", "make[1]: x\n \n"], make.column) == ["gcc a\ngcc b", "make: ok"]
    assert _column(spark, ["a\nb\nc\nd\ne", "\x1b]0;t\x07longer", "x all fine", "all fine but"], seq.column) == ["b\nc", "long", "fine", "all "]


def test_mentions_by_substring_keep_reads(spark):
    rows = [(1, 0, "read", "f", ""), (1, 1, "edit", "f", ""), (1, 2, "read", "f", ""), (1, 3, "read", "g", ""), (1, 4, "write", "g", ""), (1, 5, "read", "g", "as in Message 35 and [2]")]
    calls = spark.createDataFrame(rows, "session int, at long, op string, path string, said string")
    got = [(r.at, r.edit_at, r.read_at) for r in sessions.redundant_reads(calls, text="said").collect()]
    assert got == [(0, 1, 2)]  # read 3 is meant by "message 35"; without it (3, 4, 5) would go too
    assert {(r.number, r.last) for r in sessions.mentions(calls, text="said").collect()} == {("3", 5), ("35", 5), ("2", 5)}


def test_next_read_need_not_follow_the_edit(spark):
    calls = spark.createDataFrame([(1, 0, "read", "f", ""), (1, 1, "read", "f", ""), (1, 2, "edit", "f", "")], "session int, at long, op string, path string, said string")
    assert [(r.at, r.edit_at, r.read_at) for r in sessions.redundant_reads(calls, text="said").collect()] == [(0, 2, 1)]


def test_rollback_latches_at_a_prefix(spark):
    treated = [(i, True, i < 60) for i in range(0, 200)]
    rows = spark.createDataFrame([(i * 2, t, f) for i, t, f in treated] + [(i * 2 + 1, False, False) for i in range(200)], "i long, t boolean, f boolean")
    latch = lambda df: sessions.cohort_latch(df, ["i"], F.col("t"), F.col("f")).first()
    assert latch(rows).rolled_back and latch(rows).treated_failed == 60
    assert not latch(rows.withColumn("f", F.lit(False))).rolled_back
    assert not latch(rows.filter("i < 80")).rolled_back  # 40 treated rows are too few


def test_last_duplicate_call_answers(spark):
    uses = spark.createDataFrame([(1, "a", 0, "Read"), (1, "a", 1, "Edit"), (2, "a", 0, "Bash")], "session int, use_id string, at int, tool string")
    results = spark.createDataFrame([(1, "a", "x"), (1, "", "a"), (2, None, "a"), (1, "q", "a")], "session int, result_id string, use_id string")
    assert sorted((r.session, str(r.result_id), r.tool) for r in sessions.paired_results(uses, results).collect()) == [(1, "", "Edit"), (1, "a", "Edit"), (1, "q", None), (2, "None", "Bash")]


def test_percentiles_of_a_group(spark):
    from quern.operators.rollups import percentiles

    r = percentiles(spark.range(10).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v")), "k", "v", 0.95).first()
    assert (round(r.interpolated, 6), r.floored, r.nearest) == (8.55, 8.0, 9.0)


def test_echo_spans_are_runs_of_words(spark):
    w = [f"word{i:03d}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["x", *w[10:45], "y"])), (2, " ".join(w[:20])), (3, " ".join([*w[:30], "z", *w[30:60]]))], "doc_id int, text string")
    blocks = spark.createDataFrame([(7, " ".join(w))], "item_id int, text string")
    got = sorted((r.doc_id, r.start, r.block_start, r.words, r.bytes) for r in echo.echo_spans(docs, blocks).collect())
    assert got == [(1, 2, 11, 35, 35 * 8 - 1), (3, 1, 1, 30, 239), (3, 32, 31, 30, 239)]


def test_bodies_round_trip(spark):
    body = '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool_use","id":"t1","name":"Read","input":{"path":"f"}}]},{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":"out"}]}]}'
    items = '{"input":[{"type":"message","role":"user","content":[{"type":"input_text","text":"q"}]},{"type":"function_call","call_id":"c","name":"ls","arguments":"{}"},{"type":"function_call_output","call_id":"c","output":"x"}]}'
    rows = spark.createDataFrame([(1, body), (2, items), (3, "broken"), (4, '{"input":"only text"}')], "id int, body string")
    found = bodies.messages(rows)
    got = sorted((r.id, r.msg, r.block, r.role, r.type, r.text, r.tool_name, r.tool_use_id) for r in found.collect())
    assert got == [
        (1, 0, 0, "user", "text", "hi", None, None), (1, 1, 0, "assistant", "text", "a", None, None), (1, 1, 1, "assistant", "tool_use", "", "Read", "t1"), (1, 2, 0, "user", "tool_result", "out", None, "t1"),
        (2, 0, 0, "user", "text", "q", None, None), (2, 1, 0, "assistant", "tool_use", "", "ls", "c"), (2, 2, 0, "tool", "tool_result", "x", None, "c"), (4, 0, 0, "user", "text", "only text", None, None),
    ]
    again = bodies.messages(bodies.bodies(found))
    assert sorted(map(str, again.select(*found.columns).collect())) == sorted(map(str, found.collect()))
    per = found.groupBy("id").agg(F.collect_list(F.struct("type", "text")).alias("b")).select("id", bodies.has_type(F.col("b"), "tool_use").alias("u"), bodies.text_of(F.col("b")).alias("t"))
    assert {r.id: (r.u, sorted(r.t.split("\n"))) for r in per.collect()} == {1: (True, ["a", "hi"]), 2: (True, ["q"]), 4: (False, ["only text"])}


def test_calls_of_the_second_dialect(spark):
    body = '{"messages":[{"role":"assistant","content":"see","tool_calls":[{"id":"a","type":"function","function":{"name":"ls","arguments":"{\\"p\\":1}"}},{"id":"","function":{"name":"x","arguments":"{}"}},{"id":"b","function":{"name":"cat","arguments":"{}"}}]},{"role":"tool","tool_call_id":"a","content":"f.py"},{"role":"assistant","content":null,"tool_calls":[{"id":"c","function":{"name":"pwd","arguments":"{}"}}]},{"role":"tool","content":"loose"}]}'
    found = bodies.messages(spark.createDataFrame([(1, body)], "id int, body string"))
    assert sorted((r.msg, r.block, r.role, r.type, r.text, r.tool_name, r.tool_input, r.tool_use_id) for r in found.collect()) == [
        (0, 0, "assistant", "text", "see", None, None, None), (0, 1, "assistant", "tool_use", "", "ls", '{"p":1}', "a"), (0, 2, "assistant", "tool_use", "", "cat", "{}", "b"), (1, 0, "tool", "tool_result", "f.py", None, None, "a"),
        (2, 0, "assistant", "text", "", None, None, None), (2, 1, "assistant", "tool_use", "", "pwd", "{}", "c"), (3, 0, "tool", "text", "loose", None, None, None),
    ]
    again = bodies.messages(bodies.bodies(found))
    assert sorted(map(str, again.select(*found.columns).collect())) == sorted(map(str, found.collect()))


def test_streams_payloads_and_requests(spark):
    stream = spark.createDataFrame([("event: x",), ('data: {"type":"delta","n":1}',), ("data: [DONE]",), ("",), ("data:",)], "value string")
    assert [(r.event, r.data) for r in bodies.server_events(stream).collect()] == [("delta", '{"type":"delta","n":1}')]
    packed = base64.b64encode(gzip.compress("grün".encode())).decode()
    assert _column(spark, [packed, "no", None], bodies.unpack) == ["grün", None, None]
    asks = ['{"temperature":0}', '{"temperature":0.0,"tools":[]}', "{}", '{"temperature":0,"stream":true}', '{"temperature":0,"n":2}', '{"temperature":0,"tools":[{"a":1}]}', '{"temperature":0,"previous_response_id":"r"}', "x"]
    assert _column(spark, asks, bodies.cache_safe) == [True, True, False, False, False, False, False, False]
    pair = spark.sql("SELECT named_struct('a', 1, 'b', null) AS x, named_struct('a', 2, 'b', null) AS y")
    assert [tuple(d) for d in pair.select(bodies.drift("x", "y", ["a", "b"]).alias("d")).first().d] == [("a", "1", "2")]


def test_days_corpus_and_logs(spark, tmp_path):
    for day, text in (("2024-05-01", "a"), ("2024-05-06", "b"), ("2024-05-07", "c")):
        (tmp_path / "log" / f"dt={day}").mkdir(parents=True)
        (tmp_path / "log" / f"dt={day}" / "x.txt").write_text(f"{text}\n\n{text}2\n")
    read = lambda period: sorted(r.value for r in bodies.read_days(spark, str(tmp_path / "log"), period, "2024-05-07").filter("value <> ''").collect())
    assert read("today") == ["c", "c2"] and read("week") == ["a", "a2", "b", "b2", "c", "c2"] and len(read("all")) == 6
    files = bodies.corpus(spark, str(tmp_path / "log"), "*.txt").collect()
    assert len(files) == 3 and {r.text for r in files} == {"a\n\na2\n", "b\n\nb2\n", "c\n\nc2\n"}
    stats = logs.file_stats(spark, str(tmp_path / "log" / "dt=2024-05-01"))
    assert [(r.lines, r.bytes) for r in stats.collect()] == [(2, 6)]
    rows = spark.createDataFrame([("s", "r1", 1), ("s", "r1", 2)], "session string, req_id string, n int")
    bodies.append_log(rows, str(tmp_path / "out"))
    bodies.append_log(rows.limit(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    logs.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == rows.columns
    wide = logs.with_columns(rows, {"req_id": "string", "title": "string", "at": "long"}).first()
    assert (wide.req_id, wide.title, wide["at"]) == ("r1", "", None)


def test_session_windows_of_events(spark):
    from quern.streaming import collector

    rows = spark.sql("SELECT 1 AS user_id, timestamp_seconds(t) AS ts FROM VALUES (0), (600), (5000) AS v(t)")
    assert sorted((r.start, r.n) for r in collector.session_counts(rows).collect()) == [(0, 2), (5000, 1)]


def _plain_signature(text):
    words = text.split()
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    out, m = [], (1 << 64) - 1
    for seed in range(1, 129):
        best = m
        for p in parts:
            h = 14695981039346656037
            for b in p.encode() + seed.to_bytes(8, "little"):
                h = ((h ^ b) * 1099511628211) & m
            best = min(best, h)
        out.append(best)
    return out


def test_signatures_and_leaders_equal_a_plain_loop(spark):
    from quern.operators import neardup

    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(40):
        words = list(base[i % 2])
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            words[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((f"s{i % 3}", i, " ".join(words)))
    rows += [("s0", 40, "short"), ("s0", 41, " short\r\n"), ("s1", 42, None), ("s0", 39, rows[0][2])]
    assert neardup.signature("a b c d é").tolist() == _plain_signature("a b c d é") and neardup.signature("one").tolist() == _plain_signature("one")
    got = sorted((r.session, r["at"], r.kind, r.first) for r in neardup.leaders(spark.createDataFrame(rows, "session string, at long, text string")).collect())
    want, exact, kept = [], {}, {}
    for s, i, t in sorted(rows, key=lambda r: r[1]):
        key = s + chr(0) + (t or "").replace("\r\n", "\n").strip()
        if key in exact:
            want.append((s, i, "exact", exact[key]))
            continue
        sig = _plain_signature(key) if len(key) - len(s) - 1 >= 120 else None
        near = next((j for j, other in kept.get(s, []) if sig and j != i and sum(a == b for a, b in zip(sig, other)) / 128 >= 0.85), None)
        if near is not None:
            want.append((s, i, "near", near))
            continue
        if sig:
            kept.setdefault(s, []).append((i, sig))
        exact[key] = i
        want.append((s, i, "new", -1))
    assert got == sorted(want) and {k for _, _, k, _ in got} == {"new", "near", "exact"}


def test_staircase(spark):
    from quern.operators.neardup import staircase

    rows = spark.createDataFrame([(5,), (10,), (11,), (50,)], "n int").select("n", staircase(F.col("n"), [(10, 0.7), (20, 5.0)]).alias("t"))
    assert {r.n: r.t for r in rows.collect()} == {5: 0.7, 10: 0.7, 11: 0.85, 50: 0.85}
