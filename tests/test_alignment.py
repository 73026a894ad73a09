"""Deltas, audits, matching, running medians and folds against plain loops, with keys that hold most rows."""

import datetime
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quern.operators import audit, deltas, folds, matching, medians
from quern.operators.prefix import previous
from quern.plans import alignment_queries
from quern.session import table

SF = "/root/testdata/sf0.001"


def _table_script(old, new):
    """The script by a full table of common subsequences."""
    m, n = len(old), len(new)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in reversed(range(m)):
        for j in reversed(range(n)):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < m or j < n:
        if i < m and j < n and old[i] == new[j]:
            out.append((" ", i, j))
            i, j = i + 1, j + 1
        elif i < m and (j >= n or best[i][j + 1] < best[i + 1][j]):
            out.append(("-", i, -1))
            i += 1
        else:
            out.append(("+", -1, j))
            j += 1
    return out


def test_edit_scripts_equal_the_full_table():
    rng = random.Random(1)
    for k in range(1500):
        old = [rng.choice("abcde") for _ in range(rng.randrange(30))]
        new = [x for x in old if rng.random() < 0.8] + [rng.choice("abc")] if k % 2 else [rng.choice("abcde") for _ in range(rng.randrange(30))]
        assert deltas.edit_script(old, new) == _table_script(old, new)
        a, b = "\n".join(old), "\n".join(new)
        delta = deltas.unified(a, b)
        assert (deltas.apply_unified(a, delta) if delta else a) == b


def test_unified_diffs_by_hand():
    assert deltas.unified("a\nb\n", "a\nb\n") == ""
    assert deltas.unified("", "x\n") == "--- a\n+++ b\n@@ -1,1 +1,2 @@\n+x\n \n"
    lines = [f"l{i}" for i in range(30)]
    far = deltas.unified("\n".join(lines), "\n".join(["top", *lines[1:29], "end"]))
    assert far.count("@@ -") == 2 and "@@ -1,4 +1,4 @@\n+top\n-l0\n l1\n l2\n l3\n" in far
    # Changes five lines apart are two hunks that share lines of context.
    near = deltas.unified("\n".join(lines), "\n".join(["x", *lines[1:5], "y", *lines[6:]]))
    assert near.count("@@ -") == 2 and deltas.apply_unified("\n".join(lines), near).split("\n")[:6] == ["x", "l1", "l2", "l3", "l4", "y"]


def test_deltas_of_versions_equal_a_loop(spark):
    rng, rows = random.Random(2), []
    for key in [None, *range(6)]:
        lines = [f"line {rng.randrange(50)} of a file" for _ in range(40)]
        for idx in range(60 if key == 1 else 6):
            for _ in range(rng.randrange(3)):
                lines[rng.randrange(40)] = f"line {rng.randrange(99)} new"
            rows.append((key, idx, None if key == 2 and idx == 3 else "\n".join(lines)))
    got = {(r.key, r.idx): (r.prev, r.delta, r.bytes) for r in deltas.deltas(spark.createDataFrame([r for r in rows if r[0] is not None], "key long, idx int, text string").repartition(5)).collect()}
    want, last = {}, {}
    for key, idx, text in rows:
        if key is None:
            continue
        text = text or ""
        prev, old = last.get(key, (None, None))
        delta = deltas.unified(old, text) if old is not None and old != text else None
        want[key, idx] = (prev, delta if delta and len(delta) < 0.5 * len(text) else None, len(text))
        if old is None or old != text:
            last[key] = (idx, text)
    assert got == want and sum(v[1] is not None for v in want.values()) > 20
    assert all(deltas.apply_unified(next(t or "" for k, i, t in rows if (k, i) == (key, prev)), d) == next(t or "" for k, i, t in rows if (k, i) == (key, idx)) for (key, idx), (prev, d, _) in got.items() if d)


def test_previous_rows_of_a_key_over_many_ranges(spark):
    rows = [(1, i, f"v{i}") for i in range(500)] + [(None, i, None) for i in range(40)] + [(2, 0, "x")]
    got = {(r.k, r.i): (r.prev_v, r.has_prev) for r in previous(spark.createDataFrame(rows, "k long, i int, v string").repartition(7), ["k"], [F.col("i")], ["v"], 9).collect()}
    assert got == {(k, i): ((None if k is None else f"v{i - 1}") if i else None, i > 0) for k, i, _ in rows}


def _digests(text):
    out = {sha256(text.encode()).hexdigest()} if text else set()
    if "Process exited with code " in text:
        for marker in ("\nOutput:\n", "\r\nOutput:\r\n"):
            if marker in text:
                payload = text.split(marker, 1)[1]
                return out | ({sha256(payload.encode()).hexdigest()} if payload else set())
    return out


def _audit(turns, archive):
    """Severities by a loop; turns: {(session, turn): (before texts, after texts)}; archive: {id: body} or None."""
    import re

    ids_of = lambda t: list(dict.fromkeys(re.findall(audit.ARCHIVE, t)))
    out, seen = [], {}
    for (session, turn), (before, after) in sorted(turns.items()):
        full = seen.setdefault(session, set())
        a = [t or ("a", i) for i, t in enumerate(after)]
        b = [t or ("b", i) for i, t in enumerate(before)]
        script = _table_script(a, b)
        pairs = [(j, i) for op, i, j in script if op == " "]
        for j, _ in pairs:
            full |= _digests(before[j])
        at = (0, 0)
        for bj, ai in [*pairs, (len(before), len(after))]:
            bs, as_ = list(range(at[0], bj)), list(range(at[1], ai))
            while bs and not before[bs[0]].strip():
                bs.pop(0)
            while as_ and not after[as_[0]].strip():
                as_.pop(0)
            changes = []
            while bs and len(as_) > len(bs):
                changes.append((None, as_.pop(0)))
            while bs or as_:
                changes.append((bs.pop(0) if bs else None, as_.pop(0) if as_ else None))
            for b_, a_ in changes:
                old, new = "" if b_ is None else before[b_], "" if a_ is None else after[a_]
                if not old.strip() and not new.strip():
                    continue
                kind = _severity(old, new, after, full, archive, ids_of) if b_ is not None else audit.EXTRA
                out.append((session, turn, a_ if b_ is None else b_, kind, len(old.encode()) - len(new.encode())))
            at = (bj + 1, ai + 1)
    return sorted(out)


def _severity(old, new, after, full, archive, ids_of):
    import re

    if _digests(old) & full:
        return audit.RECOVERABLE
    ids = ids_of(new) or (ids_of("\n".join(after)) if old and (not new.strip() or len(new.encode()) < len(old.encode())) else [])
    if not ids:
        return audit.LOST if len(new.encode()) < len(old.encode()) else audit.CHANGED
    if archive is None:
        return audit.REFERENCED
    reach, frontier = set(), set(ids)
    for _ in range(audit.DEPTH + 1):
        reach |= frontier & set(archive)
        frontier = {x for i in frontier & set(archive) for x in ids_of(archive[i])}
    if any(sha256(archive[i].encode()).hexdigest() in _digests(old) for i in reach):
        return audit.REFERENCED
    if not set(ids) & set(archive):
        return audit.MISSING
    put = re.sub(audit.CHUNK, lambda m: archive.get(m[1], m[0]), new)
    if set(ids) <= set(archive) and put != new and sha256(put.encode()).hexdigest() in _digests(old):
        return audit.REFERENCED
    return audit.MISMATCH


@pytest.mark.parametrize("with_archive", [False, True])
def test_audit_equals_a_loop(spark, with_archive):
    rng, turns = random.Random(4), {}
    said = ["alpha beta", "gamma", "", "  ", "delta one two", "Process exited with code 0\nOutput:\nalpha beta", "long " * 9, "epsilon " * 4]
    archive = {"e1": "delta one two", "e2": "see local-archive://e1", "e3": "see local-archive://e2 local-archive://e3", "c1": "psilon epsilon ", "x": "other"}
    marks = ["see local-archive://e1", "see local-archive://e3", "see local-archive://nowhere", "local-archive://x", "e[context-chunk status=unchanged uri=local-archive://c1 bytes=3]epsilon epsilon ", "shorter", "something that is longer than any"]
    for session in ("s", "t"):
        for turn in range(120 if session == "s" else 12):
            before = [rng.choice(said) if rng.random() < 0.7 else f"{session} {turn} {rng.randrange(4)}" for _ in range(rng.randrange(7))]
            after = []
            for text in before:
                k = rng.randrange(10)
                if k in (5, 6) and len(text) > 3:
                    name = f"n{len(archive)}"
                    archive[name] = text if k == 5 else text[1:]
                    after.append(f"see local-archive://{name}" if k == 5 else f"{text[0]}[context-chunk status=unchanged uri=local-archive://{name} bytes=3]")
                    continue
                after += [] if k == 0 else [rng.choice(marks)] if k < 3 else ["note", text] if k == 3 else [""] if k == 4 else [text]
            turns[session, turn] = (before, after)
    rows = [(s, t, side, i, text or None, 7) for (s, t), both in turns.items() for side, texts in zip(("before", "after"), both) for i, text in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "session string, turn int, side string, block int, text string, digest int").repartition(6)
    entries = spark.createDataFrame(list(archive.items()), "id string, body string")
    found = audit.audit(blocks, entries if with_archive else None)
    got = sorted((r.session, r.turn, r.block, r.severity, r.bytes) for r in found.collect())
    want = _audit(turns, archive if with_archive else None)
    assert got == want and len({w[3] for w in want}) == (7 if with_archive else 5)
    report = {r.session: (r.turns, r.changes, r.lost, r.saved) for r in audit.audit_report(blocks, found).collect()}
    assert report["t"][1:3] == (sum(w[0] == "t" for w in want), sum(w[0] == "t" and w[3] in audit.LOSSES for w in want))


def test_audit_writes_no_row_for_each_block_of_both_sides(spark, monkeypatch):
    rows, cut = [], audit.cut

    def noted(df):
        rows.append(df.count())
        return cut(df)

    monkeypatch.setattr(audit, "cut", noted)
    blocks = [("s", turn, side, i, "shorter" if (side, i) == ("after", 3) else f"text {turn} {i} at length") for turn in range(20) for side in ("before", "after") for i in range(8)]
    found = audit.audit(spark.createDataFrame(blocks, "session string, turn int, side string, block int, text string")).collect()
    assert sorted((r.turn, r.block, r.severity, r.preview) for r in found) == [(turn, 3, audit.LOST, f"text {turn} 3 at length") for turn in range(20)]
    assert max(rows) == len(blocks) // 2


def test_audit_writes_only_forms_that_a_change_asks_for(spark, monkeypatch):
    rows, cut = [], audit.cut

    def noted(df):
        rows.append(df.count())
        return cut(df)

    monkeypatch.setattr(audit, "cut", noted)
    # Ten equal blocks of one text are a row, as the six others of a turn are each.
    texts = lambda turn, last: [*["}"] * 10, *[f"text {turn} {i} at length" for i in range(6)], last]
    blocks = [("s", turn, side, i, text) for turn in range(20) for side in ("before", "after") for i, text in enumerate(texts(turn, "shorter" if side == "after" else f"last of {turn}"))]
    blocks += [("s", 20, "before", 0, "text 3 2 at length"), ("s", 20, "after", 0, "see local-archive://e")]
    entries = spark.createDataFrame([("e", "other")], "id string, body string")
    found = audit.audit(spark.createDataFrame(blocks, "session string, turn int, side string, block int, text string"), entries).collect()
    assert sorted((r.turn, r.block, r.severity) for r in found) == [*((turn, 16, audit.LOST) for turn in range(20)), (20, 0, audit.RECOVERABLE)]
    # The form that comes back is the only one that is kept of 141.
    assert rows[0] == 20 * 8 + 1 and max(rows[1:]) == 1


def test_audit_of_forms_that_most_changes_ask_for(spark):
    turns = [(turn, side, i, text) for turn in range(150) for side in ("before", "after") for i, text in enumerate(["kept once" if side == "before" or turn == 70 else "", f"own {turn}", "gone" if side == "before" else ""])]
    blocks = spark.createDataFrame([("s", *row) for row in turns], "session string, turn int, side string, block int, text string").repartition(4)
    got = {(r.turn, r.block): r.severity for r in audit.audit(blocks).collect()}
    assert got == {(turn, 2): audit.LOST for turn in range(150)} | {(turn, 0): audit.RECOVERABLE if turn > 70 else audit.LOST for turn in range(150) if turn != 70}


def test_audit_of_documents_names_severities(spark):
    blocks, entries = alignment_queries.audited_lines(spark, SF)
    assert {r.severity for r in audit.audit(blocks, entries).select("severity").distinct().collect()} >= {audit.REFERENCED, audit.MISSING, audit.LOST, audit.CHANGED, audit.EXTRA}


def test_dyadic_bins_meet_once(spark):
    pairs = spark.range(0, 60).withColumnRenamed("id", "low").join(spark.range(0, 60).withColumnRenamed("id", "n")).withColumn("high", F.col("low") + F.col("n") % 17 - 1)
    bins = pairs.select("low", "high", matching.bins_of_interval(F.col("low"), F.col("high"), 6).alias("bins")).distinct().collect()
    for low, high, found in bins:
        cover = [s for level, b in found for s in range(b << level, (b + 1) << level)]
        assert sorted(cover) == list(range(low, high + 1))


def test_matching_of_hot_bins_and_missing_times(spark, monkeypatch):
    """All sessions and threads at one time; candidates by hand."""
    hot = matching.hot_keys
    monkeypatch.setattr(matching, "hot_keys", lambda counts, key, total=None, least=1: hot(counts, key, 0, 1))
    digest = sha256(b"hello").hexdigest()[:16]
    sessions = [("fh:a", 100.5, 200.5, "m1", "f1"), ("fh:b", 100.0, 200.0, "m9", "f1"), ("fh:c", None, 200.0, "", ""), ("no-session:d", 150.0, 160.0, "m1", ""), ("no-session:e", None, 1.0, "m1", ""), (f"fh:{digest}", 1e6, 1e6, "", ""), ("fh:f", 9e6, 9e6, None, "codex"), ("no-session:g", 100.0, 9e5, "m2", "f2")]
    threads = [("t1", "hello", 0, 150, "m1", "f1"), ("t2", "", None, 160, "m2", "f1"), ("t3", None, 0, None, "m3", "f3"), ("t4", "x", 401, 900_000, "m2", "f2"), ("t5", "x", 400, 900_000, "m2", "f2")]
    got = {r.session: (r.thread, r.how, r.reason) for r in matching.match_threads(spark.createDataFrame(sessions, "session string, first double, last double, model string, family string"), spark.createDataFrame(threads, "thread string, first_text string, created long, updated long, model string, family string")).collect()}
    none, many = (None, None, matching.NONE), (None, None, matching.MANY)
    assert got == {"fh:a": ("t1", "time", ""), "fh:b": none, "fh:c": many, "no-session:d": ("t1", "time", ""), "no-session:e": none, f"fh:{digest}": ("t1", "hash", ""), "fh:f": ("t3", "time", ""), "no-session:g": ("t5", "time", "")}


def test_running_medians_of_one_key_with_most_rows(spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.8 else rng.randrange(5), i, rng.choice([None, 0, rng.randrange(9), rng.randrange(3000)]), rng.random() < 0.4) for i in range(1500)]
    got = {(r.k, r.i): r.median for r in medians.running_medians(spark.createDataFrame(rows, "k int, i int, v int, ask boolean").repartition(5), ["k"], ["i"], F.col("v"), F.col("ask")).collect()}
    before, want = {}, {}
    for k, i, v, ask in rows:
        values = sorted(before.setdefault(k, []))
        if ask:
            want[k, i] = (values[(len(values) - 1) // 2] + values[len(values) // 2]) // 2 if values else None
        if v is not None:
            before[k].append(v)
    assert got == want


def test_negative_events_by_hand(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("s", at(0), 1, 100, False, True), ("s", at(1), 2, 300, False, True), ("s", at(2), 3, 50, True, True), ("s", at(3), 4, 0, False, True), ("s", at(4), 5, 260, False, True), ("s", at(5), 6, 1, True, True), ("s", at(125), 7, 900, False, False), ("t", at(0), 8, 5, True, False), ("t", at(1), 9, 50, False, False)]
    got = {r.session: (r.events, r.tokens) for r in medians.negative_events(spark.createDataFrame(rows, "session string, ts timestamp, id int, original int, failed boolean, usual boolean")).collect()}
    # 260 against the median 200; the retry after 120 seconds is too late; nothing usual before in t.
    assert got == {"s": (1, 60), "t": (0, 0)}


@pytest.mark.parametrize("rule", [folds.HitBaseline(size=5), folds.TokenRatio(), folds.LengthAverage(), folds.Debounce(seconds=3), folds.Downgrade(samples=4, cooldown=3, failures=0.3, overhead=60.0)])
def test_folds_over_chunks_equal_a_loop(spark, rule):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, rng.random() < 0.6, rng.choice([None, 0, 40, 70, 99]), rng.randrange(90), i * 900_000, "aggressive", rng.random() < 0.8, rng.randrange(30), rng.randrange(60), rng.random() < 0.3, rng.choice([None, 0, 3, 70])) for i in range(900)]
    names = "k int, i int, hit boolean, observed int, estimated int, micros long, wanted string, applied boolean, added int, output int, failed boolean, length int"
    out = folds.fold(spark.createDataFrame(rows, names).repartition(6), ["k"], ["i"], rule, partitions=9).collect()
    places = [[n.split()[0] for n in names.split(", ")].index(c) for c in rule.columns]
    states, want = {}, {}
    for row in rows:
        state = states.setdefault(row[0], rule.start())
        want[row[0], row[1]] = rule.step(state, *[row[p] for p in places])
    assert {(r.k, r.i): tuple(r)[2:] for r in out} == want and len(out) == 900


def test_fold_of_an_empty_table(spark):
    assert folds.fold(spark.createDataFrame([], "k int, i int, hit boolean"), ["k"], ["i"], folds.HitBaseline()).count() == 0
    assert table(spark, SF, "events").count() > 0
