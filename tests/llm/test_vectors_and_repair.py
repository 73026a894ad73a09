"""Whitening, near vectors and conversation repair against brute force, on edge rows and hot groups."""

import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_repair, lattice_dedup, queries, whitening
from quern.session import table

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id long, key string, rows long, x string"
CLASH = (9, "k", 7, "x")


# Whitening


def _whitened(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), [int(s) for s in x.astype(object).sum(0)]
    off = x - np.array(sums, np.float64) / n
    cov = off.T @ off / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    deviations = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return off @ axes / np.sqrt(e), e / np.trace(cov), deviations


def _check_whitening(rows, vectors):
    want, explained, deviations = _whitened([v for _, v in vectors])
    k = want.shape[1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == len(vectors) * k
    got = np.array([[by[i, c + 1].whitened for c in range(k)] for i, _ in vectors])
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-8
    assert {r.n for r in rows} == {len(vectors)} and max(r.identity_error for r in rows) < 1e-4
    assert [by[i, 1].deviation for i, _ in vectors] == deviations
    assert np.allclose([by[vectors[0][0], c + 1].explained for c in range(k)], explained, rtol=1e-9)


def test_whitening_equals_numpy(spark):
    rows = queries.op11_whitening(spark, SF).collect()
    _check_whitening(rows, [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()])


def test_whitening_of_edge_rows(spark):
    rng = np.random.default_rng(3)
    fine = [(i, [float(x) for x in np.float32(rng.normal(size=10))], i % 3) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [(50, None, 1), (51, [1.0] * 9 + [None], 1), (52, [nan] + [1.0] * 9, 1), (53, [inf] + [1.0] * 9, None), (54, [-inf] * 10, 1), (55, [], 1), (56, [1.0] * 4, 1)]
    rows = [(*r, *CLASH) for r in [*fine, *bad]]
    _check_whitening(whitening.whitened_components(spark.createDataFrame(rows, VECTORS)).collect(), [(i, v) for i, v, _ in fine])
    again = whitening.whitened_components(spark.createDataFrame([(*r, *CLASH) for r in [fine[0], *fine]], VECTORS)).collect()
    assert len(again) == 41 * 8 and {r.n for r in again} == {41}


def test_whitening_without_variance(spark):
    assert whitening.whitened_components(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([(1, None, 1, *CLASH), (2, [], 1, *CLASH)], VECTORS)).count() == 0
    one = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0], 1, *CLASH)], VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = whitening.whitened_components(spark.createDataFrame([(i, [float(i), 5.0], 1, *CLASH) for i in range(4)], VECTORS)).collect()
    assert {r.whitened for r in flat if r.component == 2} == {None} and {r.identity_error < 1e-9 for r in flat} == {True}
    far = whitening.whitened_components(spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)], 1, *CLASH) for i in range(4)], VECTORS)).collect()
    assert {r.deviation for r in far} == {None} and len(far) == 8


def test_whitening_sums_the_triangle_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=9)], 1, *CLASH) for i in range(30)]
    _check_whitening(whitening.whitened_components(spark.createDataFrame(rows, VECTORS.replace("float", "double"))).collect(), [(r[0], r[1]) for r in rows])


# Near vectors


def _near(rows, threshold=0.98):
    """vec_id's and links by brute force; rows: (id, vector, label)."""
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def fine(i):
        v = rows[i][1]
        return rows[i][2] is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.asarray(rows[i][1], float) / np.abs(np.asarray(rows[i][1], float)).max() if fine(i) else None for i in range(n)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
                root[b] = a
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def _got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def _clusters(rng, d, sizes, spread):
    out = []
    for label, size in enumerate(sizes):
        base = rng.normal(size=d)
        base /= np.linalg.norm(base)
        for _ in range(size):
            v = base + rng.normal(size=d) * spread / d**0.5
            out.append(([float(x) for x in np.float32(v * rng.choice([1, 3]))], label % 3))
    return out


@pytest.mark.parametrize("d", [3, 8, 12, 64])
def test_near_vectors_equal_brute_force(spark, d):
    rng = np.random.default_rng(d)
    found = _clusters(rng, d, [1, 2, 3, 5, 20, 60, 1, 1], 0.1) + _clusters(rng, d, [1] * 60, 0.1)
    found += found[:7]
    order = rng.permutation(len(found))
    rows = [(int(order[i]), *v) for i, v in enumerate(found)]
    got = _got(lattice_dedup.near_vectors(spark.createDataFrame([(*r, *CLASH) for r in rows], VECTORS).repartition(5)))
    assert got == _near(rows)


def test_near_vectors_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [], 1),
        (11, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.001], 1), (None, [0.0, 1.0], 1), (12, [1e38, 0.0], 1), (13, [1e-38, 0.0], 1), (14, [-1.0, 0.0], 1), (15, [0.0, 5.0], 2), (16, [-0.0, 5.0], 2),
    ]
    assert _got(lattice_dedup.near_vectors(spark.createDataFrame([(*r, *CLASH) for r in rows], VECTORS))) == _near(rows)
    assert lattice_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    one = lattice_dedup.near_vectors(spark.createDataFrame([(5, [1.0], 1, *CLASH)], VECTORS)).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]


def test_near_vectors_of_hot_cells_chunks_and_copies(spark, monkeypatch):
    """Every shared cell, class and component goes the way of hot ones, chunks and parts are small."""
    hot = lattice_dedup.hot_keys
    monkeypatch.setattr(lattice_dedup, "hot_keys", lambda counts, key, total=None, least=1: hot(counts, key, 0, 1))
    monkeypatch.setattr(lattice_dedup, "CHUNK", 5)
    monkeypatch.setattr(lattice_dedup, "MOST", 5)
    monkeypatch.setattr(lattice_dedup, "PART", 3)
    rng = np.random.default_rng(2)
    found = _clusters(rng, 16, [120, 40, 3], 0.16)
    found = [(v, 1) for v, _ in found] + [(found[0][0], 1)] * 30
    rows = [(i, *v) for i, v in enumerate(found)]
    assert _got(lattice_dedup.near_vectors(spark.createDataFrame([(*r, *CLASH) for r in rows], VECTORS).repartition(4))) == _near(rows)


def test_lattice_points_are_the_closest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 1.5
    home = lattice_dedup.closest_e8(x)
    assert len({tuple(v) for v in lattice_dedup.NEIGHBOURS}) == 240 and {round(float(v @ v), 9) for v in lattice_dedup.NEIGHBOURS} == {2.0}
    twice = np.rint(2 * home).astype(int)
    assert (2 * home == twice).all() and ((twice % 2 == twice[:, :1] % 2).all(1)).all() and (home.sum(1) % 2 == 0).all()
    others = home[:, None] + lattice_dedup.NEIGHBOURS[None]
    assert (((x - home) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-12).all()


def test_recall_at_the_threshold():
    """Pairs at a cosine of just 0.98 meet in a table that is home to one of them."""
    rng = np.random.default_rng(7)
    x = lattice_dedup.unit(rng.normal(size=(4000, 64)))
    z = rng.normal(size=x.shape)
    z = lattice_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * z
    a, b = (lattice_dedup.cells(v, lattice_dedup.TABLES, lattice_dedup.PROBES, lattice_dedup.SCALE * 0.2, 8) for v in (x, y))
    met = (a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)
    assert met.any(1).mean() > 0.999 and met.mean() > 0.8


# Conversation repair


def _repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text) by a plain dynamic programme."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, out) in list(best.items()):
                way = (cost + 5, audit + "I", [*out, (names[due[last]], "")])
                if due[last] not in best or way[:2] < best[due[last]][:2]:
                    best[due[last]] = way
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def put(last, way):
            if last not in after or way[:2] < after[last][:2]:
                after[last] = way

        for last, (cost, audit, out) in inserted(best).items():
            put(last, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if role[:1] == due[last] or last == "" and role[:1] == "s":
                put(role[:1], (cost + more, audit + "K", [*out, (role, text)]))
            put(due[last], (cost + more + 1, audit + "R", [*out, (names[due[last]], text)]))
        best = after
    cost, audit, out = min((w for last, w in inserted(best).items() if last in ("", "a")), key=lambda w: w[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(key.encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def _by_conv(original, rows):
    return {conv: _repaired([r[1:] for r in rows if r[0] == conv]) for conv in {r[0] for r in original}}


def _report(pieces):
    return {r[0]: tuple(r)[1:] for r in chat_repair.report(pieces).collect()}


TURNS = "conv_id long, turn long, role string, text string, conv string, copies int, key string, part int"


def _random_rows(seed, convs, length):
    rng, rows = random.Random(seed), []
    said = ["yes.", "no", "", " \n", "why?", "go on", "ok!", "é.", "it is. "]
    for conv in convs:
        for turn in range(rng.randrange(length + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "s", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None, turn + 3]), role, rng.choice([*said, f"text {turn}.", f"text {turn}.", f"text {turn}", None])))
    return rows


@pytest.mark.parametrize("seed,partitions,block", [(1, 3, 128), (2, 1, 128), (3, 7, 2), (4, 20, 1)])
def test_repair_equals_brute_force(spark, monkeypatch, seed, partitions, block):
    monkeypatch.setattr(chat_repair, "BLOCK", block)
    rows = _random_rows(seed, [None, *range(60)], 9)
    rows += rows[:15]
    df = spark.createDataFrame([(*r, "c", 5, "k", 1) for r in rows], TURNS).repartition(4)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert _report(chat_repair.repair(df, partitions=partitions)) == _by_conv(plain, plain)


def test_damaged_conversations_equal_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == _by_conv(rows, _damage(rows))


def test_damage_of_edge_rows(spark):
    rows = _random_rows(9, [None, -1, *range(80)], 6) + [(7, 0, "user", "a.b!c?"), (500 + 1, None, None, None)]
    df = spark.createDataFrame([(*r, "c", 5, "k", 1) for r in rows], TURNS)
    got = _report(chat_repair.repair(chat_repair.damaged(df), copies_col="copies", partitions=5))
    assert got == _by_conv(rows, _damage(rows))
    gone = [r for r in range(3000) if zlib.crc32(f"{r}:0".encode()) % 20 == 0][0]
    lost = spark.createDataFrame([(gone, 0, "user", "hello.", "c", 1, "k", 1)], TURNS)
    assert _report(chat_repair.repair(chat_repair.damaged(lost), copies_col="copies")) == {gone: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    assert chat_repair.report(chat_repair.repair(spark.createDataFrame([], TURNS))).count() == 0


def test_a_conversation_over_many_tasks(spark, monkeypatch):
    """One conversation holds most rows, one row of it thousands of copies; also a text beyond a block."""
    monkeypatch.setattr(chat_repair, "BLOCK", 16)
    monkeypatch.setattr(chat_repair, "CHARACTERS", 1000)
    rng, rows = random.Random(6), []
    for turn in range(700):
        rows.append((1, turn, rng.choice(["user", "assistant", "system"]), rng.choice([f"turn {turn}.", "ok.", "cut", "", "x" * 3000 + "."])))
    rows += [(1, 300, "user", "again.")] * 2500 + [(2, 0, "user", "hi."), (2, 1, "assistant", "ho.")]
    df = spark.createDataFrame([(*r, "c", 5, "k", 1) for r in rows], TURNS).repartition(8)
    pieces = chat_repair.repair(df, partitions=6)
    assert _report(pieces) == _by_conv(rows, rows)
    assert pieces.filter("conv = 1").select("part").distinct().count() > 1


def test_search_takes_the_least_edits_in_ascii_order():
    costs = chat_repair.Costs()
    rng = random.Random(3)
    for _ in range(300):
        rows = [(i, rng.choice(["s", "u", "a", "t"]), rng.choice(["x.", "x", "", "y.", f"{i}."])) for i in range(rng.randrange(8))]
        faults, seen = [], set()
        for _, role, text in rows:
            faults.append(chat_repair.BLANK if not text else chat_repair.REPEAT if (role, text) in seen else chat_repair.FINE if text.endswith(".") else chat_repair.CUT_OFF)
            seen.add((role, text))
        ((cost, audit),) = chat_repair.search([(r[1], f, 1) for r, f in zip(rows, faults)], 0, costs, True).values()
        assert (cost, audit) == _repaired(rows)[5:7]
