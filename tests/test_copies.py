"""Byte echoes, chunk references and path codes against plain loops and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import byte_echoes, chunk_refs, path_codes
from quern.plans import registry
from quern.session import table

SF = "/root/testdata/sf0.001"


def _echoes(text, blocks):
    """The rule by a loop over places: the longest common stretch around equal windows, from the left."""
    out, at, behind = [], 0, 0
    while at + 100 <= len(text):
        best = None
        for name, block in sorted(blocks.items()):
            off = block.find(text[at : at + 100])
            while off >= 0:
                a, b = 0, 100
                while at - a > 0 and off - a > 0 and text[at - a - 1] == block[off - a - 1]:
                    a += 1
                while at + b < len(text) and off + b < len(block) and text[at + b] == block[off + b]:
                    b += 1
                if a + b >= 200 and (best is None or a + b > best[1] - best[0]):
                    best = (at - a, at + b, name, off - a)
                off = block.find(text[at : at + 100], off + 1)
        if best:
            start = max(best[0], behind)
            out.append((start, best[1], best[2], best[3] + start - best[0]))
            at = behind = best[1]
        else:
            at += 1
    return out


@pytest.mark.parametrize("segment", [64, 1 << 18])
def test_byte_echoes_equal_a_loop(spark, monkeypatch, segment):
    monkeypatch.setattr(byte_echoes, "SEGMENT", segment)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    blocks = {i: some(rng.choice([150, 250, 600, 900])) for i in range(8)}
    blocks[8] = blocks[1][:240] + some(100)
    blocks[9] = "x" * 700
    texts = {}
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(5)):
            block = blocks[rng.randrange(9)]
            low = rng.randrange(max(1, len(block) - 180))
            parts += [some(rng.randrange(60)), block[low : low + rng.choice([120, 198, 230, 400])]]
        texts[i] = "".join(parts)
    texts |= {100: None, 101: "", 102: "x" * 1500, 103: blocks[2], 104: blocks[3] + blocks[3], 105: texts[7]}
    got = byte_echoes.echoes(spark.createDataFrame(list(texts.items()), "text_id long, text string").repartition(4), spark.createDataFrame(list(blocks.items()), "block_id long, text string")).collect()
    want = {i: _echoes((t or "").encode(), {k: b.encode() for k, b in blocks.items()}) for i, t in texts.items()}
    by = {i: sorted((r.start, r.end, r.block_id, r.off) for r in got if r.text_id == i) for i in texts}
    assert by == {i: sorted(w) for i, w in want.items()} and sum(map(len, want.values())) > 30
    assert byte_echoes.marked(b"aXXb", [(1, 3, "f:L1")]) == b"a[unchanged: f:L1]b"


def test_a_passage_that_most_texts_share(spark, monkeypatch):
    hot = byte_echoes.hot_keys
    monkeypatch.setattr(byte_echoes, "hot_keys", lambda counts, key, total=None, least=1: hot(counts, key, 0, 1))
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(260))
    texts = spark.range(300).select(F.col("id").alias("text_id"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" "), F.lit(passage)).alias("text"))
    got = byte_echoes.echoes(texts, spark.createDataFrame([(1, passage)], "block_id int, text string"))
    assert got.filter(F.col("end") - F.col("start") == 260).count() == got.count() == 300


def test_line_cuts_and_plans():
    rng = random.Random(1)
    text = "\n".join("word " * rng.randrange(30) + str(i) for i in range(400)).encode()
    for data in (text, text.replace(b"7\n", b"7\r\n"), b"", b"one\ntwo", b"x\n" * 40, b"y" * 9000 + b"\n" * 40):
        for plan in chunk_refs.plans(data).values():
            assert b"".join(p for _, p in plan) in (data, b"")
    cuts = chunk_refs.line_cuts(text)
    assert cuts[-1] == len(text) and all(text[c - 1 : c] == b"\n" for c in cuts[:-1]) and chunk_refs.line_cuts(b"a\n" * 31) == []
    full = 1469598103934665603
    for line in text.splitlines(True)[:50]:
        x = full
        for b in line:
            x = ((x ^ b) * 1099511628211) % (1 << 64)
        assert chunk_refs._ends_chunk(line) == (x & 7 == 0)


def test_encode_takes_the_most_useful_repeats_that_fit():
    chunks = [(f"c{i}", bytes([65 + i]) * n) for i, n in enumerate([500, 90, 400, 300, 10])]
    data, saved, refs, used = chunk_refs.encode(chunks, {"c0", "c2", "c3", "c4"}, 850)
    # 500 first, then 400 doesn't fit, 300 does; 10 is shorter than its reference.
    assert (refs, used) == (2, 800) and chunk_refs.decode(data, dict(chunks)) == b"".join(p for _, p in chunks) and saved == 1300 - len(data)
    assert chunk_refs.decode(data, {}) == data


def test_chunk_references_read_back(spark):
    rng, rows = random.Random(4), []
    lines = [f"line {i} " + "z" * rng.randrange(40) for i in range(900)]
    for i in range(14):
        low = rng.randrange(500)
        rows.append((None if i % 5 == 0 else "s" if i % 2 else "t", i, "\n".join(lines[low : low + 400])))
    rows += [("s", 20, None), ("s", 21, ""), ("s", 22, rows[1][2]), ("s", 23, rows[1][2] + "[context-chunk status=unchanged uri=local-archive://x bytes=3]")]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(5)
    out = chunk_refs.encoded(docs)
    back = {r.doc_id: r.text for r in chunk_refs.decoded(out, chunk_refs.archived(docs)).collect()}
    assert back == {i: t or "" for _, i, t in rows}
    # By a loop: what each text may refer to is what its session had before it.
    seen, want = {}, {}
    for session, i, text in sorted(rows, key=lambda r: r[1]):
        data, had = (text or "").encode(), seen.setdefault(session, set())
        best = (data, 0)
        for plan in chunk_refs.plans(data).values():
            got = chunk_refs.encode(plan, had, len(data))
            best = got[:2] if got[1] > best[1] else best
        want[i] = (bytes(best[0]), best[1])
        had |= {name for plan in chunk_refs.plans(data).values() for name, _ in plan}
    got = {r.doc_id: (bytes(r.data), r.saved) for r in out.collect()}
    assert got == want and sum(s > 0 for _, s in want.values()) > 3
    halved = chunk_refs.encoded(docs, percent=50).filter("refs > 0").select(F.max(F.col("ref_bytes") / F.length("data"))).first()
    assert halved[0] is not None


def test_chunk_references_of_documents_read_back(spark):
    assert registry.queries()["chunk_references"](spark, SF).filter("not reads_back").count() == 0 and table(spark, SF, "documents").count() == 200


def test_path_codes(spark):
    long, other = "/home/user/projects/quern/main.py", "/opt/tools/release/bin/of/this/run"
    texts = [f"{long} " * 5, f"{other} {long} " * 3, f"{long} " * 2, f"http:{long} " * 9, "/srv/a/b/c/d/e/f/g/h/i/j/k/l " * 9, f"{long} " * 5 + "[P1]", None, "", f"{long} {long}/deeper/still " * 4, f"{long} " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.coded, r.saved, r.back) for r in path_codes.coded(rows).withColumn("back", path_codes.expanded(F.col("coded"))).collect()}
    assert [got[i][2] for i in range(len(texts))] == texts
    assert got[0][0] == f"[path dictionary]\n[P1]={long}\n[/path dictionary]\n" + "[P1] " * 5 and got[0][1] == len(texts[0]) - len(got[0][0])
    assert got[1][0].startswith(f"[path dictionary]\n[P1]={other}\n[P2]={long}\n") and {got[i][1] for i in (2, 3, 4, 5, 6, 7, 9)} == {0}
    assert "[P1]/deeper/still" in got[8][0]
