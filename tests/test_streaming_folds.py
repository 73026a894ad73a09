"""Folds over streams in several triggers, with restarts from the checkpoint and keys closed by timers."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import folds
from quern.streaming import folds as S


def _triggers(spark, tmp_path, name, parts, schema, make):
    """Each part is a file and a query of its own over one checkpoint, as after a restart."""
    source, out = tmp_path / "in", []
    source.mkdir()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        table = f"{name}_{k}"
        q = make(spark.readStream.schema(schema).parquet(str(source))).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).queryName(table).start()
        assert q.awaitTermination(120) and q.exception() is None
    return out


@pytest.mark.parametrize("rule", [folds.TokenRatio(), S.LineDedup(window=3)])
def test_restarts_give_what_one_run_gives(spark, tmp_path, rule):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2]), i, rng.choice([None, 0, 40, 70]), rng.randrange(1, 90), rng.choice(["a", "a", "b", "c", "d", "e", None])) for i in range(60)]
    schema = "k long, i long, observed long, estimated long, line string"
    out = _triggers(spark, tmp_path, type(rule).__name__, [rows[:17], rows[17:18], rows[18:]], schema, lambda s: S.fold_stream(s, ["k"], ["i"], rule))
    states, want = {}, {}
    for k, i, observed, estimated, line in rows:
        values = (line,) if isinstance(rule, S.LineDedup) else (observed, estimated)
        want[k, i] = rule.step(states.setdefault(k, rule.start()), *values)
    assert {(r.k, r.i): tuple(r)[2:] for r in out} == want


def test_line_dedup_by_hand():
    rule = S.LineDedup(window=2)

    def run(lines):
        state = rule.start()
        return [x for x in [*[rule.step(state, line)[0] for line in lines], rule.finish(state)[0]] if x is not None]

    assert run(["a", "a", "a", "b", "a", "c", "a", "a"]) == ["a (x3)", "b", "c", "a (x2)"]
    assert run([]) == [] and run(["", ""]) == [" (x2)"]


def test_phrases_over_pieces_are_cut_and_ends_come_out(spark, tmp_path):
    rule = S.PhraseCutter(("Let me know if",), least=10, tail=40, hold=3)
    told = {1: ["The answer is 42.", " It is", " so. Le", "t me kn", "ow if you", " need more"], 2: ["The answer", " is 7.", " Done"]}
    rows = [(k, i, p, 1_700_000_000 + i) for k, pieces in told.items() for i, p in enumerate(pieces)]
    schema = "k long, i long, piece string, second long"
    later = [(9, 0, "later", 1_700_100_000)]
    out = _triggers(spark, tmp_path, "cutter", [rows[:4], rows[4:], later, [(9, 1, "x", 1_700_200_000)]], schema, lambda s: S.fold_stream(s.withColumn("ts", F.timestamp_seconds("second")), ["k"], ["i"], rule, time="ts", idle_seconds=60))
    by = {k: "".join(r.emit for r in sorted((r for r in out if r.k == k), key=lambda r: (r.i is None, r.i or 0)) if r.emit) for k in (1, 2)}
    assert by[2] == "".join(told[2]) and by[1].startswith("The answer is 42.") and "Le" not in by[1]
    assert any(r.cut for r in out if r.k == 1) and not any(r.cut for r in out if r.k == 2)
