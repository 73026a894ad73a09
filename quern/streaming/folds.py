"""Ordered folds over streams: the rules of `quern.operators.folds`, and rules that only streams need.

A key's state is the rule's short list as JSON in the state store, so a restart from the checkpoint goes on
where the last trigger ended. Rows of one trigger are taken in order. With an event time, a key that had no
rows for `idle` is closed by a timer once the watermark has passed: what its rule holds back comes out and
the state goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quern.operators.folds import Rule
from quern.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class LineDedup:
    """Lines without those among the last `window` distinct ones; repeats in a row become one line with (xN).

    A line comes out when the next new one is seen, or at the end. Lines are told by 64-bit digests, of
    which the oldest is dropped beyond `window` (a fixed value of the rule: 500).
    """

    window: int = 500
    columns: tuple[str, ...] = ("line",)
    outputs: tuple[tuple[str, str], ...] = (("emit", "string"),)

    def start(self) -> list:
        return [[], None, 0]

    def step(self, state: list, line) -> tuple:
        seen, last, count = state
        line = "" if line is None else line
        digest = blake2b(line.encode(), digest_size=8).hexdigest()
        if count and seen and digest == seen[-1]:
            state[2] = count + 1
            return (None,)
        if digest in seen:
            return (None,)
        out = self.finish(state)
        state[:] = [[*seen, digest][-self.window :], line, 1]
        return out

    def finish(self, state: list) -> tuple:
        _, last, count = state
        return (None if not count else last if count == 1 else f"{last} (x{count})",)


@dataclass(frozen=True)
class PhraseCutter:
    """Pieces of an answer up to a closing phrase: once the text has `least` characters and a phrase stands in its last `tail` ones, nothing more comes out.

    `hold` pieces are held back, so the beginning of a phrase that spreads over pieces doesn't come out
    either; a phrase over any number of pieces is found, as the tail is of the text. What is held comes out
    at the end if no phrase was found. Fixed values of the rule: 80 and 96.
    """

    phrases: tuple[str, ...]
    least: int = 80
    tail: int = 96
    hold: int = 4
    columns: tuple[str, ...] = ("piece",)
    outputs: tuple[tuple[str, str], ...] = (("emit", "string"), ("cut", "boolean"))

    def start(self) -> list:
        return ["", 0, [], False]

    def step(self, state: list, piece) -> tuple:
        text, size, held, done = state
        if done or not piece:
            return None, done
        # A piece may be longer than the tail; what is checked is the tail after it, as the text then ends.
        text, size = (text + piece)[-self.tail :], size + len(piece)
        if size >= self.least and any(p in text for p in self.phrases):
            state[:] = ["", size, [], True]
            return None, True
        held = [*held, piece]
        out = held.pop(0) if len(held) > self.hold else None
        state[:] = [text, size, held, False]
        return out, False

    def finish(self, state: list) -> tuple:
        return "".join(state[2]) or None, state[3]


class _Keeper(StatefulProcessor):
    def __init__(self, by: list[str], order: list[str], rule: Rule, time: str | None, idle_ms: int):
        self.by, self.order, self.rule, self.time, self.idle_ms = by, order, rule, time, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string, until bigint")

    def _frame(self, key: tuple, places: list[tuple], results: list[tuple]) -> pd.DataFrame:
        out = {c: [k] * len(results) for c, k in zip(self.by, key)} | {c: [p[i] for p in places] for i, c in enumerate(self.order)} | {c: [r[i] for r in results] for i, (c, _) in enumerate(self.rule.outputs)}
        return pd.DataFrame(out, dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state = json.loads(held[0]) if held else self.rule.start()
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        inputs = [[None if v is pd.NA or v is None or v != v else v for v in frame[c].astype(object)] for c in self.rule.columns]
        places = list(frame[self.order].astype(object).itertuples(index=False, name=None))
        results = [self.rule.step(state, *values) for values in zip(*inputs)]
        until = held[1] if held else None
        if self.time is not None:
            new = max(int(pd.Timestamp(frame[self.time].max()).timestamp() * 1000) + self.idle_ms, until or 0)
            if new != until:
                if until is not None:
                    self.handle.deleteTimer(until)
                self.handle.registerTimer(new)
                until = new
        self.state.update((json.dumps(state), until))
        yield self._frame(key, places, results)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = json.loads(self.state.get()[0])
            self.state.clear()
            if hasattr(self.rule, "finish"):
                yield self._frame(key, [tuple(None for _ in self.order)], [self.rule.finish(state)])

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, by: list[str], order: list[str], rule: Rule, time: str | None = None, late: str = "10 minutes", idle_seconds: int = 1800) -> DataFrame:
    """by, order and the rule's outputs for every row of a stream; a row without order is what a key's end gave.

    time: a timestamp column; keys are closed after `idle_seconds` without rows, rows over `late` late are
    dropped. Without it keys stay open. Needs the RocksDB state store (`PROVIDER`).
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = dict(stream.dtypes)
    wanted = [c for c in dict.fromkeys([*by, *order, *rule.columns, *([time] if time else [])])]
    narrow = stream.select(*wanted)
    narrow = narrow.withWatermark(time, late) if time else narrow
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*by, *order]], *[f"`{c}` {t}" for c, t in rule.outputs]])
    keeper = _Keeper(by, order, rule, time, idle_seconds * 1000)
    return narrow.groupBy(*[F.col(c) for c in by]).transformWithStateInPandas(keeper, schema, "append", "eventTime" if time else "none")
