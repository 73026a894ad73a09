"""Ordered folds with carried state, for rules that don't combine: each row's result depends on all rows before it.

Rows are dealt by ranges of (key, order), so a key may be many chunks. The first chunks of all keys run at
once; the state after a chunk, a short JSON text, is handed to the next chunk of its key in the next
round. Only keys that a range boundary splits have a second chunk, so the states that a round hands on
are at most one a partition. The same rules run on streams (`quern.streaming.folds`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut, ship


class Rule(Protocol):
    """columns: what a row gives; outputs: names and types of what it gets. start and step keep the state, a list that JSON can hold."""

    columns: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]

    def start(self) -> list: ...

    def step(self, state: list, *row) -> tuple: ...


@dataclass(frozen=True)
class HitBaseline:
    """Hit rate of the last `size` rows against a baseline that follows healthy rates: a spike is a rate under (1 - drop) of it.

    The baseline is the first full rate; a spike leaves it, any other rate moves it by `share`. Fixed values of the rule: 50, 0.25, 0.05.
    """

    size: int = 50
    drop: float = 0.25
    share: float = 0.05
    columns: tuple[str, ...] = ("hit",)
    outputs: tuple[tuple[str, str], ...] = (("rate", "double"), ("baseline", "double"), ("spike", "boolean"))

    def start(self) -> list:
        return ["", None]

    def step(self, state: list, hit) -> tuple:
        ring = (state[0] + ("1" if hit else "0"))[-self.size :]
        baseline, rate, spike = state[1], None, False
        if len(ring) == self.size:
            rate = ring.count("1") / self.size
            if baseline is None:
                baseline = rate
            elif rate < baseline * (1 - self.drop):
                spike = True
            else:
                baseline = (1 - self.share) * baseline + self.share * rate
        state[:] = [ring, baseline]
        return rate, baseline, spike


@dataclass(frozen=True)
class TokenRatio:
    """Bytes per 1000 tokens, moved by `share` towards what was observed, bounded, its fraction dropped at each step.

    Rows without a positive observation or estimate don't move it. Fixed values of the rule: 3500, 0.05, 1500 to 6000.
    """

    first: int = 3500
    share: float = 0.05
    low: int = 1500
    high: int = 6000
    columns: tuple[str, ...] = ("observed", "estimated")
    outputs: tuple[tuple[str, str], ...] = (("ratio", "bigint"),)

    def start(self) -> list:
        return [self.first]

    def step(self, state: list, observed, estimated) -> tuple:
        if observed and estimated and observed > 0 and estimated > 0:
            ratio = state[0]
            state[0] = int(min(max(ratio * (1 - self.share) + ratio * estimated / observed * self.share, self.low), self.high))
        return (state[0],)


@dataclass(frozen=True)
class LengthAverage:
    """Moving average of session lengths: the first one, then `share` of each new one. Lengths under 1 don't count. Fixed value of the rule: 0.1."""

    share: float = 0.1
    columns: tuple[str, ...] = ("length",)
    outputs: tuple[tuple[str, str], ...] = (("estimate", "double"), ("samples", "bigint"))

    def start(self) -> list:
        return [None, 0]

    def step(self, state: list, length) -> tuple:
        if length and length >= 1:
            state[:] = [float(length) if state[0] is None else self.share * length + (1 - self.share) * state[0], state[1] + 1]
        return tuple(state)


@dataclass(frozen=True)
class Debounce:
    """Whether a trigger is accepted: not within `seconds` of the last accepted one of its key. Fixed value of the rule: 120."""

    seconds: int = 120
    columns: tuple[str, ...] = ("micros",)
    outputs: tuple[tuple[str, str], ...] = (("accepted", "boolean"),)

    def start(self) -> list:
        return [None]

    def step(self, state: list, micros) -> tuple:
        fine = state[0] is None or micros - state[0] >= self.seconds * 1_000_000
        if fine:
            state[0] = micros
        return (fine,)


@dataclass(frozen=True)
class Downgrade:
    """The profile that a turn gets: the wanted one, or for `cooldown` turns a softer one after too many failures or too little gain.

    A turn takes the profile first, then its outcome counts if it was applied. After `samples` outcomes
    outside a cooldown, a failure rate over `failures` or an overhead over `overhead` percent of the output
    goes one step softer and counts anew. Fixed values of the rule: 30, 20 and the order of profiles.
    """

    samples: int = 30
    cooldown: int = 20
    failures: float = 0.1
    overhead: float = 50.0
    softer: dict = field(default_factory=lambda: {"aggressive": "standard", "standard": "mild", "mild": "off"})
    columns: tuple[str, ...] = ("wanted", "applied", "added", "output", "failed")
    outputs: tuple[tuple[str, str], ...] = (("profile", "string"), ("cooling", "bigint"))

    def start(self) -> list:
        return [None, None, 0, 0, 0, 0, 0]

    def step(self, state: list, wanted, applied, added, output, failed) -> tuple:
        soft, profile, cooling, n, overhead, given, failures = state
        profile = profile or wanted
        if soft is not None and cooling > 0:
            cooling -= 1
            got = soft
        else:
            if soft is not None:
                soft, profile = None, wanted
            got = wanted
        if applied:
            if cooling <= 0:
                profile = wanted
            n, overhead, given, failures = n + 1, overhead + (added or 0), given + (output or 0), failures + bool(failed)
            if cooling <= 0 and n >= self.samples and (0 < self.failures < failures / n or given > 0 and overhead / given * 100 > self.overhead):
                soft = profile = self.softer.get(profile, "off")
                cooling, n, overhead, given, failures = self.cooldown, 0, 0, 0, 0
        state[:] = [soft, profile, cooling, n, overhead, given, failures]
        return got, cooling


def fold(rows: DataFrame, by: list[str], order: list[str], rule: Rule, partitions: int | None = None) -> DataFrame:
    """by, order and the rule's outputs for every row, each computed after all rows before it in its key.

    (by, order) should be unique; rows that tie are taken in any order. Nulls in `by` are a key of their
    own, in `order` they come first. An empty table gives no rows.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [*by, *order]
    inputs = [c for c in rule.columns]
    named = rows.select(*kept, *[F.col(c).alias(f"__in_{c}") for c in inputs])
    placed = cut(named.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    # Chunks of split keys, numbered; at most two a partition, so they may be broadcast.
    chunks = placed.select(*by, "__part").distinct()
    of_key = Window.partitionBy(*by)
    split = cut(chunks.withColumn("__chunks", F.count(F.lit(1)).over(of_key)).filter("__chunks > 1").withColumn("__chunk", F.row_number().over(of_key.orderBy("__part"))))
    same = lambda other: [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by]
    sided = lambda df, other, extra: df.select(*[F.col(c).alias(f"{other}{c}") for c in by], *extra)
    number = sided(split, "__k_", [F.col("__part").alias("__at"), "__chunk"])
    numbered = placed.join(F.broadcast(number), [F.col("__part") == F.col("__at"), *same("__k_")], "left").drop("__at", *[f"__k_{c}" for c in by]).withColumn("__chunk", F.coalesce("__chunk", F.lit(1)))
    rounds = split.agg(F.coalesce(F.max("__chunk"), F.lit(1))).first()[0]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in named.dtypes if c in kept], *[f"`{c}` {t}" for c, t in rule.outputs], "__state string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by chunk and order; the state goes out with a chunk's last row."""
        key, state, held = None, None, None
        types = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            out, states = [], []
            keys = list(zip(*[batch.column(c).to_pylist() for c in by], batch.column("__part").to_pylist()))
            values = list(zip(*[batch.column(f"__in_{c}").to_pylist() for c in inputs]))
            handed = batch.column("__handed").to_pylist()
            for k, v, h in zip(keys, values, handed):
                if k != key:
                    if states:
                        states[-1] = json.dumps(state)
                    elif held is not None:
                        held = held.set_column(held.num_columns - 1, "__state", pa.array([json.dumps(state)], pa.string()))
                    key, state = k, json.loads(h) if h else rule.start()
                out.append(rule.step(state, *v))
                states.append(None)
            if held is not None:
                yield held
            columns = [batch.column(c) for c in kept] + [pa.array([o[i] for o in out], types[t]) for i, (_, t) in enumerate(rule.outputs)] + [pa.array(states, pa.string())]
            done = pa.RecordBatch.from_arrays(columns, [*kept, *[c for c, _ in rule.outputs], "__state"])
            # The last row waits, as its chunk may end with it.
            if len(done):
                yield done.slice(0, len(done) - 1)
                held = done.slice(len(done) - 1)
        if held is not None:
            yield held.set_column(held.num_columns - 1, "__state", pa.array([json.dumps(state)], pa.string()))

    done, states = None, None
    for r in range(1, rounds + 1):
        part = numbered.filter(F.col("__chunk") == r)
        if states is None:
            part = part.withColumn("__handed", F.lit(None).cast("string"))
        else:
            part = part.join(F.broadcast(states), same("__s_"), "left").drop(*[f"__s_{c}" for c in by])
        ordered = part.repartition(n, *by, "__part").sortWithinPartitions(*by, "__part", *order)
        found = cut(ordered.mapInArrow(run, schema))
        if r < rounds:
            states = sided(found.filter("__state IS NOT NULL").join(F.broadcast(sided(split.select(*by).distinct(), "__k_", [])), same("__k_"), "left_semi"), "__s_", [F.col("__state").alias("__handed")])
        done = found if done is None else done.unionByName(found)
    return done.drop("__state")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))
