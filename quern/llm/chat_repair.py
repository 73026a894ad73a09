"""Conversation structure repair: A* on the edit lattice of a conversation's rows.

Rows are taken by turn (nulls first, then role, then text). A row is blank, a repeat of an earlier row, cut
off, or fine, by its first fault. Edits: Keep, Rerole to the role that is due, Delete (required for blank
rows and repeats), Insert a row without text; the roles that are left must read (system)? (user
assistant)+ or nothing, by initials.

A node of the lattice is how many rows are decided and which role came last. The search takes nodes by
(cost so far + bound, edits so far): the bound is a suffix sum of what every way on must pay, the
deletions that are required and the lesser charge of each row that is cut off (kept with its charge or
deleted). It never exceeds the cost that is left and falls by no more than an edit costs, so the first
time that a node is taken is the cheapest way to it with the least edits in ASCII order, and the first
goal is the answer.

A conversation of any length, over any number of tasks: rows are dealt by ranges of (conversation, turn,
role, text) and cut into blocks of at most BLOCK rows; equal rows are counted before. Short conversations
inside a range are repaired where they are. For the blocks of others the search runs from each of the
four last roles to each of them; a fold over those 4 x 4 tables (narrow rows, one per block) picks the
roles at the borders, least edits among equal costs, and each block then takes its part. Edits between
two borders that start alike and end apart differ before one is the beginning of the other, so the least
of each part is the least of the whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import attach, cut, hot_keys, ship

#: Rows and characters after which a block ends.
BLOCK, CHARACTERS = 128, 1 << 20
BLANKS = r"[^\x20\x09-\x0D]"
FINE, BLANK, REPEAT, CUT_OFF = range(4)
#: The last role so far: none, system, user, assistant. What is due after it, and where an initial leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
DUE = [USER, USER, ASSISTANT, USER]
STEPS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
NAMES = ["", "system", "user", "assistant"]
LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    cut_off: int = 5

    def least(self, fault: int, copies: int) -> int:
        """What every way over such a row pays."""
        if fault in (BLANK, REPEAT):
            return self.delete * copies
        return (min(self.delete, self.cut_off) if fault == CUT_OFF else 0) + self.delete * (copies - 1)


def search(rows: list[tuple[str, int, int]], entry: int, costs: Costs, final: bool) -> dict[int, tuple[int, str]]:
    """The cheapest edits of rows (initial, fault, copies) after the role `entry`: cost and edits by the last role.

    final: the first allowed end only, with rows inserted behind the last one. Else all that can be reached
    with the last row's edit as the last.
    """
    n = len(rows)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + costs.least(rows[i][1], rows[i][2])
    heap = [(bound[0], "", 0, entry)]
    taken: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while heap:
        f, edits, i, last = heapq.heappop(heap)
        if (i, last) in taken:
            continue
        taken.add((i, last))
        cost = f - bound[i]
        if i == n:
            if not final or last in (NONE, ASSISTANT):
                found[last] = (cost, edits)
                if final or len(found) == 4:
                    break
            if not final:
                continue
        due = DUE[last]
        heapq.heappush(heap, (f + costs.insert, edits + "I", i, due))
        if i == n:
            continue
        initial, fault, copies = rows[i]
        on = cost + bound[i + 1]
        heapq.heappush(heap, (on + costs.delete * copies, edits + "D" * copies, i + 1, last))
        if fault in (BLANK, REPEAT):
            continue
        on += costs.delete * (copies - 1) + (costs.cut_off if fault == CUT_OFF else 0)
        rest = "D" * (copies - 1)
        to = STEPS[last].get(initial)
        if to is not None:
            heapq.heappush(heap, (on, edits + "K" + rest, i + 1, to))
        if to != due:
            heapq.heappush(heap, (on + costs.rerole, edits + "R" + rest, i + 1, due))
    return found


def apply_edits(rows: list[tuple[str, str, int]], edits: str, last: int) -> list[tuple[str, str]]:
    """(role, text) of what is left of the rows (role, text, copies) after the edits, `last` being the role before."""
    flat = ((role, text) for role, text, copies in rows for _ in range(copies))
    out: list[tuple[str, str]] = []
    for e in edits:
        if e == "D":
            next(flat)
            continue
        if e == "K":
            role, text = next(flat)
            last = STEPS[last][role[:1]]
        else:
            last = DUE[last]
            role, text = NAMES[last], "" if e == "I" else next(flat)[1]
        out.append((role, text))
    return out


def _tables(rows: list[tuple[str, int, int]], costs: Costs) -> tuple[list[int], list[int], list[str]]:
    """Costs (-1: no way), places among the edits from the same role, and edits, from each role to each role."""
    prices, places, edits = [], [], []
    for entry in range(4):
        found = search(rows, entry, costs, False)
        order = sorted(found, key=lambda to: found[to][1])
        prices += [found[to][0] if to in found else -1 for to in range(4)]
        places += [order.index(to) if to in found else -1 for to in range(4)]
        edits += [found[to][1] if to in found else "" for to in range(4)]
    return prices, places, edits


class Route:
    """A fold over the tables of a conversation's blocks: for each last role the cheapest way and its place in ASCII order."""

    def __init__(self) -> None:
        self.at: dict[int, tuple[int, int]] = {NONE: (0, 0)}
        self.back: list[bytes] = []

    def add(self, prices: list[int], places: list[int]) -> None:
        best: dict[int, tuple[int, int, int, int]] = {}
        for entry, (cost, place) in self.at.items():
            for to in range(4):
                if (price := prices[4 * entry + to]) >= 0:
                    way = (cost + price, place, places[4 * entry + to], entry)
                    if to not in best or way < best[to]:
                        best[to] = way
        self.back.append(bytes(best[to][3] if to in best else 255 for to in range(4)))
        order = sorted(best, key=lambda to: best[to][1:3])
        self.at = {to: (best[to][0], order.index(to)) for to in best}

    def close(self, costs: Costs) -> list[tuple[int, int, str]]:
        """(entry, exit, edits behind) of each block."""
        tails = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        last = min(self.at, key=lambda to: (self.at[to][0] + costs.insert * len(tails[to]), self.at[to][1]))
        tail, out = tails[last], []
        for back in reversed(self.back):
            out.append((back[last], last, tail))
            last, tail = back[last], ""
        return out[::-1]


PIECE = (
    "whole boolean, part int, seq int, least bigint, most bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first string, last string, cost bigint, audit string, turns array<struct<role:string,text:string>>"
)


def _pieces(placed: DataFrame, kind: str, costs: Costs) -> DataFrame:
    """Blocks of the rows of each range: repaired if they are a whole conversation, else with their tables."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema = TaskContext.get().partitionId(), None
        out: list[dict] = []
        seq = started = 0
        conv = rows = None

        def close(whole: bool) -> None:
            nonlocal seq
            turns = [r[0] for r in rows if r[3] and r[0] is not None]
            real = [r for r in rows if r[3]]
            initials = [r[1][:1] for r in real]
            line = {
                "conv": conv, "whole": whole, "part": part, "seq": seq, "least": min(turns, default=None), "most": max(turns, default=None), "distinct": len(set(turns)),
                "blank": sum(r[3] for r in real if r[4] == BLANK), "duplicate": sum(r[3] if r[4] == REPEAT else r[3] - 1 if r[4] != BLANK else 0 for r in real), "truncated": sum(r[4] == CUT_OFF for r in real),
                "illegal": sum(r[3] - 1 for r in real) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                "first": initials[0] if real else None, "last": initials[-1] if real else None,
            }
            lattice = [(r[1][:1], r[4], r[3]) for r in real]
            if whole:
                ((cost, edits),) = search(lattice, NONE, costs, True).values()
                left = apply_edits([r[1:4] for r in real], edits, NONE)
                line |= {"cost": cost, "audit": edits, "turns": [{"role": r, "text": t} for r, t in left]}
            else:
                prices, places, edits = _tables(lattice, costs)
                line |= {"prices": prices, "places": places, "edits": edits, "rows": [{"role": r[1], "text": r[2], "copies": r[3]} for r in real]}
            out.append(line)
            rows.clear()
            seq += 1

        size = 0
        for batch in batches:
            schema = schema or pa.schema([("conv", batch.schema.field("conv").type), *TYPES])
            for name, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows is None or name != conv:
                    if rows:
                        close(started > 1 and not cut_before)
                    conv, rows, cut_before, size = name, [], False, 0
                    started += 1
                elif len(rows) >= BLOCK or size >= CHARACTERS:
                    close(False)
                    cut_before, size = True, 0
                rows.append(tuple(row))
                size += len(row[2])
            if len(out) > 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if rows:
            close(False)
            yield pa.RecordBatch.from_pylist(out, schema)

    TYPES = [
        ("whole", pa.bool_()), ("part", pa.int32()), ("seq", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("distinct", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
        ("prices", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("edits", pa.list_(pa.string())), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))),
    ]
    tables = "prices array<bigint>, places array<int>, edits array<string>, rows array<struct<role:string,text:string,copies:bigint>>"
    return placed.mapInArrow(run, f"conv {kind}, {PIECE}, {tables}")


def _by_conversation(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv").sortWithinPartitions("conv", "part", "seq")


def _routes(tables: DataFrame, costs: Costs) -> DataFrame:
    """part, seq, entry, exit and edits behind of every block: what is held is four bytes for each block of a conversation."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, keys, route, out = None, [], Route(), []

        def close() -> None:
            nonlocal keys, route
            out.extend({"p": p, "s": s, "entry": a, "exit": b, "tail": t} for (p, s), (a, b, t) in zip(keys, route.close(costs)))
            keys, route = [], Route()

        schema = pa.schema([("p", pa.int32()), ("s", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()), ("tail", pa.string())])
        for batch in batches:
            for name, part, seq, prices, places in zip(*[c.to_pylist() for c in batch.columns]):
                if keys and name != conv:
                    close()
                conv = name
                keys.append((part, seq))
                route.add(prices, places)
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema)

    return _by_conversation(tables).mapInArrow(run, "p int, s int, entry int, exit int, tail string")


def _resolved(blocks: DataFrame, kind: str, costs: Costs) -> DataFrame:
    """The blocks with their part of the repair."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, audits, prices = [], [], []
            for price, edits, rows, entry, to, tail in zip(*[batch.column(c).to_pylist() for c in ("prices", "edits", "rows", "entry", "exit", "tail")]):
                audits.append(edits[4 * entry + to] + tail)
                prices.append(price[4 * entry + to] + costs.insert * len(tail))
                turns.append([{"role": r, "text": t} for r, t in apply_edits([(x["role"], x["text"], x["copies"]) for x in rows], audits[-1], entry)])
            columns = {c: batch.column(c) for c in names} | {"cost": pa.array(prices, pa.int64()), "audit": pa.array(audits, pa.string()), "turns": pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))}
            yield pa.RecordBatch.from_pydict(columns)

    names = ["conv", *[c.split()[0] for c in PIECE.split(", ")]]
    return blocks.mapInArrow(run, f"conv {kind}, {PIECE}")


def repair(turns: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """The repaired conversations in pieces: conv, part and seq (the order of its pieces), turns (role, text), audit, cost and counts.

    Most conversations are one piece (`whole`); `report` folds pieces into a row for each. Null roles and
    texts are one space, so a null text is blank. Rows are ordered by turn (nulls first), then role, then
    text; rows equal in all of them are adjacent, the first one counts and others repeat it. Null
    conversation ids are one conversation. Texts of any length are a row each; a block ends after
    CHARACTERS. An empty table gives no rows. Other columns aren't read. copies_col: how often a row
    occurs, 0 for a row that only names its conversation.

    Distinct texts that share conversation, turn, role and their first 64 characters stay in one range.
    """
    spark = turns.sparkSession
    ship(spark)
    kind = turns.schema[conv_col].dataType.simpleString()
    copies = F.lit(1) if copies_col is None else F.col(copies_col)
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"), copies.cast("long").alias("copies"))
    key = F.struct("conv", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    later = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = rows.filter("copies > 0").groupBy(key.alias("key")).agg(F.min(later).alias("first"), F.count(F.lit(1)).alias("rows"))
    often = cut(said.filter("rows > 1"))
    merged = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    known = attach(merged, often.select("key", "first"), "key", hot_keys(often.select("key", "rows"), "key"), "left")
    end = F.right(F.expr(r"rtrim(' \t\n\u000B\f\r', text)"), F.lit(1))
    fault = (
        F.when(~F.col("text").rlike(BLANKS), BLANK).when(F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")), REPEAT).when(~end.isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = known.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))
    placed = columns.repartitionByRange(n, "conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")
    pieces = cut(_pieces(placed, kind, costs))
    open_ = pieces.filter("not whole")
    routes = cut(_routes(open_.select("conv", "part", "seq", "prices", "places"), costs))
    blocks = open_.join(routes, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    names = ["conv", *[c.split()[0] for c in PIECE.split(", ")]]
    return pieces.filter("whole").select(*names).unionByName(_resolved(blocks, kind, costs))


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def report(pieces: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation.

    The digest is of `role:text`, joined by newlines. Whole conversations are rows already; pieces of others
    are read in order, a piece at a time, so a long conversation is a stream of its pieces.
    """
    import pyarrow as pa

    kind = pieces.schema["conv"].dataType.simpleString()
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0)).cast("bigint").alias("gaps")
    whole = pieces.filter("whole").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, schema, out = None, None, None, []

        def close() -> None:
            least, most, distinct = state["turns"]
            out.append({"conv": conv, "gaps": most - least + 1 - distinct if distinct else 0, **{k: state[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(state["audit"]), "repaired_sha256": state["digest"].hexdigest()})

        for batch in batches:
            schema = schema or pa.schema([("conv", batch.schema.field("conv").type), *[(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")]])
            for row in batch.to_pylist():
                if state is None or row["conv"] != conv:
                    if state is not None:
                        close()
                    conv = row["conv"]
                    state = {"turns": (None, None, 0), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "digest": sha256(), "said": False, "before": None}
                least, most, distinct = state["turns"]
                if row["distinct"]:
                    state["turns"] = (row["least"] if least is None else least, row["most"], distinct + row["distinct"] - (most == row["least"]))
                for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    state[k] += row[k]
                state["audit"].append(row["audit"])
                if row["first"] is not None:
                    state["illegal"] += state["before"] is not None and state["before"] + row["first"] not in LEGAL
                    state["before"] = row["last"]
                if row["n"]:
                    state["digest"].update((("\n" if state["said"] else "") + row["said"]).encode())
                    state["said"] = True
            if len(out) > 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema)

    parts = pieces.filter("not whole").select("conv", "part", "seq", "least", "most", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last", "cost", "audit", F.size("turns").alias("n"), said.alias("said"))
    return whole.unionByName(_by_conversation(parts).mapInArrow(run, f"conv {kind}, {REPORT}"))


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` damaged by crc32 of conv_id:turn modulo 20, with `copies`: 0 dropped, 1 emptied, 2 without [.!?], 3 twice, 4 said by the user.

    Nulls are one space, in the key as well. A dropped row stays with 0 copies and no content, so its
    conversation is known.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    gone = F.col("k") == 0
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"),
        F.when(gone, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"),
    )
