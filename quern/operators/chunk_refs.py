"""Chunk references that can be read back: texts encoded against the chunks that their session has seen.

Every text has two plans, content-defined chunks and chunks of lines. A chunk is a repeat if an earlier
text of the session has it in the same kind of plan. Of a plan's repeats the most useful are replaced by
references under a budget of bytes; the better plan is taken, decoded again, and given up for the plain
text if it doesn't decode to it. Which chunks repeat is a join of narrow rows (session, chunk id, text id),
so a session or a chunk of any size is many tasks; only the encoding of one text runs in Python.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.chunks import cuts
from quern.session import attach, cut, hot_keys, ship

#: Least, usual and largest bytes of a chunk of lines, least lines of a text that has any, and one line in eight that ends one.
LEAST, USUAL, MOST, LINES, ENDS = 512, 2048, 8192, 32, 7
_REFERENCE = re.compile(rb"\[context-chunk status=unchanged uri=(local-archive://[A-Za-z0-9_\-]+) bytes=([0-9]+)\]")
#: Fixed values of the rule: where the line hash starts, and its factor.
_FNV, _PRIME = 1469598103934665603, 1099511628211


def reference(name: str, size: int) -> bytes:
    return f"[context-chunk status=unchanged uri=local-archive://{name} bytes={size}]".encode()


def _ends_chunk(line: bytes) -> bool:
    """Whether the last bits of the line's FNV-1a hash are zeros; only those bits are kept, as products go upwards."""
    low = _FNV & ENDS
    for byte in line:
        low = ((low ^ byte) * _PRIME) & ENDS
    return low == 0


def line_cuts(data: bytes) -> list[int]:
    """Where chunks of whole lines end; none for texts of few lines, or of one chunk."""
    lines = data.splitlines(True) if b"\r" not in data and b"\x0b" not in data and b"\x0c" not in data else re.findall(rb"[^\n]*\n|[^\n]+", data)
    if data.count(b"\n") < LINES:
        return []
    out, at, start = [], 0, 0
    for line in lines:
        at += len(line)
        if at - start >= MOST or at - start >= USUAL and _ends_chunk(line):
            out.append(at)
            start = at
    if start < len(data):
        out.append(len(data))
    return out if len(out) > 1 else []


def plans(data: bytes) -> dict[str, list[tuple[str, bytes]]]:
    """(id, chunk) of each plan: '' of content-defined chunks, 'line-' of lines."""
    out = {}
    for kind, ends in (("", cuts(data)), ("line-", line_cuts(data))):
        pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
        out[kind] = [(kind + hashlib.sha256(p).hexdigest(), p) for p in pieces if p]
    return out


def encode(chunks: list[tuple[str, bytes]], repeats: set[str], budget: int) -> tuple[bytes, int, int, int]:
    """(data, saved bytes, references, bytes under references): repeats by what they save, large ones and earlier ones first.

    A chunk that the budget has no room for is passed over, smaller ones after it are still taken.
    """
    gains = [(len(reference(name, len(p))) - len(p), -len(p), i) for i, (name, p) in enumerate(chunks) if name in repeats]
    taken, used = set(), 0
    for gain, size, i in sorted(gains):
        if gain < 0 and used - size <= budget:
            taken.add(i)
            used -= size
    out = b"".join(reference(name, len(p)) if i in taken else p for i, (name, p) in enumerate(chunks))
    return out, sum(len(p) for _, p in chunks) - len(out), len(taken), used


def decode(data: bytes, known: dict[str, bytes]) -> bytes:
    """The plain bytes; references that aren't known, or whose size isn't right, stay."""

    def put(m: re.Match) -> bytes:
        body = known.get(m[1].decode().removeprefix("local-archive://"))
        return m[0] if body is None or len(body) != int(m[2]) else body

    return _REFERENCE.sub(put, data)


def _chunk_ids(rows: DataFrame) -> DataFrame:
    """session, id, chunk: the distinct chunks of every text, of both plans."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = list(dict.fromkeys(name for plan in plans(text).values() for name, _ in plan))
                at += [i] * len(found)
                names += found
            one = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array(names, pa.string())], ["session", "id", "chunk"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"session {kinds['session']}, id {kinds['id']}, chunk string")


def encoded(docs: DataFrame, session: str = "source", id_col: str = "doc_id", text_col: str = "text", percent: int = 100) -> DataFrame:
    """session, id_col, data (binary), saved, refs, ref_bytes: every text with what its session has seen replaced.

    Texts of a session come in order of id_col (unique in it). At most `percent` of a text's bytes go under
    references. Null and empty texts are empty; texts without gain are as they were. Rows with a null
    session are a session. `archived` has the chunks that references name.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select(F.col(session).alias("session"), F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("data"))
    found = cut(_chunk_ids(rows))
    key = F.struct("session", "chunk").alias("key")
    first = cut(found.groupBy(key).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    seen = attach(found.select(key, "session", "id"), first.select("key", "first"), "key", hot_keys(first.select("key", "rows"), "key")).filter("id > first")
    repeats = seen.groupBy("session", "id").agg(F.collect_set("key.chunk").alias("repeats"))  # of one text
    both = rows.join(repeats.select(F.col("session").alias("s"), F.col("id").alias("i"), "repeats"), F.col("session").eqNullSafe(F.col("s")) & (F.col("id") == F.col("i")), "left").select("session", "id", "data", "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                best = (data, 0, 0, 0)
                for plan in plans(data).values() if names else ():
                    got = encode(plan, set(names), len(data) * percent // 100)
                    if got[1] > best[1] and decode(got[0], {name: p for name, p in plan if name in names}) == data:
                        best = got
                out.append(best)
            columns = [pa.array([o[0] for o in out], pa.binary()), *[pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["session", "id", "data", "saved", "refs", "ref_bytes"])

    kinds = dict(rows.dtypes)
    done = both.mapInArrow(run, f"session {kinds['session']}, id {kinds['id']}, data binary, saved bigint, refs bigint, ref_bytes bigint")
    return done.select(F.col("session").alias(session), F.col("id").alias(id_col), "data", "saved", "refs", "ref_bytes")


def archived(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """chunk and body of every chunk of both plans, once: what references are read back from."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: p for text in batch.column(0).to_pylist() for plan in plans(text).values() for name, p in plan}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["chunk", "body"])

    data = docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("data"))
    return data.mapInArrow(run, "chunk string, body binary").groupBy("chunk").agg(F.first("body").alias("body"))


def decoded(rows: DataFrame, archive: DataFrame, session: str = "source", id_col: str = "doc_id") -> DataFrame:
    """session, id_col and text of encoded rows, read back from the archive: references are looked up by joins."""
    import pyarrow as pa

    ship(rows.sparkSession)
    text = F.decode("data", "iso-8859-1")
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[context-chunk status=unchanged uri=local-archive://([A-Za-z0-9_\-]+) bytes="), 1))
    asked = cut(rows.filter("refs > 0").select(F.col(session).alias("s"), F.col(id_col).alias("i"), F.explode(names).alias("chunk")))
    hot = hot_keys(asked.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows")), "chunk")
    bodies = attach(asked, archive, "chunk", hot).groupBy("s", "i").agg(F.collect_list(F.struct("chunk", "body")).alias("bodies"))  # of one text
    both = rows.join(bodies, F.col(session).eqNullSafe(F.col("s")) & (F.col(id_col) == F.col("i")), "left").select(session, id_col, "data", "bodies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(data, {x["chunk"]: x["body"] for x in known or ()}).decode() for data, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [session, id_col, "text"])

    kinds = dict(both.dtypes)
    return both.mapInArrow(run, f"`{session}` {kinds[session]}, `{id_col}` {kinds[id_col]}, text string")
