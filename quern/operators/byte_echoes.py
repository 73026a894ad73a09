"""Echoes on bytes: stretches of a text of SPAN bytes or more that stand in an indexed block, exactly.

Seeds are windows of WINDOW bytes, chosen by content on both sides: of every run of SPAN - WINDOW + 1
windows the one with the smallest hash (the rightmost of equal ones). A common stretch of SPAN bytes holds
a whole run, so both sides choose a window of it, and about one row for every 50 bytes is shuffled instead
of one a byte. Seeds meet by hash; bytes decide and are extended both ways. Of a text's stretches the
leftmost is taken first, the longest of those that cover its place, and none overlaps the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import attach, cut, hot_keys, ship

WINDOW, SPAN = 100, 200
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each window: a polynomial of its bytes from prefix sums, divided by the place's power."""
    n = len(data)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    with np.errstate(over="ignore"):
        powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_TABLE[data] * powers[:n])])
        return _mix((sums[window:] - sums[:-window]) * inverse[: n - window + 1])


def seeds(data: bytes, window: int = WINDOW, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen windows; a text shorter than a span has none."""
    run, out, found = span - window + 1, [], []
    for low in range(0, max(len(data) - span + 1, 0), SEGMENT):
        part = np.frombuffer(data, np.uint8, min(SEGMENT + span - 1, len(data) - low), low)
        hashes = window_hashes(part, window)
        view = np.lib.stride_tricks.sliding_window_view(hashes, run)
        at = np.unique(np.arange(len(view)) + run - 1 - view[:, ::-1].argmin(1))
        out.append(at + low)
        found.append(hashes[at].view(np.int64))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, first = np.unique(np.concatenate(out), return_index=True)
    return places, np.concatenate(found)[first]


def _seeds(rows: DataFrame, name: str, window: int, span: int) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                places, hashes = seeds(text.as_py() or b"", window, span)
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(places)), pa.array(places), pa.array(hashes)], [name, "place", "hash"])

    kind = dict(rows.dtypes)[name]
    return rows.select(name, F.encode("text", "utf-8").alias("text")).mapInArrow(run, f"{name} {kind}, place bigint, hash bigint")


def extend(text: bytes, block: bytes, at: int, off: int, window: int) -> tuple[int, int] | None:
    """(start, end) in the text of the longest common stretch around equal windows, None if they differ."""
    if text[at : at + window] != block[off : off + window]:
        return None
    a, b = np.frombuffer(text, np.uint8), np.frombuffer(block, np.uint8)
    right, n = window, min(len(a) - at, len(b) - off)
    left, m = 0, min(at, off)
    while right < n:
        step = min(4096, n - right)
        differ = np.flatnonzero(a[at + right : at + right + step] != b[off + right : off + right + step])
        right += int(differ[0]) if len(differ) else step
        if len(differ):
            break
    while left < m:
        step = min(4096, m - left)
        differ = np.flatnonzero(a[at - left - step : at - left][::-1] != b[off - left - step : off - left][::-1])
        left += int(differ[0]) if len(differ) else step
        if len(differ):
            break
    return at - left, at + right


def stretches(texts: DataFrame, blocks: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """text_id, block_id, start, end, off: every maximal common stretch of `span` bytes or more, once."""
    import pyarrow as pa

    ship(texts.sparkSession)
    of_blocks = cut(_seeds(blocks, "block_id", window, span))
    hashes = of_blocks.groupBy("hash").agg(F.collect_set(F.struct("block_id", F.col("place").alias("off"))).alias("places"), F.count(F.lit(1)).alias("rows"))
    index = cut(hashes)
    of_texts = cut(_seeds(texts, "text_id", window, span).join(index.select("hash"), "hash", "left_semi"))
    hot = hot_keys(of_texts.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")), "hash")
    met = attach(of_texts, index.select("hash", "places"), "hash", hot).select("text_id", "place", F.explode("places").alias("p"))
    # Of the seeds of one diagonal the Python side takes each that the stretch before doesn't hold.
    pairs = cut(met.groupBy("text_id", F.col("p.block_id").alias("block_id")).agg(F.array_sort(F.collect_set(F.struct((F.col("place") - F.col("p.off")).alias("diagonal"), "place"))).alias("seeds")))
    named = pairs.join(blocks.select("block_id", F.encode("text", "utf-8").alias("block")), "block_id").join(texts.select("text_id", F.encode("text", "utf-8").alias("text")), "text_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = [], []
            for i in range(len(batch)):
                text, block = batch.column("text")[i].as_py(), batch.column("block")[i].as_py()
                diagonal, end = None, 0
                for seed in batch.column("seeds")[i].as_py():
                    if seed["diagonal"] == diagonal and seed["place"] + window <= end:
                        continue
                    found = extend(text, block, seed["place"], seed["place"] - seed["diagonal"], window)
                    if found:
                        diagonal, end = seed["diagonal"], found[1]
                        if found[1] - found[0] >= span:
                            rows.append(i)
                            values.append((*found, found[0] - diagonal))
            one = batch.select(["text_id", "block_id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*one.columns, *[pa.array([v[k] for v in values], pa.int64()) for k in range(3)]], ["text_id", "block_id", "start", "end", "off"])

    kinds = dict(named.dtypes)
    return named.select("text_id", "block_id", "seeds", "block", "text").mapInArrow(run, f"text_id {kinds['text_id']}, block_id {kinds['block_id']}, start bigint, end bigint, off bigint")


def choose(found: list[tuple[int, int, int, int]], window: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, index) of the stretches (start, end, block's place in order, off), from the left; a start is moved behind the end before.

    At a place the longest stretch whose next window lies in it is taken; of equal ones the first block's, then
    the one whose window stands first in the block.
    """
    at, behind = 0, 0
    order = sorted(range(len(found)), key=lambda i: found[i][0])
    open_: list[int] = []
    k = 0
    while k < len(order) or open_:
        open_ = [i for i in open_ if found[i][1] - window >= at]
        if not open_ and k < len(order):
            at = max(at, found[order[k]][0])
        while k < len(order) and found[order[k]][0] <= at:
            if found[order[k]][1] - window >= at:
                open_.append(order[k])
            k += 1
        if open_:
            best = min(open_, key=lambda i: (found[i][0] - found[i][1], found[i][2], found[i][3] - found[i][0]))
            yield max(found[best][0], behind), found[best][1], best
            at = behind = found[best][1]


def echoes(texts: DataFrame, blocks: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """text_id, start, end, block_id, off: the stretches of a text that are echoes, in bytes, none overlapping another.

    texts: text_id, text. blocks: block_id, text; the smaller block_id, then the smaller place in it, comes
    first among equally long stretches. Nulls and texts under a span have none; ids have to be unique.
    Equal texts give equal rows. Empty tables give no rows.
    """
    import pyarrow as pa

    found = stretches(texts, blocks, window, span)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(found.dtypes)
    ordered = found.repartition(n, "text_id").sortWithinPartitions("text_id", "block_id", "off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is held are the stretches of one text."""
        held: pa.Table | None = None

        def chosen(rows: pa.Table) -> pa.RecordBatch:
            names: dict = {}
            ranks = [names.setdefault(b, len(names)) for b in rows.column("block_id").to_pylist()]
            places = list(zip(rows.column("start").to_pylist(), rows.column("end").to_pylist(), ranks, rows.column("off").to_pylist()))
            taken = list(choose(places, window))
            out = rows.take(pa.array([i for _, _, i in taken], pa.int64())).combine_chunks()
            starts = pa.array([s for s, _, _ in taken], pa.int64())
            off = pa.array([o + s - t for o, s, t in zip(out.column("off").to_pylist(), starts.to_pylist(), out.column("start").to_pylist())], pa.int64())
            columns = [out.column("text_id"), out.column("block_id"), starts, out.column("end"), off]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["text_id", "block_id", "start", "end", "off"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            ids = rows.column("text_id").to_pylist()
            low = 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or ids[k] != ids[low]:
                    if k < len(ids):
                        yield chosen(rows.slice(low, k - low))
                        low = k
            held = rows.slice(low)
        if held is not None and held.num_rows:
            yield chosen(held)

    return ordered.mapInArrow(run, f"text_id {kinds['text_id']}, block_id {kinds['block_id']}, start bigint, end bigint, off bigint")


def marked(text: bytes, found: list[tuple[int, int, str]]) -> bytes:
    """The text with each stretch (start, end, name) replaced by a note, as a reduction would show it."""
    out, at = [], 0
    for start, end, name in sorted(found):
        out += [text[at:start], f"[unchanged: {name}]".encode()]
        at = end
    return b"".join([*out, text[at:]])
