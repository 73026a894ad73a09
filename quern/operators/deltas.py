"""Line deltas between versions of a text: alignment, hunks, and the way back.

Which version is compared with which is settled on narrow rows (key, place, digest), so a key with most
of the rows is many partitions; texts then meet by (key, place). The alignment itself is per pair of
texts and runs in Arrow batches: rows of the table of common subsequences are bit vectors (a Python int
each, one addition per old line), of which one in so many is kept and the others are computed anew on the
way back, so two texts of n lines take about n * sqrt(n) / 8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums, previous
from quern.session import ship

#: Unchanged lines around a change, and the share of the new text's bytes that a delta has to stay under.
CONTEXT, SHARE = 3, 0.5
_HUNK = re.compile(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@")


def _row(bits: int, same: int, full: int) -> int:
    """The next row: a zero bit is a place where the longest common subsequence grows by one."""
    met = bits & same
    return ((bits + met) | (bits & ~same)) & full


def edit_script(old: Sequence, new: Sequence) -> list[tuple[str, int, int]]:
    """(op, old index, new index) from the start: ' ' for equal items, '+' before '-' where both are as good.

    It is a shortest script of insertions and deletions. Equal heads are always taken.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    a, b = old[head:], new[head:]
    m, n = len(a), len(b)
    full = (1 << n) - 1
    places: dict = {}
    for j, item in enumerate(b):
        # From the end, as subsequences of what is left are needed.
        places[item] = places.get(item, 0) | 1 << (n - 1 - j)
    step = max(1, int(m**0.5))
    kept, bits = {m: full}, full
    for i in range(m - 1, -1, -1):
        bits = _row(bits, places.get(a[i], 0), full)
        if i % step == 0:
            kept[i] = bits
    out = [(" ", k, k) for k in range(head)]
    rows: dict[int, int] = {}
    i = j = 0
    while i < m or j < n:
        if i < m and j < n and a[i] == b[j]:
            out.append((" ", head + i, head + j))
            i, j = i + 1, j + 1
            continue
        if i < m and i not in rows:
            top = min((i // step + 1) * step, m)
            rows, bits = {}, kept[top]
            for k in range(top - 1, i - 1, -1):
                bits = rows[k] = _row(bits, places.get(a[k], 0), full)
        if j < n and (i >= m or rows[i] >> (n - 1 - j) & 1):
            out.append(("+", -1, head + j))
            j += 1
        else:
            out.append(("-", head + i, -1))
            i += 1
    return out


def _hunks(script: list[tuple[str, int, int]], context: int) -> Iterator[tuple[int, int]]:
    """Ranges of the script: changes that are at most `context` apart, with as many lines around them."""
    end = start = None
    for k, (op, _, _) in enumerate(script):
        if op == " ":
            continue
        if end is not None and k > end:
            yield start, min(end, len(script) - 1)
            start = None
        if start is None:
            start = max(k - context, 0)
        end = k + context
    if start is not None:
        yield start, min(end, len(script) - 1)


def unified(old: str, new: str, context: int = CONTEXT) -> str:
    """The unified diff of two texts by lines, empty if they are equal."""
    a, b = old.split("\n"), new.split("\n")
    script, out = edit_script(a, b), []
    for first, last in _hunks(script, context):
        some = script[first : last + 1]
        olds, news = [i for _, i, _ in some if i >= 0], [j for _, _, j in some if j >= 0]
        out.append(f"@@ -{olds[0] + 1 if olds else 0},{len(olds)} +{news[0] + 1 if news else 0},{len(news)} @@\n")
        out += [f"{op}{a[i] if op != '+' else b[j]}\n" for op, i, j in some]
    return "--- a\n+++ b\n" + "".join(out) if out else ""


def apply_unified(old: str, delta: str) -> str:
    """The new text from the old one and its unified diff (empty: no change)."""
    a, out, at = old.split("\n"), [], 0
    lines = delta.split("\n")[2:-1]
    k = 0
    while k < len(lines):
        start, olds, _, news = map(int, _HUNK.fullmatch(lines[k]).groups())
        place = start - 1 if olds else at
        k += 1
        while olds or news:
            op, text = lines[k][:1], lines[k][1:]
            k += 1
            olds, news = olds - (op != "+"), news - (op != "-")
            if op == "+":
                out.append(text)
                continue
            # Context may reach back over lines that the hunk before has given already.
            if place >= at:
                out += a[at:place] + ([text] if op == " " else [])
                at = place + 1
            place += 1
    return "\n".join(out + a[at:])


def version_pairs(versions: DataFrame, key: str = "key", place: str = "idx", text: str = "text") -> DataFrame:
    """key, place, prev: the place of the version that a version is compared with, null for the first.

    That is the last recorded one before it; a version equal to the one before it isn't recorded, so the
    first of a run of equal versions stands for all of them.
    """
    rows = versions.select(F.col(key).alias("key"), F.col(place).alias("place"), F.sha2(text, 256).alias("digest"))
    order = [F.col("place"), F.col("digest")]
    known = previous(rows, ["key"], order, ["digest"])
    new = known.withColumn("new", (~F.col("digest").eqNullSafe(F.col("prev_digest")) | ~F.col("has_prev")).cast("long"))
    counted = prefix_sums(new, ["key"], order, {"rank": F.col("new")})
    # The rank of the last recorded version before a row: its own rank, less one if it is recorded itself.
    recorded = counted.filter("new = 1").select(F.col("key").alias("k"), F.col("rank").alias("r"), F.col("place").alias("prev"))
    found = counted.join(recorded, F.col("key").eqNullSafe(F.col("k")) & (F.col("rank") - F.col("new") == F.col("r")), "left")
    return found.select(F.col("key").alias(key), F.col("place").alias(place), "prev", (F.col("new") == 0).alias("same"))


def deltas(versions: DataFrame, key: str = "key", place: str = "idx", text: str = "text", context: int = CONTEXT, share: float = SHARE) -> DataFrame:
    """key, place, prev, delta, bytes, delta_bytes: versions as diffs against the one before them.

    delta is null for a first version, for one equal to the one before it, and where the diff isn't under
    `share` of the text's bytes. (key, place) has to be unique; a null text is an empty one.
    """
    import pyarrow as pa

    ship(versions.sparkSession)
    texts = versions.select(F.col(key).alias("key"), F.col(place).alias("place"), F.coalesce(text, F.lit("")).alias("text"))
    pairs = version_pairs(texts, "key", "place", "text")
    olds = texts.select(F.col("key").alias("k"), F.col("place").alias("p"), F.col("text").alias("old"))
    # Only what is compared goes on with its text; others need its size.
    rows = texts.join(pairs, ["key", "place"]).select("key", "place", "prev", F.octet_length("text").cast("long").alias("bytes"), F.when(~F.col("same") & F.col("prev").isNotNull(), F.col("text")).alias("text"))
    both = rows.join(olds, (F.col("key") == F.col("k")) & (F.when(F.col("text").isNotNull(), F.col("prev")) == F.col("p")), "left")
    both = both.select("key", "place", "prev", "old", "text", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for old, new, size in zip(*(batch.column(c).to_pylist() for c in ("old", "text", "bytes"))):
                delta = None if old is None or new is None else unified(old, new, context)
                found.append(delta if delta and len(delta.encode()) < share * size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.string()), batch.column("bytes")], ["key", "place", "prev", "delta", "bytes"])

    kinds = dict(both.dtypes)
    out = both.mapInArrow(run, f"key {kinds['key']}, place {kinds['place']}, prev {kinds['prev']}, delta string, bytes bigint")
    return out.select(F.col("key").alias(key), F.col("place").alias(place), "prev", "delta", "bytes", F.octet_length("delta").cast("long").alias("delta_bytes"))


def edited(text: Column, every: int) -> Column:
    """The text with the last word of one line in `every` replaced, lines chosen by their checksum: a later version of it."""
    lines = F.split(text, "\n", -1)
    change = lambda line: F.when(F.pmod(F.crc32(line.cast("binary")), F.lit(every)) == 0, F.concat(F.regexp_replace(line, r"[^ ]+$", ""), F.lit("edited"))).otherwise(line)
    return F.array_join(F.transform(lines, change), "\n")
