"""Content-defined chunking of texts and what of them was seen before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import attach, cut, hot_keys, ship

#: Smallest, wanted and largest chunk in bytes.
LEAST, WANTED, MOST = 512, 2048, 8192
#: Low bits of the rolling hash that are 0 at a cut: before the wanted size, and beyond it.
STRICT, LOOSE = 13, 9


def _gear() -> np.ndarray:
    """The 256 numbers of the rolling hash: the splitmix64 sequence, its fixed seed and constants."""
    out, x, all_bits = [], 0x9E3779B97F4A7C15, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & all_bits
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & all_bits
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & all_bits
        out.append((z ^ (z >> 31)) & ((1 << STRICT) - 1))  # no higher bit is ever looked at
    return np.array(out, np.uint32)


_GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data.

    The hash of a chunk starts at its smallest size and doubles with every byte, so its low bits hold the
    last few bytes only: they are computed for all places at once, but for the first places of a chunk.
    """
    g = _GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(len(g), np.uint32)
    for k in range(min(STRICT, len(g))):
        h[k:] += g[: len(g) - k] << np.uint32(k)
    strict, loose = (np.flatnonzero(h & np.uint32((1 << bits) - 1) == 0) for bits in (STRICT, LOOSE))
    out, start = [], 0
    while start < len(data):
        limit, middle = min(len(data) - start, MOST), min(WANTED, len(data) - start)
        end = start + limit
        if len(data) - start > LEAST:
            value, warm = 0, min(LEAST + STRICT - 1, limit)
            for i in range(LEAST, warm):
                value = value * 2 + int(g[start + i])
                if value & ((1 << (STRICT if i < middle else LOOSE)) - 1) == 0:
                    end = start + i + 1
                    break
            else:
                for places, low, high in ((strict, warm, middle), (loose, max(middle, warm), limit)):
                    k = np.searchsorted(places, start + low)
                    if k < len(places) and places[k] < start + high:
                        end = int(places[k]) + 1
                        break
        out.append(end)
        start = end
    return out or [0]


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns of `keep`, ord, chunk_id (sha256), bytes of every chunk; the chunks of a text joined are the text.

    An empty or null text is one empty chunk.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    kept = [id_col, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ords, names, sizes = [], [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                data, start = (text or "").encode("utf-8", "replace"), 0
                for n, end in enumerate(cuts(data)):
                    rows.append(row)
                    ords.append(n)
                    names.append(hashlib.sha256(data[start:end]).hexdigest())
                    sizes.append(end - start)
                    start = end
            taken = batch.select(list(range(len(kept)))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ords, pa.int32()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], [*kept, "ord", "chunk_id", "bytes"])

    narrow = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{types}, ord int, chunk_id string, bytes long")


def repeated_chunks(docs: DataFrame, session: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: chunks, bytes and bytes of chunks that an earlier document of its session has.

    Repeats inside one document aren't seen before. Rows that share a session and an id, null ones too, are one document.
    """
    found = chunk(docs, id_col, text_col, [session]).withColumn("__key", F.struct(session, "chunk_id"))
    first = cut(found.groupBy("__key").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("rows")))
    marked = attach(found, first.select("__key", "__first"), "__key", hot_keys(first, "__key")).withColumn("seen", F.coalesce(F.col("__first") < F.col(id_col), F.lit(False)))
    return marked.groupBy(session, id_col).agg(F.count(F.lit(1)).alias("chunks"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("seen"), F.col("bytes")).otherwise(0)).alias("repeated_bytes"))
