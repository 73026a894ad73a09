"""Near duplicates within a session by ordered leaders: a text is compared with the earlier texts that were kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import trim_all
from quern.session import ship

# The hash's start and factor, numbers of a signature, words of a shingle, bytes of a text that is compared.
FNV_START, FNV_FACTOR = 14695981039346656037, 1099511628211
DIMENSIONS, SHINGLE, LEAST_BYTES = 128, 3, 120
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def shingles(text: str) -> list[bytes]:
    """Shingles of three words, or all words if there are fewer."""
    w = [x for x in _SPACE.split(text) if x]
    return [" ".join(w[i : i + SHINGLE]).encode("utf-8", "surrogatepass") for i in range(max(1, len(w) - SHINGLE + 1))] if w else []


def signature(text: str) -> np.ndarray:
    """The smallest FNV-1a hash of the shingles under each of 128 seeds, as unsigned numbers; zeros for no words."""
    parts = sorted(set(shingles(text)), key=len)
    if not parts:
        return np.zeros(DIMENSIONS, np.uint64)
    factor = np.uint64(FNV_FACTOR)
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(p.ljust(sizes[-1], b"\0") for p in parts), np.uint8).reshape(len(parts), -1).astype(np.uint64)
    h = np.full(len(parts), FNV_START, np.uint64)
    for k in range(sizes[-1]):  # one byte of all shingles at a time; they are sorted by length
        live = slice(int(np.searchsorted(sizes, k, "right")), None)
        h[live] = (h[live] ^ data[live, k]) * factor
    # A seed's eight bytes are its number and seven zeros, which multiply only.
    seeds, rest = np.arange(1, DIMENSIONS + 1, dtype=np.uint64), np.uint64(pow(FNV_FACTOR, 8, 1 << 64))
    out = np.full(DIMENSIONS, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 4096):
        out = np.minimum(out, ((h[k : k + 4096, None] ^ seeds) * rest).min(0))
    return out


class Leaders:
    """The signatures of leaders in order, and the first one that agrees with a signature in a share of at least `least`.

    If at most d of the numbers differ, one of d + 1 bands of them is equal, so only leaders that share a band
    are compared; no other one can agree so far.
    """

    def __init__(self, least: float):
        same = next(k for k in range(1, DIMENSIONS + 1) if k / DIMENSIONS >= least)
        cuts = np.linspace(0, DIMENSIONS, DIMENSIONS - same + 2).astype(int)
        self.same, self.bands = same, list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        self.sigs, self.places = np.empty((16, DIMENSIONS), np.int64), []
        self.index: list[dict[int, list[int]]] = [{} for _ in self.bands]
        self.compared = 0

    def _keys(self, sig: np.ndarray) -> list[int]:
        data = sig.tobytes()  # the hash of a band finds leaders, their numbers decide
        return [hash(data[8 * a : 8 * z]) for a, z in self.bands]

    def find(self, sig: np.ndarray, place: int) -> int | None:
        """The place of the first such leader that stands at another place."""
        some = {k for band, key in zip(self.index, self._keys(sig)) for k in band.get(key, ())}
        if not some:
            return None
        few = np.array(sorted(some))
        self.compared += len(few)
        near = few[(self.sigs[few] == sig).sum(1) >= self.same]
        return next((self.places[k] for k in near.tolist() if self.places[k] != place), None)

    def add(self, sig: np.ndarray, place: int) -> None:
        n = len(self.places)
        if n == len(self.sigs):
            self.sigs = np.concatenate([self.sigs, np.empty((n, DIMENSIONS), np.int64)])
        self.sigs[n] = sig
        self.places.append(place)
        for band, key in zip(self.index, self._keys(sig)):
            band.setdefault(key, []).append(n)


def staircase(count: Column, steps: list[tuple[int, float]], default: float = 0.85) -> Column:
    """The threshold of the first step whose limit isn't below the count; steps out of (0, 1] mean the default."""
    out = F
    for limit, threshold in steps:
        out = out.when(count <= limit, F.lit(float(threshold if 0 < threshold <= 1 else default)))
    return out.otherwise(F.lit(float(default))) if steps else F.lit(float(default))


def leaders(texts: DataFrame, session: str = "session", at: str = "at", text: str = "text", steps: list[tuple[int, float]] | None = None, default: float = 0.85) -> DataFrame:
    """session, at, kind (new, exact, near) and first (the place it repeats) of every text, in the order of `at`.

    Texts are compared without outer blanks. A text of 120 bytes or more is near the first leader of its
    session whose signature agrees in a share of at least the threshold; leaders are texts that are
    neither. Signatures are computed for all texts at once; the ordered pass over a session keeps those of
    its leaders, so a session is one task, as the rule's result depends on the order. A text is compared
    only with leaders that share a band of its signature, which loses none.
    """
    ship(texts.sparkSession)
    norm = trim_all(F.coalesce(F.col(text), F.lit("")))
    # The rule hashes the session's name in front of the text.
    keyed = F.concat(F.coalesce(F.col(session).cast("string"), F.lit("")), F.lit("\0"), norm)

    @F.pandas_udf("array<bigint>")
    def signed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if x is None else signature(x).view(np.int64).tolist() for x in part], dtype=object)

    long = F.octet_length(norm) >= LEAST_BYTES
    rows = texts.select(session, F.col(at).cast("long").alias("at"), F.sha2(keyed, 256).alias("sha"), F.when(long, keyed).alias("keyed"))
    counted = rows.withColumn("least", staircase(F.count(F.lit(1)).over(Window.partitionBy(session)), steps or [], default))
    narrow = counted.select(F.col(session).alias("session"), "at", "sha", "least", signed("keyed").alias("sig"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        exact: dict[str, int] = {}
        kept = Leaders(part["least"].iloc[0])
        out = []
        for place, sha, sig in part.sort_values(["at", "sha"])[["at", "sha", "sig"]].itertuples(index=False):
            if sha in exact:
                out.append((place, "exact", exact[sha]))
                continue
            if sig is not None:
                mine = np.asarray(sig, np.int64)
                first = kept.find(mine, place)
                if first is not None:
                    out.append((place, "near", first))
                    continue
                kept.add(mine, place)
            exact[sha] = place
            out.append((place, "new", -1))
        found = pd.DataFrame(out, columns=["at", "kind", "first"])
        found.insert(0, "session", key[0])
        return found

    kind = texts.schema[session].dataType.simpleString()
    return narrow.groupBy("session").applyInPandas(run, f"session {kind}, at long, kind string, first long").select(F.col("session").alias(session), "at", "kind", "first")
