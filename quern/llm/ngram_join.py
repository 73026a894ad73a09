"""N-gram Jaccard join by a partition of the token universe and the pigeonhole principle.

A document is its set of word n-grams, hashed to 64 bits. Two sets that reach the similarity differ in
at most H elements, H following from their sizes. Sizes are cut into bands; each band cuts the universe
of hashes into m = H + 1 segments, H being the largest of the band. Two similar sets then agree on
enough segments: giving segment i the allowance v_i (-1: not used, 0: subsets equal, 1: at most one
element apart), any allocation with sum(v_i + 1) > H finds the pair.

Index side (larger set): a signature of each segment's subset in the band of its size, and in the first
few segments also of every one-deletion neighbour. Probe side (smaller set): in each band that a partner
can be in, the allocation of least cost. The cost of a subset is the corpus frequency of its rarest
n-gram, from a fixed-size sketch counted over all documents; costly segments are left out against
segments without cost or against a one-deletion allowance.

Equal sets are one class from the start. Within a bucket of equal signatures every class first meets
the bucket's pivot only (the class that meets most others), and of its pivots the one that it shares
most buckets with; verified links are contracted to components. Then the pairs of each bucket that are
still in different components are verified too, but for those whose parity bitmaps already differ in
more bits than similar sets have different elements. So a large group of near copies costs a star, and
no link between components is lost.

Hashes only find candidates; words decide. A word's hash is keyed and not linear in its bytes. A pair is
verified by comparing the n-grams themselves. Rows are one class if their sets' digests agree; where
their word sequences differ (by a 128-bit BLAKE2b digest), the sorted n-grams themselves are digested
with 256 bits and must agree, or all hashes are drawn anew under another key.

Skew: signatures that many rows share are found on a sample of the classes, which decides their route
only: their buckets are combined before they are shuffled, dropped if they can give no pair, and
joined to broadcast sums. Classes and nodes that many rows share go the same way (`quern.session.attach`).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import HOT_LEAST, attach, bounded, cut, hot_keys, ship

#: Sizes of a band reach from its first one to this many times it.
BAND = 1.35
#: One segment in so many has its one-deletion neighbours indexed (one at least).
NEIGHBOURS = 32
#: 64-bit words of a set's parity bitmap: as many bits differ between two bitmaps as elements at most.
BITS = 8
#: Counters of the frequency sketch.
SKETCH = 1 << 16
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Bytes of short texts that are hashed together, and bytes of a word beyond which it is hashed on its own.
BLOCK, LONG = 1 << 18, 256
#: N-grams that are compared at once.
SLICE = 100_000
#: Classes that a task remembers, so that it emits a copy's signatures once.
SEEN = 500_000
#: Parts of the buckets of such signatures.
HOT_SALTS = 64
#: Rows of a hot bucket that a part of it gets, on average.
PART = 1024
#: One class in so many is read to find the signatures that many rows share.
SAMPLED = 64

U = np.uint64
_BLANKS = re.compile(rb"[\x20\x09-\x0d]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLACES = [int(x) | 1 for x in np.random.default_rng(12).integers(0, 1 << 63, 64, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z, in pieces of about PIECE bytes that end between words."""
    for piece in pieces(text):
        yield piece.lower().split()


def pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            blank = _BLANKS.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def word_hashes(text: bytes, edges: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjoining texts, text i from edges[i] to edges[i + 1], and how many each text has.

    A hash takes in 8 bytes at a time, each step a multiplication and a mixing, so it isn't linear in the
    bytes; words of up to 8 bytes and one length never collide. Words over LONG bytes are BLAKE2b's.
    """
    b = np.frombuffer(text.lower() + bytes(8), np.uint8)
    word = ~_BLANK[b]
    word[len(text) :] = False
    first = np.zeros(len(b) + 1, bool)  # a text starts here
    first[edges] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    close = word
    close[:-1] &= ~word[1:] | first[1:-1]
    w0, w1 = np.flatnonzero(begin), np.flatnonzero(close) + 1
    n_words = np.diff(np.searchsorted(w0, edges))
    size = w1 - w0
    loads = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
    h = mix(size.astype(np.uint64) * U(_PLACES[63]) + U((seed * _PLACES[61] + _PLACES[60]) % (1 << 64)))
    at, left, some = w0, size, slice(None)
    while len(at):
        h[some] = mix(h[some] * U(_PLACES[59]) ^ (loads[at] & _FIRST[np.minimum(left, 8)]))
        keep = np.flatnonzero((left > 8) & (left <= LONG))
        some = keep if isinstance(some, slice) else some[keep]
        at, left = at[keep] + 8, left[keep] - 8
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(blake2b(b[w0[i] : w1[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h, n_words


def sequence(text: bytes, seed: int) -> np.ndarray:
    """Hashes of the words of one text, piece by piece."""
    each = [word_hashes(p, np.array([0, len(p)]), seed)[0] for p in pieces(text)]
    return np.concatenate([np.empty(0, np.uint64), *each])


def grams_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of every n-gram of a sequence of word hashes, in order; of fewer words the one of them all."""
    n = len(hashes)
    if 0 < n < words:
        one = sum(int(h) * _PLACES[k] for k, h in enumerate(hashes)) + n * _PLACES[62]
        return mix(np.array([one % (1 << 64)], np.uint64))
    grams = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words if n else 0):
        grams += hashes[k : n - words + 1 + k] * U(_PLACES[k])
    return mix(grams)


def text_sets(texts: list[bytes], words: int, seed: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text; short texts are hashed together."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        if j == i + 1:
            yield np.unique(grams_of(sequence(texts[i], seed), words))
        else:
            h, n = word_hashes(b"".join(texts[i:j]), np.cumsum([0, *map(len, texts[i:j])]), seed)
            at = np.cumsum([0, *n]).tolist()
            for k in range(j - i):
                yield np.unique(grams_of(h[at[k] : at[k + 1]], words))
        i = j


def texts_of(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    import pyarrow as pa

    text = column.cast(pa.large_string())
    if not len(text):
        return []
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].tolist()
    data = memoryview(text.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]


def _grams_at(flat: list[bytes], at: Iterator[int], words: int) -> set[bytes]:
    return {b" ".join(flat[i : i + words]) for i in at}


def overlap(a: bytes, b: bytes, words: int) -> tuple[int, int, int]:
    """Sizes of the n-gram sets of two texts and of their intersection, by the n-grams themselves.

    N-grams are compared in slices of their hashes, so that the sets in memory stay small.
    """
    sides = [([w for piece in word_lists(text) for w in piece], grams_of(sequence(text, 0), words)) for text in (a, b)]
    n = 1 + max(len(g) for _, g in sides) // SLICE
    sizes = [0, 0, 0]
    for k in range(n):
        x, y = (_grams_at(flat, range(len(g)) if n == 1 else np.flatnonzero(g % U(n) == U(k)).tolist(), words) for flat, g in sides)
        for i, part in enumerate((x, y, x & y)):
            sizes[i] += len(part)
    return tuple(sizes)


def content_digest(text: bytes, words: int) -> bytes:
    """256-bit digest of the sorted n-grams of a text themselves, slice by slice of their hashes."""
    flat = [w for piece in word_lists(text) for w in piece]
    g = grams_of(sequence(text, 0), words)
    # As many slices whatever the text, so that equal sets of different texts are sliced alike.
    size = len(np.unique(g))
    n, out = 1 + size // SLICE, blake2b(digest_size=32)
    for k in range(n):
        for gram in sorted(_grams_at(flat, np.flatnonzero(g % U(n) == U(k)).tolist(), words)):
            out.update(len(gram).to_bytes(8, "little") + gram)
    return out.digest()


def digest(s: np.ndarray) -> int:
    """A 64-bit digest of a set, signed."""
    x = int(mix(s ^ U(_PLACES[20])).sum(dtype=np.uint64))
    return x - (1 << 64) if x >= 1 << 63 else x


class Bands:
    """Sizes cut into bands, and what follows from the similarity (percent) for each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def apart(self, a: int, b: int) -> int:
        """The most elements in which similar sets of sizes a and b differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest(self, n: int) -> int:
        """The size of the largest set that one of n elements can be similar to."""
        return 100 * n // self.percent

    def at(self, k: int) -> tuple[int, int, int, int]:
        """First and last size of band k, its segments, and those of them with one-deletion neighbours."""
        while len(self.lows) < k + 2:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND)))
        low, high = self.lows[k], self.lows[k + 1] - 1
        m = self.apart(high, high) + 1
        return low, high, m, min(m, 1 + m // NEIGHBOURS)

    def of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.at(len(self.lows) - 1)
        return bisect_right(self.lows, n) - 1


def allocate(cost0: np.ndarray, cost1: np.ndarray, need: int) -> np.ndarray:
    """v of each segment with sum(v + 1) >= need at least cost; cost1 is of the first segments (v = 1 allowed there)."""
    m = len(cost0)
    v = np.full(m, -1, np.int8)
    order = np.argsort(cost0, kind="stable")
    used = order[:need]
    v[used] = 0
    # Each exchange leaves out the costliest segment against a second allowance elsewhere.
    worst = [i for i in used[::-1][: len(cost1) + 1]]
    gain = sorted((float(cost1[j]) - float(cost0[j]), j) for j in range(len(cost1)) if v[j] == 0)
    for extra, j in gain:
        while worst and (v[worst[0]] != 0 or worst[0] == j):
            worst.pop(0)
        if not worst or cost0[worst[0]] <= extra:
            break
        v[worst.pop(0)] = -1
        v[j] = 1
    return v


def set_signatures(s: np.ndarray, bands: Bands, costs: np.ndarray, everything: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Signatures of a set and their roles: 1 index, 2 probe, 3 both."""
    n = len(s)
    sigs: list[np.ndarray] = []
    roles: list[np.ndarray] = []
    own, most = bands.of(n), bands.largest(n)
    if bands.apart(n, most) < 1 and bands.apart(n, n) < 1:
        return sigs, roles  # only equal sets are similar
    g = mix(s ^ U(_PLACES[18]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(g, out=sums[1:])
    cost = costs[(s & U(SKETCH - 1)).astype(np.int64)]
    high32 = s >> U(32)
    k = own
    while True:
        low, high, m, d = bands.at(k)
        if low > most:
            break
        # Segments are ranges of the hash, so a sorted set falls into them in order.
        seg = (high32 * U(m) >> U(32)).astype(np.int64)
        edge = np.searchsorted(seg, np.arange(m + 1))
        size = np.diff(edge)
        subset = sums[edge[1:]] - sums[edge[:-1]]
        place = np.arange(m, dtype=np.uint64) * U(_PLACES[16]) + U(k * _PLACES[17] % (1 << 64))
        exact = mix(subset ^ mix(place.copy()))
        t = edge[d]
        near = mix((subset[seg[:t]] - g[:t]) ^ mix(place[seg[:t]]))
        cost0 = np.full(m, everything, np.float32)
        full = size > 0
        if n:
            cost0[full] = np.minimum.reduceat(cost, edge[:-1][full])
        cost1 = np.empty(d)
        for j in range(d):
            rare = np.sort(cost[edge[j] : edge[j + 1]])
            cost1[j] = everything if not len(rare) else (len(rare) + 1) * float(rare[0]) + (float(rare[1]) if len(rare) > 1 else everything)
        v = allocate(cost0, cost1, bands.apart(n, min(high, most)) + 1)
        if k == own:
            sigs += [exact, near]
            roles += [np.where(v >= 0, 3, 1), np.where(v[seg[:t]] == 1, 3, 1)]
        else:
            chosen = v >= 0
            sigs += [exact[chosen], near[v[seg[:t]] == 1]]
            roles += [np.full(int(chosen.sum()), 2), np.full(len(sigs[-1]), 2)]
        k += 1
    return sigs, roles


def parities(s: np.ndarray) -> list[int]:
    """The parity bitmap of a set: bit i tells whether an odd number of elements fall on it."""
    odd = np.bincount((s >> U(20) & U(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _profile(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """A row per document (id, th, n, d1, seq, bits) and, per task, a row with its frequency sketch (counts)."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "n", "d1", "seq", "bits", "counts"]
        kind = pa.struct([(f"b{i}", pa.int64()) for i in range(BITS)])
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            n, d1, seq, bits = [], [], [], []
            texts = texts_of(batch.column(2))
            for text, s in zip(texts, text_sets(texts, words, seed)):
                order = blake2b(digest_size=16)
                for p in word_lists(text):
                    if p:
                        order.update(b" ".join(p) + b" ")
                n.append(len(s))
                d1.append(digest(s))
                seq.append(order.digest())
                bits.append(parities(s))
                np.add.at(counts, (s & U(SKETCH - 1)).astype(np.int64), 1)
            words_ = np.array(bits, np.int64).reshape(len(n), BITS)
            packed = pa.StructArray.from_arrays([pa.array(words_[:, i]) for i in range(BITS)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(seq, pa.binary()), packed, pa.nulls(len(n), pa.binary())], names)
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), kind)]
        yield pa.RecordBatch.from_arrays([*none, pa.array([counts.tobytes()], pa.binary())], names)

    words_type = ", ".join(f"b{i}: bigint" for i in range(BITS))
    return docs.select("id", "th", "text").mapInArrow(run, f"id long, th long, n int, d1 long, seq binary, bits struct<{words_type}>, counts binary")


def _sketch(profile: DataFrame) -> np.ndarray:
    """The summed frequency sketch. Tasks' sketches are summed in the tasks that read them, SKETCH numbers come back from each."""
    import pyarrow as pa

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    parts = profile.filter("counts is not null").select("counts")
    # Two levels, so that the driver reads at most 16 of them whatever the number of tasks.
    rows = parts.mapInArrow(add, "counts binary").repartition(16).mapInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(r[0], np.int64) for r in rows), np.zeros(SKETCH, np.int64))


def _signatures(docs: DataFrame, words: int, percent: int, seed: int, sketch: np.ndarray, everything: int) -> DataFrame:
    """sig, d1, size (4 * n + role) of every document's set, once per task and class."""
    import pyarrow as pa

    costs = sketch.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        seen: set[tuple[int, int]] = set()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(owner, np.int64), lengths)), pa.array((np.concatenate(roles) + np.repeat(np.array(sizes) * 4, lengths)).astype(np.int32))],
                ["sig", "d1", "size"],
            )

        sigs, roles, owner, sizes, lengths, rows = [], [], [], [], [], 0
        for batch in batches:
            for s in text_sets(texts_of(batch.column(0)), words, seed):
                if not len(s):
                    continue
                key = (digest(s), len(s))
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                x, r = set_signatures(s, bands, costs, float(everything))
                if not x:
                    continue
                sigs += x
                roles += r
                owner.append(key[0])
                sizes.append(len(s))
                lengths.append(sum(map(len, x)))
                rows += lengths[-1]
                if rows >= 100_000:
                    yield flush()
                    sigs, roles, owner, sizes, lengths, rows = [], [], [], [], [], 0
        if rows:
            yield flush()

    return docs.select("text").mapInArrow(run, "sig long, d1 long, size int")


def _over(rows: DataFrame, key: str, keep: str = "true", **sums: Column) -> DataFrame:
    """rows (of classes) with sums over all rows of the same key, of the keys whose sums satisfy `keep`.

    Cold rows meet in windows. Hot ones are combined before they are shuffled; their sums (a row per hot
    key) are laid beside each of HOT_SALTS parts of the key's rows, and windows over the parts take them.
    """
    cold = rows.filter("not hot").select("*", *[c.over(Window.partitionBy(key)).alias(name) for name, c in sums.items()]).filter(keep)
    hot = rows.filter("hot")
    totals = hot.groupBy(key).agg(*[c.alias(name) for name, c in sums.items()]).filter(keep)
    seeds = totals.select(key, *sums, F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).alias("salt"), F.lit(1).alias("seed"))
    parts = hot.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(HOT_SALTS)).cast("int")).unionByName(seeds, allowMissingColumns=True)
    part = Window.partitionBy(key, "salt")
    met = parts.select(*rows.columns, *[F.max(name).over(part).alias(name) for name in sums], F.max("seed").over(part).alias("seed"))
    return cold.unionByName(met.filter("cls is not null and seed = 1").select(*cold.columns))


def _flagged(rows: DataFrame, shared: list[int]) -> DataFrame:
    """rows with hot: their signature is one of the shared ones, of which there are few by a proven bound."""
    return rows.withColumn("hot", F.col("sig").isin(shared) if shared else F.lit(False))


def _shared(counts: DataFrame, least: int) -> list[int]:
    found = hot_keys(counts, "sig", least=least)
    return [] if found is None else [r["sig"] for r in found.collect()]


def _buckets(signatures: DataFrame, sample: DataFrame) -> DataFrame:
    """sig, cls, role of the buckets that can give a pair (several classes, a probe and an index row), a row per class."""
    shared = _shared(sample.groupBy("sig").agg(F.count(F.lit(1)).alias("rows")), 8)
    rows = signatures.select(
        "sig",
        F.struct("d1", F.shiftright("size", 2).alias("n")).alias("cls"),
        F.col("size").bitwiseAND(3).alias("role"),
    )
    # One pass over the signatures: hot ones are spread by class, and what their parts say is combined afterwards.
    able = "least != most and roles = 3"
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("cls"), F.lit(HOT_SALTS))).otherwise(0) if shared else F.lit(0)
    part = Window.partitionBy("sig", salt) if shared else Window.partitionBy("sig")
    live = _flagged(rows, shared).select("*", F.min("cls").over(part).alias("least"), F.max("cls").over(part).alias("most"), F.bit_or("role").over(part).alias("roles")).filter(f"hot or {able}")
    if shared:
        live = cut(live)
        sums = live.filter("hot").groupBy("sig").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.bit_or("roles").alias("roles"))
        wanted = [r["sig"] for r in sums.filter(able).select("sig").collect()]  # hot signatures: few
        live = live.filter(~F.col("hot") | F.col("sig").isin(wanted))
    # A class comes from several tasks if its copies do.
    return live.groupBy("sig", "cls").agg(F.bit_or("role").alias("role"))


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _near_bits(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity bitmaps differ in no more bits than similar sets have different elements."""
    side = lambda name: classes.select(F.col("cls").alias(name), F.col("bits").alias(f"{name}_bits"))
    shared = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows")), "a")
    both = attach(pairs.join(side("b"), "b"), side("a"), "a", shared)
    differ = sum((F.bit_count(F.col(f"a_bits.b{i}").bitwiseXOR(F.col(f"b_bits.b{i}"))) for i in range(BITS)), F.lit(0))
    return both.filter(differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)).select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those that are similar, by their n-grams themselves. texts: cls, packed."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                m, n, both = overlap(unpack(x.as_py()), unpack(y.as_py()), words)
                keep.append(100 * both >= percent * (m + n - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("cls").alias("a"), F.col("packed").alias("za"))
    right = texts.select(F.col("cls").alias("b"), F.col("packed").alias("zb"))
    found = pairs.select("a", "b").join(right, "b").select("a", "b", "zb").join(left, "a").select("a", "b", "za", "zb")
    return found.mapInArrow(run, "a struct<d1:bigint,n:int>, b struct<d1:bigint,n:int>")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node of the links (a, b).

    Large-star and small-star steps in turn until nothing changes. A node's smallest neighbour is a
    combined aggregate; nodes with many links get it by a broadcast of a proven bound. Each step is written.
    """

    def least(rows: DataFrame, total: int | None = None) -> DataFrame:
        """rows (u, v) with m: the smallest v of the row's u."""
        found = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
        return attach(rows, found.select("u", "m"), "u", hot_keys(found, "u", total))

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u != v").distinct()
        small = least(cut(large))
        moved = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = cut(small.select(moved.alias("e")).select("e.u", "e.v").filter("u != v").distinct())


def _classes(base: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(profile, rows, classes, seed): every row with its class, and the classes, each checked on content.

    at is the place of a class's first row: its smallest id (nulls last) and text hash.
    """
    seed = 0
    while True:
        profile = cut(_profile(base, words, seed))
        rows = profile.filter("counts is null").select("id", F.struct(F.col("id").isNull().alias("void"), "id", "th").alias("at"), F.struct("d1", "n").alias("cls"), "seq", "bits")
        facts = rows.filter("cls.n > 0").groupBy("cls")
        classes = cut(facts.agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.first("bits").alias("bits")))
        mixed = classes.filter("low != high").select("cls")
        if mixed.isEmpty() or _same_content(base, rows, mixed, words):
            return profile, rows, classes, seed
        seed += 1  # different sets had one digest and one size


def _read(base: DataFrame, places: DataFrame) -> DataFrame:
    """The columns of places beside `at`, and the text of every row at one of them."""
    places = cut(places)
    side = bounded(places, places.count(), 64)
    on = F.col("id").eqNullSafe(F.col("at.id")) & F.col("th").eqNullSafe(F.col("at.th"))
    return base.join(side, on).select(*[c for c in places.columns if c != "at"], "text")


def _same_content(base: DataFrame, rows: DataFrame, mixed: DataFrame, words: int) -> bool:
    """Whether all rows of each of the classes have the same n-grams; each word sequence is read once."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([content_digest(t, words) for t in texts_of(batch.column(1))], pa.binary())], ["cls", "content"])

    members = rows.join(mixed, "cls", "left_semi").groupBy("cls", "seq").agg(F.min("at").alias("at")).select("cls", "at")
    found = _read(base, members).mapInArrow(run, "cls struct<d1:bigint,n:int>, content binary")
    return found.groupBy("cls").agg((F.min("content") == F.max("content")).alias("same")).filter("not same").isEmpty()


def _class_texts(base: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, seed: int) -> DataFrame:
    """cls and a compressed text of every class in the pairs, a row each, written once."""
    import pyarrow as pa

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z(t) for t in texts_of(batch.column(1))], pa.binary())], ["cls", "packed"])

    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = _read(base, classes.join(wanted, "cls", "left_semi").select("cls", "at"))
    return cut(texts.mapInArrow(pack, "cls struct<d1:bigint,n:int>, packed binary").groupBy("cls").agg(F.min("packed").alias("packed")))


def _meetings(base: DataFrame, profile: DataFrame, rows: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """The buckets: sig, cls, role, hot."""
    sketch = _sketch(profile)
    everything = rows.count()
    signatures = lambda docs: _signatures(docs, words, percent, seed, sketch, everything)
    buckets = cut(_buckets(signatures(base), signatures(base.filter(F.pmod(F.xxhash64("id", "th"), F.lit(SAMPLED)) == 0))))
    shared = _shared(buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("rows")), HOT_LEAST)
    # The list of shared signatures is in one plan only, not in each that reads the buckets.
    return cut(_flagged(buckets, shared)) if shared else _flagged(buckets, shared)


def _crossing(meeting: DataFrame, percent: int, apart: bool) -> DataFrame:
    """Distinct pairs (a < b) of a probe and an index row of one bucket whose sizes and bitmaps let them be similar.

    A hot bucket of n parts is n x n meetings: its probes are dealt out, its index rows go to every part.
    """
    differ = sum((F.bit_count(F.col(f"a.bits.b{i}").bitwiseXOR(F.col(f"b.bits.b{i}"))) for i in range(BITS)), F.lit(0))
    near = differ * (100 + percent) <= (F.col("a.cls.n") + F.col("b.cls.n")) * (100 - percent)
    other = F.col("a.root") != F.col("b.root") if apart else F.col("a.cls") != F.col("b.cls")
    fits = other & (F.col("a.cls.n") <= F.col("b.cls.n")) & _similar_sizes(F.col("a.cls.n"), F.col("b.cls.n"), percent) & near
    probes, index = meeting.filter(F.col("role").bitwiseAND(2) != 0), meeting.filter(F.col("role").bitwiseAND(1) != 0)

    def met(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        return a.alias("a").join(b.alias("b"), [*on, fits]).select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b"))

    # A row per hot signature, of which there are few by a proven bound.
    parts = F.broadcast(meeting.filter("hot").groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    dealt = probes.filter("hot").join(parts, "sig").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    spread = index.filter("hot").join(parts, "sig").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met(probes.filter("not hot"), index.filter("not hot"), "sig").unionByName(met(dealt, spread, "sig", "part")).distinct()


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def ngram_links(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): all pairs a < b of linked classes, and id_col and cls of every row with words.

    A class is the rows with equal sets of n-grams; links inside a class aren't listed. No link is left
    out, so a group of near copies that are all linked costs its pairs, which `ngram_join` doesn't make.
    Texts without words are in no class. No rows give no rows.
    """
    base = _base(docs, id_col, text_col)
    profile, rows, classes, seed = _classes(base, words)
    buckets = _meetings(base, profile, rows, words, percent, seed)
    pairs = cut(_crossing(buckets.join(classes.select("cls", "bits"), "cls"), percent, False))
    links = cut(_verify(pairs, _class_texts(base, classes, pairs, words, seed), words, percent))
    return links, rows.filter("cls.n > 0").select(F.col("id").alias(id_col), "cls")


def _components(base: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, first): id, at and cls of every row; cls, rows and the first place of its component for every class with words."""
    profile, rows, classes, seed = _classes(base, words)
    buckets = _meetings(base, profile, rows, words, percent, seed)

    # First the pivots: in each bucket the class that meets most others, and for each class the pivot that it meets most often.
    # Each plan reads rows of the buckets several times (cold, hot, totals), so one inside another is written first.
    met = cut(_over(buckets, "sig", k=F.count(F.lit(1))).groupBy("cls").agg(F.sum("k").alias("weight")))
    pivoted = _over(buckets.join(met, "cls"), "sig", first=F.max(F.struct("weight", "cls"))).withColumn("pivot", F.col("first.cls"))
    pairs = pivoted.filter((F.col("cls") != F.col("pivot")) & _similar_sizes(F.col("cls.n"), F.col("pivot.n"), percent)).groupBy("pivot", "cls").agg(F.count(F.lit(1)).alias("times"))
    stars = cut(pairs.groupBy("cls").agg(F.max(F.struct("times", "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("cls").alias("b")))
    near = cut(_near_bits(stars, classes, percent))
    links = cut(_verify(near, _class_texts(base, classes, near, words, seed), words, percent))
    roots = components(links)

    # Then what is still apart: pairs of a probe and an index row of one bucket in different components.
    rooted = buckets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    apart = cut(_over(rooted, "sig", "least != most", least=F.min("root"), most=F.max("root")).drop("least", "most"))
    crossing = _crossing(apart.join(classes.select("cls", "bits"), "cls"), percent, True)
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut(crossing.join(seen, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = cut(_verify(rest, _class_texts(base, classes, rest, words, seed), words, percent))
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    # Most classes are a component of their own; of the others, large components are attached by broadcast.
    member = cut(roots.withColumnRenamed("node", "cls").join(classes.select("cls", "at"), "cls"))
    least = member.groupBy("root").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    joined = attach(member.select("cls", "root"), least.select("root", "first"), "root", hot_keys(least, "root"))
    named = classes.select("cls", "at", "rows").join(joined.select("cls", "first"), "cls", "left")
    return rows.select("id", "at", "cls"), cut(named.select("cls", "rows", F.coalesce("first", "at").alias("first")))


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id.

    A text's set is its distinct n-grams of `words` words, lower-cased in A-Z; a text with fewer words
    has its whole sequence as the one element, a text without words (or null) the empty set, which is
    linked with nothing: its component_id is its own id. Two rows are linked if their sets' similarity
    is at least `percent` hundredths; component_id is the smallest id reachable by links. Repeated rows
    and ids are rows like others. Null ids are members of components, but never name one unless all its
    ids are null. Ids are cast to long: strings that are no numbers are an error of the cast. Very long
    texts are read in pieces, and all of their n-grams count. Which class of ties is a bucket's pivot doesn't
    matter to the components. No rows give no rows. Other columns aren't read.
    """
    rows, first = _components(_base(docs, id_col, text_col), words, percent)
    full, blank = rows.filter("cls.n > 0").select("id", "cls"), rows.filter("cls.n = 0").select("id", "cls", F.col("id").alias("component_id"))
    found = attach(full, first.select("cls", F.col("first.id").alias("component_id")), "cls", hot_keys(first, "cls"))
    out = found.select("id", "cls", "component_id").unionByName(blank)
    return out.select(F.col("id").alias(id_col), F.col("cls.n").cast("long").alias("n_shingles"), "component_id")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without near copies: of each component of `ngram_join` one row stays.

    The row with the smallest id stays (nulls last, then the smallest text hash); of rows that repeat its
    id and text any one. Rows without words are in no component and stay. Decisions go with a row's id
    and text, so rows that share an id are decided on their own. No rows give no rows. Columns of `docs`
    may have any name.
    """
    rows, first = _components(_base(docs, id_col, text_col), words, percent)
    placed = attach(rows.filter("cls.n > 0").select("at", "cls"), first.select("cls", "first"), "cls", hot_keys(first, "cls")).select("at", (F.col("at") == F.col("first")).alias("stays"))
    placed = cut(placed.groupBy("at").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("rows")))
    leave = placed.filter("not stays").select("at")
    text = F.col(text_col).cast("string")
    at = F.struct(F.col(id_col).cast("long").isNull().alias("void"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), at.alias("at"))
    kept = packed.join(bounded(leave, leave.count(), 64), packed["at"].eqNullSafe(leave["at"]), "left_anti")
    twice = placed.filter("stays and rows > 1").select("at")
    if not twice.isEmpty():  # rows that repeat an id and a text
        side = bounded(twice, twice.count(), 64)
        once = kept.join(side, kept["at"].eqNullSafe(side["at"]), "left_semi").groupBy("at").agg(F.first("row").alias("row"))
        kept = kept.join(side, kept["at"].eqNullSafe(side["at"]), "left_anti").unionByName(once.select(*kept.columns))
    return kept.select("row.*")
