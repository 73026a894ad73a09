"""Near-duplicate vectors by lattice hashing: E8 cells of random projections, neighbouring cells, cosine.

A table is eight random orthonormal directions (of one rotation, so that tables split a difference among
them): a unit vector's eight coordinates, over the cell's scale, are decoded to the closest point of E8.
A vector lies in that home cell and also asks in the few of the 240 neighbouring cells that it is closest
to. Two vectors meet in a cell that is home to one of them. Measured for unrelated directions at a cosine
of just 0.98 in 64 dimensions: 0.85 of the pairs meet in a table, more than 0.9999 in one of eight.

- Equal vectors of one label are one class from the start, so copies cost a class.
- In every cell, each class first meets the cell's pivot (its smallest home class); verified links are
  contracted to components. Then only classes of a cell that are still in different components meet.
  So a large group of near copies costs a star, and no pair that meets is left out.
- Linked vectors are in one component, so the number of links is counted there: a component's classes
  are dealt into chunks of bounded size, and each pair of chunks is one matrix product that gives a count
  for each class, never a list of pairs. A component is as many groups as its chunks have pairs.

Hot cells, pivots and components are attached by broadcasts of a proven bound (`quern.session.attach`);
hot cells whose classes stay apart are split into salted parts of both sides. What is shuffled for the
cells are narrow rows. Every step is written, so a lost executor costs that step.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.ngram_join import components
from quern.llm.whitening import finite
from quern.session import attach, cut, hot_keys, ship

TABLES, PROBES = 8, 4
#: A cell's scale is this many times the distance of unit vectors at the threshold (projections keep distances on average).
SCALE = 1.75
#: Classes of a chunk of a component, on average: from CHUNK to MOST, in between with the root of its size, so that
#: neither one group nor the number of groups that a class goes to grows faster than that.
CHUNK, MOST = 48, 2048
#: Rows of a hot cell that a part of it gets, on average.
PART = 1024
_LAST = (1 << 63) - 1


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


NEIGHBOURS = _neighbours()


def _closest_d8(x: np.ndarray) -> np.ndarray:
    """The closest points with whole entries of an even sum: round, then turn the worst entry if the sum is odd."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1) % 2)
    off = (x - f)[odd]
    worst = np.abs(off).argmax(1)
    f[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def closest_e8(x: np.ndarray) -> np.ndarray:
    """The closest point of E8 to each row: E8 is D8 and D8 moved by 1/2 in every entry."""
    a, b = _closest_d8(x), _closest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def rotation(d: int, tables: int, seed: int) -> np.ndarray:
    """d x (8 * tables): orthonormal directions, eight for each table; under eight dimensions the rest are zeros."""
    rng, found = np.random.default_rng(seed), []
    while len(found) < tables:
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        q = np.pad(q, ((0, 0), (0, max(0, 8 - d))))
        found += [q[:, 8 * t : 8 * t + 8] * max(1.0, d / 8) ** 0.5 for t in range(q.shape[1] // 8)]
    return np.concatenate(found[:tables], axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; entries are scaled first, so squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cells(units: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """A 64-bit number for each row, table and cell (its home first, then the neighbours it asks in)."""
    projected = units @ rotation(units.shape[1], tables, seed) / scale
    out = np.empty((len(units), tables, 1 + probes), np.int64)
    places = np.random.default_rng(seed + 1).integers(1, 1 << 62, (tables, 9), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        for t in range(tables):
            x = projected[:, 8 * t : 8 * t + 8]
            home = closest_e8(x)
            near = np.argpartition((home - x) @ NEIGHBOURS.T, probes, axis=1)[:, :probes] if probes else np.empty((len(x), 0), int)
            points = np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[near]], axis=1)
            out[:, t] = (np.rint(2 * points).astype(np.int64) * places[t, :8]).sum(2) + places[t, 8]
    return out


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the lists of each length."""
    import pyarrow.compute as pc

    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, matrix(column.take(at))


def _cells(classes: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """node, sig and home: a row for each class and cell. sig takes in the label and the number of dimensions."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_length(batch.column("vector")):
                for low in range(0, len(at), 1024):
                    some = at[low : low + 1024]
                    found = cells(unit(vectors[low : low + 1024]), tables, probes, scale, seed)
                    each = found.shape[1] * found.shape[2]
                    home = np.zeros(found.shape[1:], bool)
                    home[:, 0] = True
                    kind = np.repeat(batch.column("kind").to_numpy()[some], each)
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.repeat(some, each))), pa.array(kind), pa.array(found.reshape(-1)), pa.array(np.tile(home.reshape(-1), len(some)))], ["node", "kind", "cell", "home"])

    kind = F.xxhash64(F.col("key.label"), F.size("key.vector"))
    rows = classes.select("node", kind.alias("kind"), F.col("key.vector").alias("vector"))
    return rows.mapInArrow(run, "node struct<id:bigint,tag:bigint>, kind bigint, cell bigint, home boolean").select("node", F.xxhash64("kind", "cell").alias("sig"), "home")


def _verify(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of one label, of which a may be hot, whose cosine reaches the threshold in double precision."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            linked = np.zeros(len(batch), bool)
            for (at, u), (_, v) in zip(_by_length(x), _by_length(y)):
                linked[at] = (unit(u) * unit(v)).sum(1) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked))

    second = pairs.join(classes.select(F.col("node").alias("b"), F.col("key").alias("right")), "b")
    hot = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows")), "a")
    both = attach(second, classes.select(F.col("node").alias("a"), F.col("key").alias("left")), "a", hot)
    same = both.filter((F.col("left.label") == F.col("right.label")) & (F.size("left.vector") == F.size("right.vector")))
    node = "struct<id:bigint,tag:bigint>"
    return same.select("a", "b", F.col("left.vector").alias("x"), F.col("right.vector").alias("y")).mapInArrow(run, f"a {node}, b {node}")


def _apart(rows: DataFrame, roots: DataFrame, tried: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Distinct pairs of a home class and another one of a cell that are in different components and weren't tried yet."""
    rooted = rows.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("sig", "node", "home", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted)
    sides = rooted.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most"), F.max("home").alias("some"))
    parts = sides.filter("least != most and some").select("sig", F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    mixed = cut(attach(rooted, parts, "sig", hot))
    # A cell of n parts is n x n meetings: the homes are dealt out, the others go to every part.
    homes = mixed.filter("home").select("sig", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.col("node").alias("h"), F.col("root").alias("hr"))
    others = mixed.select("sig", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "root")
    met = homes.join(others, ["sig", "part"]).filter("hr != root")
    pairs = met.select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """node and links: the rows of other classes of its component whose cosine reaches the threshold.

    members has root, node, rows and key. Each pair of chunks of a component is a group of its own.
    """
    import pyarrow as pa

    def count(group: list[tuple]) -> tuple[list, list]:
        root, left, right = group[0][:3]
        names, weights = [g[4] for g in group], np.array([g[5] for g in group], np.int64)
        vectors, chunk = unit(np.stack([np.asarray(g[6], np.float64) for g in group])), np.array([g[3] for g in group])
        a, b = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        near = vectors[a] @ vectors[b].T >= threshold
        total = np.zeros(len(group), np.int64)
        if left == right:
            np.fill_diagonal(near, False)
            total[a] += near @ weights[b]
        else:
            total[a] += near @ weights[b]
            total[b] += weights[a] @ near
        return names, total.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by group; what is held is one group."""
        group: list[tuple] = []
        names: list = []
        totals: list[int] = []
        kind = pa.struct([("id", pa.int64()), ("tag", pa.int64())])

        def close() -> None:
            found = count(group)
            names.extend(found[0])
            totals.extend(found[1])
            group.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns[:6]], (v for v in batch.column(6).to_numpy(zero_copy_only=False))):
                if group and (group[0][0], group[0][1], group[0][2]) != (row[0], row[1], row[2]):
                    close()
                group.append(row)
            if len(names) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(totals, pa.int64())], ["node", "links"])
                names.clear()
                totals.clear()
        if group:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(totals, pa.int64())], ["node", "links"])

    sizes = cut(members.groupBy("root").agg(F.count(F.lit(1)).alias("rows")))
    chunks = sizes.select("root", F.ceil(F.col("rows") / F.greatest(F.lit(CHUNK), F.least(F.lit(MOST), 1.5 * F.sqrt("rows")))).cast("int").alias("chunks"))
    dealt = attach(members, chunks, "root", hot_keys(sizes, "root")).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = other.select("root", F.least("chunk", "other").alias("l"), F.greatest("chunk", "other").alias("r"), "chunk", "node", "rows", F.col("key.vector").alias("vector"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_groups = groups.repartition(n, "root", "l", "r").sortWithinPartitions("root", "l", "r")
    found = sorted_groups.mapInArrow(run, "node struct<id:bigint,tag:bigint>, links bigint")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _key(label: Column, vector: Column) -> Column:
    return F.struct(label.alias("label"), vector.alias("vector"))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES, seed: int = 8
) -> DataFrame:
    """One row per row of `vectors`: id_col, n_links, component_id, kept.

    Two rows of one label (not null) and one length link when their cosine in double precision reaches the
    threshold. n_links counts the other rows linked directly, component_id is the smallest id reachable,
    kept says whether that is the row's own. Null labels, and vectors that are null, empty, zero or hold
    null or non-finite entries, link with nothing. Rows that repeat an id or a vector are rows of their
    own; a null id counts as greater than all others and stays null. Ties between equal cosines don't
    matter. An empty table gives no rows. Other columns aren't read, whatever their names; there are no
    texts, so no long ones. Pairs are found with the probability that the module states (at a cosine of
    the threshold itself; closer ones more surely); counts inside a component are exact.
    """
    spark = vectors.sparkSession
    ship(spark)
    scale = SCALE * (2 - 2 * threshold) ** 0.5
    some = F.coalesce(F.exists(F.col(vector_col), lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), (F.col(label_col).isNotNull() & finite(vector_col) & some).alias("fine"))
    usable = rows.filter("fine").select("id", _key(F.col("label"), F.col("vector")).alias("key"))
    node = F.struct(F.col("id"), F.xxhash64("key").alias("tag"))
    classes = usable.groupBy("key").agg(F.coalesce(F.min("id"), F.lit(_LAST)).alias("id"), F.count(F.lit(1)).alias("rows"))
    classes = cut(classes.select(node.alias("node"), "key", "rows"))

    met = cut(_cells(classes, tables, probes, scale, seed))
    sums = met.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("home"), F.col("node"))).alias("pivot"))
    shared = cut(sums.filter("rows > 1 and pivot is not null"))
    hot = hot_keys(shared.select("sig", "rows"), "sig")
    rows_met = cut(attach(met, shared.select("sig", "pivot"), "sig", hot))
    stars = rows_met.filter("pivot != node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = cut(stars)
    links = cut(_verify(stars, classes, threshold))
    roots = components(links)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = cut(_apart(rows_met, roots, tried, hot))
    more = cut(_verify(rest, classes, threshold))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    roots = cut(roots)
    linked = roots.join(classes, "node")
    counts = _counts(linked.select("root", "node", "rows", "key"), threshold)
    named = classes.join(roots, "node", "left").join(counts, "node", "left")
    of_class = cut(named.select("key", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root.id", "node.id").alias("first"), "rows"))
    found = attach(usable, of_class.select("key", "n_links", "first"), "key", hot_keys(of_class.select("key", "rows"), "key"))
    alone = rows.filter("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("first"))
    out = found.select("id", "n_links", F.when(F.col("first") != _LAST, F.col("first")).alias("first")).unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("first").alias("component_id"), F.col("id").eqNullSafe(F.col("first")).alias("kept"))
