"""Before/after audit: what a reduction changed in the blocks of each turn, and whether anything was lost.

The blocks of a turn before and after are aligned by digests (a longest common subsequence), the stretches
between are paired in order, and each difference gets a severity. Whether a block was seen in full before,
which archive entries a text names and what these hold are joins over the whole table; only the alignment
of one turn's digests runs in Python. What a block's row needs (digests, size, names, preview) goes with its
turn in one shuffle and isn't joined to again. Texts aren't moved but for those with chunk references. A
change has a number from then on, by which what is found out about it comes back; of the forms that were
passed on in full only those that a change asks for leave the aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.deltas import edit_script
from quern.session import HOT_LEAST, attach, cut, hot_keys, ship

RECOVERABLE, REFERENCED, MISSING, MISMATCH = "recoverable_prior_full", "elided_with_reference", "reference_missing", "reference_mismatch"
LOST, CHANGED, EXTRA = "lost", "changed_without_reference", "extra_after_block"
#: Severities that count as a loss of content.
LOSSES = (LOST, CHANGED, EXTRA, MISSING, MISMATCH)
ARCHIVE = r"local-archive://([A-Za-z0-9_\-]+)"
CHUNK = r"\[context-chunk status=unchanged uri=local-archive://([A-Za-z0-9_\-]+) bytes=[0-9]+\]"
#: How far entries of the archive are followed to entries that they name.
DEPTH = 4
_EXIT, _OUTPUTS = "Process exited with code ", ("\nOutput:\n", "\r\nOutput:\r\n")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _payload(text: Column) -> Column:
    """Digest of a command's output without its envelope, null for other texts."""
    payload = F.lit(None).cast("string")
    for marker in reversed(_OUTPUTS):
        at = F.instr(text, marker)
        payload = F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(payload)
    return F.when(text.contains(_EXIT), F.when(payload != "", _digest(payload)))


def align(before: list[tuple], after: list[tuple]) -> Iterator[tuple[str, int | None, int | None]]:
    """(kind, before, after) by places, of blocks (digest or None for an empty text, blank): equal, replaced, removed, extra.

    Of subsequences that are as long, blocks before are passed over first. Between equal blocks, blank
    blocks in front are left out; if more blocks come after than were before, the first ones are extra.
    """

    def between(b: list[int], a: list[int]) -> Iterator[tuple[str, int | None, int | None]]:
        while b and before[b[0]][1]:
            b = b[1:]
        while a and after[a[0]][1]:
            a = a[1:]
        more = max(0, len(a) - len(b)) if b else 0
        for j in a[:more]:
            yield "extra", None, j
        a = a[more:]
        yield from (("replaced", i, j) for i, j in zip(b, a))
        yield from (("removed", i, None) for i in b[len(a) :])
        yield from (("extra", None, j) for j in a[len(b) :])

    def visible(rows):
        return (r for r in rows if not all(blocks[k][1] for blocks, k in ((before, r[1]), (after, r[2])) if k is not None))

    items = [[(name, k) if digest is None else digest for k, (digest, _) in enumerate(blocks)] for name, blocks in (("b", before), ("a", after))]
    b: list[int] = []
    a: list[int] = []
    for op, j, i in edit_script(items[1], items[0]):
        if op == " ":
            yield from visible(between(b, a))
            yield "equal", i, j
            b, a = [], []
        elif op == "+":
            b.append(i)
        else:
            a.append(j)
    yield from visible(between(b, a))


_FOUND = "kind string, b bigint, a bigint, digest binary, payload binary, bytes bigint, ids array<string>, chunked boolean, preview string"


def _aligned(blocks: DataFrame, kind: str) -> DataFrame:
    """session, turn, kind and digest and payload of the block before; of changes also b, a (blocks before and after), bytes, ids, chunked, preview.

    ids are the entries that a change names: those of its replacement, or where what is left of it is
    shorter, all that the turn's blocks name afterwards. Equal blocks of one turn with one text are a row.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("before", "after"):
                column = batch.column(name)
                ends, end = [], 0
                for n in column.value_lengths().to_pylist():
                    ends.append((end, end := end + n))
                sides.append((ends, dict(zip(("block", "digest", "blank", "ids", "payload", "size", "chunked", "preview"), column.flatten().flatten()))))
            (b_at, old), (a_at, new) = sides
            items = [list(zip(x["digest"].to_pylist(), x["blank"].to_pylist())) for x in (old, new)]
            old_size, new_size, new_ids = old["size"].to_pylist(), new["size"].to_pylist(), new["ids"].to_pylist()
            # Places of each found row: its turn, its block before, and of changes both blocks.
            at, kinds, olds, b, a, sizes, ids = [], [], [], [], [], [], []
            for row, ((b0, b1), (a0, a1)) in enumerate(zip(b_at, a_at)):
                context, known = None, set()
                for name, i, j in align(items[0][b0:b1], items[1][a0:a1]):
                    i, j = None if i is None else b0 + i, None if j is None else a0 + j
                    if name == "equal":
                        if items[0][i][0] in known:
                            continue
                        known.add(items[0][i][0])
                    at.append(row)
                    kinds.append(name)
                    olds.append(i)
                    if name == "equal":
                        i = j = more = names = None
                    else:
                        was, now = 0 if i is None else old_size[i], 0 if j is None else new_size[j]
                        more, names = was - now, [] if j is None else new_ids[j]
                        if not names and was > 0 and (j is None or items[1][j][1] or now < was):
                            if context is None:
                                context = list(dict.fromkeys(x for found in new_ids[a0:a1] for x in found))
                            names = context
                    b.append(i)
                    a.append(j)
                    sizes.append(more)
                    ids.append(names)
            olds, b, a = (pa.array(x, pa.int64()) for x in (olds, b, a))
            one = batch.select(["session", "turn"]).take(pa.array(at, pa.int64()))
            preview = pc.coalesce(old["preview"].take(b), new["preview"].take(a))
            found = [pa.array(kinds, pa.string()), old["block"].take(b), new["block"].take(a), old["digest"].take(olds), old["payload"].take(olds), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.string())), new["chunked"].take(a), preview]
            yield pa.RecordBatch.from_arrays([*one.columns, *found], ["session", "turn", "kind", "b", "a", "digest", "payload", "bytes", "ids", "chunked", "preview"])

    row = F.struct("block", "digest", "blank", "ids", "payload", "size", "chunked", "preview")
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, row)))
    turns = blocks.groupBy("session", "turn").agg(side("before").alias("before"), side("after").alias("after"))
    return turns.mapInArrow(run, f"session {kind}, turn bigint, {_FOUND}")


def audit(blocks: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """session, turn, block, severity, bytes, preview: a row for each block that a reduction changed.

    blocks: session, turn, side (before or after), block (place in the turn), text (null: empty). archive:
    id, body; without it a reference counts as good. bytes is what the change took away. Severities: a
    block that was passed on in full in this or an earlier turn of the session is recoverable; a
    replacement that names archive entries is referenced if an entry, one that it names (DEPTH steps), or
    the replacement with its chunks put in holds the block, missing if no entry is there, else a mismatch.
    What has no reference is lost if it got shorter, else changed; added blocks are extra. A turn's blocks
    are one request and meet in one row, without their texts (80 characters of each at most). Empty tables give no rows.
    """
    ship(blocks.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = blocks.select("session", F.col("turn").cast("long").alias("turn"), "side", F.col("block").cast("long").alias("block"), text.alias("text"))
    names = F.when(F.col("text").contains("local-archive://"), F.array_distinct(F.regexp_extract_all("text", F.lit(ARCHIVE), 1))).otherwise(F.array().cast("array<string>"))
    narrow = rows.select(
        "session", "turn", "side", "block", F.when(F.col("text") != "", _digest(F.col("text"))).alias("digest"), (~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).alias("blank"), names.alias("ids"),
        _payload(F.col("text")).alias("payload"), F.octet_length("text").cast("long").alias("size"), F.col("text").rlike(CHUNK).alias("chunked"), F.left(F.trim("text"), F.lit(80)).alias("preview"),
    )
    # Changes are numbered as they are written, so joins go by a number.
    found = cut(_aligned(narrow, dict(rows.dtypes)["session"]).withColumn("eid", F.when(F.col("kind") != "equal", F.monotonically_increasing_id())))

    # The first turn in which a form of a block was passed on in full: of forms that a change from that turn on asks for.
    stable, old = F.array_compact(F.array("digest", "payload")), F.col("kind") == "equal"
    forms = found.filter("kind != 'extra'").select("eid", "turn", "kind", "session", F.explode(stable).alias("form")).select("eid", "turn", "kind", F.struct("session", "form").alias("key"))
    first = forms.groupBy("key").agg(F.min(F.when(old, F.col("turn"))).alias("since"), F.max(F.when(~old, F.col("turn"))).alias("last"), F.count_if(~old).alias("rows"))
    first = cut(first.filter((F.col("since") <= F.col("last")) | (F.col("rows") > HOT_LEAST)))
    asking = forms.filter(~old).select("eid", "turn", "key")
    hot = hot_keys(first.select("key", "rows"), "key", asking.count())
    before = cut(attach(asking, first.select("key", "since"), "key", hot).filter("since <= turn").select("eid").distinct()).withColumn("recoverable", F.lit(True))

    changed = found.filter("kind != 'equal'").join(before, "eid", "left")
    named = (F.col("kind") != "extra") & F.col("recoverable").isNull() & (F.size("ids") > 0)
    open_, rest = changed.filter(named), changed.filter(~named)
    out = ["session", "turn", F.coalesce("b", "a").alias("block")]
    severity = F.when(F.col("kind") == "extra", EXTRA).when(F.col("recoverable"), RECOVERABLE).when(F.col("bytes") > 0, LOST).otherwise(CHANGED)
    told = rest.select(*out, severity.alias("severity"), "bytes", "preview")
    if archive is None:
        return told.unionByName(open_.select(*out, F.lit(REFERENCED).alias("severity"), "bytes", "preview"))
    refs = _references(open_.select("eid", "session", "turn", "a", stable.alias("stable"), "ids", "chunked"), rows, archive)
    judged = open_.select("eid", *out, "bytes", "preview").join(refs, "eid", "left")
    return told.unionByName(judged.select("session", "turn", "block", F.coalesce("reference", F.lit(MISSING)).alias("severity"), "bytes", "preview"))


def _references(named: DataFrame, rows: DataFrame, archive: DataFrame) -> DataFrame:
    """eid and reference of the changes (eid, session, turn, a, stable, ids, chunked) that name entries of the archive; those whose entries aren't there have no row."""
    entries = cut(archive.select(F.col("id").alias("entry"), "body", _digest(F.col("body")).alias("digest"), F.array_distinct(F.regexp_extract_all("body", F.lit(ARCHIVE), 1)).alias("nested")))
    named = cut(named)

    def look(frontier: DataFrame, total: int) -> DataFrame:
        """eid, entry, hit (the entry holds the block), and where it doesn't and names others, these (nested) and the block's forms (stable)."""
        counts = cut(frontier.groupBy("entry").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HOT_LEAST))
        met = attach(frontier, entries.drop("body"), "entry", hot_keys(counts, "entry", total))
        hit = F.coalesce(F.array_contains("stable", F.col("digest")), F.lit(False))
        on = ~hit & (F.size("nested") > 0)
        return cut(met.select("eid", "entry", hit.alias("hit"), F.when(on, F.col("nested")).alias("nested"), F.when(on, F.col("stable")).alias("stable")))

    frontier, known = named.select("eid", "stable", F.explode("ids").alias("entry")), None
    for _ in range(DEPTH + 1):
        total = frontier.count()
        if known is not None and not total:
            break
        met = look(frontier, total)
        # Entries that the change names itself are counted, those behind them aren't.
        told = met.select("eid", "entry", "hit") if known is None else met.filter("hit").select("eid", F.lit(None).cast("string").alias("entry"), "hit")
        known = told if known is None else known.unionByName(told)
        frontier = cut(met.select("eid", "stable", F.explode("nested").alias("entry")).distinct())
    state = cut(known.groupBy("eid").agg(F.size(F.collect_set("entry")).alias("there"), F.max("hit").alias("good")))

    # Replacements whose entries are all there: their chunks are put in and the whole is compared.
    whole = named.filter("chunked").join(state.filter("not good"), "eid").filter(F.col("there") == F.size("ids")).select("eid", "stable", F.col("session").alias("s"), F.col("turn").alias("t"), F.col("a").alias("k"))
    after = rows.filter((F.col("side") == "after") & F.col("text").rlike(CHUNK)).select("session", "turn", "block", "text")
    texts = whole.join(after, (F.col("s") == F.col("session")) & (F.col("t") == F.col("turn")) & (F.col("k") == F.col("block"))).select("eid", "stable", "text")
    chunks = texts.select("eid", "stable", "text", F.posexplode(F.regexp_extract_all("text", F.lit(CHUNK), 1)).alias("place", "entry"))
    bodies = chunks.join(entries.select("entry", "body"), "entry", "left")
    put = bodies.groupBy("eid", "stable", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]).alias("bodies"), F.count("body").alias("known"))
    marks = F.regexp_extract_all("text", F.lit(f"({CHUNK})"), 1)
    filled = F.array_join(F.flatten(F.zip_with(F.split("text", CHUNK, -1), F.zip_with("bodies", marks, lambda b, m: F.coalesce(b, m)), lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))), "")
    expanded = put.filter(F.col("known") > 0).filter(F.array_contains("stable", _digest(filled))).select("eid").distinct().withColumn("expanded", F.lit(True))
    return state.join(expanded, "eid", "left").select("eid", F.when(F.col("good") | F.col("expanded"), REFERENCED).otherwise(MISMATCH).alias("reference"))


def audit_report(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """session, turns, bytes_before, bytes_after, saved, changes, lost: a row per session."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = blocks.groupBy("session").agg(
        F.countDistinct("turn").alias("turns"), F.sum(F.when(F.col("side") == "before", size).otherwise(0)).cast("long").alias("bytes_before"), F.sum(F.when(F.col("side") == "after", size).otherwise(0)).cast("long").alias("bytes_after")
    )
    counts = found.groupBy("session").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("severity").isin(*LOSSES)).alias("lost"))
    joined = sizes.join(counts, "session", "left")
    return joined.select("session", "turns", "bytes_before", "bytes_after", (F.col("bytes_before") - F.col("bytes_after")).alias("saved"), F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("lost", F.lit(0)).alias("lost"))
