"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has its character boundaries as nodes and vocabulary pieces as arcs. For a
unigram vocabulary a path's value is the sum of its pieces' scores. For a BPE vocabulary the search is
first-order: two pieces may follow each other only if byte-pair merging leaves exactly that pair of
their joined text, and by that rule one path survives at each boundary, the one that merging the whole
prefix gives. So the ids are those of SentencePiece for either kind of model.

The search is a stream: boundaries are taken in order, each from the window of the longest piece before
it, and whenever all surviving paths run through one boundary the ids up to it are committed and
forgotten. Two kinds of boundaries are known to be such before the search: the start of a word (no piece
of the model goes on over a word's start mark) and both sides of a character that no piece has. The
stretches between them are therefore streams of their own, and they are searched side by side, one
boundary of all of them at a time; equal stretches of a block are searched once. A stretch of more than
LOOK characters is searched alone, and there the surviving paths are compared after every LOOK
characters, so an endless word needs no more than the window and what isn't committed yet.

Hashes find pieces and equal stretches, characters decide: every hit is compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship

SPACE = "▁"
#: Entries of a worker's cache of piece pairs, as strings and (a power of two) as ids.
PAIRS, PAIR_BITS = 200_000, 20
#: Bytes of text that are searched at once.
BLOCK = 1 << 19
#: Characters after which an unfinished search looks for a boundary that all paths share.
LOOK = 64


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model; a plain, fixed-size value that is sent to the tasks."""

    kind: str  # "bpe" or "unigram"
    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_of: dict[int, int]  # id -> byte
    unk: int
    dummy_prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: dict[int, int] = field(default_factory=dict)
    longest: int = 1
    crossing: bool = False  # a piece goes on after a word's start mark in its middle
    key: str = ""  # a digest of all of the above

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        whole = (self.kind, self.pieces, self.scores, self.normal, sorted(self.byte_of.items()), self.unk, self.dummy_prefix)
        self.key = sha256(repr(whole).encode("utf-8", "surrogatepass")).hexdigest()


def load(path: str) -> Vocabulary:
    """Read a model file on the driver. The public library is used as a reader of its own format only.

    What the search doesn't do is an error: normaliser rules, dropping of extra blanks, blanks that
    aren't marked or are marked behind a word, pieces that users defined, and models of words or characters.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, kind = model.normalizer_spec, {1: "unigram", 2: "bpe"}.get(model.trainer_spec.model_type)
    unfit = {
        "a model of words or characters": kind is None,
        "normaliser rules": bool(spec.precompiled_charsmap) or bool(spec.normalization_rule_tsv),
        "dropping of extra blanks": spec.remove_extra_whitespaces,
        "blanks without a mark": not spec.escape_whitespaces,
        "marks behind words": model.trainer_spec.treat_whitespace_as_suffix,
        "user-defined pieces": any(p.type == 4 for p in model.pieces),
    }
    if any(unfit.values()):
        raise ValueError(f"{path} needs what isn't supported: {', '.join(k for k, v in unfit.items() if v)}")
    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    n = reader.get_piece_size()
    bytes_ = {i: int(reader.id_to_piece(i)[3:5], 16) for i in range(n) if reader.is_byte(i)}
    normal = [not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)) for i in range(n)]
    return Vocabulary(kind, [reader.id_to_piece(i) for i in range(n)], [reader.get_score(i) for i in range(n)], normal, bytes_, reader.unk_id(), model.normalizer_spec.add_dummy_prefix)


def _distinct(keys: np.ndarray, points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each stretch points[start:stop] among the distinct ones, and a place of each of those.

    Stretches (adjoining, in order) are grouped by key; one that isn't equal to the first of its key in
    length and every character is a distinct one of its own.
    """
    import pandas as pd

    code, names = pd.factorize(keys)
    first = np.empty(len(names), np.int64)
    first[code[::-1]] = np.arange(len(keys) - 1, -1, -1)
    size = stop - start
    other = size != size[first][code]
    # The character at the same place of the first stretch, for all characters at once.
    shift = np.where(other, 0, start[first][code] - start)
    same = points == points[np.arange(len(points)) + np.repeat(shift, size)]
    other |= np.logical_or.reduceat(~same, start)
    alone = np.flatnonzero(other)
    code = code.astype(np.int64)
    code[alone] = len(first) + np.arange(len(alone))
    return code, np.concatenate([first, alone])


class Pieces:
    """Lookup of pieces by a rolling hash of their code points, then by the code points: tables of open slots, no collisions in the later ones."""

    BITS = 19

    def __init__(self, voc: Vocabulary):
        ids = np.array(sorted(voc.ids.values()), np.int64)
        self.points = np.zeros((len(voc.pieces), voc.longest), np.uint32)
        for i in ids:
            self.points[i, : len(voc.pieces[i])] = [ord(c) for c in voc.pieces[i]]
        for base in range(0x9E3779B97F4A7C15, 1 << 64, 2):  # the first odd number under which no two pieces share a hash
            self.base, self.power, self.inverse = base, np.empty(0, np.uint64), np.empty(0, np.uint64)
            keys = np.array([self.one(voc.pieces[i]) for i in ids], np.uint64)
            if len(np.unique(keys)) == len(keys):
                break
        self.tables = []
        for shift in range(64 - self.BITS, -1, -3):
            slot = self._slot(keys, shift)
            first = np.unique(slot, return_index=True)[1]
            if self.tables and len(first) < len(keys):
                continue  # a table without collisions for what is left
            at, name = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
            at[slot[first]], name[slot[first]] = keys[first], ids[first]
            self.tables.append((shift, at, name))
            left = np.setdiff1d(np.arange(len(keys)), first)
            keys, ids = keys[left], ids[left]
            if not len(keys):
                break

    def _slot(self, keys: np.ndarray, shift: int) -> np.ndarray:
        return (keys >> np.uint64(shift) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, x in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                p = np.full(n, x, np.uint64)
                p[:1] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, points: np.ndarray) -> np.ndarray:
        """Prefix sums from which the hash of any stretch follows."""
        self.powers(len(points) + 1)
        out = np.zeros(len(points) + 1, np.uint64)
        spread = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(29)
        np.cumsum(spread * self.power[: len(points)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def one(self, piece: str) -> int:
        points = np.array([ord(c) for c in piece], np.uint32)
        return int(self.hashes(self.sums(points), np.array([0]), np.array([len(points)]))[0])

    def find(self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """The id of each stretch points[start : start + size] with its hash, -1 if it is no piece."""
        out = np.full(len(keys), -1, np.int32)
        for shift, at, name in self.tables:
            slot = self._slot(keys, shift)
            hit = at[slot] == keys
            out[hit] = name[slot[hit]]
        hit = np.flatnonzero(out >= 0)
        for c in range(size):
            hit = hit[points[start[hit] + c] == self.points[out[hit], c]]
        sure = np.full(len(keys), -1, np.int32)
        sure[hit] = out[hit]
        return sure


class Codec:
    """Encoder and decoder of a worker, with bounded caches."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.floor = min((voc.scores[i] for i in voc.ids.values()), default=0.0) - 10.0  # fixed value: the format's penalty
        self.rank = {p: -voc.scores[i] for p, i in voc.ids.items()}
        self.steps: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # What each id decodes to.
        self.bytes = [bytes([voc.byte_of[i]]) if i in voc.byte_of else p.replace(SPACE, " ").encode() if voc.normal[i] else b"" for i, p in enumerate(voc.pieces)]
        self.pieces = Pieces(voc)
        self.none = len(voc.pieces)  # stands before a unit's first piece
        known = np.zeros(0x110000, bool)
        known[[ord(p) for p in voc.ids if len(p) == 1]] = True
        self.known = known
        # Whether one id may follow another, by hash of the pair: 2 * pair + answer. A fixed-size cache.
        self.follow = np.full(1 << PAIR_BITS, -1, np.int64)

    def _steps(self, a: str) -> tuple | None:
        """The merges that make the piece a of its characters: ranks, last part after each, first part after each; None if they make something else."""
        if a in self.steps:
            return self.steps[a]
        parts, ranks, rights, lefts = list(a), [], [], []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ranks.append(best)
            rights.append(parts[-1])
            lefts.append(parts[0])
        out = self.steps[a] = (ranks, rights, lefts) if len(parts) == 1 else None
        return out

    def _compatible(self, a: str, b: str) -> bool:
        """Merging leaves the pieces a, b of their joined text: no merge over their border ever comes first."""
        x, y = self._steps(a), self._steps(b)
        if x is None or y is None:
            return False
        never = float("inf")
        (xs, rights, _), (ys, _, lefts) = x, y
        i = j = 0
        right, left = a[-1], b[0]
        while True:
            p = xs[i] if i < len(xs) else never
            q = ys[j] if j < len(ys) else never
            over = self.rank.get(right + left, never)
            if over < p and over <= q and over < never:
                return False
            if p == q == never:
                return True
            if p <= q:
                right = rights[i]
                i += 1
            else:
                left = lefts[j]
                j += 1

    def _follows(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._compatible(a, b)
        return ok

    def _alone(self, a: str) -> bool:
        """Merging leaves the piece a of its own text."""
        return self._steps(a) is not None

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """_follows for arrays of ids; before may hold `none`."""
        key = before.astype(np.int64) * (self.none + 1) + piece
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        got = self.follow[slot]
        miss = got >> 1 != key
        if miss.any():
            names = self.voc.pieces
            fresh = np.unique(key[miss])
            answers = np.array([self._alone(names[k % (self.none + 1)]) if k // (self.none + 1) == self.none else self._compatible(names[k // (self.none + 1)], names[k % (self.none + 1)]) for k in fresh.tolist()], bool)
            found = answers[np.searchsorted(fresh, key[miss])]
            self.follow[slot[miss]] = key[miss] * 2 + found
            out = (got & 1).astype(bool)
            out[miss] = found
            return out
        return (got & 1).astype(bool)

    def _ids(self, piece: str) -> list[int]:
        k = self.voc.ids.get(piece)
        if k is not None:
            return [k]
        raw = [self.voc.byte_ids.get(b) for b in piece.encode("utf-8", "surrogatepass")]
        return [self.voc.unk] if None in raw else raw

    def viterbi(self, text: str) -> Iterator[int]:
        """Ids of a text, committed as soon as all surviving paths agree."""
        voc, n, longest = self.voc, len(text), self.voc.longest
        bpe = voc.kind == "bpe"
        floor = self.floor
        back: dict[int, int] = {0: -1}  # boundary -> boundary before it on its path
        value: dict[int, float] = {0: 0.0}
        done = 0  # all boundaries up to here are committed
        look = LOOK
        for j in range(1, n + 1):
            best, at = None, -1
            for i in range(max(done, j - longest), j):
                if i not in back:
                    continue
                piece = text[i:j]
                k = voc.ids.get(piece)
                if k is None and j - i > 1:
                    continue
                if bpe:
                    p = back[i]
                    if (self._follows(text[p:i], piece) if p >= 0 else self._alone(piece) or j - i == 1) if k is not None and p >= 0 or p < 0 else self._follows(text[p:i], piece):
                        best, at = 0.0, i
                        break
                else:
                    v = value[i] + (voc.scores[k] if k is not None else floor)
                    if best is None or v > best:
                        best, at = v, i
            if at >= 0:
                back[j], value[j] = at, best
            if j - done >= look and j < n:
                # Live paths: all boundaries that a piece may still start from.
                live = {b for b in range(j - longest + 1, j + 1) if b in back}
                while len(live) > 1:
                    top = max(live)
                    live.discard(top)
                    live.add(back[top])
                shared = live.pop()
                if shared > done:
                    yield from self._path(text, back, done, shared)
                    before = back[shared]
                    for b in [b for b in back if b < shared]:
                        del back[b], value[b]
                    # The piece before the boundary still decides what may follow.
                    back[shared] = before
                    done = shared
                    look = LOOK
                else:
                    look += LOOK
        yield from self._path(text, back, done, n)

    def _path(self, text: str, back: dict[int, int], start: int, stop: int) -> list[int]:
        cuts = []
        while stop > start:
            cuts.append(stop)
            stop = back[stop]
        out: list[int] = []
        for i, j in zip([start, *cuts[:0:-1]], cuts[::-1]):
            out += self._ids(text[i:j])
        return out

    def _lattices(self, points: np.ndarray, sums: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units at once, flat, and how many each has: the search of `viterbi`, one boundary of all units at a time.

        Units are known characters between two boundaries that every path runs through, so a unit's ids
        are committed when its end is reached; at most LOOK boundaries wait for that.
        """
        order = np.argsort(-length, kind="stable")
        start, size = start[order], length[order]
        node = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        last = np.full(int((size + 1).sum()), -1, np.int32)
        back = np.zeros(len(last), np.uint8)
        last[node] = self.none
        at_least = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        for j in range(1, int(size[0]) + 1):
            open_ = np.arange(at_least[j - 1])
            for k in range(min(j, self.voc.longest), 0, -1):
                before = last[node[open_] + j - k]
                some = np.flatnonzero(before >= 0)
                from_ = start[open_[some]] + j - k
                piece = self.pieces.find(self.pieces.hashes(sums, from_, from_ + k), points, from_, k)
                hit = np.flatnonzero(piece >= 0)
                some, piece = some[hit], piece[hit]
                ok = self._may_follow(before[some], piece)
                some, piece = some[ok], piece[ok]
                to = node[open_[some]] + j
                last[to], back[to] = piece, k
                rest = np.ones(len(open_), bool)
                rest[some] = False
                open_ = open_[rest]
                if not len(open_):
                    break
        # Back from the ends: the n-th id before a unit's end, for all units.
        seen, ids, unit = [], [], np.arange(len(size))
        at = node + size
        count = np.zeros(len(size), np.int64)
        while len(unit):
            ids.append(last[at])
            seen.append(unit)
            count[unit] += 1
            at = at - back[at]
            more = at > node[unit]
            unit, at = unit[more], at[more]
        counts = np.empty(len(size), np.int64)
        counts[order] = count
        end = np.cumsum(counts)[order]
        flat = np.empty(int(counts.sum()), np.int32)
        for n, (u, x) in enumerate(zip(seen, ids)):
            flat[end[u] - 1 - n] = x
        return flat, counts

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, flat, and how many each has."""
        voc = self.voc
        if voc.kind != "bpe" or voc.crossing:
            each = [list(self.viterbi((SPACE if voc.dummy_prefix else "") + t.replace(" ", SPACE))) if t else [] for t in texts]
            return self._joined(np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64))
        lead = SPACE if voc.dummy_prefix else ""
        marked = [lead + t if t else "" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        space = ord(SPACE)
        points[points == 32] = space
        # Units: a run of blanks and the word after it, and every character that no piece has.
        mark, known = points == space, self.known[points]
        begin = np.ones(len(points), bool)
        begin[1:] = (mark[1:] & ~mark[:-1]) | ~known[1:] | ~known[:-1]
        text_start = np.cumsum(sizes) - sizes
        begin[text_start[sizes > 0]] = True
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(points))
        sums = self.pieces.sums(points)
        code, first = _distinct(self.pieces.hashes(sums, start, stop) + (stop - start).astype(np.uint64), points, start, stop)
        s, e = start[first], stop[first]
        plain = known[s] & (e - s <= LOOK)
        counts = np.zeros(len(first), np.int64)
        flat, counts_plain = self._lattices(points, sums, s[plain], e[plain] - s[plain]) if plain.any() else (np.empty(0, np.int32), np.empty(0, np.int64))
        counts[plain] = counts_plain
        offset = np.zeros(len(first), np.int64)
        offset[plain] = np.cumsum(counts_plain) - counts_plain
        extra, total = [flat], len(flat)
        for u in np.flatnonzero(~plain):  # characters without a piece, and long units
            unit = points[s[u] : e[u]].tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.array(self._ids(unit) if len(unit) == 1 else list(self.viterbi(unit)), np.int32)
            offset[u], counts[u] = total, len(ids)
            extra.append(ids)
            total += len(ids)
        flat = np.concatenate(extra)
        n = counts[code]
        out = flat[np.repeat(offset[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])
        edge = np.searchsorted(start, np.append(text_start, len(points)))
        return self._joined(out, np.diff(ends[edge]))

    def _joined(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters in a row are one id, as the format has it, if the model has no bytes."""
        if self.voc.byte_of or not len(flat):
            return flat, counts
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != self.voc.unk) | (flat[:-1] != self.voc.unk) | (owner[1:] != owner[:-1])
        return flat[keep], np.bincount(owner[keep], minlength=len(counts))

    def encode(self, text: str) -> list[int]:
        return self.encode_block([text])[0].tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.voc.dummy_prefix and raw[:1] == " " else raw


_codecs: dict[str, Codec] = {}


def _codec(voc: Vocabulary) -> Codec:
    """The worker's codec of a vocabulary; a worker that goes on to another task keeps its caches."""
    if voc.key not in _codecs:
        _codecs.clear()
        _codecs[voc.key] = Codec(voc)
    return _codecs[voc.key]


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, ids array<int>, n_ids long, decoded string.

    Null texts give nulls, empty ones no ids and an empty string. decoded equals the text unless it
    holds U+2581, which the format itself reads as a blank, or characters that a model without bytes
    doesn't know, which it drops. Texts of any length are encoded whole.
    Repeated rows give equal rows; no rows, no rows; other columns aren't read.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary)  # fixed size: the vocabulary
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            size = np.array(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ends, i = np.cumsum(size), 0
            while i < len(size):  # blocks of texts; a longer one is a block of its own
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right")))
                column = batch.column(1).slice(i, j - i)
                texts = column.to_pylist()
                flat, counts = codec.encode_block([t or "" for t in texts])
                offsets = np.concatenate([[0], np.cumsum(counts)])
                decoded = [None if t is None else codec.decode(flat[offsets[k] : offsets[k + 1]].tolist()) for k, t in enumerate(texts)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=column.is_null())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])
                i = j

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {id_type.simpleString()}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_ids"), "decoded")
