"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic text and one on ordinary text, of equal size and
from equally many pieces. Each window of a text is compressed with both, and the bytes that the toxic
dictionary saves are the window's distance.

Toxic text is mostly ordinary text, so plain halves give two dictionaries of the same common words and a
distance that is mostly noise. Therefore both dictionaries have one part in common in front, trained by
zstandard on other ordinary texts, and are trained on what that part leaves: of each class the share of
its pieces that the common part compresses worst. Ordinary windows then cost about the same with either.

A document's distance is the mean of its windows'. Dictionaries are trained on pieces of several lengths
and draws; the pair that tells the calibration texts (sampled rows that no dictionary has seen) apart
best is taken. Two thresholds are calibrated on the same texts: the mean distance from which a document is
toxic (best F1 at the corpus's rate of toxic labels; it becomes the score 0.3), and the distance from
which a window is (more than all but one in a hundred ordinary windows).

Scoring streams over Arrow batches; what is shipped is two dictionaries of half a megabyte, whatever
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sampling import held_out, sample_ids, sample_texts
from quern.session import ship

#: Labelled rows of each class that may be sampled.
SAMPLE_ROWS = 1500
WINDOW = 160
STRIDE = 144
#: Bytes of the part that both dictionaries have in common, and of each one's own part.
COMMON_BYTES, OWN_BYTES = 512 << 10, 4096
#: Bytes of a piece of the common part's training, and the segments (k, d) that its trainer picks.
COMMON_PIECE, COMMON_SEGMENT = 128, (48, 6)
#: The same for the own parts, and how many draws of pieces each is trained on; those that calibrate best are taken.
PIECES = [(20, (20, 6)), (32, (12, 6)), (48, (16, 6))]
DRAWS = 2
#: The share of a class's pieces, those that the common part compresses worst, that an own part is trained on.
WORST = 0.3
CUT = 0.3


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    slope: float = 0.0
    bias: float = 0.0
    #: Distance from which a window counts as toxic.
    window_cut: int = 1 << 30


def compressor(dictionary: bytes):
    """A function from bytes to their compressed form. Dictionaries are read as content, so short windows keep plain literals and a match shows in the length."""
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=20, hash_log=20, chain_log=20, search_log=8, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=params).compress
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress


def windows(b: bytes, size: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    """Windows of a whole text, the last one shorter; an empty text has one empty window."""
    return [b[i : i + size] for i in range(0, max(1, len(b) - (size - stride)), stride)]


def distances(b: bytes, ordinary, toxic) -> list[int]:
    """Bytes that the toxic dictionary saves, for each window of b."""
    return [len(ordinary(w)) - len(toxic(w)) for w in windows(b)]


def _train(pieces: list[bytes], size: int, segment: tuple[int, int], rng: np.random.Generator) -> bytes:
    """A dictionary trained by zstandard on the pieces in random order; empty if there is too little text."""
    mixed = [pieces[i] for i in rng.permutation(len(pieces))]
    try:
        return zstandard.train_dictionary(size, mixed, k=segment[0], d=segment[1]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _separation(scores: np.ndarray, y: np.ndarray) -> float:
    """The area under the ROC curve, ties counted half."""
    ordered = np.sort(scores[y == 0])
    below, upto = np.searchsorted(ordered, scores[y == 1]), np.searchsorted(ordered, scores[y == 1], "right")
    return float((below + upto).mean() / 2 / max(1, len(ordered)))


def _logistic(x: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve over one number, by Newton steps with a slight ridge."""
    a, w, ridge = np.stack([x, np.ones_like(x)], 1), np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return max(0.05, float(w[0]))


def _threshold(scores: np.ndarray, y: np.ndarray, base_rate: float) -> float:
    """Between two scores, where F1 is best if the corpus has base_rate of toxic texts."""
    order = np.argsort(-scores, kind="stable")
    share = y.mean()
    weight = np.where(y == 1, base_rate / share, (1 - base_rate) / (1 - share))[order]
    hit, all_ = np.cumsum(weight * y[order]), np.cumsum(weight)
    f1 = 2 * hit / (all_ + (weight * y[order]).sum())
    s = scores[order]
    last = np.append(s[1:] != s[:-1], True)  # equal scores fall on one side
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def fit(samples: list[tuple[int, str]], base_rate: float) -> Model:
    """Dictionaries from three quarters of the samples, calibration on the rest; base_rate is the corpus's share of toxic labels.

    With too few samples of either class the model has no dictionaries and every score is the base rate.
    """
    none = Model(bias=float(np.log((base_rate + 1e-6) / (1 - base_rate + 1e-6))))
    texts = {label: [t.encode("utf-8", "replace") for y, t in samples if y == label] for label in (0, 1)}
    learn = {label: [b for i, b in enumerate(x) if i % 4 != 3] for label, x in texts.items()}
    check = [(label, b) for label in (0, 1) for b in texts[label][3::4]]
    y = np.array([label for label, _ in check], int)
    if len(set(y.tolist())) < 2:
        return none
    rng = np.random.default_rng(7)
    half = {0: learn[0][1::2], 1: learn[1]}
    common = _train([p for b in learn[0][::2] for p in windows(b, COMMON_PIECE, COMMON_PIECE)], COMMON_BYTES, COMMON_SEGMENT, rng)
    squeeze, best = compressor(common), None
    for size, segment in PIECES:
        worst = {}
        for label in (0, 1):
            pieces = [p for b in half[label] for p in windows(b, size, size)]
            cost = np.array([len(squeeze(p)) / max(1, len(p)) for p in pieces])
            worst[label] = [pieces[i] for i in np.argsort(-cost, kind="stable")[: int(len(pieces) * WORST)]]
        n = min(map(len, worst.values()))
        for _ in range(DRAWS):
            own = {label: _train([p[i] for i in rng.permutation(len(p))[:n]], OWN_BYTES, segment, rng) for label, p in worst.items()}
            if not own[0] or not own[1]:
                continue
            pair = compressor(common + own[0]), compressor(common + own[1])
            each = [distances(b, *pair) for _, b in check]
            mean = np.array([np.mean(d) for d in each])
            found = _separation(mean, y)
            if best is None or found > best[0]:
                plain = np.concatenate([d for d, label in zip(each, y) if label == 0])
                best = found, own, mean, int(np.quantile(plain, 0.99)) + 1
    if best is None:
        return none
    _, own, mean, window_cut = best
    slope, cut = _logistic(mean, y), _threshold(mean, y, base_rate)
    return Model(common + own[0], common + own[1], slope, float(np.log(CUT / (1 - CUT)) - slope * cut), window_cut)


def score_text(text: str | None, model: Model, pair) -> tuple[float, int, int]:
    """Score, windows and toxic windows of a text."""
    if pair is None:
        return float(1 / (1 + np.exp(-model.bias))), 0, 0
    d = distances((text or "").encode("utf-8", "replace"), *pair)
    margin = model.slope * (sum(d) / len(d)) + model.bias
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30)))), len(d), sum(x >= model.window_cut for x in d)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most sample_rows labelled texts of each class, none of them held out."""
    ship(docs.sparkSession)
    usable = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(id_col, label_col)
    counts = {r[0]: r[1] for r in usable.groupBy(label_col).count().collect()}
    picked = sample_ids(usable, id_col, label_col, sample_rows)
    base_rate = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    return fit([(int(y), t) for y, t in sample_texts(docs, picked, id_col, text_col)], base_rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, held_out, score, predicted (1 from a score of 0.3), windows, toxic_windows.

    Null texts are scored as empty ones, which have one empty window of distance 0. Very long texts are
    scored whole, window by window. A model without dictionaries gives every text the base rate and no
    windows. A text at the threshold itself is predicted toxic. Repeated rows get equal scores; no rows,
    no scores; other columns aren't read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType
    sent = spark.sparkContext.broadcast(model)  # fixed size: two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        pair = (compressor(fitted.ordinary), compressor(fitted.toxic)) if fitted.toxic else None
        for batch in batches:
            rows = [score_text(t.as_py(), fitted, pair) for t in batch.column(1)]
            score, n, hot = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(hot, pa.int64())], ["id", "score", "windows", "toxic_windows"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type.simpleString()}, score double, windows long, toxic_windows long")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "windows", "toxic_windows")
