"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a gated unit with an update gate: n = s(W x + U h), z = (1 + s(W' x + U' h)) / 2,
h = h + z (n - h), where s(a) = a / (1 + |a|) squashes (a fifth of the cost of tanh). Both states together label every byte; a document's probabilities are the mean over
its bytes. The network is trained in numpy by backpropagation through time on a bounded sample of
texts, and everything that is shipped is its weights (some 40 kB).

Texts are cut into windows of CORE bytes, each read with CONTEXT bytes of run-up on either side, so a
text of any length is a number of equal windows, batched over documents; every byte is labelled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.sampling import held_out, sample_ids, sample_texts
from quern.session import ship

#: Labelled rows of each language that may be sampled for training.
SAMPLE_ROWS = 1000
HIDDEN = 8
CORE = 128
CONTEXT = 16
#: Training: windows per step, their length, steps, learning rate.
BATCH, LENGTH, STEPS, RATE = 256, 48, 300, 0.02
#: Windows that are run at once.
BLOCK = 1024
#: Bytes of text that are labelled at once.
BYTES = 1 << 19
UNDETERMINED = "und"
#: What a text must have to be in a language.
LETTER = r"\p{L}"


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # [2, 2 * HIDDEN, 256] input contribution of each byte, gate rows first
    recur: np.ndarray  # [2, 2 * HIDDEN, HIDDEN]
    out: np.ndarray  # [2, labels, HIDDEN]
    bias: np.ndarray  # [labels, 1]


def _new(labels: list[str], rng: np.random.Generator) -> Model:
    h, k = HIDDEN, len(labels)
    return Model(
        labels,
        rng.normal(0, 0.3, (2, 2 * h, 256)).astype(np.float32),
        rng.normal(0, 0.6 / np.sqrt(h), (2, 2 * h, h)).astype(np.float32),
        rng.normal(0, 0.3, (2, k, h)).astype(np.float32),
        np.zeros((k, 1), np.float32),
    )


def _states(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run both directions. x: [T, 2, B] bytes in reading order. Returns h, z, n as [T, 2, HIDDEN, B]."""
    t, _, b = x.shape
    h_, z_, n_ = (np.empty((t, 2, HIDDEN, b), np.float32) for _ in range(3))
    h = np.zeros((2, HIDDEN, b), np.float32)
    for i in range(t):
        a = np.matmul(m.recur, h)
        a[0] += np.take(m.table[0], x[i, 0], axis=1)
        a[1] += np.take(m.table[1], x[i, 1], axis=1)
        a /= 1 + np.abs(a)
        z, n = a[:, :HIDDEN], a[:, HIDDEN:]
        z_[i] = 0.5 + 0.5 * z
        n_[i] = n
        h = h + z_[i] * (n - h)
        h_[i] = h
    return h_, z_, n_


def _train_step(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss of labelling every byte of the windows x [T, B] as y [B], and its gradients."""
    t, b = x.shape
    both = np.stack([x, x[::-1]], axis=1)
    h, z, n = _states(m, both)
    forward, backward = h[:, 0], h[::-1, 1]
    logits = np.matmul(m.out[0], forward) + np.matmul(m.out[1], backward) + m.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -np.log(p[:, y, np.arange(b)] + 1e-9).mean()
    d = p
    d[:, y, np.arange(b)] -= 1
    d /= t * b
    g_out = np.stack([np.einsum("tkb,thb->kh", d, forward), np.einsum("tkb,thb->kh", d, backward)])
    g_bias = d.sum((0, 2))[:, None]
    dh_out = np.stack([np.matmul(m.out[0].T, d), np.matmul(m.out[1].T, d)[::-1]], axis=1)  # [T, 2, H, B] in reading order
    g_table, g_recur = np.zeros_like(m.table), np.zeros_like(m.recur)
    dh = np.zeros((2, HIDDEN, b), np.float32)
    da = np.empty((2, 2 * HIDDEN, b), np.float32)
    flat = np.empty((t, 2, 2 * HIDDEN, b), np.float32)
    for i in range(t - 1, -1, -1):
        before = h[i - 1] if i else np.zeros_like(dh)
        dh = dh + dh_out[i]
        zi, ni = z[i], n[i]
        # s' = (1 - |s|)^2
        da[:, :HIDDEN] = dh * (ni - before) * 0.5 * (1 - np.abs(2 * zi - 1)) ** 2
        da[:, HIDDEN:] = dh * zi * (1 - np.abs(ni)) ** 2
        flat[i] = da
        g_recur += np.matmul(da, before.transpose(0, 2, 1))
        dh = dh * (1 - zi) + np.matmul(m.recur.transpose(0, 2, 1), da)
    for side in (0, 1):
        values = flat[:, side].transpose(1, 0, 2).reshape(2 * HIDDEN, -1)
        at = both[:, side].reshape(-1)
        for row in range(2 * HIDDEN):
            g_table[side, row] = np.bincount(at, weights=values[row], minlength=256)
    return float(loss), [g_table, g_recur, g_out, g_bias]


def fit(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Model:
    """Train on (label, text) pairs; labels come sorted. Without samples the model has no labels."""
    labels = sorted({y for y, _ in samples})
    rng = np.random.default_rng(seed)
    m = _new(labels, rng)
    if len(labels) < 2:
        return m
    texts = {k: [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for y, t in samples if y == label and t] for k, label in enumerate(labels)}
    texts = {k: v for k, v in texts.items() if v}
    classes = sorted(texts)
    params = [m.table, m.recur, m.out, m.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = np.array(classes)[rng.integers(0, len(classes), BATCH)]
        x = np.zeros((LENGTH, BATCH), np.uint8)
        for j, k in enumerate(y):
            t = texts[k][rng.integers(len(texts[k]))]
            at = int(rng.integers(0, max(1, len(t) - LENGTH + 1)))
            w = t[at : at + LENGTH]
            x[: len(w), j] = w
        _, grads = _train_step(m, x, y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p, g, a, b in zip(params, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def label_windows(m: Model, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of windows of the texts data[start:stop]: text number, offset, probabilities [CORE, labels, B] (0 beyond a text)."""
    counts = (stops - starts + CORE - 1) // CORE
    owner = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin, end, low = starts[owner] + nth * CORE, stops[owner], starts[owner]
    steps = np.arange(CONTEXT + CORE)[:, None]
    for i in range(0, len(owner), BLOCK):
        b, e, lo = begin[i : i + BLOCK], end[i : i + BLOCK], low[i : i + BLOCK]
        ahead, back = b - CONTEXT + steps, b + CONTEXT + CORE - 1 - steps
        x = np.empty((CONTEXT + CORE, 2, len(b)), np.uint8)
        x[:, 0] = np.where((ahead >= lo) & (ahead < e), data[np.clip(ahead, 0, len(data) - 1)], 0)
        x[:, 1] = np.where(back < e, data[np.clip(back, 0, len(data) - 1)], 0)
        h = np.empty((CONTEXT + CORE, 2, HIDDEN, len(b)), np.float32)
        state = np.zeros((2, HIDDEN, len(b)), np.float32)
        a, c = (np.empty((2, 2 * HIDDEN, len(b)), np.float32) for _ in range(2))
        for t in range(CONTEXT + CORE):
            np.matmul(m.recur, state, out=a)
            m.table[0].take(x[t, 0], axis=1, out=c[0], mode="clip")
            m.table[1].take(x[t, 1], axis=1, out=c[1], mode="clip")
            a += c
            np.abs(a, out=c)
            c += 1
            a /= c
            z, n = a[:, :HIDDEN], a[:, HIDDEN:]
            z += 1
            z *= 0.5
            n -= state
            n *= z
            state = np.add(state, n, out=h[t])
        logits = np.matmul(m.out[0], h[CONTEXT:, 0]) + np.matmul(m.out[1], h[CONTEXT:, 1][::-1]) + m.bias
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        logits *= (np.arange(CORE)[:, None] < (e - b)[None, :])[:, None, :]
        yield owner[i : i + BLOCK], b - lo, logits


def predict_texts(m: Model, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """[texts, labels]: mean probability over the bytes of each text."""
    pooled = np.zeros((len(starts), len(m.labels)))
    for owner, _, p in label_windows(m, data, starts, stops):
        sums = p.sum(0)
        for k in range(len(m.labels)):
            pooled[:, k] += np.bincount(owner, weights=sums[k], minlength=len(starts))
    return pooled / np.maximum(stops - starts, 1)[:, None]


def label_runs(m: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, stop, label) of runs of equally labelled bytes of one text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return []
    best = np.concatenate([p.argmax(1).T.reshape(-1) for _, _, p in label_windows(m, data, np.array([0]), np.array([len(data)]))])[: len(data)]
    cuts = np.flatnonzero(np.diff(best)) + 1
    edges = [0, *cuts.tolist(), len(data)]
    return [(a, b, m.labels[best[a]]) for a, b in zip(edges, edges[1:])]


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", steps: int = STEPS) -> Model:
    """Fit on at most sample_rows texts of each language that are not held out."""
    usable = docs.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).select(id_col, label_col)
    picked = sample_ids(usable, id_col, label_col, sample_rows)
    return fit(sample_texts(docs.filter(F.col(label_col).isNotNull()), picked, id_col, text_col), steps)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: id_col, held_out, lang_pred, score; with `keep`, those columns of docs, lang_pred, score.

    lang_pred is a label of the model, `und` with score 0 if the text is null or has no letter (or the
    model no labels). score is the mean probability of the label over the text's bytes; ties go to
    the label that sorts first. Repeated rows get equal rows; no rows, no predictions. Columns besides
    those named aren't read; kept columns called lang_pred or score are replaced.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ends, i = np.cumsum(sizes), 0
            while i < len(sizes):  # blocks of texts; a longer one is a block of its own
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BYTES, "right")))
                part = batch.slice(i, j - i)
                names, scores = label(part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], names, scores], [*part.schema.names[2:], "lang_pred", "score"])
                i = j

    def label(column: pa.Array, letters: pa.Array) -> tuple[pa.Array, pa.Array]:
        text = column.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
        lettered = np.array(letters.to_pylist(), bool)
        starts, stops = offsets[:-1].copy(), offsets[1:].copy()
        stops[~lettered] = starts[~lettered]
        names, scores = [UNDETERMINED] * len(text), np.zeros(len(text))
        if model.labels:
            pooled = predict_texts(model, data, starts, stops)
            best = pooled.argmax(1)
            scores = np.where(lettered, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)
            names = [model.labels[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)]
        return pa.array(names, pa.string()), pa.array(scores, pa.float64())

    kept = [c for c in ([id_col] if keep is None else keep) if c not in ("lang_pred", "score")]
    text = F.col(text_col).cast("string")
    own = ["text", "lettered"]
    while set(own) & set(docs.columns):
        own = [f"{name}_" for name in own]
    rows = docs.select(text.alias(own[0]), F.coalesce(text.rlike(LETTER), F.lit(False)).alias(own[1]), *kept)
    schema = T.StructType([*rows.schema.fields[2:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(run, schema)
    if keep is not None:
        return found
    return found.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score")
