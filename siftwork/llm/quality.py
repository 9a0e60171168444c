"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is put into quantile bins; cyclic boosting visits the
features in turn and adds a shallow tree's step function to a lookup table a
feature, then does the same for the most telling pairs of features. A score is
a sum of table entries: a handful of vectorised gathers for a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.base import held_out, texts

#: Most labelled rows that a model is fitted on, chosen by a hash of the id.
FIT_ROWS = 8192
FEATURES = ("log_chars", "words", "mean_word", "letters", "upper", "digits", "symbols", "pipes", "bangs", "stops", "commas", "lines", "line_repeat", "word_variety", "next_repeat", "non_ascii", "longest_word", "title_words")
_CLASS = np.zeros(256, np.int64)  # other
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\f", b".", b",", b"!", b"|", b"#$%&*@^~<>{}[]\\/=+_`"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
CLASS = _CLASS.tolist()


def features(text: str | None) -> list[float]:
    """The FEATURES of a whole text; an empty one has zeros."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return [0.0] * len(FEATURES)
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by = np.bincount(np.asarray(CLASS), weights=codes, minlength=11)
    n = float(len(data))
    words = data.split()
    w = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    longest = max(map(len, words), default=0)
    again = sum(map(bytes.__eq__, words, words[1:]))
    title = sum(map(bytes.istitle, words))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - by[4]) / w, (by[1] + by[2]) / n, by[2] / n, by[3] / n, by[9] / n, by[8] / w, by[7] / w, by[5] / w, by[6] / w,
        float(np.log1p(len(lines))), 1.0 - len(set(lines)) / max(1, len(lines)), distinct / w, again / w, by[10] / n, float(np.log1p(longest)), title / w,
    ]


def _step(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step function over ordered bins that a shallow tree fits to summed gradients."""
    out, spans = np.zeros(len(grad)), [(0, len(grad))]
    g, h = np.r_[0.0, np.cumsum(grad)], np.r_[0.0, np.cumsum(hess)]
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = g[m] - g[a], h[m] - h[a], g[b] - g[m], h[b] - h[m]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
            gain[(hl < 1.0) | (hr < 1.0)] = -1.0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], k, int(m[i]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of depth two over two axes: the better first axis is cut once, then each side on the other axis."""

    def cut_first(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        first = _step(g.sum(1), h.sum(1), 2, ridge)
        cut = int(np.argmax(np.diff(first) != 0)) + 1 if len(first) > 1 and first[0] != first[-1] else 0
        step = np.zeros_like(g)
        for rows in (slice(0, cut), slice(cut, None)):
            step[rows] = _step(g[rows].sum(0), h[rows].sum(0), 2, ridge * 2)
        # what the step takes off a second-order loss
        return float((g * step - h * step * step / 2).sum()), step

    one, other = cut_first(g, h), cut_first(g.T, h.T)
    return one[1] if one[0] >= other[0] else other[1].T


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.12, leaves: int = 4, pairs: int = 6, ridge: float = 2.0) -> dict:
    """A model as plain arrays. With no rows, or one class only, it scores that share for every text."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    p = float(np.clip((y.sum() + 1.0) / (len(y) + 2.0), 1e-3, 1 - 1e-3))
    model = {"base": float(np.log(p / (1 - p))), "edges": [np.empty(0)] * k, "tables": [np.zeros(1)] * k, "pairs": []}
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    b = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(k)]
    sizes = [len(e) + 1 for e in edges]
    tables, f = [np.zeros(s) for s in sizes], np.full(len(y), model["base"])

    def residuals():
        q = 1 / (1 + np.exp(-f))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j in range(k):
            r, h = residuals()
            step = rate * _step(np.bincount(b[j], r, sizes[j]), np.bincount(b[j], h, sizes[j]), leaves, ridge)
            tables[j] += step
            f += step[b[j]]
    # pairs by the gain of a coarse grid on what is left
    r, h = residuals()
    coarse = [np.minimum(v * 8 // s, 7) for v, s in zip(b, sizes)]
    gains = []
    for i in range(k):
        for j in range(i):
            cell = coarse[i] * 8 + coarse[j]
            gains.append((float((np.bincount(cell, r, 64) ** 2 / (np.bincount(cell, h, 64) + 8.0)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        model["pairs"].append([i, j, np.zeros((sizes[i], sizes[j]))])
    for _ in range(rounds // 4):
        for i, j, table in model["pairs"]:
            r, h = residuals()
            cell = b[i] * sizes[j] + b[j]
            g2, h2 = np.bincount(cell, r, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]), np.bincount(cell, h, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
            step = _tree(g2, h2, ridge)
            table += rate * step
            f += rate * step[b[i], b[j]]
    model |= {"edges": edges, "tables": tables}
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1 for rows of features."""
    f = np.full(len(x), model["base"])
    b = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["edges"])]
    for j, t in enumerate(model["tables"]):
        f += t[b[j]]
    for i, j, t in model["pairs"]:
        f += t[b[i], b[j]]
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def featurise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, x): the feature vector of every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = FIT_ROWS) -> dict:
    """A model fitted on at most `rows` labelled documents, the first by a hash of the id.

    Null labels and labels of absent documents teach nothing; of contradicting labels of one id the largest counts,
    of texts that share an id the one with the least features.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    some = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers: small enough to send to every executor
    seen = featurise(docs.join(F.broadcast(some), "doc_id", "left_semi")).join(F.broadcast(some), "doc_id")
    seen = seen.groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(FEATURES))
    return fit(x, seen["y"].to_numpy(float))


def predict(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`: no shuffle.

    Null and empty texts are scored as a text of zero features; repeated rows
    each have a result; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            s = score(model, x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: learns from the other four folds, scores every row."""
    model = train(docs, labels.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
