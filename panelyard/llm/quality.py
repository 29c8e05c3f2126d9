"""Quality classifier: a factorisation machine over words, structure and metadata.

Inputs: hashed words (square roots of counts, unit length), structure statistics of
the text (word and line lengths, repeated lines, shares of marks, capitals, digits,
bars) and its length as metadata. Every input has a weight and a short vector; a
pair of inputs interacts by the product of its vectors. The sum over all pairs is
half of (sum of v x)^2 - sum of (v x)^2, so scoring is linear in the inputs.

Labels, language, source and id are never inputs.

Defined results: null and empty texts have structure zero and get a score. Rows are
scored on their own, repeated and null ids included. Without training labels of both
kinds every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.toxicity import sampled_texts

BITS = 15
RANK = 8
#: The most labelled rows that training reads.
SAMPLE = 10_000
STATISTICS = 12
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGITS, _SPACE = bytes(range(65, 91)), b"0123456789", b" \t\n\r\x0b\x0c"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = f = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
        return f


def structure(data: bytes, words: list[bytes]) -> list[float]:
    """The statistics, each of moderate size."""
    n, k = max(len(data), 1), max(len(words), 1)
    lines = data.split(b"\n")
    without = lambda chars: 1 - len(data.translate(None, chars)) / n
    marks = len(data.translate(None, _LETTERS + _DIGITS + _SPACE)) / n
    return [
        np.log1p(len(words)), np.log1p(len(data)), np.log1p(len(lines)), len(data) / k, len(set(words)) / k, len(set(lines)) / len(lines),
        marks, without(_UPPER), without(_DIGITS), data.count(b"|") / k, (data.count(b".") + data.count(b"?")) / k, data.count(b"!") / k,
    ]


def inputs(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(word features, values, statistics)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = data.split()
    low = data.lower().split()
    ids, n = np.unique(np.fromiter(map(words.__getitem__, low), np.int64, len(low)), return_counts=True)
    x = np.sqrt(n)
    return ids, x / max(np.sqrt((x * x).sum()), 1e-9), structure(data, found)


class Machine:
    """Bias, weights and vectors; statistics follow the words as further inputs."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.mean, self.spread, self.bias, self.w, self.v = mean, spread, bias, w, v

    def rows(self, raw: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, values, row starts) of all rows, one after the other."""
        stats = np.clip((np.array([r[2] for r in raw]) - self.mean) / self.spread, -4, 4) / np.sqrt(STATISTICS)
        own = np.arange(STATISTICS) + (1 << BITS)
        ids = np.concatenate([np.concatenate((r[0], own)) for r in raw])
        x = np.concatenate([np.concatenate((r[1], s)) for r, s in zip(raw, stats, strict=True)])
        size = np.array([len(r[0]) + STATISTICS for r in raw])
        return ids, x, np.concatenate(([0], np.cumsum(size)[:-1]))

    def margin(self, ids: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score before the sigmoid, sums of v x, v x)."""
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        pairs = 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), start))
        return self.bias + np.add.reduceat(self.w[ids] * x, start) + pairs, s, vx


def fit(raw: list[tuple], label: np.ndarray, epochs: int = 6, batch: int = 200, rate: float = 0.1, penalty: float = 1e-5) -> Machine:
    """AdaGrad on the logistic loss, rows in hashed order."""
    size = (1 << BITS) + STATISTICS
    if not len(label) or label.min() == label.max():
        return Machine(np.zeros(STATISTICS), np.ones(STATISTICS), 0.0, np.zeros(size), np.zeros((size, RANK)))
    stats = np.array([r[2] for r in raw])
    r = np.random.default_rng(17)
    chance = label.mean()
    m = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-6, float(np.log(chance / (1 - chance))), np.zeros(size), r.normal(0, 0.03, (size, RANK)))
    seen_b, seen_w, seen_v = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-4)
    for _ in range(epochs):
        order = r.permutation(len(raw))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            ids, x, start = m.rows([raw[i] for i in part])
            z, s, vx = m.margin(ids, x, start)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[part]) / len(part)
            per = np.repeat(g, np.diff(np.append(start, len(ids))))
            rows = np.repeat(np.arange(len(part)), np.diff(np.append(start, len(ids))))
            used, back = np.unique(ids, return_inverse=True)
            gw = np.bincount(back, per * x, len(used)) + penalty * m.w[used]
            each = (per * x)[:, None] * (s[rows] - vx)
            gv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(RANK)], axis=1) + penalty * m.v[used]
            seen_b += g.sum() ** 2
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            m.bias -= rate * g.sum() / np.sqrt(seen_b)
            m.w[used] -= rate * gw / np.sqrt(seen_w[used])
            m.v[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        rows = [inputs(t, words) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
            ["label", "ids", "x", "stats"],
        )


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = shared.value
        words = _Words()
        for batch in batches:
            texts, scores = batch.column(1).to_pylist(), []
            for k in range(0, len(texts), 500):
                z, _, _ = machine.margin(*machine.rows([inputs(t, words) for t in texts[k : k + 500]]))
                scores.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            p = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE) -> Machine:
    rows = sampled_texts(docs, labels, id_col, text_col, label_col, most).mapInArrow(_featurise, "label int, ids array<int>, x array<float>, stats array<double>").toArrow()
    # slices of the table's own arrays, no Python numbers
    parts = [[x.values.to_numpy() for x in rows[c]] for c in ("ids", "x", "stats")]
    raw = [(a.astype(np.int64), b.astype(np.float64), c) for a, b, c in zip(*parts, strict=True)]
    return fit(raw, rows["label"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Trains on rows that are not held out."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = F.coalesce(held_out, F.lit(False))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out"))
    known = source.where(~F.col("held_out"))
    machine = train(known, labels.select(F.col(id_col).alias("doc_id"), label_col), label_col=label_col, most=most)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return source.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
