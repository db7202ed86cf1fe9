"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of word characters and runs of other visible characters. Each of ``BUCKETS`` hashed
tokens has a sparse ternary index vector; its context vector adds up the index vectors of the tokens
up to two places away, over all tokens of all documents. A document is pooled to the mean and the
deviation of its tokens' vectors, the share of repeated tokens and its length. A network of two
layers in numpy gives the logit; one temperature, fitted on labelled rows that the training did not
see, calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bindloom.llm.common import append_columns, byte_view, enter, row_groups, run_hashes

BUCKETS = 1 << 14
DIMS = 64
NONZERO = 4
BLOCK = 128  # buckets per row of the summed context table
HIDDEN = 32

_CLASSES = np.full(256, 2, np.uint8)  # runs of other characters
_CLASSES[list(b" \t\n\r\x0b\x0c")] = 0
_CLASSES[[b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128]] = 1
_CLASSES[np.arange(65, 91)] = 3  # capitals: one token for each run


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the nonzero entries of every bucket's index vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens and the first token of every row."""
    hashes, first = run_hashes(data, _CLASSES[data], offsets)
    return (hashes >> np.uint64(64 - 14)).astype(np.int64), first


def _groups(col: pa.Array):
    data, offsets = byte_view(col)
    for i, j in row_groups(offsets):
        a, b = offsets[i], offsets[j]
        yield _tokens(data[a:b], offsets[i : j + 1] - a)


def context_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors (BUCKETS x DIMS) over all texts.

    Every task adds up its own table, whose size does not depend on the data; the tables travel
    as blocks of rows and each block is added up row by row.
    """

    module = __name__

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(module)
        columns, signs = _index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for tokens, first in _groups(batch.column(0)):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for away in (1, 2):
                    same = row[away:] == row[:-away]
                    a, b = tokens[:-away][same], tokens[away:][same]
                    for word, other in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(word * DIMS + columns[other, k], signs[other, k], BUCKETS * DIMS)
        blocks = total.reshape(-1, BLOCK * DIMS)
        used = np.flatnonzero(np.abs(blocks).sum(axis=1))
        yield _block_rows(used, blocks[used])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(values.as_py())
                sums[block] = sums[block] + part if block in sums else part
        yield _block_rows(np.array(list(sums), np.int64), np.array(list(sums.values())))

    schema = "block int, sums binary"
    blocks = BUCKETS // BLOCK
    parts = df.select(F.col(text)).mapInArrow(count, schema).repartition(blocks, "block").mapInArrow(add, schema)
    table = np.zeros((blocks, BLOCK * DIMS))
    for r in parts.collect():  # BUCKETS x DIMS numbers, whatever the input
        table[r["block"]] = np.frombuffer(r["sums"])
    table = table.reshape(BUCKETS, DIMS)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norms, 1e-12)).astype(np.float32)


def _block_rows(blocks: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks.astype(np.int32), pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["block", "sums"]
    )


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features (rows x 2 * DIMS + 2) of a column of texts; zeros for a text without tokens."""
    out = []
    for tokens, first in _groups(col):
        feats = np.zeros((len(first) - 1, 2 * DIMS + 2), np.float32)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if a == b:
                continue
            words, times = np.unique(tokens[a:b], return_counts=True)
            share = (times / (b - a)).astype(np.float32)
            v = vectors[words]
            mean = share @ v
            feats[i, :DIMS] = mean
            feats[i, DIMS : 2 * DIMS] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
            feats[i, -2] = 1 - len(words) / (b - a)
            feats[i, -1] = np.log1p(b - a)
        out.append(feats)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMS + 2), np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def logits(self, feats: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.tanh((feats - self.center) / self.scale @ w1 + b1) @ w2 + b2).astype(np.float64)

    def score(self, feats: np.ndarray) -> np.ndarray:
        # rounded, so that a text's score does not depend on the rows next to it
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(feats) / self.temperature, -40, 40))), 9)


def train(vectors: np.ndarray, feats: np.ndarray, labels: np.ndarray, seed: int = 7, epochs: int = 60) -> Model:
    """Network on four fifths of the rows (Adam, weight decay); temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    cut = max(1, len(order) // 5)
    held, used = order[:cut], order[cut:] if len(order) > 1 else order
    center, scale = feats[used].mean(axis=0), feats[used].std(axis=0) + 1e-3
    x, y = (feats - center) / scale, labels.astype(np.float64)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            rows = used[at : at + 128]
            h = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - h * h)
            grads = [x[rows].T @ back + 1e-3 * weights[0], back.sum(axis=0), h.T @ error + 1e-3 * weights[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, center, scale, weights, 1.0)
    z, t = model.logits(feats[held]), y[held]
    losses = {s: np.mean(np.logaddexp(0, z / s) - t * z / s) for s in np.geomspace(0.25, 8, 61).tolist()}
    model.temperature = min(losses, key=losses.get)
    return model


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    df: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample: int = 20_000,
) -> Model:
    """Word vectors from all texts; network from at most ``sample`` labelled rows that are not held out.

    The sample takes the labels with the least hash of their id, so it is the same on any
    partitioning; its documents are pooled by Spark and only their features reach the driver.
    Labels other than 0 and 1 and null ids are passed over; several labels of one id count as 1 if
    their mean is at least a half. Without any usable label the score is 0.5 for all texts, with
    only one label value it follows that value.
    """
    vectors = context_vectors(df, text)
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    usable = usable.filter(~is_held_out("_id")).groupBy("_id").agg(F.avg("_y").alias("_y"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` pairs of numbers
    texts = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    shared = df.sparkSession.sparkContext.broadcast(vectors)

    def start():
        return lambda cols: [pa.array([v.tobytes() for v in pooled(cols[0], shared.value)], pa.binary())]

    rows = append_columns(texts, ["_text"], ["_id", "_y"], "feats binary", start)
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "feats").limit(sample).collect()
    feats = np.array([np.frombuffer(r["feats"], np.float32) for r in rows], np.float64).reshape(len(rows), 2 * DIMS + 2)
    known = np.array([r["_y"] >= 0.5 for r in rows], bool)
    if len(rows) < 2:
        width = 2 * DIMS + 2
        bias = 0.0 if not len(rows) else 4.0 if known[0] else -4.0
        return Model(vectors, np.zeros(width), np.ones(width), [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(bias)], 1.0)
    return train(vectors, feats, known)


def classify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Columns ``keep`` (None: all), score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold`` on).

    Only the text enters the score. Null, empty and blank texts all get the score of a text
    without tokens; a text of any length is pooled whole. Equal texts get equal scores, repeated rows
    stay. An input column with the name of a new one gives way to it.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        def step(cols):
            score = shared.value.score(pooled(cols[0], shared.value.vectors))
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]

        return step

    return append_columns(df, [text], keep, "score double, predicted int", start)
