"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text, lower-cased and with every run of other characters than letters as one blank, gives the
character n-grams of 1 to ``LONGEST`` code points in ``BUCKETS`` hashed columns. Document frequencies come from all
texts that may be learnt from. Weights are trained by follow-the-regularised-leader with one learning
rate per coordinate and an elastic net, which leaves columns without evidence at exactly zero; a temperature,
fitted on rows that the training did not see, calibrates the probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.llm.common import append_columns

BITS = 16
BUCKETS = 1 << BITS
LONGEST = 4
UNKNOWN = "und"
BLANK = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
c = F.col


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code point of every letter and mark, a blank for all others; and which are letters."""
    low, letter = np.full(0x110000, BLANK, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        ch = chr(i)
        letter[i] = ch.isalpha()
        if letter[i] or unicodedata.category(ch)[0] == "M":
            lower = ch.lower()
            low[i] = ord(lower) if len(lower) == 1 else i
    return low, letter


def letters_of(text: str) -> np.ndarray:
    """Code points with one blank before, between and behind the runs of letters; empty without a letter."""
    low, letter = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return np.zeros(0, np.uint32)
    points = np.concatenate([[BLANK], low[points], [BLANK]]).astype(np.uint32)
    blank = points == BLANK
    return points[~(blank & np.concatenate([[False], blank[:-1]]))]


def columns_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of the n-grams of a text, ascending, and how often each occurs."""
    points = letters_of(text)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = []
    hashed = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if n > len(points):
            break
        hashed = (hashed[: len(points) - n + 1] * _MIX + points[n - 1 :].astype(np.uint64) + np.uint64(n)) * _MIX
        hashed ^= hashed >> np.uint64(32)
        grams.append((hashed * _MIX) >> np.uint64(64 - BITS))
    all_grams = np.concatenate(grams).astype(np.int64)
    if len(all_grams) * 8 < BUCKETS:
        return np.unique(all_grams, return_counts=True)
    counts = np.bincount(all_grams, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


def weighted(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length, with 1 + log of the counts."""
    values = (1 + np.log(counts)) * idf[columns]
    norm = np.sqrt(values @ values)
    return values / norm if norm else values


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents per column and all documents, over all rows; the table has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                columns = columns_of(value.as_py() or "")[0]
                seen[columns] += 1
                n += 1
        used = np.flatnonzero(seen)
        at, times = np.append(used, -1), np.append(seen[used], n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(times, pa.int64())], names=["at", "times"])

    rows = df.select(text).mapInArrow(count, "at int, times long").groupBy("at").agg(F.sum("times").alias("times"))
    found, n = np.zeros(BUCKETS, np.int64), 0
    for at, times in rows.toLocalIterator():  # BUCKETS + 1 rows at most
        if at < 0:
            n = times
        else:
            found[at] = times
    return found, n


def trained(
    rows: list[tuple[np.ndarray, np.ndarray]],
    classes: np.ndarray,
    n_classes: int,
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.5,
    seed: int = 5,
) -> np.ndarray:
    """Weights (BUCKETS x classes) by FTRL-proximal steps, one row of (columns, values) at a time."""
    z, n = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    rng = np.random.default_rng(seed)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order.tolist():
            columns, values = rows[i]
            zs, ns = z[columns], n[columns]
            w = weights(zs, ns)
            share = _softmax(values @ w)
            share[classes[i]] -= 1
            grad = values[:, None] * share
            squared = grad * grad
            step = (np.sqrt(ns + squared) - np.sqrt(ns)) / alpha
            z[columns] = zs + grad - step * w
            n[columns] = ns + squared
    return weights(z, n)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(columns, counts, self.idf) @ self.weights[columns]

    def predict(self, text: str | None) -> tuple[str, float]:
        columns, counts = columns_of(text or "")
        if not len(columns) or not self.languages:
            return UNKNOWN, 0.0
        share = _softmax(self.logits(columns, counts) / self.temperature)
        best = int(np.argmax(share))
        return self.languages[best], round(float(share[best]), 9)


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0. False for a null id."""
    x = c(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(x.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    sample: int = 6_000,
    most_languages: int = 200,
) -> Model:
    """Document frequencies from all rows that may be learnt from, weights from at most ``sample`` of them.

    Rows with a null id, a null language, no letter or a held-out id are not learnt from. The sample takes equally many
    rows of each language (of the ``most_languages`` most frequent ones), those with the least hash of id and text; Spark
    turns them into columns and counts, and only these reach the driver. A fifth of them fits the temperature.
    """
    rows = df.select(c(f"`{doc_id}`").alias("_id"), c(f"`{text}`").alias("_text"), c(f"`{lang}`").cast("string").alias("_lang"))
    rows = rows.filter(c("_id").isNotNull() & c("_lang").isNotNull() & c("_text").isNotNull() & ~is_held_out("_id"))
    seen, n = document_frequencies(rows, "_text")
    idf = np.log((1 + n) / (1 + seen)) + 1
    counted = rows.filter(c("_text").rlike(r"\p{L}")).groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(most_languages).collect()
    languages = sorted(r["_lang"] for r in counted)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 1)), 1.0)
    each = max(2, sample // len(languages))
    known = rows.filter(c("_lang").isin(languages) & c("_text").rlike(r"\p{L}"))
    known = known.select("_lang", "_text", F.xxhash64("_id", "_text").alias("_h"))
    # first the hashes below a bound that leaves about twice as many rows as wanted, then their exact order
    bounds = F.create_map(*[x for r in counted for x in (F.lit(r["_lang"]), F.lit(2.0 * each / r["count"] + 1e-12))])
    below = F.shiftrightunsigned("_h", 11) / float(1 << 53) < F.element_at(bounds, c("_lang"))
    few = known.filter(below).select("_lang", "_h").distinct()
    drawn = few.withColumn("_rn", F.row_number().over(W.partitionBy("_lang").orderBy("_h"))).filter(c("_rn") <= each)
    texts = known.join(F.broadcast(drawn), ["_lang", "_h"]).dropDuplicates(["_lang", "_h"])

    def start():
        def step(cols):
            found = [columns_of(x.as_py()) for x in cols[0]]
            return [pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)]

        return step

    got = append_columns(texts, ["_text"], ["_lang", "_h"], "at binary, times binary", start).collect()  # at most `sample` rows
    got.sort(key=lambda r: (r["_h"], r["_lang"]))
    features = []
    for r in got:
        columns, counts = (np.frombuffer(r[x], np.int32).astype(np.int64) for x in ("at", "times"))
        features.append((columns, weighted(columns, counts, idf)))
    classes = np.array([languages.index(r["_lang"]) for r in got])
    cut = np.arange(len(got)) % 5 == 4
    used, held = np.flatnonzero(~cut), np.flatnonzero(cut)
    w = trained([features[i] for i in used], classes[used], len(languages))
    logits = np.array([features[i][1] @ w[features[i][0]] for i in held]).reshape(len(held), len(languages))
    return Model(languages, idf, w, _temperature(logits, classes[held]))


def _temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the logits with the least log loss; 1 without rows."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(classes)), classes]))

    return min(np.geomspace(0.05, 10, 107).tolist(), key=loss)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (None: all), lang_pred and score, the calibrated probability of that language.

    Only the text enters a prediction. A null text and one without a letter are ``und`` with score 0;
    a text of any length is read whole. Ties go to the language that sorts first. Equal texts get
    equal results, repeated rows stay; an empty table gives an empty result. Without any row to learn
    from all texts are ``und``. An input column with the name of a new one gives way to it.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def start():
        predict = shared.value.predict

        def step(cols):
            found = [predict(x.as_py()) for x in cols[0]]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return step

    return append_columns(df, [text], keep, "lang_pred string, score double", start)
