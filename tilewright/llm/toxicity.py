"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (runs of letters, lower case) and their leading letters, so that unseen endings
of a known stem count; each text is the set of its terms. The score is

    sigmoid(w0 + sum_i w_i + 1/2 sum_f [(sum_i v_if)^2 - sum_i v_if^2])

with a linear weight and a short vector for each term: pairs of terms, such as an insult and the mention of a
group, weigh more (or less) together than their two weights.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, the smallest hashes of the ids, half of
each class where there are enough), in one task; its size is fixed by ``BITS`` and ``RANK``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Terms are hashed to 2**BITS cells, with a vector of RANK numbers for each.
BITS, RANK = 18, 4
STEMS = (4, 5)
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.05, 2e-5
#: Terms in fewer sampled texts than this, or as common in either class up to so many standard errors, are left out.
LEAST_TEXTS, LEAST_Z = 4, 4.0
CACHE = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Cells of a word and its stems. A cache of bounded size; nothing depends on what it holds."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        mask = (1 << BITS) - 1
        cells = (xxhash.xxh64_intdigest("=" + word) & mask, *(xxhash.xxh64_intdigest(word[:n]) & mask for n in STEMS if len(word) >= n))
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = cells
        return cells

    def of(self, text: str | None) -> np.ndarray:
        words = set(LETTERS.findall((text or "").lower()))
        return np.unique(np.fromiter((c for w in words for c in self[w]), dtype=np.int64))


def sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows, half of them of each class where there are enough; the same ones in every run.

    Each half is a bounded smallest-k, so no task gathers a class.
    """
    halves = [labels.where(F.col(label) == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    return halves[0].unionByName(halves[1])


def machine(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(margins, sums of the vectors) of texts whose cells lie in a row in ``flat``."""
    n = len(starts)
    margin, sums = np.full(n, float(model["w0"][0])), np.zeros((n, model["v"].shape[1]))
    full = np.flatnonzero(lengths)
    if len(full):
        at = starts[full]
        vectors = model["v"][flat]
        sums[full] = np.add.reduceat(vectors, at, axis=0)
        squares = np.add.reduceat((vectors**2).sum(axis=1), at)
        margin[full] += np.add.reduceat(model["w"][flat], at) + 0.5 * ((sums[full] ** 2).sum(axis=1) - squares)
    return margin, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)), np.cumsum(lengths) - lengths, lengths


def tells(sets: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Which cells are in enough texts, and in one class more than in the other beyond ``LEAST_Z`` standard errors."""
    counts = [np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *(s for s, y in zip(sets, labels) if y == k)]), minlength=size) for k in (0, 1)]
    of = [max(int((labels == k).sum()), 1) for k in (0, 1)]
    both = counts[0] + counts[1]
    share = both / (of[0] + of[1])
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / of[0] + 1 / of[1]))
    return (both >= LEAST_TEXTS) & (np.abs(counts[1] / of[1] - counts[0] / of[0]) >= LEAST_Z * error)


def fit_arrays(sets: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Adagrad on the log loss with both classes weighing the same."""
    rng = np.random.default_rng(7)
    size = 1 << BITS
    telling = tells(sets, labels, size)
    # A term may tell nothing by itself and much beside a telling one.
    beside = [k for k, s in enumerate(sets) if telling[s].any()]
    frequent = telling | tells([sets[k] for k in beside], labels[beside], size)
    sets = [s[frequent[s]] for s in sets]
    model = {"w0": np.zeros(1), "w": np.zeros(size), "v": np.zeros((size, RANK))}
    positives = labels.sum()
    if not 0 < positives < len(labels):  # nothing to tell apart
        model["w0"][0] = 4.0 if positives else -4.0
        return model
    model["v"][frequent] = rng.normal(0, 0.01, (int(frequent.sum()), RANK))
    weight = np.where(labels == 1, 0.5 / positives, 0.5 / (len(labels) - positives)) * len(labels)
    gw0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sets))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            flat, starts, lengths = joined([sets[r] for r in rows])
            margin, sums = machine(flat, starts, lengths, model)
            slope = (sigmoid(margin) - labels[rows]) * weight[rows] / len(rows)
            gw0 += slope.sum() ** 2
            model["w0"][0] -= RATE * slope.sum() / np.sqrt(gw0)
            each = np.repeat(slope, lengths)
            cells, back = np.unique(flat, return_inverse=True)
            step = np.bincount(back, weights=each, minlength=len(cells)) + DECAY * model["w"][cells]
            gw[cells] += step**2
            model["w"][cells] -= RATE * step / np.sqrt(gw[cells])
            pull = each[:, None] * (np.repeat(sums, lengths, axis=0) - model["v"][flat])
            step = np.stack([np.bincount(back, weights=pull[:, f], minlength=len(cells)) for f in range(RANK)], axis=1) + DECAY * model["v"][cells]
            gv[cells] += step**2
            model["v"][cells] -= RATE * step / np.sqrt(gv[cells])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "label", most: int = SAMPLE) -> dict[str, np.ndarray]:
    """A model from texts (doc_id, text) and labels (doc_id, 0 or 1).

    Rows with other labels or null ids are left out, as are repeated ids beyond their first label and text;
    without both classes the score is constant.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, labels, terms = [], [], Terms()
        for batch in batches:
            sets += [terms.of(x.as_py()) for x in batch.column(0)]
            labels += batch.column(1).to_pylist()
        model = fit_arrays(sets, np.array(labels, dtype=np.float64))
        used = np.flatnonzero(model["w"] != 0)
        values = np.concatenate((model["w"][used, None], model["v"][used]), axis=1).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model["w0"], used.astype(np.int32), values)], ["w0", "cells", "values"])

    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(label).alias("label"))
    chosen = F.broadcast(sample(chosen, "label", most))  # ``most`` rows of two numbers
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    row = texts.orderBy("label", F.xxhash64("doc_id"), "doc_id").coalesce(1).select("text", "label").mapInArrow(learn, "w0 binary, cells binary, values binary").first()
    if row is None:  # no labelled text
        return fit_arrays([], np.empty(0))
    model = {"w0": np.frombuffer(row["w0"]), "w": np.zeros(1 << BITS, dtype=np.float32), "v": np.zeros((1 << BITS, RANK), dtype=np.float32)}
    cells, values = np.frombuffer(row["cells"], dtype=np.int32), np.frombuffer(row["values"], dtype=np.float32).reshape(-1, RANK + 1)
    model["w"][cells], model["v"][cells] = values[:, 0], values[:, 1:]
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` with the score in a new last column, in place of one of that name if there is any.

    Null and empty texts get the score of a text without terms; repeated rows are scored each.
    """
    docs = docs.drop(name)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**BITS * (RANK + 1) numbers at most
    from pyspark.sql.types import DoubleType, StructField, StructType

    place = docs.columns.index("text")
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names may hold anything
    schema = StructType([*numbered.schema.fields, StructField("score", DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, terms = shared.value, Terms()
        live = model["w"] != 0
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 200):
                sets = [terms.of(x.as_py()) for x in batch.column(place).slice(i, 200)]
                out.append(sigmoid(machine(*joined([s[live[s]] for s in sets]), model)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.empty(0))], schema.names)

    return numbered.mapInArrow(apply, schema).toDF(*docs.columns, name)
