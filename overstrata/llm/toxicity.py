"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the logistic score of its words and of their beginnings; a
document's score is the noisy-or of its sentences', 1 - prod(1 - p). Only documents carry labels; the weights are
learned through the noisy-or, and the sentences with a high score are then the offending ones. Features that stand
no more often in toxic documents than chance would have it (a z of under 5) get no weight.

Defined cases: a null or empty text has no sentence and scores 0; repeated rows each get their row; other columns
are neither read nor changed; a table without usable labels gives a model that scores everything 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled documents of each class that a fit takes at most (those with the smallest hash of their id).
FIT_ROWS_PER_CLASS = 4000
#: Text bytes of one numpy step of a fit.
FIT_STEP = 1 << 20
BITS = 18  # features share 2**BITS weights, 1 MB in all
#: Bytes of a word's beginning that are features beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
LEAST_Z = 5.0


@dataclass
class Model:
    """weights: of word buckets; bias: of a sentence."""

    weights: np.ndarray
    bias: float

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text index, first byte, end byte, logit) of each sentence that has a word."""
        features, first, doc, start, end = split(data, offsets)
        if not len(first):
            return doc, start, end, np.zeros(0)
        total = np.zeros(features.shape[1])
        for row in features:
            total += self.weights[row]
        return doc, start, end, np.add.reduceat(total, first) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, _, _, z = self.sentences(data, offsets)
        return -np.expm1(-np.bincount(doc, np.logaddexp(0, z), len(offsets) - 1))


_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Buckets of all words (a row for each kind of feature); of each sentence its first word, text, first and end byte.

    Bucket 0 stands for no feature and never has a weight.
    """
    words = C.Words(data, offsets, C.FOLDED_WORDS)
    features = np.zeros((1 + len(PREFIXES), len(words.hash)), np.int64)
    features[0] = words.hash >> np.uint64(64 - BITS)
    for i, n in enumerate(PREFIXES, 1):
        at = np.flatnonzero(words.end - words.start >= n)
        features[i, at] = words.prefix(at, n) >> np.uint64(64 - BITS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    stops = np.cumsum(_STOP[data])
    before = stops[words.start] if len(words.start) else np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return features, first, doc[first], words.start[first], words.end[last]


def fit_texts(texts: list[str] | pa.Array | pa.ChunkedArray, labels: np.ndarray, epochs: int = 150, rate: float = 0.1, decay: float = 1e-4, prior: float | None = None) -> Model:
    """Adam on the mean log loss of the noisy-or. prior: the share of toxic documents, where the texts hold more or fewer."""
    size = 1 << BITS
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), -40.0 if not len(texts) or not labels.max() else 0.0)
    column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    # Once for how many documents have each feature, once for those features that are used: little is held at a time.
    found = np.zeros((2, size))
    for at, _, data, offsets in C.steps(column, FIT_STEP):
        features, first, doc, _, _ = split(data, offsets)
        word_doc = np.repeat(doc, np.diff(np.append(first, features.shape[1])))
        seen = np.unique((word_doc[None, :] * size + features).ravel())
        for k in (0, 1):
            found[k] += np.bincount(seen[labels[at + seen // size] == k] % size, minlength=size)
    n1, n0 = labels.sum(), (1 - labels).sum()
    z = (found[1] / n1 - found[0] / n0) / np.sqrt((found[0] + found[1] + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    z[0] = 0
    used = np.flatnonzero(z >= LEAST_Z)
    slot = np.full(size, -1)
    slot[used] = np.arange(len(used))
    cols, rows, docs_of, n = [], [], [], 0
    for at, _, data, offsets in C.steps(column, FIT_STEP):
        features, first, doc, _, _ = split(data, offsets)
        sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, features.shape[1]))) + n
        kind, word = np.nonzero(slot[features] >= 0)
        cols.append(slot[features[kind, word]])
        rows.append(sentence[word])
        docs_of.append(doc + at)
        n += len(first)
    if not n:
        return Model(np.zeros(size, np.float32), -40.0)
    col, row, doc = np.concatenate(cols), np.concatenate(rows), np.concatenate(docs_of)
    y = labels.astype(float)
    prior = y.mean() if prior is None else prior
    share = np.where(y > 0, prior / y.sum(), (1 - prior) / (1 - y).sum())
    w, b = np.zeros(len(used)), -4.0
    m, v, t = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0
    for _ in range(epochs):
        z = np.bincount(row, w[col], n) + b
        none = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log of the chance that no sentence is toxic
        p = np.clip(-np.expm1(-none), 1e-9, 1)
        # d loss / d none: 1 for clean documents, -(1 - p) / p for toxic ones
        g = share * np.where(y > 0, -(1 - p) / p, 1.0)
        gz = g[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.append(np.bincount(col, gz[row], len(used)) + decay * np.sign(w), gz.sum())
        t += 1
        m = 0.9 * m + 0.1 * grad
        v = 0.98 * v + 0.02 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-7)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(size, np.float32)
    weights[used] = np.where(np.abs(w) > 0.05, w, 0)
    return Model(weights, float(b))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that never trains: crc32 of the id's text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = FIT_ROWS_PER_CLASS) -> Model:
    """Learn from labels (doc_id, toxic) outside the held-out fold; an id with several labels counts as toxic if one says so."""
    chosen = None
    C.bounded_batches(docs)
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    for label in (0, 1):
        part = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * rows_per_class rows of two numbers: small by its limit. The fit runs in one task over as many texts.
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())]))
        model = fit_texts(got["text"], got["toxic"].to_numpy().astype(int), prior=prior)
        used = np.flatnonzero(model.weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([used.tobytes()], pa.binary()), pa.array([model.weights[used].tobytes()], pa.binary())], names=["bias", "used", "weights"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    row = sample.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(run, "bias double, used binary, weights binary").first()
    if row is None:  # no row of documents has a usable label
        return fit_texts([], np.zeros(0, int))
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(row.used, np.int32)] = np.frombuffer(row.weights, np.float32)
    return Model(weights, row.bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, spans: bool = True) -> DataFrame:
    """docs (doc_id, text) with score, predicted and the offending sentences as (start, end, score), in bytes of the text."""
    C.bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cut = np.log(threshold / (1 - threshold))
        for batch in batches:
            scores, found = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for at, to, data, offsets in C.steps(batch.column("text")):
                doc, start, end, z = m.sentences(data, offsets)
                scores[at:to] = -np.expm1(-np.bincount(doc, np.logaddexp(0, z), to - at))
                for i in np.flatnonzero(z >= cut) if spans else ():
                    found[at + doc[i]].append({"start": int(start[i] - offsets[doc[i]]), "end": int(end[i] - offsets[doc[i]]), "score": float(1 / (1 + np.exp(-z[i])))})
            scores = np.clip(scores, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(found, out.field("offending").type)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the toxic ones; all columns and all other rows stay as they are."""
    C.bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, to, data, offsets in C.steps(batch.column("text")):
                keep[at:to] = shared.value.scores(data, offsets) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
