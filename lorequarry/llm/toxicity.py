"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of n-grams of letters within and around words. Each is scaled by the logarithm of the ratio of
its smoothed shares in toxic and other documents, and a logistic regression with an L2 penalty weighs the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .ngrams import Grams, chunks, pieces
from .workspace import Workspace

LENGTHS = (4, 5, 6)
BITS = 20
#: The classifier is fitted on at most about this many labelled documents of each class.
SAMPLE_DOCS = 4000
#: The features with the most telling ratios that are kept, and the documents that must have one. This is the model's
#: regularisation as well: without it the README's held-out figures are far lower.
FEATURES, MIN_DOCS = 8192, 4
#: What the penalty of the weights is weighed against.
COST = 1.0
HELD_OUT, FOLDS = 0, 5


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def present(texts: list[str], keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The feature numbers that occur in each text, once each, ascending; only those marked in ``keep``."""
    for a, b in chunks(texts):
        g = Grams(texts[a:b], max(LENGTHS))
        doc = np.repeat(np.arange(b - a, dtype=np.int64) << BITS, g.lengths)
        real, found = g.real(), []
        for n in LENGTHS:
            idx = g.hashed(n, BITS)
            at = np.flatnonzero(real & keep.take(idx) if keep is not None else real)
            found.append(doc[at] | idx[at])
        found = np.unique(np.concatenate(found))
        yield from np.split(found & ((1 << BITS) - 1), np.searchsorted(found, np.arange(1, b - a, dtype=np.int64) << BITS))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for part in pieces(batch, 128):
            labels = part.column("label").to_pylist()
            for label, idx in zip(labels, present([t or "" for t in part.column("text").to_pylist()]), strict=True):
                counts[label, idx] += 1
    at = np.flatnonzero(counts.sum(0))
    for i in range(0, len(at), 50_000):
        k = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[0, k]), pa.array(counts[1, k])], names=["f", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    A document labelled twice is toxic if one label says so; null labels are left out. Of each class those documents
    are used whose ids hash lowest, about ``sample_docs``. Without both classes, every score is the share of label 1.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    prior = float(np.clip(np.log((n1 + 1e-3) / (n0 + 1e-3)), -12, 12)) if n0 + n1 else -12.0
    none = Model(np.zeros(1 << BITS, np.float32), prior)
    if not n0 or not n1:
        return none
    h = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("label") == 1, min(1.0, sample_docs / n1)).otherwise(min(1.0, sample_docs / n0))
    chosen = ws.save(labels.where(h <= rate), "chosen")  # about 2 * sample_docs rows of two numbers, so it may be broadcast
    sample = ws.save(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), "sample")
    have = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        return none
    counts = sample.mapInArrow(_count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_DOCS)
    ratio = F.log((F.col("n1") + 1.0) / (have[1] + 2.0)) - F.log((F.col("n0") + 1.0) / (have[0] + 2.0))
    counts = counts.withColumn("ratio", ratio).withColumn("z", F.abs("ratio") / F.sqrt(1 / (F.col("n0") + 1.0) + 1 / (F.col("n1") + 1.0)))
    top = counts.orderBy(F.desc("z"), "f").limit(FEATURES).select("f", "ratio").toArrow()
    if not top.num_rows:
        return none
    scale = np.zeros(1 << BITS)
    scale[top["f"].to_numpy()] = top["ratio"].to_numpy()
    keep = scale != 0

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 128):
                idx = [x.astype(np.int32) for x in present([t or "" for t in part.column("text").to_pylist()], keep)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label"), pa.array(idx, pa.list_(pa.int32()))], names=["doc_id", "label", "idx"])

    got = sample.mapInArrow(hits, "doc_id long, label int, idx array<int>").toArrow().sort_by("doc_id")  # the result doesn't hang on how tasks returned it
    y = np.where(got["label"].to_numpy() == 1, 1.0, -1.0)
    lists = got["idx"].combine_chunks()
    rows = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    w, b = logistic(rows, scale, y)
    b += prior - float(np.log(have[1] / have[0]))
    return Model((w * scale).astype(np.float32), b)


def logistic(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by coordinate descent on its dual: a document's weight a in (0, cost) is moved
    to where the derivative is zero, by Newton's steps in that one variable. ``rows`` holds the features of each document."""
    values = [scale[x] for x in rows]
    norm = [float(v @ v) + 1.0 for v in values]
    a = np.full(len(rows), 1e-3 * cost)
    w, b = np.zeros(len(scale)), float(a @ y)
    for x, v, t in zip(rows, values, a * y, strict=True):
        w[x] += t * v
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            margin, z = y[i] * (w[x] @ v + b), a[i]
            for _ in range(20):
                slope = norm[i] * (z - a[i]) + margin + np.log(z / (cost - z))
                new = z - slope / (norm[i] + cost / (z * (cost - z)))
                new = z / 10 if new <= 0 else cost - (cost - z) / 10 if new >= cost else new
                z, step = new, abs(new - z)
                if step <= 1e-9 * cost:
                    break
            move = (z - a[i]) * y[i]
            w[x] += move * v
            b += move
            most, a[i] = max(most, abs(move)), z
        if most < 1e-3 * cost:
            break
    return w, b


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    keep = model.weights != 0
    z = np.array([float(model.weights[idx].sum(dtype=np.float64)) for idx in present([t or "" for t in texts], keep)])
    return 1 / (1 + np.exp(-np.clip(z + model.bias, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, score``, a row per input row; only the text is looked at.

    A null text is an empty one, whose score is that of no feature. Repeated rows get equal scores. An empty table gives
    an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(model, part.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def training_rows(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
