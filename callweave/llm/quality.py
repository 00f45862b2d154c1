"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, and runs of other characters between spaces, as they are; a word that repeats the
one before it, or the one two before, is one of two marker words, whichever word it is. Unigrams and bigrams are hashed
to DIM weights; a text's value for a feature is its count over the square root of the text's words, so a score is a sum
of weights over occurrences: a sparse dot product without a sort.

Training rows are the labelled rows whose doc_id's crc32 (as text) leaves no HELD remainder by FOLDS; of those that
are there, whatever their length, the SAMPLE least by a hash of doc_id, as many as fit into BYTES together. Passes over them are in an order drawn from a fixed seed. One FTRL
step takes one row. The intercept alone scores texts without words, null ones too. With no training rows all scores are
0.5, and `accepted` keeps all rows; with repeated doc_ids each text counts once. Repeated label rows of one doc_id that agree count once; contradictory ones
both count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import batches, filtered, ship, utf8
from .words import hashes, runs

BITS = 20
DIM = 1 << BITS
FOLDS, HELD = 4, 2
SAMPLE, BYTES = 6000, 32 << 20
PASSES = 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.1
THRESHOLD = 0.7
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts joined, and how many each text has."""
    words = [_WORD.findall(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    h = hashes(words, int(counts.sum()))
    first = np.cumsum(counts) - counts
    place = np.arange(len(h)) - np.repeat(first, counts)
    marked = h.copy()
    for lag in (2, 1):  # two before: a word that goes on with a sign between
        if len(h) > lag:
            same = h[lag:] == h[:-lag]
            marked[lag:][same & (place[lag:] >= lag)] = lag
    h = marked
    one = runs(h, 1)
    two = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        two[:-1] = runs(h, 2)
    last = np.cumsum(counts)[counts > 0] - 1
    two[last] = one[last] ^ np.uint64(1 << 63)  # a text's last word stands for the bigram it has not
    both = np.empty(2 * len(h), np.uint64)
    both[::2], both[1::2] = one, two
    return (both >> np.uint64(64 - BITS)).astype(np.int64), 2 * counts


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        at, counts = features(texts)
        sums = np.add.reduceat(np.append(self.weights[at], np.float32(0)).astype(np.float64), np.minimum(np.cumsum(counts) - counts, len(at)))
        sums[counts == 0] = 0
        return 1 / (1 + np.exp(-np.clip(self.intercept + sums / np.sqrt(np.maximum(counts, 1)), -35, 35)))


def train(texts: list[bytes], labels: np.ndarray, passes: int = PASSES, seed: int = 1) -> Model:
    """FTRL-proximal, one row a step."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    rows = []
    for t in texts:
        at, count = features([t])
        own, times = np.unique(at, return_counts=True)
        rows.append((np.append(own, DIM), np.append(times / np.sqrt(max(1, int(count[0]))), 1.0)))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = _weights(z, n)
    return Model(w[:DIM].astype(np.float32), float(w[DIM]))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def held_out(folds: int, held: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))


def sampled(texts: DataFrame, sample: int, most: int, labels: DataFrame | None = None) -> list[Row]:
    """t and y of sample rows of texts (id, t, and y unless labels have it: id, y) at most, by a hash of id; of texts with most bytes together at most."""
    keys = texts.select(*(c for c in texts.columns if c != "t"), F.octet_length("t").alias("n"), F.xxhash64("t").alias("h"))
    keys = (keys.join(labels, "id") if labels is not None else keys).select("id", "y", "h", "n").distinct()
    taken = []
    for r in keys.orderBy(F.xxhash64("id"), "id", "y", "n", "h").limit(sample).collect():
        if r["n"] <= most:
            most -= r["n"]
            taken.append((r["id"], r["y"], r["h"]))
    # sample rows at most: they can be broadcast, so that no text is moved but the sample's
    some = F.broadcast(texts.sparkSession.createDataFrame(taken, keys.select("id", "y", "h").schema))
    own = texts.withColumn("h", F.xxhash64("t")).join(some, [c for c in ("id", "y", "h") if c in texts.columns or c == "h"])
    return own.dropDuplicates(["id", "y", "h"]).orderBy(F.xxhash64("id"), "id", "y", "t").select("t", "y").collect()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Train on docs (doc_id, text) with labels (doc_id, quality): on sample rows and most bytes of text at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(FOLDS, HELD))
    known = known.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).distinct()
    rows = sampled(docs.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("t")), sample, most, known)
    if not rows:
        return Model(np.zeros(DIM, np.float32), 0.0)
    return train([bytes(r["t"]) for r in rows], np.array([r["y"] for r in rows], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # DIM weights, whatever the input

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns; all rows if nothing could be learnt."""
    model = fit(docs, labels)
    if not model.weights.any() and not model.intercept:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: shared.value.scores(texts) >= threshold)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) for each of docs (doc_id, text)."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


__all__ = ["Model", "accepted", "features", "fit", "held_out", "quality", "sampled", "scored", "train"]
