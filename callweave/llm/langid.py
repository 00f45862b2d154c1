"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters are lower-cased (A-Z), all other ASCII becomes a space. Its subwords are the runs of 3 and 4 bytes with
no space but at their ends; each has one of BUCKETS embeddings. The average goes through a linear layer to a softmax.
Both are trained by stochastic gradient descent in numpy. As average and layer are linear, embeddings times layer is one
table of logits for each subword, so a text's score is the mean of table rows.

Training rows have a lang and a doc_id whose crc32 (as text) leaves no HELD remainder by FOLDS; of those with
a text the SAMPLE least by a hash of doc_id, as many as fit into BYTES together. A tenth of them is not trained on; it sets the temperature of the
softmax and the least score that is not rejected (the REJECT quantile of right answers' scores). A text without a letter
is `und` with score 0 and rejected; so is every text if there are no training rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ship, utf8
from .quality import held_out, sampled

BITS, WIDTH = 15, 16
BUCKETS = 1 << BITS
ORDERS = (3, 4)
FOLDS, HELD = 3, 1
SAMPLE, BYTES = 3000, 16 << 20
PASSES, RATE = 3, 2.0
REJECT = 0.01
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in bytes(range(256)).lower())


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode(errors="replace"))


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword numbers of all texts joined, and how many each text has."""
    clean = [b" %b " % b" ".join(t.translate(TABLE).split()) for t in texts]
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    data = np.frombuffer(b"".join(clean), np.uint8)
    inner = data != 32
    owner = np.repeat(np.arange(len(clean)), sizes)
    numbers, owners = [], []
    code = data.astype(np.uint64)
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        gram = np.full(m, n, np.uint64)
        ok = owner[:m] == owner[n - 1 :]
        for j in range(n):
            gram = gram << np.uint64(8) | code[j : j + m]
            if 0 < j < n - 1:
                ok &= inner[j : j + m]
        at = np.flatnonzero(ok)
        numbers.append((gram[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
        owners.append(owner[at])
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    order = np.argsort(np.concatenate(owners), kind="stable") if len(texts) > 1 else slice(None)
    return np.concatenate(numbers)[order].astype(np.int64), np.bincount(np.concatenate(owners), minlength=len(texts))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def raw(self, texts: list[bytes]) -> np.ndarray:
        at, counts = subwords(texts)
        starts = np.minimum(np.cumsum(counts) - counts, len(at))
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            column = np.ascontiguousarray(self.logits[:, k])
            out[:, k] = np.add.reduceat(np.append(column[at], np.float32(0)), starts, dtype=np.float64)
        out[counts == 0] = 0
        return out / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = _softmax(self.raw(texts) / self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(texts)), best]
        known = np.array([has_letter(t) for t in texts], bool)
        score[~known] = 0
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)], score


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], passes: int = PASSES, seed: int = 1) -> Model:
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    rows = []
    for t in texts:
        own, times = np.unique(subwords([t])[0], return_counts=True)
        rows.append((own, times / max(1, times.sum())))
    n_fit = max(1, len(rows) * 9 // 10)
    for step in range(passes):
        rate = RATE * (1 - step / passes)
        for i in rng.permutation(n_fit):
            at, x = rows[i]
            mean = x @ embed[at]
            g = _softmax((mean @ layer + bias)[None])[0]
            g[y[i]] -= 1
            embed[at] -= rate * np.outer(x, layer @ g)
            layer -= rate * np.outer(mean, g)
            bias -= 0.1 * rate * g
    model = Model(languages, (embed @ layer).astype(np.float32), bias)
    rest = range(n_fit, len(rows)) if n_fit < len(rows) else range(len(rows))
    raw, truth = model.raw([texts[i] for i in rest]), y[list(rest)]
    loss = {t: -np.log(_softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(raw / model.temperature)
    right = p.argmax(axis=1) == truth
    model.least = float(np.quantile(p.max(axis=1)[right], REJECT)) if right.any() else 0.0
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Train on docs (doc_id, text, lang): on sample rows and most bytes of text at most."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(FOLDS, HELD))
    own = known.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("t"), F.col("lang").cast("string").alias("y"))
    rows = sampled(own.where(F.octet_length("t") > 0), sample, most)
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    return train([bytes(r["t"]) for r in rows], [r["y"] for r in rows])


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each of docs (doc_id, text; lang to train on)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs))  # a few MB, whatever the input

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "t", 1 << 20):
            langs, score = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    least = shared.value.least
    return out.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "lang_pred", "score", ((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).alias("rejected"))


__all__ = ["Model", "fit", "has_letter", "identified", "subwords", "train"]
