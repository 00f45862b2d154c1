"""Stupid-backoff scores of documents under a bigram model of the corpus.

The count tables of unigrams and bigrams are partitioned by hash, and documents' n-grams are joined to them, by the packed
questions of `packed`: a slice of documents asks each hash partition for the corpus counts of its distinct n-grams, with
its own counts of them; a partition adds up the counts of all slices and answers. A slice then scores each of its words:

  S(w | v) = c(v w) / c(v)  if c(v w) >= least,  else  backoff * c(w) / N.

A word without one before it in its document is scored by its unigram alone. A document's score is the sum of ln S over its words, each rounded to
UNITS of a nat, so that sums do not depend on any order; perplexity is exp(-score / words).

Words are runs of bytes other than 9 to 13 and 32, A-Z lower-cased. Null texts and texts without words have score 0 and
no perplexity. Rows of equal doc_id are documents of their own. A very long text is a slice of its own, held whole by one
worker. No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import BLOB_ROWS, batched, mix, stored
from .words import hashes, runs, split

LEAST, BACKOFF = 2, 0.4
#: Units of a nat.
UNITS = 1_000_000
_LOWER = bytes(range(256)).lower()
#: What is counted: words and pairs.
_KINDS = tuple(np.uint64(x) for x in (0x6A09E667F3BCC908, 0x3C6EF372FE94F82B))


def _grams(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: words in each text; for each word the hashes of the word and of the pair with the word before (for a text's first word: unused)."""
    words, counts = split(packed.texts_of(row), _LOWER)
    h = hashes(words, int(counts.sum()))
    one, pair = mix(h ^ _KINDS[0]), np.zeros(len(h), np.uint64)
    if len(h) > 1:
        pair[1:] = mix(runs(h, 2) ^ _KINDS[1])
    return counts, one, pair


def _follows(counts: np.ndarray) -> np.ndarray:
    """Which words have one before them in their text."""
    out = np.ones(int(counts.sum()), bool)
    out[(np.cumsum(counts) - counts)[counts > 0]] = False
    return out


def _coded(n: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for one that follows behind, as a long."""
    large = n >= 255
    return np.where(large, 255, n).astype(np.uint8).tobytes() + n[large].astype("<i8").tobytes()


def _uncoded(data: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", offset=size)
    return n


def _asked(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of a slice, ascending, and its counts of them."""
    counts, one, pair = _grams(row)
    return np.unique(np.concatenate((one, pair[_follows(counts)])), return_counts=True)


def counted(slices: packed.Slices, parts: int) -> DataFrame:
    """Answers: the corpus counts of a slice's distinct n-grams, in the order of their hashes."""

    def ask(row: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        keys, n = _asked(row)
        for p, a, b in packed.cut(keys, parts):
            yield p, np.array([b - a], "<i8").tobytes() + packed.stripped(keys[a:b]) + _coded(n[a:b])

    def answer(part: int, numbers: list[int], questions: list[bytes]) -> Iterator[tuple[int, bytes]]:
        sizes = [int(np.frombuffer(q, "<i8", 1)[0]) for q in questions]
        keys = np.concatenate([packed.unstripped(q[8:], s) for q, s in zip(questions, sizes, strict=True)])
        n = np.concatenate([_uncoded(q[8 + 7 * s :], s) for q, s in zip(questions, sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(keys))))
        at = 0
        for number, size in zip(numbers, sizes, strict=True):
            yield number, _coded(total[at : at + size])
            at += size

    return packed.answered(slices, packed.asked(slices.frame, ask), answer)


def scored(docs: DataFrame, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, n_backoff (words scored by their unigram), log_score, perplexity for each of docs (doc_id, text)."""
    slices = packed.sliced(docs)
    # about two distinct n-grams of a slice for each nine bytes
    parts = slices.partitions(entry_bytes=4)
    answers = counted(slices, parts)

    def sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = [int(split(packed.texts_of(b.slice(i, 1)), _LOWER)[1].sum()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    with batched(docs.sparkSession, BLOB_ROWS):
        total = slices.frame.select("lengths", "texts").mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                counts, one, pair = _grams(row)
                keys, own = _asked(row)
                of = np.zeros(len(keys), np.int64)
                got = {a["part"]: a["answer"] for a in row.column(row.schema.get_field_index("answers"))[0].as_py() or ()}
                for p, lo, hi in packed.cut(keys, parts):
                    of[lo:hi] = _uncoded(got[p], hi - lo)
                follows = _follows(counts)
                c_one = of[np.searchsorted(keys, one)]
                c_pair = np.zeros(len(one), np.int64)
                c_pair[follows] = of[np.searchsorted(keys, pair[follows])]
                c_before = np.concatenate(([1], c_one[:-1])) if len(one) else c_one
                known = c_pair >= least
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(known, c_pair / c_before, np.where(follows, backoff, 1.0) * c_one / max(total, 1))
                units = np.round(np.log(value) * UNITS).astype(np.int64)
                ends = np.cumsum(counts)
                sums = np.concatenate(([0], np.cumsum(units)))
                back = np.concatenate(([0], np.cumsum(~known)))
                score = (sums[ends] - sums[ends - counts]) / UNITS
                perplexity = np.exp(-score / np.maximum(counts, 1))
                columns = [packed.ids_of(row), pa.array(counts), pa.array(back[ends] - back[ends - counts]), pa.array(score), pa.array(perplexity, mask=counts == 0)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_backoff", "log_score", "perplexity"])

    out = packed.joined(slices.frame, answers).mapInArrow(run, "doc_id long, n_words long, n_backoff long, log_score double, perplexity double")
    return stored(out, "scores", BLOB_ROWS)[0]
