"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>) for the terms i, j that a text has: the pairs
let a term count for more, or less, in the company of another, which additive weights can't.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievegrid.llm.common import id_and_text, labelled_sample

#: Labelled rows that training takes at most, by the smallest hash of the id: more don't change the few thousand weights much.
SAMPLE_ROWS = 12_000
#: Hashed terms: words, and the first four letters of each.
BUCKETS = 1 << 18
#: A term takes part if so many sampled texts have it and it tells the classes apart, by itself (a z-score) or in the company
#: of another one (that of the interaction; pairs are many, so it must be higher). Weights go to MOST_TERMS at most, the best.
LEAST_TEXTS, MOST_TERMS, ALONE, TOGETHER = 5, 4096, 4.0, 6.0
#: Terms looked at in pairs: those whose presence divides the sampled texts most evenly.
PAIR_TERMS = 1024
FACTORS = 4
_WORDS = re.compile(r"[^\W\d_]+")
_KEPT = 500_000


@dataclass(frozen=True)
class Machine:
    """Weights by slot; `slots` holds the bucket of each, ascending."""

    slots: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """texts: the slots of each, without repeats."""
        ends = np.cumsum([0, *map(len, texts)])
        at = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64)
        group = np.repeat(np.arange(len(texts)), np.diff(ends))
        total = np.bincount(group, self.linear[at], len(texts)) + self.bias
        for v in self.factors.T:
            v = v[at]
            total += 0.5 * (np.bincount(group, v, len(texts)) ** 2 - np.bincount(group, v * v, len(texts)))
        return total


def term_buckets(word: str) -> tuple[int, int]:
    return zlib.crc32(b"w" + word.encode()) % BUCKETS, zlib.crc32(b"p" + word[:4].encode()) % BUCKETS


class Slots:
    """From texts to slots; words that come again are looked up (a bounded table per task)."""

    def __init__(self, slots: np.ndarray | None):
        self.slot_of = None if slots is None else {int(b): i for i, b in enumerate(slots)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = set(_WORDS.findall(text.lower()))
        if len(self.known) > _KEPT:
            self.known.clear()
        for word in words.difference(self.known):
            buckets = term_buckets(word)
            self.known[word] = buckets if self.slot_of is None else tuple(self.slot_of[b] for b in buckets if b in self.slot_of)
        return np.array(sorted({slot for word in words for slot in self.known[word]}), np.int64)


@dataclass(frozen=True)
class Terms:
    """Which terms take part: see LEAST_TEXTS, MOST_TERMS, ALONE, TOGETHER and PAIR_TERMS. With alone and together at 0, and most and
    pairs at BUCKETS, all do that least_texts have."""

    least_texts: int = LEAST_TEXTS
    most: int = MOST_TERMS
    alone: float = ALONE
    together: float = TOGETHER
    pairs: int = PAIR_TERMS


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, which: Terms = Terms()) -> Machine:
    """Learns from the documents of at most `sample_rows` labelled ids.

    Terms of whole texts are taken in Spark; the driver gets their bucket numbers only. Null texts have no terms; ids
    without a document, null ids and null labels are left out; of an id labelled more than once the larger label
    counts, and repeated rows of an id count each. Without rows of both classes every score is 0.5.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(None)
        for batch in batches:
            found = [slots(t).astype(np.int32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["label", "terms"])

    sample = labelled_sample(docs, labels, label_col, id_col, text_col, sample_rows)
    got = sample.select("text", "label").mapInArrow(terms, "label int, terms binary").toPandas()
    return train(got["label"].to_numpy(np.int64), [np.frombuffer(t, np.int32) for t in got["terms"]], which=which)


def interactions(labels: np.ndarray, texts: list[np.ndarray], terms: np.ndarray, least_texts: int = LEAST_TEXTS) -> np.ndarray:
    """Of each term the largest z-score of an interaction with another of `terms`: how far the rate of positives among
    texts with both is from what either alone changes, (both - one) - (other - neither)."""
    place = np.full(BUCKETS, -1)
    place[terms] = np.arange(len(terms))
    x = np.zeros((len(texts), len(terms)), np.float32)
    for row, t in zip(x, texts, strict=True):
        t = place[t]
        row[t[t >= 0]] = 1
    y = labels.astype(np.float32)
    both, both_positive = x.T @ x, (x * y[:, None]).T @ x
    have, have_positive = np.diag(both), np.diag(both_positive)
    n, positive = float(len(texts)), float(y.sum())
    cells = (
        (both, both_positive),
        (have[:, None] - both, have_positive[:, None] - both_positive),
        (have[None, :] - both, have_positive[None, :] - both_positive),
        (n - have[:, None] - have[None, :] + both, positive - have_positive[:, None] - have_positive[None, :] + both_positive),
    )
    rates = [(k + 0.5) / (m + 1) for m, k in cells]
    error = np.sqrt(sum(p * (1 - p) / (m + 1) for p, (m, _) in zip(rates, cells, strict=True)))
    z = np.abs(rates[0] - rates[1] - rates[2] + rates[3]) / error
    z[np.min([m for m, _ in cells], axis=0) < least_texts] = 0
    return z.max(1, initial=0)


def chosen_terms(labels: np.ndarray, texts: list[np.ndarray], which: Terms = Terms()) -> np.ndarray:
    """Buckets of the terms that take part, ascending."""
    n, positives = len(labels), int(labels.sum())
    have = np.bincount(np.concatenate(texts), minlength=BUCKETS)
    have_positive = np.bincount(np.concatenate([t for t, y in zip(texts, labels, strict=True) if y]), minlength=BUCKETS)
    p, q, mean = have_positive / positives, (have - have_positive) / (n - positives), have / n
    z = np.abs(p - q) / np.sqrt(mean * (1 - mean) * (1 / positives + 1 / (n - positives)) + 1e-12) / max(which.alone, 1e-9)
    even = np.minimum(have, n - have)
    looked = np.argsort(-even, kind="stable")[: which.pairs]
    looked = looked[even[looked] >= which.least_texts]
    z[looked] = np.maximum(z[looked], interactions(labels, texts, looked, which.least_texts) / max(which.together, 1e-9))
    z[(have < which.least_texts) | (z < 1)] = 0
    return np.sort(np.argsort(-z, kind="stable")[: min(which.most, int((z > 0).sum()))])


def train(labels: np.ndarray, texts: list[np.ndarray], factors: int = FACTORS, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, most_dropped: float = 0.8, seed: int = 7, which: Terms = Terms()) -> Machine:
    """Logistic loss, balanced classes, Adagrad over shuffled mini-batches of 64 texts."""
    n, positives = len(labels), int(labels.sum())
    if not positives or positives == n:
        return Machine(np.empty(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)))
    slots = chosen_terms(labels, texts, which)
    slot_of = np.full(BUCKETS, -1)
    slot_of[slots] = np.arange(len(slots))
    rows = [s[s >= 0] for s in (slot_of[t] for t in texts)]

    random = np.random.default_rng(seed)
    bias, linear, v = 0.0, np.zeros(len(slots)), random.normal(0, 0.01, (len(slots), factors))
    seen_bias, seen_linear, seen_v = 1e-6, np.full(len(slots), 1e-6), np.full((len(slots), factors), 1e-6)
    weight = np.where(labels == 1, n / (2 * positives), n / (2 * (n - positives)))
    for epoch in range(epochs):
        drop = most_dropped * (1 - epoch / (epochs - 1))
        order = random.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            # terms are left out at random, fewer in each epoch: one insult among many must count by itself
            held = [rows[i][random.random(len(rows[i])) >= drop] for i in batch]
            flat = np.concatenate(held)
            group = np.repeat(np.arange(len(batch)), [len(h) for h in held])
            sums = np.stack([np.bincount(group, v[flat, k], len(batch)) for k in range(factors)], 1)
            logit = bias + np.bincount(group, linear[flat], len(batch)) + 0.5 * (sums**2).sum(1) - 0.5 * np.bincount(group, (v[flat] ** 2).sum(1), len(batch))
            slope = weight[batch] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)
            touched, inverse = np.unique(flat, return_inverse=True)
            d_linear = np.bincount(inverse, slope[group], len(touched)) + decay * linear[touched]
            d_v = np.stack([np.bincount(inverse, slope[group] * (sums[group, k] - v[flat, k]), len(touched)) for k in range(factors)], 1) + decay * v[touched]
            seen_linear[touched] += d_linear**2
            seen_v[touched] += d_v**2
            seen_bias += slope.sum() ** 2
            linear[touched] -= rate * d_linear / np.sqrt(seen_linear[touched])
            v[touched] -= 0.3 * rate * d_v / np.sqrt(seen_v[touched])
            bias -= rate * slope.sum() / np.sqrt(seen_bias)
    return Machine(slots, float(bias), linear, v)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the score, 0 to 1, of every whole text.

    Null and empty texts get the score of a text without known terms. Rows without an id and repeated rows are
    scored like others; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # at most MOST_TERMS rows of weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(model.value.slots)
        for batch in batches:
            logits = model.value.logits([slots(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, score double")
