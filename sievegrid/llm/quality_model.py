"""Quality by Bradley-Terry ranking: from pairs of a better and a worse document, weights such that
P(better wins) = sigmoid(w . (x_better - x_worse)). A cut at a quantile of the scores separates what to keep.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import bounded_batches, dealt, id_and_text, labelled, quantiles, stored

#: Labelled rows that learn together in one task; preference pairs drawn for each row of this number.
SHARD_ROWS, PAIRS_A_ROW = 12_000, 5
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@+]")
_LETTERS = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞЀ-Я]")
_DIGITS = re.compile(r"\d")
FEATURES = ("symbols", "exclamations", "bars", "upper", "digits", "letters", "word_length", "long_words", "repeated_lines", "repeated_words", "repeated_neighbours", "top_word", "log_words", "few_words", "sentence_marks", "words_a_line")


def features(text: str) -> list[float]:
    """Of a whole text, in the order of FEATURES; shares lie between 0 and 1."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 12 + [0.0, 1.0, 0.0, 0.0]
    lines = [line for line in text.split("\n") if line.strip()]
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    symbols = len(_SYMBOLS.findall(text))
    letters = len(_LETTERS.findall(text))
    return [
        min(1.0, symbols / n),
        min(1.0, text.count("!") / n),
        min(1.0, text.count("|") / n),
        len(_UPPER.findall(text)) / max(1, letters),
        len(_DIGITS.findall(text)) / chars,
        letters / chars,
        min(1.0, sum(map(len, words)) / n / 20),
        sum(len(w) > 25 for w in counts) / len(counts),
        1 - len(set(lines)) / len(lines),
        1 - len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(counts.values()) / n if n >= 20 else 0.0,
        min(1.0, np.log1p(n) / 10),
        float(n < 10),
        min(1.0, (text.count(".") + text.count("?")) / n),
        min(1.0, n / len(lines) / 100),
    ]


def expanded(rows: np.ndarray) -> np.ndarray:
    """Each feature and its square root: the first step away from 0 counts most for the shares."""
    return np.hstack([rows, np.sqrt(rows)])


@dataclass(frozen=True)
class Ranking:
    """weights and scale of the features; cut: the raw score that the calibrated score `at` stands for."""

    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    cut: float
    spread: float
    at: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return ((expanded(rows) - self.mean) / self.deviation) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        logit = np.log(self.at / (1 - self.at)) + (self.raw(rows) - self.cut) / self.spread
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _featured(docs: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """columns of docs and `features` of the column text, which is the last."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], [*columns, "features"])

    return docs.select(*columns, "text").mapInArrow(rows, f"{schema}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", at: float = 0.3, shard_rows: int = SHARD_ROWS) -> Ranking:
    """Learns from all labelled documents.

    Their rows are dealt by hash to shards of about `shard_rows`, which draw pairs and learn weights each in its task; the
    weights are the mean of those of the shards, by their rows. Scaling and cut are those of all rows: the cut lies at the quantile
    of the raw scores that equals the share of label 0; the calibrated score there is `at`. Features of whole texts
    are taken in Spark. Null texts count as empty; ids without a document, null ids and null labels are left out; of an id labelled
    more than once the larger label counts, and repeated rows of an id count each. Without rows of both classes
    every score is 0.5. The driver gets sums, counts and 2 * len(FEATURES) weights a shard.
    """
    rows = stored(_featured(labelled(docs, labels, label_col, id_col, text_col), ["doc_id", "label"], "doc_id long, label int"), "features")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return _untaught()
    each = [F.get("features", F.lit(i)) for i in range(len(FEATURES))]
    each += [F.sqrt(c) for c in each]
    moments = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean, deviation = np.array(moments[: len(each)]), np.array(moments[len(each) :]) + 1e-9

    def learn(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(features=[tuple(f) for f in shard["features"]]).sort_values(["doc_id", "label", "features"])
        z = (expanded(np.array(shard["features"].tolist(), float)) - mean) / deviation
        w = weights(shard["label"].to_numpy(np.int64), z, PAIRS_A_ROW * shard_rows, seed=11 + key[0])
        return pd.DataFrame({"shard": [key[0]], "rows": [len(shard)], "weights": [w]})

    learnt = dealt(rows, sizes, shard_rows).groupBy("shard").applyInPandas(learn, "shard int, rows long, weights array<double>")
    found = sorted(learnt.collect(), key=lambda r: r["shard"])
    w = np.average([r["weights"] for r in found], axis=0, weights=[r["rows"] for r in found])
    ranking = Ranking(w, mean, deviation, 0.0, 1.0, at)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.raw(got), pa.float64())], ["label", "raw"])

    scored = stored(rows.select("label", "features").mapInArrow(raw, "label int, raw double"), "raw-scores")
    n = sum(sizes.values())
    cut = float(np.mean(quantiles(scored, "raw", n, _cut_shares(sizes[0] / n))))
    (high,) = quantiles(scored.where("label = 1"), "raw", sizes[1], [0.5])
    return Ranking(w, mean, deviation, cut, float(max(high - cut, 1e-6) / 4), at)


def _untaught() -> Ranking:
    width = 2 * len(FEATURES)
    return Ranking(np.zeros(width), np.zeros(width), np.ones(width), 0.0, 1.0, 0.5)


def _cut_shares(share: float) -> list[float]:
    """Around the quantile that has as many scores below it as documents are labelled 0, a margin of 2 % of either class."""
    return [0.98 * share, share + 0.02 * (1 - share)]


def weights(labels: np.ndarray, x: np.ndarray, pairs: int, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> np.ndarray:
    """Adagrad on the logistic loss of the differences of random pairs of the scaled rows x, one of either label each."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    random = np.random.default_rng(seed)
    difference = x[random.choice(good, pairs)] - x[random.choice(bad, pairs)]
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    for _ in range(epochs):
        order = random.permutation(pairs)
        for i in range(0, pairs, 256):
            d = difference[order[i : i + 256]]
            lose = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope = decay * w - (lose[:, None] * d).mean(0)
            seen += slope**2
            w -= rate * slope / np.sqrt(seen)
    return w


def train(labels: np.ndarray, rows: np.ndarray, at: float = 0.3, pairs: int = PAIRS_A_ROW * SHARD_ROWS, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> Ranking:
    """The ranking that fit() learns from a single shard, from rows at hand."""
    x = expanded(rows)
    if not (labels == 1).any() or not (labels == 0).any():
        return _untaught()
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    x = (x - mean) / deviation
    w = weights(labels, x, pairs, epochs, rate, decay, seed)
    raw = x @ w
    cut = np.quantile(raw, _cut_shares((labels == 0).mean())).mean()
    high = np.median(raw[labels == 1])
    return Ranking(w, mean, deviation, float(cut), float(max(high - cut, 1e-6) / 4), at)


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the calibrated score, 0 to 1, of every whole text.

    Null and empty texts are scored as texts without words. Rows without an id and repeated rows are scored like
    others; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(ranking)  # 2 * len(FEATURES) weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(got), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, score double")


def keep(docs: DataFrame, ranking: Ranking, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns; cases as in score()."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(ranking)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.value.scores(got) >= least))

    return docs.mapInArrow(rows, docs.schema)
