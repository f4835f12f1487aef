"""Quality: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of characters and words (symbols, capitals, digits, repetition and so on) of the
line itself and of its neighbours.  Labels exist for documents only, so training alternates: lines of good
documents are good; of a bad document, the lines that the model so far thinks bad, and at least the worst
one, are bad; then the field is fitted again.  A document's quality is the mean of the forward-backward
marginals of "good", weighted by the lines' lengths; a logistic curve fitted on training documents turns it
into the probability of label 1.

Defined cases: null or empty text is one empty line and gets that line's score; labels other than 0 and 1,
and labelled ids without a document, are not used; with labels of one kind, or none, the score is their
smoothed share; equal rows get equal scores; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import LOWER, UPPER, held_out, table, text_of
from tremorlake.llm.labelled import fit_logistic, sigmoid, training_rows

#: Largest number of labelled rows that the model is fitted on; their texts are whole.
SAMPLE_ROWS = 4_000
THRESHOLD = 0.3
ROUNDS = 3

UPPER_B, LETTERS_B, DIGITS_B = UPPER.encode(), (UPPER + LOWER).encode(), b"0123456789"
PUNCTUATION_B = b".,;:'\"()-"
SPACE_B = b" \t\n\x0b\x0c\r"
SYMBOLS_B = bytes(c for c in range(33, 127) if c not in LETTERS_B + DIGITS_B + PUNCTUATION_B)
OWN = 14


def line_features(line: str) -> list[float]:
    raw = line.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    if not words:
        return [1.0] + [0.0] * (OWN - 1)
    count = lambda chars: n - len(raw.translate(None, chars))
    k, distinct = len(words), len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters, upper, digits, symbols = count(LETTERS_B), count(UPPER_B), count(DIGITS_B), count(SYMBOLS_B)
    return [
        0.0,
        symbols / n,
        min(1.0, symbols / k),
        upper / max(1, letters),
        float(letters > 0 and upper > 0.6 * letters),
        digits / n,
        1 - distinct / k if k > 3 else 0.0,
        again / k,
        raw.count(b"|") / k,
        raw.count(b"!") / k,
        min(2.0, n / k / 8),
        math.log1p(k) / 4,
        float(raw.rstrip()[-1:] in b".!?"),
        float(k < 4),
    ]


def own_features(lines: list[str]) -> np.ndarray:
    return np.array([line_features(x) for x in lines])


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, the mean of both neighbours' and the differences from it, and a constant."""
    before, after = np.vstack([own[:1], own[:-1]]), np.vstack([own[1:], own[-1:]])
    near = (before + after) / 2
    return np.hstack([own, near, np.abs(own - near), np.ones((len(own), 1))])


WIDTH = 3 * OWN + 1


def lines_of(text: str) -> tuple[list[str], np.ndarray]:
    lines = text.split("\n")
    return lines, np.array([len(x) + 1.0 for x in lines])


@dataclass
class Field:
    """emission . features is the log odds of "good" against "bad"; pull[a, b] the worth of a before b."""

    emission: np.ndarray
    pull: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of every line by forward and backward passes over the odds."""
        odds = (x @ self.emission).clip(-30, 30)
        (bb, bg), (gb, gg) = np.exp(self.pull)
        n = len(odds)
        weight = np.exp(odds).tolist()
        forward, f = [0.0] * n, 0.5
        for i in range(n):
            good = weight[i] * ((1 - f) * bg + f * gg if i else 0.5)
            bad = (1 - f) * bb + f * gb if i else 0.5
            f = good / (good + bad)
            forward[i] = f
        out, b = np.empty(n), 0.5
        for i in range(n - 1, -1, -1):
            f = forward[i]
            p = f * b / (f * b + (1 - f) * (1 - b))
            out[i] = p
            good = weight[i] * b
            up_good, up_bad = gg * good + gb * (1 - b), bg * good + bb * (1 - b)
            b = up_good / (up_good + up_bad)
        return out

    def expectations(self, x: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Marginals and expected counts of the four transitions, of documents whose first lines are starts.

        All documents take a step together, the longest ones first, so the steps are as many as its lines."""
        starts = np.zeros(1, np.int64) if starts is None else starts
        sizes = np.diff(np.append(starts, len(x)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        odds = (x @ self.emission).clip(-30, 30)
        w = np.stack([np.ones_like(odds), np.exp(odds)], 1)
        t = np.exp(self.pull)
        going = [int(np.searchsorted(-sizes, -i, side="left")) for i in range(int(sizes[0]) + 1)]  # of more than i lines
        f, b = np.empty_like(w), np.ones_like(w)
        f[starts] = w[starts] / w[starts].sum(1, keepdims=True)
        for i in range(1, int(sizes[0])):
            at = starts[: going[i]] + i
            now = w[at] * (f[at - 1] @ t)
            f[at] = now / now.sum(1, keepdims=True)
        for i in range(int(sizes[0]) - 2, -1, -1):
            at = starts[: going[i + 1]] + i
            now = (w[at + 1] * b[at + 1]) @ t.T
            b[at] = now / now.sum(1, keepdims=True)
        p = f * b
        p = p[:, 1] / p.sum(1)
        # the pairwise marginal by the conditional of the chain, from the marginals on both sides
        later = np.ones(len(x), bool)
        later[starts] = False
        later = np.flatnonzero(later)
        pairs = np.zeros((2, 2))
        for k in range(0, len(later), 100_000):
            own = later[k : k + 100_000]
            joint = f[own - 1, :, None] * t[None] * (w[own] * b[own])[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        return p, pairs


def fit_field(x: np.ndarray, starts: np.ndarray, truth: np.ndarray, start: Field, penalty: float = 1.0, steps: int = 12) -> Field:
    """Conditional likelihood by gradient steps: the emissions by Newton's method, the transitions by their log counts' gap.

    x and truth: the lines of all documents, whose first ones are starts."""
    field = Field(fit_logistic(x[:, :-1], truth, penalty), start.pull.copy())
    later = np.ones(len(x), bool)
    later[starts] = False
    later = np.flatnonzero(later)
    want = np.full((2, 2), 1.0)
    np.add.at(want, (truth[later - 1].astype(int), truth[later].astype(int)), 1.0)
    for step in range(steps):
        p, pairs = field.expectations(x, starts)
        field.pull = (field.pull + 0.5 * np.log(want / (1.0 + pairs))).clip(-4, 4)
        field.pull -= field.pull.mean()
        field.emission = field.emission + (2.0 / (1 + step)) * ((truth - p) @ x - 0.01 * penalty * field.emission) / max(1, len(x))
    return field


def summarised(quality):
    return np.log((quality + 0.01) / (1.01 - quality))


@dataclass
class Model:
    field: Field | None
    curve: np.ndarray  # of (logit of quality, worst line's share), and the intercept

    def summary(self, text: str) -> list[float]:
        lines, lengths = lines_of(text)
        p = self.field.marginals(with_neighbours(own_features(lines)))
        return [float(summarised((p * lengths).sum() / lengths.sum()))]

    def scores(self, texts) -> np.ndarray:
        if self.field is None:
            return np.full(len(texts), float(sigmoid(self.curve[-1])))
        x = np.array([self.summary(t) for t in texts]).reshape(len(texts), 1)
        return sigmoid(x @ self.curve[:-1] + self.curve[-1])


def train(documents: list[np.ndarray], lengths: np.ndarray, labels: np.ndarray) -> Model:
    """documents: own features of all lines of each; lengths: of all their lines in a row."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = np.array([0.0, math.log(share / (1 - share))])
    if len(set(labels.tolist())) < 2:
        return Model(None, prior)
    sizes = np.array([len(d) for d in documents])
    starts = np.cumsum(sizes) - sizes
    x = np.empty((int(sizes.sum()), WIDTH))
    for s, d in zip(starts.tolist(), documents, strict=True):
        x[s : s + len(d)] = with_neighbours(d)
    good = np.repeat(labels.astype(float), sizes)
    field, truth = Field(np.zeros(WIDTH), np.zeros((2, 2))), good
    for _ in range(ROUNDS):
        field = fit_field(x, starts, truth, field)
        p, _ = field.expectations(x, starts)
        worst = np.maximum(0.5, np.repeat(np.minimum.reduceat(p, starts), sizes) + 1e-9)
        truth = np.where(good > 0, 1.0, (p >= worst).astype(float))
    model = Model(field, prior)
    quality = np.add.reduceat(p * lengths, starts) / np.add.reduceat(lengths, starts)
    model.curve = fit_logistic(summarised(quality)[:, None], labels.astype(float), 0.1)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    rows = training_rows(docs, labels, label, sample_rows, id_col, text_col)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, told, text in zip(batch["doc_id"], batch["label"], batch["text"], strict=True):
                each, lengths = lines_of(text)
                yield pd.DataFrame({"doc_id": [doc_id], "label": [told], "own": [own_features(each).tobytes()], "lengths": [lengths.tobytes()]})

    # features of whole texts travel to the driver, not the texts
    told = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInPandas(lines, "doc_id string, label int, own binary, lengths binary").toPandas()
    told = told.sort_values(["doc_id", "lengths", "own"], ignore_index=True)
    documents = [np.frombuffer(b, float).reshape(-1, OWN) for b in told["own"]]
    return train(documents, np.frombuffer(b"".join(told["lengths"]), float), told["label"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": model.scores(batch["text"].tolist())})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    told = rows.mapInPandas(run, "doc_id string, held_out boolean, score double")
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
