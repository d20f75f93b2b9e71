"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: rounds pass over the features, each fitting a shallow tree to the
gradient over the bins of one feature and adding it, shrunk, to that feature's lookup
table. Then the pairs of features whose joint bins explain most of what is left get
tables of their own. A document is scored by adding up table entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bicspark.llm.common import free_name, from_texts, in_share, labelled

#: At most so many labelled documents train the model.
TRAINING_ROWS = 20_000
#: Texts are taken to pieces of so many characters, so that features use bounded memory.
PIECE = 1 << 20
FEATURES = [
    "log_words", "word_length", "distinct_words", "top_word", "adjacent_repeats", "upper_letters",
    "upper_words", "digits", "symbols", "punctuation", "bangs", "bars", "line_length", "distinct_lines",
    "sentence_ends", "non_ascii",
]
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#$%&*+<=>@[\\]^_`{}~/",
    "punct": b".,;:?'\"()-",
    "bang": b"!",
    "bar": b"|",
}


def features(text: str | None) -> list[float]:
    """The features of a whole text; all zero for a null or blank one."""
    counts = np.zeros(256, dtype=np.int64)
    words: dict[str, int] = {}
    n_words = letters = repeats = upper_words = 0
    last = None
    text = text or ""
    for start in _pieces(text):
        piece = text[start[0] : start[1]]
        counts += np.bincount(np.frombuffer(piece.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        found = piece.split()
        n_words += len(found)
        for word in found:
            if word == last:
                repeats += 1
            last = word
            words[word] = words.get(word, 0) + 1
        letters += sum(map(len, found))
    if not n_words:
        return [0.0] * len(FEATURES)
    kind = {k: int(counts[np.frombuffer(v, dtype=np.uint8)].sum()) for k, v in _KINDS.items()}
    total = max(int(counts.sum()), 1)
    alpha = max(kind["upper"] + kind["lower"], 1)
    upper_words = sum(n for w, n in words.items() if len(w) > 2 and w.isupper())
    lines = text.split("\n")
    ends = counts[ord(".")] + counts[ord("?")] + counts[ord("!")]
    return [
        float(np.log1p(n_words)),
        letters / n_words,
        len(words) / n_words,
        max(words.values()) / n_words,
        repeats / n_words,
        kind["upper"] / alpha,
        upper_words / n_words,
        kind["digit"] / total,
        kind["symbol"] / total,
        kind["punct"] / total,
        kind["bang"] / total,
        kind["bar"] / total,
        float(np.log1p(total / len(lines))),
        len(set(lines)) / len(lines),
        float(ends) / n_words,
        float(counts[128:].sum()) / total,
    ]


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Cuts at white space, at least ``PIECE`` apart, so that no word is cut."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield start, end
        start = end
    yield start, len(text)


@dataclass(frozen=True)
class Additive:
    """``edges[f]``: bin limits; ``tables[f]`` and ``pairs[(f, g)]``: what a bin adds."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = _bins(x, self.edges)
        total = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (f, g), table in self.pairs.items():
            total += table[bins[:, f], bins[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 150, rate: float = 0.1, leaves: int = 4, n_pairs: int = 8, pair_rounds: int = 50
) -> Additive:
    """Fit on a feature matrix. Without both labels the model is its prior alone."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    edges = [_limits(x[:, f], n_bins) for f in range(x.shape[1])]
    sizes = [len(e) + 1 for e in edges]
    tables = [np.zeros(n) for n in sizes]
    if len(np.unique(y)) < 2:
        return Additive(bias, edges, tables, {})
    bins = _bins(x, edges)
    total = np.full(len(y), bias)
    for _ in range(rounds):
        for f, n in enumerate(sizes):
            gradient, weight = _sums(y, total, bins[:, f], n)
            step = rate * _tree(gradient, weight, leaves)
            tables[f] += step
            total += step[bins[:, f]]
    coarse = [np.minimum(np.arange(n) * 8 // n, 7) for n in sizes]
    ranked = sorted(
        ((_pair_gain(y, total, coarse[f][bins[:, f]], coarse[g][bins[:, g]]), f, g) for f in range(len(sizes)) for g in range(f)),
        reverse=True,
    )
    pairs = {(f, g): np.zeros((sizes[f], sizes[g])) for _, f, g in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (f, g), table in pairs.items():
            # A shallow tree over two features: a cut of one, then of the other in each half.
            joint = bins[:, f] * sizes[g] + bins[:, g]
            gradient, weight = (v.reshape(table.shape) for v in _sums(y, total, joint, table.size))
            step = np.empty_like(table)
            cut = _cut(gradient.sum(1), weight.sum(1))
            for part in (slice(0, cut), slice(cut, None)):
                step[part] = _tree(gradient[part].sum(0), weight[part].sum(0), 2)
            step *= rate
            table += step
            total += step.ravel()[joint]
    return Additive(bias, edges, tables, pairs)


def _limits(values: np.ndarray, n_bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, n_bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


def _sums(y, total, bins, n):
    p = 1 / (1 + np.exp(-total))
    return np.bincount(bins, y - p, n), np.bincount(bins, p * (1 - p), n)


_RIDGE = 1.0


def _gains(gradient, weight):
    g, w = np.cumsum(gradient), np.cumsum(weight)
    left, right = g[:-1] ** 2 / (w[:-1] + _RIDGE), (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + _RIDGE)
    return left + right - g[-1] ** 2 / (w[-1] + _RIDGE)


def _cut(gradient, weight) -> int:
    return int(np.argmax(_gains(gradient, weight))) + 1 if len(gradient) > 1 else len(gradient)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of the tree that splits the best leaf until there are ``leaves``."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = max(
            ((gains.max(), a + int(np.argmax(gains)) + 1, k) for k, (a, b) in enumerate(parts) if b - a > 1
             for gains in [_gains(gradient[a:b], weight[a:b])]),
            default=(0.0, 0, 0),
        )
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[2])
        parts += [(a, best[1]), (best[1], b)]
    out = np.empty(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + _RIDGE)
    return out


def _pair_gain(y, total, f, g) -> float:
    gradient, weight = _sums(y, total, f * 8 + g, 64)
    return float((gradient**2 / (weight + _RIDGE)).sum())


def with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``features`` in place of ``text``."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keep].assign(features=[features(t) for t in batch["text"]])

    return rows.select(*keep, "text").mapInPandas(compute, f"{schema}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Additive:
    """Fit on at most ``TRAINING_ROWS`` labelled documents outside the held-out share."""
    rows = with_features(labelled(docs, labels, "quality", modulus, held_out, TRAINING_ROWS), ["label"])
    found = rows.toPandas().sort_values("label", kind="stable")
    x = np.array(found["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, found["label"].to_numpy())) if len(x) else []
    return fit(x[order], found["label"].to_numpy(dtype=float)[order])


def score(rows: DataFrame, model: Additive, keep: list[str], name: str = "score") -> DataFrame:
    """The kept columns with the probability of label 1. Every text is scored whole."""

    def scores(texts: list[str | None]) -> dict[str, list]:
        x = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return {name: model.scores(x)}

    return from_texts(rows, keep, {name: T.DoubleType()}, lambda: scores)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Null, empty and blank texts have all features zero and are scored by them. Rows
    without a ``doc_id`` are never trained on and count as not held out; repeated rows
    are scored each. Without labels of both kinds the score is the smoothed share.
    """
    model = train(docs, labels)
    # The text itself is not returned, so that little leaves the Python workers.
    scored = score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id",
        in_share(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def kept_by_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns unchanged.

    Rows are judged one by one, as in :func:`quality`: null and blank texts by the score of
    texts without features, repeated rows alike, rows without a ``doc_id`` like others.
    """
    name = free_name("score", docs.columns)
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) >= threshold).drop(name)
