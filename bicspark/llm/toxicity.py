"""Toxicity by maximum-scoring segments.

Tokens are words and their beginnings of three to eight letters. Each has a log-odds of
toxic against other documents, shrunk by an informative Dirichlet prior (its share in all
training documents), and a z-score that tells whether it is significant. Along a text, a
word adds the log-odds of its longest significant token, and any other word a negative
drift. A linear scan finds every maximal segment (Ruzzo and Tompa); a segment is a toxic
passage if its chance under the extreme-value law of such scores in clean text is small.
A document's score comes from the sum statistic of its best segments under that law.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bicspark.llm.common import from_texts, in_share, labelled

#: At most so many labelled documents train the model.
TRAINING_ROWS = 10_000
#: Weight of the prior against the counts; from which z-score and odds a token counts.
PRIOR = 0.1
LEAST_Z = 2.8
LEAST_ODDS = 1.0
#: Lengths of the beginnings that are tokens besides the whole word.
BEGINNINGS = range(3, 9)
#: So many words at most are kept with their value by a task.
KNOWN_WORDS = 100_000
#: What a word that is not significant adds.
DRIFT = -0.25
#: A passage is reported if as good a one is expected in less than so many texts.
PASSAGE = 0.05
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """``odds``: significant words; ``rate`` and ``size``: the extreme-value law's lambda
    and K; ``slope`` and ``bias`` turn its evidence into a probability; ``base`` is the
    probability of a text without any passage."""

    odds: dict[str, float]
    rate: float
    size: float
    slope: float
    bias: float
    base: float


def tokens(word: str) -> list[str]:
    """The word and its beginnings, longest first."""
    return [word, *[word[:k] + "-" for k in reversed(BEGINNINGS) if k < len(word)]]


class Values(dict):
    """The log-odds of words, from those of tokens; None for words without any."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds

    def __missing__(self, word: str) -> float | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = next((self.odds[t] for t in tokens(word) if t in self.odds), None)
        return value


def hits(text: str | None, values: Values) -> tuple[int, list[tuple[int, float, int, int]]]:
    """The number of words, and (place, log-odds, start, end) of each significant one."""
    n, found = 0, []
    for match in WORD.finditer(_folded(text or "")):
        value = values[match.group()]
        if value is not None:
            found.append((n, value, match.start(), match.end()))
        n += 1
    return n, found


def _folded(text: str) -> str:
    """Lower case of the same length, so that places stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def segments(found: list[tuple[int, float, int, int]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first hit, last hit + 1), in text order.

    The scan of Ruzzo and Tompa over runs: hits, and the drift of the words between
    them. Candidates keep the sum left and right of them; a new one that starts no
    lower than an earlier one and ends higher swallows it. Each is merged once.
    """
    kept: list[list] = []  # [left sum, right sum, first, last + 1]
    total, place = 0.0, 0
    for k, (at, value, _, _) in enumerate(found):
        total += drift * (at - place)
        place = at + 1
        if value <= 0:
            total += value
            continue
        new = [total, total + value, k, k + 1]
        total += value
        # Candidates are stacked; those that end above the new one's end can't be joined.
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0]:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= new[1]:
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
        kept.append([*new, j])
    return [(right - left, a, b) for left, right, a, b, _ in kept]


def evidence(score: float, n_words: int, rate: float, size: float) -> float:
    """Minus the logarithm of the expected number of such segments in a clean text."""
    return rate * score - float(np.log(max(size * max(n_words, 1), 1e-12)))


def strength(scores: list[float], n_words: int, rate: float, size: float) -> float | None:
    """Minus the log chance of the best segments in a clean text; None without any.

    For the r best the sum T of their evidence has the chance
    ``exp(-T) T**(r-1) / (r! (r-1)!)``; the r that is least likely by chance counts.
    """
    total, most = 0.0, None
    for r, score in enumerate(sorted(scores, reverse=True), start=1):
        total += evidence(score, n_words, rate, size)
        found = total
        if r > 1:
            if total <= r:
                break
            found = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r)
        most = found if most is None else max(most, found)
    return most


def best(text: str | None, model: Model, values: Values) -> tuple[float | None, list[tuple[int, int]]]:
    """The strength of the best segments, and the character spans of toxic passages."""
    n, found = hits(text, values)
    every = segments(found)
    limit = -math.log(PASSAGE)
    spans = [(found[a][2], found[b - 1][3]) for s, a, b in every if evidence(s, n, model.rate, model.size) >= limit]
    return strength([s for s, _, _ in every], n, model.rate, model.size), spans


def probability(strength: float | None, model: Model) -> float:
    if strength is None:
        return model.base
    return float(1 / (1 + np.exp(-np.clip(model.bias + model.slope * strength, -40, 40))))


def log_odds(counts: DataFrame) -> DataFrame:
    """``(token, odds, z)`` from ``(token, n0, n1)``, with the informative Dirichlet prior."""
    sums = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))

    def smoothed(n: str, t: str):
        return F.col(n) + F.lit(PRIOR) * (F.col("n0") + F.col("n1")) * (F.col(t) + 1) / (F.col("t0") + F.col("t1") + 2)

    one, none = smoothed("n1", "t1"), smoothed("n0", "t0")
    delta = F.log(one / (F.col("t1") + 1)) - F.log(none / (F.col("t0") + 1))
    # The one-row side is a sum and so may be broadcast.
    return counts.crossJoin(F.broadcast(sums)).select(
        "token", delta.alias("odds"), (delta / F.sqrt(1 / one + 1 / none)).alias("z")
    )


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    """Learn from at most ``TRAINING_ROWS`` labelled documents outside the held-out share."""
    rows = labelled(docs, labels, "toxic", modulus, held_out, TRAINING_ROWS)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted({t for w in set(WORD.findall(_folded(x or ""))) for t in tokens(w)}) for x in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "tokens": found})

    spelt = rows.mapInPandas(spell, "label int, tokens array<string>")
    counts = spelt.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )
    strong = log_odds(counts).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    odds = {r["token"]: r["odds"] for r in strong.collect()}  # tokens of a bounded sample

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = Values(odds)
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                n, found = hits(text, values)
                out.append((label, n, [s for s, _, _ in segments(found)], [v for _, v, _, _ in found]))
            yield pd.DataFrame(out, columns=["label", "n", "scores", "values"])

    seen = rows.mapInPandas(measure, "label int, n long, scores array<double>, values array<double>").toPandas()
    return calibrate(seen.sort_values(["label", "n"], kind="stable"), odds)


def calibrate(seen: pd.DataFrame, odds: dict[str, float]) -> Model:
    """The extreme-value law of clean text, and the probability that goes with strength."""
    clean = seen[seen["label"] == 0]
    share = (float(seen["label"].sum()) + 1) / (len(seen) + 2)
    n_clean = max(float(clean["n"].sum()), 1.0)
    values = np.concatenate([np.asarray(v, float) for v in clean["values"]]) if len(clean) else np.zeros(0)
    # Half a hit stands for the unseen, so that the law exists without any.
    unseen = float(np.mean(list(odds.values()))) if odds else 1.0
    weights = np.append(np.ones(len(values)), 0.5) / (n_clean + 0.5)
    rate = _lambda(np.append(values, unseen), weights)
    # K, by the number of clean segments: E(score >= s) = K n exp(-lambda s), summed over
    # the segments' own scores.
    scores = np.concatenate([np.asarray(v, float) for v in clean["scores"]]) if len(clean) else np.zeros(0)
    size = float(np.exp(np.clip(rate * np.append(scores, unseen), 0, 30)).mean()) * (len(scores) + 0.5) / n_clean
    size = float(np.clip(size, 1e-9, 1.0))
    seen = seen.assign(strength=[strength(list(s), n, rate, size) for s, n in zip(seen["scores"], seen["n"])])
    with_hits = seen[seen["strength"].notna()]
    without = seen[seen["strength"].isna()]
    base = (float(without["label"].sum()) + share) / (len(without) + 1)
    slope, bias = _logistic(with_hits["strength"].to_numpy(float), with_hits["label"].to_numpy(float), share)
    return Model(odds, rate, size, slope, bias, base)


def _lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(lambda x) = 1 for the score of a random clean word."""
    rest = max(1.0 - weights.sum(), 1e-9)

    def f(rate: float) -> float:
        return float((weights * np.exp(np.clip(rate * values, -50, 50))).sum() + rest * np.exp(rate * DRIFT) - 1)

    low, high = 1e-6, 20.0
    if f(low) >= 0:
        return low
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope (not below 0) and bias, by Newton steps with a small ridge."""
    slope, bias = 0.0, float(np.log(share / (1 - share)))
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 0.1 * slope, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, bias = slope + float(np.clip(step[0], -1, 1)), bias + float(np.clip(step[1], -3, 3))
    return (slope, bias) if slope > 0 else (0.0, bias)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted, passages)`` of every row.

    ``passages`` has "start:end" character spans of all significant toxic passages. A
    null or empty text has no passage and gets the probability of such texts. Rows
    without a ``doc_id`` are never trained on; repeated rows are scored each.
    """
    model = train(docs, labels)

    def start():
        values = Values(model.odds)

        def compute(texts: list[str | None]) -> dict[str, list]:
            found = [best(t, model, values) for t in texts]
            return {
                "score": [probability(s, model) for s, _ in found],
                "passages": [",".join(f"{a}:{b}" for a, b in spans) for _, spans in found],
            }

        return compute

    scored = from_texts(docs, ["doc_id"], {"score": T.DoubleType(), "passages": T.StringType()}, start)
    return scored.select(
        "doc_id",
        in_share(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )
