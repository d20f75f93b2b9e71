"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of one to four characters inside its words, with a mark at
both ends of a word, hashed into buckets. Its embedding is the mean over all of them, and
a linear layer with softmax gives the languages' probabilities. Embeddings and layer are
learnt together by stochastic gradient descent in numpy, over a bounded sample. A share of
the sample is kept back to calibrate: a temperature, and the confidence under which a
prediction is rejected.

The mean and the layer are linear, so a scoring task adds up one row of
``embeddings @ layer`` per subword, over the code points of many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bicspark.llm.common import in_share

#: At most so many documents train the model, shared evenly by the languages.
TRAINING_ROWS = 4_000
#: So many languages at most are learnt, the ones with most documents.
LANGUAGES = 100
#: Every so many-th training document calibrates instead.
KEPT_BACK = 5
BITS = 14
BUCKETS = 1 << BITS
DIMENSIONS = 16
LENGTHS = (1, 2, 3, 4)
#: A prediction is rejected if the error of kept-back documents at least as sure exceeds this.
ERROR = 0.01
#: So many characters are taken at a time, so that memory doesn't grow with a text.
PIECE = 1 << 17
UNDETERMINED = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    """``rows``: what a subword's bucket adds to each language; ``languages`` in its order."""

    languages: list[str]
    rows: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    found = _LETTER[np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        found[k] = chr(codes[k]).isalpha()
    return found


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(codes, owner)`` of about ``PIECE`` code points at a time: letters, 0 between words.

    ``owner`` is the place of the text that a code comes from. Texts are cut between
    words; a word of more than ``PIECE`` letters is cut anywhere.
    """
    waiting: list[tuple[int, str]] = []
    size = 0
    for place, text in enumerate(texts):
        text = text or ""
        start = 0
        while start < len(text):
            end = min(len(text), start + PIECE - size)
            stop = end
            while stop < len(text) and stop - end < PIECE and text[stop].isalpha():
                stop += 1
            waiting.append((place, text[start:stop]))
            size += stop - start
            start = stop
            if size >= PIECE:
                yield _coded(waiting)
                waiting, size = [], 0
    if waiting:
        yield _coded(waiting)


def _coded(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [(place, text.lower()) for place, text in parts]
    joined = "".join(" " + text + " " for _, text in lowered)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat([place for place, _ in lowered], [len(text) + 2 for _, text in lowered])
    is_letter = letters(codes)
    kept = is_letter | np.append(False, is_letter[:-1])  # one mark after each word,
    kept[np.cumsum([0, *[len(text) + 2 for _, text in lowered[:-1]]])] = True  # and one before each part
    return np.where(is_letter, codes, 0)[kept].astype(np.uint32), owner[kept]


def subwords(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, owner)`` of all subwords of each length; marks are at their ends only."""
    inside = codes != 0
    mixed = np.zeros(len(codes), dtype=np.uint32)
    whole = np.ones(len(codes), dtype=bool)  # no mark between the first and the last code
    for k in range(max(LENGTHS)):
        n = len(codes) - k
        if n <= 0:
            return
        mixed, whole = mixed[:n], whole[:n]
        if k > 1:
            whole = whole & inside[k - 1 : k - 1 + n]
        mixed = (mixed ^ codes[k:]) * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint32(15)
        if k + 1 in LENGTHS:
            # A mark alone, or two of them, say nothing.
            take = whole & (inside[:n] | inside[k:] if k < 2 else True)
            spread = mixed[take] * np.uint32(0x2C1B3C6D) + np.uint32(k)
            yield (spread >> np.uint32(32 - BITS)).astype(np.int32), owner[:n][take]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords in order, and how often each occurs."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for codes, owner in pieces([text]):
        for bucket, _ in subwords(codes, owner):
            total += np.bincount(bucket, minlength=BUCKETS)
    bucket = np.flatnonzero(total)
    return bucket.astype(np.int32), total[bucket].astype(np.float32)


def totals(texts: list[str | None], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean of ``rows`` over its subwords, and whether it has a letter."""
    sums, n = np.zeros((len(texts), rows.shape[1])), np.zeros(len(texts))
    for codes, owner in pieces(texts):
        for bucket, at in subwords(codes, owner):
            if not len(at):
                continue
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            sums[at[cuts]] += np.add.reduceat(rows.take(bucket, axis=0, mode="clip"), cuts, axis=0, dtype=float)
            n[at[cuts]] += np.diff(np.append(cuts, len(at)))
    return sums / np.maximum(n, 1)[:, None], n > 0


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def descend(
    samples: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n_languages: int,
    epochs: int = 6, batch: int = 16, rate: float = 4.0, seed: int = 13,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, layer and bias after stochastic gradient descent with a falling rate.

    A language's samples weigh as much in all as any other's.
    """
    random = np.random.default_rng(seed)
    embedded = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, n_languages)), np.zeros(n_languages)
    present = np.bincount(target, minlength=n_languages)
    weight = (len(target) / (np.maximum(present, 1) * np.count_nonzero(present)))[target]
    shares = [c / c.sum() for _, c in samples]
    n_steps, step = epochs * -(-len(samples) // batch), 0
    for _ in range(epochs):
        order = random.permutation(len(samples))
        for start in range(0, len(order), batch):
            taken = order[start : start + batch]
            bucket = np.concatenate([samples[k][0] for k in taken])
            share = np.concatenate([shares[k] for k in taken])
            begin = np.cumsum([0, *[len(shares[k]) for k in taken]])
            mean = np.add.reduceat(embedded[bucket] * share[:, None], begin[:-1], axis=0)
            error = softmax(mean @ layer + bias)
            error[np.arange(len(taken)), target[taken]] -= 1
            error *= (weight[taken] / len(taken))[:, None]
            pace = rate * (1 - step / n_steps)
            back = error @ layer.T
            layer -= pace * mean.T @ error
            bias -= pace * error.sum(axis=0)
            moved = np.repeat(back, np.diff(begin), axis=0) * share[:, None]
            np.subtract.at(embedded, bucket, pace * len(taken) * moved)
            step += 1
    return embedded, layer, bias


def calibrate(logits: np.ndarray, target: np.ndarray, error: float = ERROR) -> tuple[float, float]:
    """The temperature of least loss, and the least confidence that is not rejected.

    The loss is against smoothed labels, as if one more sample were wrong, so that perfect
    samples don't make it certain. The least confidence is the lowest at which the samples
    at least as sure are wrong in at most a share ``error``, one more than seen counted as
    wrong once there are enough of them to afford it. Without samples nothing is scaled or
    rejected.
    """
    if not len(target):
        return 1.0, 0.0
    own = np.arange(len(target)), target
    n_samples, n_languages = logits.shape
    smooth = np.full(logits.shape, 1 / (n_samples + 2) / max(n_languages - 1, 1))
    smooth[own] = (n_samples + 1) / (n_samples + 2)

    def loss(temperature: float) -> float:
        return float(-(smooth * np.log(np.maximum(softmax(logits / temperature), 1e-300))).sum(axis=1).mean())

    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    found = softmax(logits / temperature)
    sure = found.max(axis=1)
    order = np.argsort(-sure, kind="stable")
    wrong = np.cumsum(found.argmax(axis=1)[order] != target[order])
    n = np.arange(1, len(order) + 1)
    last_of_ties = np.append(np.diff(sure[order]) != 0, True)
    allowed = np.flatnonzero(last_of_ties & (wrong + np.minimum(1, error * n) <= error * n + 1e-9))
    return float(temperature), float(sure[order][allowed[-1]]) if len(allowed) else 1.0


def sample(docs: DataFrame, modulus: int, held_out: int, limit: int = TRAINING_ROWS) -> DataFrame:
    """``(lang, r, text)``: at most ``limit`` documents to learn from, by a hash of id and language.

    The languages with most documents share them evenly. Documents without a text, a
    language or a ``doc_id`` and held-out ones are not used; of rows that agree in id
    and language the text that sorts first is.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~in_share(F.col("doc_id"), modulus, held_out)
    ).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "lang").alias("r"), "text")
    counts = known.groupBy("lang").count()
    most = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not most:
        return known.limit(0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("r"))
    slim = known.where(F.col("lang").isin(most)).select("lang", "r").distinct()
    last = slim.withColumn("place", place).where(F.col("place") <= max(1, limit // len(most))).groupBy("lang").agg(F.max("r"))
    limits = {r[0]: r[1] for r in last.collect()}  # one for each language learnt
    below = F.lit(False)
    for lang, limit_r in limits.items():
        below = below | ((F.col("lang") == lang) & (F.col("r") <= limit_r))
    return known.where(below).groupBy("lang", "r").agg(F.min("text").alias("text"))


def train(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> Model | None:
    """Learn from :func:`sample`; None if no document has both a letter and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"), batch.column("r"),
                    pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.float32())),
                ],
                names=["lang", "r", "buckets", "counts"],
            )

    features = sample(docs, modulus, held_out).mapInArrow(count, "lang string, r long, buckets array<int>, counts array<float>")
    table = features.where(F.size("buckets") > 0).toArrow().sort_by([("r", "ascending"), ("lang", "ascending")])
    if not table.num_rows:
        return None
    langs = table.column("lang").to_pylist()
    languages = sorted(set(langs))
    target = np.array([languages.index(l) for l in langs])
    samples = [
        (b.values.to_numpy(), c.values.to_numpy().astype(float)) for b, c in zip(table.column("buckets"), table.column("counts"))
    ]
    back = np.arange(len(samples)) % KEPT_BACK == KEPT_BACK - 1
    fitted = [s for s, b in zip(samples, back) if not b]
    embedded, layer, bias = descend(fitted, target[~back], len(languages))
    rows = embedded @ layer
    logits = np.array([(rows[b] * (c / c.sum())[:, None]).sum(axis=0) for (b, c), k in zip(samples, back) if k])
    temperature, least = calibrate(logits.reshape(-1, len(languages)) + bias, target[back])
    return Model(languages, rows.astype(np.float32), bias, temperature, least)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its calibrated probability."""
    if model is None:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    means, spelt = totals(texts, model.rows)
    found = softmax((means + model.bias) / model.temperature)
    best = found.argmax(axis=1)
    named = [model.languages[k] if s else UNDETERMINED for k, s in zip(best, spelt)]
    return named, np.where(spelt, found[np.arange(len(texts)), best], 0.0)


def languages(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every row.

    ``lang_pred`` is the likeliest language learnt, and ``und`` with a score of 0 for a
    text that is null or has no letter, or if nothing could be learnt. ``rejected`` tells
    that the score is below the calibrated least confidence; ``und`` always is. Texts are
    read whole. Rows without a ``doc_id`` count as not held out and are never learnt
    from; repeated rows are predicted each; ties go to the language that sorts first.
    """
    model = train(docs, modulus, held_out)
    least = model.least if model else 1.0
    key = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, scores = predict(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {key}, lang_pred string, score double")
    return scored.select(
        "doc_id",
        in_share(F.col("doc_id"), modulus, held_out).alias("held_out"),
        "lang_pred",
        "score",
        ((F.col("score") == 0) | (F.col("score") < least)).alias("rejected"),
    )
