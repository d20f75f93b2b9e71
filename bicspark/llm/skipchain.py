"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans of a text. Its tokens that look like parts of such
data become the nodes of a random field, with the labels "none" and the four kinds.
Edges join neighbours (the chain) and tokens that are equal or similar, however far
apart (the skip chain). Node potentials are learnt from all texts: how often tokens of a
shape lie in base spans. Loopy max-product messages then carry a label from where a
pattern holds to where the same data appears in a form that no pattern catches. Base
spans are fixed; the field only adds spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bicspark.llm.common import from_texts

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits has one end, so a match that fails at its first digit fails at all.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Tokens that may be nodes: they hold a digit, a dot or an underscore. Words of letters
# only, such as the name of an address elsewhere in the text, are none.
_NODE = re.compile(rf"[(+]?[0-9](?:[\x20().-]{{0,2}}[0-9])+|(?<![{_LOCAL}])[{_LOCAL}]*[0-9._][{_LOCAL}]*[A-Za-z0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
#: Fewest digits, and letters or digits of a name, by which two tokens are similar.
SIMILAR_DIGITS, SIMILAR_NAME = 8, 6
#: Potentials: equal labels of an open token and a base span that it is similar to, of
#: similar tokens one after the other, of neighbours in the text; and the odds against a
#: label where the shape has not been seen.
SKIP, NEAR, CHAIN, UNSEEN = 6.0, 0.5, 0.2, -4.0
ROUNDS = 8
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all base matches, by start and then kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL_CHARS))
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, tail.end(), 0))
            free = tail.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def shape(token: str) -> str:
    """The class of a token: letters, digit counts and separators, without the values."""
    digits = len(_NOT_DIGITS.sub("", token))
    letters = any(c.isalpha() for c in token)
    marks = "".join(m for m in "+(.-_ " if m in token)
    return f"{'a' if letters else ''}{min(digits, 20)}{marks}"


def nodes(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label): base spans, label 1 to 4, and other node tokens, label 0."""
    out = [(a, b, k + 1) for a, b, k in base]
    reach = [(a, b) for a, b, _ in sorted(base)]
    k = 0
    for m in _NODE.finditer(text):
        while k < len(reach) and reach[k][1] <= m.start():
            k += 1
        if k == len(reach) or reach[k][0] >= m.end():
            out.append((m.start(), m.end(), 0))
    return sorted(out)


def keys(token: str, label: int) -> list[str]:
    """What tokens have in common that are similar: last digits, or a name."""
    digits = _NOT_DIGITS.sub("", token)
    found = []
    if len(digits) >= SIMILAR_DIGITS and (label in (0, 3, 4)):
        found.append("d" + digits[-SIMILAR_DIGITS:])
    if label in (0, 2) and digits:
        parts = _NOT_DIGITS.split(token.strip("()+.-_ "))
        if len(parts) == 4 and all(parts):
            found.append("q" + ".".join(parts))
    name = token.split("@")[0].lower() if label in (0, 1) else ""
    if len(name) >= SIMILAR_NAME and any(c.isalpha() for c in name) and (label == 1 or not name.isalpha()):
        found.append("n" + name.strip("._%+-"))
    return found


def edges(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """Chain edges between nodes close by, skip edges among the places of a key.

    A place is joined to the one before, and each open place to the first base span of
    its key, from where the label comes. So edges grow with the nodes, not with pairs.
    """
    out = [(k, k + 1, CHAIN) for k in range(len(found) - 1) if 0 <= found[k + 1][0] - found[k][1] <= 2]
    places: dict[str, list[int]] = {}
    for k, (a, b, label) in enumerate(found):
        for key in keys(text[a:b], label):
            places.setdefault(key, []).append(k)
    for own in places.values():
        base = next((k for k in own if found[k][2]), None)
        out += [(base, k, SKIP) for k in own if base is not None and not found[k][2]]
        out += [(j, k, NEAR) for j, k in zip(own, own[1:])]
    return out


def infer(unary: np.ndarray, links: list[tuple[int, int, float]]) -> np.ndarray:
    """The label of every node, by ``ROUNDS`` rounds of max-product messages."""
    if not links:
        return unary.argmax(axis=1)
    left, right = np.array([e[0] for e in links]), np.array([e[1] for e in links])
    weight = np.array([e[2] for e in links])[:, None]
    source, target = np.concatenate([left, right]), np.concatenate([right, left])
    weight = np.concatenate([weight, weight])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    messages = np.zeros((len(source), unary.shape[1]))
    for _ in range(max(ROUNDS, 1)):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        rest = belief[source] - messages[back]
        fresh = np.maximum(rest.max(axis=1, keepdims=True), rest + weight)
        fresh -= fresh.max(axis=1, keepdims=True)
        if np.abs(fresh - messages).max() < 1e-9:
            break
        messages = 0.5 * messages + 0.5 * fresh
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return belief.argmax(axis=1)


def added_spans(text: str, base: list[Span], odds: dict[str, list[float]]) -> list[Span]:
    """What the field finds besides the base spans. Without any, nothing is similar to one."""
    if not base:
        return []
    found = nodes(text, base)
    if len(found) == len(base):
        return []
    unary = np.zeros((len(found), len(KINDS) + 1))
    for k, (a, b, label) in enumerate(found):
        if label:
            unary[k] = -50.0
            unary[k, label] = 0.0
        else:
            unary[k, 1:] = odds.get(shape(text[a:b]), [UNSEEN] * len(KINDS))
    labels = infer(unary, edges(text, found))
    return [(a, b, int(x) - 1) for (a, b, label), x in zip(found, labels) if not label and x]


def shape_counts(docs: DataFrame) -> DataFrame:
    """``(shape, label, n)`` over the node tokens of all texts; label 0 lies in no base span.

    Shapes are few: up to 20 digits, letters or none, and which of six marks occur.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            for text in batch["text"]:
                if text and (("@" in text) or _DIGIT.search(text)):
                    for a, b, label in nodes(text, base_spans(text)):
                        key = (shape(text[a:b]), label)
                        seen[key] = seen.get(key, 0) + 1
        yield pd.DataFrame([(s, k, n) for (s, k), n in seen.items()], columns=["shape", "label", "n"])

    counted = docs.select("text").mapInPandas(count, "shape string, label int, n long")
    return counted.groupBy("shape", "label").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> dict[str, list[float]]:
    """Log-odds of each kind against none, by shape, smoothed and never in favour of a kind
    by themselves: only what a skip edge carries can outweigh them."""
    counts: dict[str, list[int]] = {}
    for row in shape_counts(docs).collect():  # bounded by the number of shapes
        counts.setdefault(row["shape"], [0] * (len(KINDS) + 1))[row["label"]] = row["n"]
    return {
        s: [float(np.clip(math.log((n + 0.1) / (sum(c) + 1.0)), UNSEEN, -1.0)) for n in c[1:]] for s, c in counts.items()
    }


def find(docs: DataFrame, keep: list[str], odds: dict[str, list[float]]) -> DataFrame:
    """The kept columns with ``base`` and ``added`` spans of every whole text."""

    def scan(texts: list[str | None]) -> dict[str, list]:
        base = [base_spans(t) if t else [] for t in texts]
        more = [added_spans(t, b, odds) if b else [] for t, b in zip(texts, base)]
        out = {f"n_{kind}": [sum(s[2] == k for s in b) for b in base] for k, kind in enumerate(KINDS)}
        out["base"] = [joined(b) for b in base]
        out["spans"] = [joined(sorted(b + m, key=lambda s: (s[0], s[2]))) for b, m in zip(base, more)]
        return out

    added = {f"n_{kind}": T.LongType() for kind in KINDS} | {"base": T.StringType(), "spans": T.StringType()}
    return from_texts(docs, keep, added, lambda: scan)


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row.

    Counts are of base spans; ``spans`` has the added ones too. Null and empty texts
    have none, and the hash of the empty string. Rows without a ``doc_id`` and repeated
    rows are scanned like others.
    """
    found = find(docs, ["doc_id"], learn(docs))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, ``n_chars`` to match.

    Where spans overlap, the first to start names what is masked. Null and empty texts and
    texts without personal data stay as they are, repeated rows alike; other columns are
    unchanged, whatever their names.
    """
    odds = learn(docs)

    def mask(text: str | None) -> str | None:
        base = base_spans(text) if text else []
        if not base:
            return text
        parts, done = [], 0
        for a, b, k in sorted(base + added_spans(text, base, odds), key=lambda s: (s[0], s[2])):
            if a >= done:
                parts += [text[done:a], f"[{KINDS[k].upper()}]"]
            done = max(done, b)
        return "".join([*parts, text[done:]])

    out = from_texts(docs, docs.columns, {"text": T.StringType()}, lambda: lambda texts: {"text": [mask(t) for t in texts]})
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
