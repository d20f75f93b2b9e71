"""Cheapest edits of a sequence of roles, by Four-Russians block tables.

A conversation is a string of one symbol per row. Its cheapest edits are a shortest path
over four states (nothing yet, after the system row, after a user row, after an assistant
row). Read from the end, a symbol turns the vector of the states' costs-to-go into another
one. Up to an added constant only few vectors occur, so they are numbered, and for every
block of up to ``BLOCK`` symbols a table gives the number of the next vector and the
constant. A string is processed by one lookup per block. To trace the edits, a block is
expanded again from the vector at its right end backward, and followed forward, taking at
each step the first letter in ASCII order that is still cheapest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BLOCK = 4
#: Row symbols: one that must go, then one that may stay for each initial, whole or cut short.
MUST_GO = 0
INITIALS = "sua"  # any other initial is the fourth
N_SYMBOLS = 9
#: States, and which state a role leads to. Only rows that are kept can be the system's.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {(START, 0): SYSTEM, **{(q, 1): USER for q in (START, SYSTEM, ASSISTANT)}, (USER, 2): ASSISTANT}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_DELETE, _INSERT, _REROLE, _CUT_SHORT = 3, 2, 2, 1


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs of states at a place, if empty rows may be inserted there."""
    for _ in range(3):
        costs = [min(c, _INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, in ASCII order."""
    found = [("D", _DELETE, state)]
    if symbol != MUST_GO:
        initial, cut = (symbol - 1) % 4, _CUT_SHORT * (symbol > 4)
        if (state, initial) in _KEPT:
            found.append(("K", cut, _KEPT[state, initial]))
        found.append(("R", _REROLE + cut, _NEXT[state]))
    return found


#: The costs-to-go after the last row: what is missing is inserted.
END = _with_inserts([0, 99, 99, 0])


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row, from those after it."""
    return _with_inserts([min(cost + after[to] for _, cost, to in _choices(symbol, q)) for q in range(4)])


@dataclass(frozen=True)
class Tables:
    """``vectors[k]``: normalised costs; ``following[n][block, k]`` and ``added[n][block, k]``:
    the vector before a block of n symbols and the constant, from vector k after it."""

    vectors: list[tuple[int, ...]]
    following: list[np.ndarray]
    added: list[np.ndarray]


@lru_cache(maxsize=1)
def tables() -> Tables:
    """All vectors that can occur, and the tables of all blocks of up to ``BLOCK`` symbols."""
    vectors, place = [END], {END: 0}
    step, constant = [], []
    for vector in vectors:  # grows while vectors are found
        row, extra = [], []
        for symbol in range(N_SYMBOLS):
            costs = _before(symbol, vector)
            low = min(costs)
            normal = tuple(c - low for c in costs)
            if normal not in place:
                place[normal] = len(vectors)
                vectors.append(normal)
            row.append(place[normal])
            extra.append(low)
        step.append(row)
        constant.append(extra)
    single, single_cost = np.array(step).T, np.array(constant).T
    following, added = [np.arange(len(vectors))[None, :]], [np.zeros((1, len(vectors)), dtype=np.int64)]
    for _ in range(BLOCK):
        # The first symbol of a block is met last.
        inner, cost = following[-1], added[-1]
        following.append(np.concatenate([single[s][inner] for s in range(N_SYMBOLS)]))
        added.append(np.concatenate([cost + single_cost[s][inner] for s in range(N_SYMBOLS)]))
    return Tables(vectors, following, added)


def blocks(symbols: str) -> list[str]:
    """A string of digits, one per symbol, cut from the left."""
    return [symbols[k : k + BLOCK] for k in range(0, len(symbols), BLOCK)]


def transition(symbols: str) -> tuple[np.ndarray, np.ndarray]:
    """For every vector after the string, the vector before it and the constant."""
    t = tables()
    at, cost = np.arange(len(t.vectors)), np.zeros(len(t.vectors), dtype=np.int64)
    for block in reversed(blocks(symbols)):
        key = int(block, N_SYMBOLS)
        cost += t.added[len(block)][key][at]
        at = t.following[len(block)][key][at]
    return at, cost


@lru_cache(maxsize=1 << 17)
def _traced(block: str, after: int, state: int) -> tuple[str, int, int]:
    """(letters, next state, cost) of a block entered in a state, expanded from its end."""
    t = tables()
    inner = [after]
    for symbol in reversed(block):
        inner.append(int(t.following[1][int(symbol), inner[-1]]))
    letters, total = "", 0
    for k, symbol in enumerate(block):
        costs = t.vectors[inner[len(block) - 1 - k]]
        before = _before(int(symbol), costs)
        while True:
            options = {letter: (cost, to) for letter, cost, to in _choices(int(symbol), state)}
            letter = min(
                [l for l, (cost, to) in options.items() if cost + costs[to] == before[state]]
                + ["I"] * (_INSERT + before[_NEXT[state]] == before[state])
            )
            letters += letter
            if letter == "I":
                total, state = total + _INSERT, _NEXT[state]
                continue
            total, state = total + options[letter][0], options[letter][1]
            break
    return letters, state, total


def trace(symbols: str, state: int = START, after: int = 0, ends: bool = True) -> tuple[str, int, int]:
    """The cheapest edits' letters, ASCII-least, with the last state and their cost.

    ``after`` is the vector after the string; ``ends`` tells whether nothing follows, so
    that rows missing at the end are inserted.
    """
    t = tables()
    parts = blocks(symbols)
    at = [after]
    for block in reversed(parts):
        at.append(int(t.following[len(block)][int(block, N_SYMBOLS), at[-1]]))
    letters, total = [], 0
    for block, vector in zip(parts, reversed(at[:-1])):
        found, state, cost = _traced(block, vector, state)
        letters.append(found)
        total += cost
    if ends:
        while END[state]:
            letters.append("I")
            total, state = total + _INSERT, _NEXT[state]
    return "".join(letters), state, total
