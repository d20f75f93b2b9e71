"""Token ids of whole texts, by the tokenizers library, over Arrow batches.

A tokenizer never merges across the cuts made here, so each distinct piece of a batch
is encoded once and its ids are laid out wherever it occurs. Pieces of ASCII and Latin-1
letters are cut further into the words that the tokenizer's own split would give, and
the distinct words go to its model in one string; all other pieces, and all texts with
unusual white space, go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are laid out at a time, to bound a task's memory.
CHUNK_BYTES = 4 << 20
#: A space before other white space or the end of the text: such texts are not cut.
_LOOSE_SPACE = r" [\s\pZ\x{1c}-\x{1f}\x{85}]| $"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x20-\x7E\n\r\t{_LATIN}]*")
# The splits of the two vocabularies' files, over plain characters.
_WORDS_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
#: Words that go to the model in one string, and words that a worker remembers.
_TOGETHER = 500
KNOWN_WORDS = 200_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _letters() -> dict[int, str]:
    """The byte-level letters of the plain characters: bytes that print stand for
    themselves, the others for the letters from U+0100 on, in order."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printing)
    letter = {b: chr(b) for b in printing} | {b: chr(0x100 + k) for k, b in enumerate(others)}
    plain = [c for c in range(0x100) if _PLAIN.fullmatch(chr(c))]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in plain}


@lru_cache(maxsize=2)
def _word_model(path: str):
    """The tokenizer's model alone, for words parted by the letter of byte 0, and that id."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import Split

    model = Tokenizer(tokenizer(path).model)
    model.pre_tokenizer = Split("\u0100", "isolated")
    return model, model.encode("\u0100", add_special_tokens=False).ids[0]


class _Known:
    """Words that a worker has met, with their ids; forgotten when they get too many."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, new: list[str]) -> None:
        """Take in the ids of the words that were added last."""
        model, mark = _word_model(self.path)
        table = _letters() | {0: "\u0100"}
        groups = ["\0".join(new[k : k + _TOGETHER]).translate(table) for k in range(0, len(new), _TOGETHER)]
        ids, lengths = [self.ids], []
        for found in model.encode_batch_fast(groups, add_special_tokens=False):
            own = np.array(found.ids, dtype=np.uint32)
            marks = np.flatnonzero(own == mark)
            lengths.append(np.diff(marks, prepend=-1, append=len(own)) - 1)
            ids.append(np.delete(own, marks))
        ends = self.starts[-1] + np.cumsum(np.concatenate(lengths))
        self.ids, self.starts = np.concatenate(ids), np.concatenate([self.starts, ends])


_known = lru_cache(maxsize=2)(_Known)


def _flat(pieces: list[str], path: str, spaces_kept: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and where each piece starts."""
    known = _known(path)
    if len(known.words) > KNOWN_WORDS:
        known.clear()
    words, before = known.words, len(known.words)
    split = _WORDS_SPACED.findall if spaces_kept else _WORDS.findall
    codes, counts, odd = [], [], []
    for piece in pieces:
        if _PLAIN.fullmatch(piece) and "<|" not in piece:
            found = split(piece if spaces_kept else piece.lower())
            codes += [words.setdefault(w, len(words)) for w in found]
            counts.append(len(found))
        else:
            codes.append(-1 - len(odd))
            counts.append(1)
            odd.append(piece)
    if len(words) > before:
        known.encode(list(words)[before:])
    odd_ids, odd_starts = _whole(odd, path)
    at = np.array(codes, dtype=np.int64)
    at[at < 0] = len(words) - 1 - at[at < 0]
    ids = np.concatenate([known.ids, odd_ids])
    starts = np.concatenate([known.starts, known.starts[-1] + odd_starts[1:]])
    flat, sizes = _laid_out(at, ids, starts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


def _whole(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_flat`, by the whole tokenizer."""
    parts, lengths = [np.zeros(0, np.uint32)], [0]
    for k in range(0, len(texts), 4096):
        found = tokenizer(path).encode_batch(texts[k : k + 4096], add_special_tokens=False)
        parts += [np.array(e.ids, dtype=np.uint32) for e in found]
        lengths += [len(p) for p in parts[len(lengths) :]]
    return np.concatenate(parts), np.cumsum(lengths)


def _laid_out(codes: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces in the order of ``codes``, and the length of each."""
    lengths = starts[codes + 1] - starts[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts[codes] - (ends - lengths), lengths)
    return flat[shift + np.arange(total)], lengths


def encode(texts: pa.StringArray, path: str, spaces_kept: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and the number of ids of each. A null text is empty.

    ``spaces_kept`` tells a byte-level vocabulary, whose pieces begin with their space,
    from one that drops white space.
    """
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not spaces_kept:
        lists = pc.ascii_split_whitespace(texts)
        words = pc.list_flatten(lists).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts = _flat(words.dictionary.to_pylist(), path, False)
        whole = np.zeros(n, dtype=bool)
    else:
        whole = pc.match_substring_regex(texts, _LOOSE_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        words = pc.list_flatten(lists).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spaced = np.ones(len(codes), dtype=bool)
        spaced[lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]] = False
        pairs, codes = np.unique(codes * 2 + spaced, return_inverse=True)
        plain = words.dictionary.to_pylist()
        flat, starts = _flat([" " * int(p & 1) + plain[p >> 1] for p in pairs], path, True)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    ids, lengths = _laid_out(codes, flat, starts)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    counts = sums[bounds[1:]] - sums[bounds[:-1]]
    if whole.any():
        at = np.flatnonzero(whole)
        own, own_starts = _whole(texts.take(pa.array(at)).to_pylist(), path)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, row in enumerate(at):
            parts[row] = own[own_starts[k] : own_starts[k + 1]]
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
    return ids, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by ``end_id``."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``limit`` bytes of text or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def binary_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per document: its ids as little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
    data = np.ascontiguousarray(ids, dtype="<u4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
