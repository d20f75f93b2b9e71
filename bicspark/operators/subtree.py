"""The closed sets below one node, found within a task.

A node whose records fit a task needs no more shuffles: the records are bit masks, and the
sets below it come out batch by batch, many nodes at a time. The walk goes on as the levels
over tables do (see :mod:`bicspark.operators.closure`) and meets every set once, always in
the same order, so a set is told by its place in the walk of its node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bicspark.plans.stages import Stages, ship_code

#: From so many records a level is left to tasks, apart from nodes with more than ``NODE_RECORDS``.
LEVEL_RECORDS = 50_000
NODE_RECORDS = 50_000
#: Items of a range that a mask holds.
MASK_ITEMS = 64
#: The level of the sets found in tasks; ``node`` is the number of their part and their place in its walk.
IN_TASK = 1 << 20
_PLACES = 36

#: Records of the nodes that are extended at a time, and sets that come out together.
BATCH = 200_000
OUT = 20_000
_ONE = np.uint64(1)
_BITS = 64


@dataclass(frozen=True)
class Met:
    """Sets that the walk meets, numbered on from ``first``.

    ``root`` is the place of the node that each is below, ``items`` are their masks and ``n`` their
    rows by weight. ``records`` are the places of their records, set after set and in the order that
    these were given in, and ``starts`` where each set's begin.
    """

    first: int
    root: np.ndarray
    items: np.ndarray
    n: np.ndarray
    records: np.ndarray
    starts: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.records))

    def places(self) -> np.ndarray:
        """For each record the place of its set."""
        return np.repeat(np.arange(len(self.starts)), self.sizes())


def walk(starts: np.ndarray, cand: np.ndarray, pre: np.ndarray, weight: np.ndarray, minsup: int, least: np.ndarray) -> Iterator[Met]:
    """All closed sets below some nodes with at least ``minsup`` rows and ``least`` items more than their node.

    Records lie node after node, those of each from one of ``starts``. ``cand`` masks the items of
    each that may extend the node, and ``pre`` those that must stay out. A set is met as the child
    of the set without its last added item and what that closes; a closure that adds an item
    before is met elsewhere.
    """
    full = cand | pre
    n_nodes = len(starts)
    lengths = np.diff(starts, append=len(cand))
    # Of each node: its records, how many they are, its place among the given ones, its items, those that may extend it.
    given = (np.arange(len(cand), dtype=np.int32), lengths, np.arange(n_nodes), np.zeros(n_nodes, np.uint64), np.bitwise_or.reduceat(cand, starts))
    stack = [*_batches(*given)]
    first = 0
    while stack:
        records, lengths, root, items, ext = stack.pop()
        node = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        may = full[records] & ext[node]
        frequent = np.zeros(len(lengths), np.uint64)  # of the items after the one at hand
        found = []
        # From the last item, so that it is known which of the later ones are frequent.
        present = int(np.bitwise_or.reduce(may))
        for j in reversed(range(present.bit_length())):
            bit = _ONE << np.uint64(j)
            if not present >> j & 1:
                continue
            at = np.flatnonzero(may & bit)
            own, of = records[at], node[at]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            n = np.add.reduceat(weight[own], begin)
            enough = n >= minsup
            if not enough.any():
                continue
            lengths = np.diff(begin, append=len(own))
            kept = np.repeat(enough, lengths)
            own, n, lengths, parent = own[kept], n[enough], lengths[enough], of[begin[enough]]
            closure = np.bitwise_and.reduceat(full[own], _starts(lengths))
            later = frequent[parent] & ~closure
            frequent[parent] |= bit
            proper = closure & (bit - _ONE) & ~items[parent] == 0
            if not proper.all():
                own, n, lengths, parent = own[np.repeat(proper, lengths)], n[proper], lengths[proper], parent[proper]
                closure, later = closure[proper], later[proper]
            found.append((own, lengths, root[parent], closure, later, n))
        if not found:
            continue
        own, lengths, above, closure, later, n = (np.concatenate(x) for x in zip(*found, strict=True))
        size = np.bitwise_count(closure)
        shown = size >= least[above]
        if shown.any():
            yield Met(first, above[shown], closure[shown], n[shown], own[np.repeat(shown, lengths)], _starts(lengths[shown]))
        first += int(shown.sum())
        # A proper child has fewer rows.
        inner = (n > minsup) & (later != 0) & (size + np.bitwise_count(later) >= least[above])
        if inner.any():
            stack.extend(_batches(own[np.repeat(inner, lengths)], lengths[inner], above[inner], closure[inner], later[inner]))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _batches(records: np.ndarray, lengths: np.ndarray, *of_nodes: np.ndarray) -> Iterator[tuple]:
    """Nodes in batches of about :data:`BATCH` records."""
    starts = _starts(lengths)
    cuts = np.flatnonzero(np.diff(starts // BATCH, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        end = starts[b] if b < len(starts) else len(records)
        yield records[starts[a] : end], lengths[a:b], *[x[a:b] for x in of_nodes]


def mask_of(items: str, universe: str) -> Column:
    """A bit for each of ``items``, at its place in ``universe``."""

    def bit(item: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position(universe, item) - 1).cast("int"))

    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(bit(i)))


@dataclass(frozen=True)
class Subtrees:
    """The closed sets below nodes that were left to tasks.

    ``roots``    (part, root, bucket_id, universe, place): the nodes, the items below and above, and their bits
    ``records``  (part, root, tid, cand, pre, weight, row set parts): their transaction groups, items as masks

    A part is some roots that are walked at once. Parts are dealt out to ``tasks`` for each walk, along with
    what is asked of their sets.
    """

    roots: DataFrame
    records: DataFrame
    minsup: int
    min_cols: int
    tasks: int
    before: int
    n_parts: int
    row_set: list[str]

    @classmethod
    def dealt(
        cls, roots: DataFrame, records: DataFrame, n_records: int, before: int, minsup: int, min_cols: int, row_set: list[str], stages: Stages
    ) -> Subtrees:
        """Roots and records put into parts, numbered on from ``before``: a few for each task, and as many as the records need."""
        tasks = stages.tasks(n_records)
        n_parts = max(2 * tasks, -(-2 * n_records // NODE_RECORDS))
        part = (before + F.col("root") % n_parts).alias("part")
        roots = roots.select(part, "root", "bucket_id", "universe", "place", "n_above")
        return cls(roots, records.select(part, "*"), minsup, min_cols, tasks, before, n_parts, row_set)

    def _walked(self, records: DataFrame, asked: DataFrame | None, out: Callable, schema: str) -> DataFrame:
        """``out`` over the walk of each part, with its records, roots and what is ``asked`` of it."""
        roots = self.roots if asked is None else self.roots.select("part", "root", "n_above")
        kinds = [(records, 0), (roots, 1)] + ([] if asked is None else [(asked, 2)])
        tagged = [table.withColumn("kind", F.lit(kind)) for table, kind in kinds]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        minsup, min_cols, every = self.minsup, self.min_cols, asked is None

        def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches)
            own, roots, asked = (table.filter(pc.equal(table["kind"], k)).combine_chunks() for k in range(3))
            if not len(own) or not (every or len(asked)):
                return
            own, roots = own.sort_by("root"), roots.sort_by("root")
            starts = np.flatnonzero(np.diff(own["root"].to_numpy(), prepend=-1))
            roots = roots.filter(pc.is_in(roots["root"], own["root"])).combine_chunks()
            least = np.maximum(1, min_cols - roots["n_above"].to_numpy().astype(np.int64))
            part = int(roots["part"][0].as_py()) << _PLACES
            yield from _together(out(part, own, roots if every else asked, starts, minsup, least))

        ship_code(both.sparkSession)
        return both.repartition(self.tasks, "part").groupBy("part").applyInArrow(of_group, schema)

    def _asked(self, concepts: DataFrame, *more: str) -> DataFrame:
        part = F.shiftright("node", _PLACES)
        found = concepts.where((F.col("level") == IN_TASK) & part.between(self.before, self.before + self.n_parts - 1))
        return found.select(part.alias("part"), F.col("node").bitwiseAND((1 << _PLACES) - 1).alias("nth"), *more)

    def sets(self) -> DataFrame:
        """``(level, node, bucket_id, cols, n_cols, n_rows, row_min, ...)`` of all sets."""
        types = dict(self.roots.dtypes) | dict(self.records.dtypes)
        parts = self.row_set
        kinds = [f"{c} {types[c]}" for c in parts]
        schema = f"level int, node bigint, bucket_id {types['bucket_id']}, cols {types['universe']}, n_cols int, n_rows bigint, {', '.join(kinds)}"

        def out(part: int, own: pa.Table, roots: pa.Table, starts: np.ndarray, minsup: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            lists, place = roots["universe"].combine_chunks(), roots["place"].combine_chunks()
            bucket, universe, place = roots["bucket_id"].combine_chunks(), lists.flatten(), place.flatten().to_numpy()
            at, length = lists.offsets.to_numpy()[:-1].astype(np.int64), np.diff(lists.offsets.to_numpy())
            width = int(length.max())
            # Of each root and place in its universe: the bit, the last one if always set, the one before if beyond its end.
            bits = np.full((len(length), width), _BITS + 1)
            bits[np.repeat(np.arange(len(length)), length), _ranges(np.zeros(len(length), np.int64), length)] = np.where(place < 0, _BITS, place)
            merged = [_merging(own[c], c) for c in parts]
            for met in walk(starts, *_masks(own), minsup, least):
                n = len(met.n)
                having = np.zeros((n, _BITS + 2), np.uint8)
                having[:, :_BITS] = np.unpackbits(met.items.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                having[:, _BITS] = 1
                having = np.take_along_axis(having, bits[met.root], axis=1)
                n_cols = having.sum(axis=1, dtype=np.int32)
                of, nth = np.nonzero(having)
                offsets = np.concatenate([[0], np.cumsum(n_cols)]).astype(np.int32)
                cols = pa.ListArray.from_arrays(pa.array(offsets), universe.take(pa.array(at[met.root[of]] + nth)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, IN_TASK, np.int32)),
                        pa.array(part + met.first + np.arange(n)),
                        bucket.take(pa.array(met.root)),
                        cols,
                        pa.array(n_cols),
                        pa.array(met.n),
                        *[m(met) for m in merged],
                    ],
                    names=["level", "node", "bucket_id", "cols", "n_cols", "n_rows", *parts],
                )

        records = self.records.select("part", "root", "cand", "pre", "weight", *parts)
        return self._walked(records, None, out, schema)

    def occurrences(self, concepts: DataFrame) -> DataFrame:
        """``(level, node, tid)`` of the sets among ``concepts``."""

        def out(part: int, own: pa.Table, asked: pa.Table, starts: np.ndarray, minsup: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            chosen = _marks(asked["nth"].to_numpy())
            tid = own["tid"].to_numpy()
            for met in walk(starts, *_masks(own), minsup, least):
                wanted = _of(chosen, met, -1) >= 0
                places = met.places()
                kept = wanted[places]
                yield _batch(level=np.full(int(kept.sum()), IN_TASK, np.int32), node=part + met.first + places[kept], tid=tid[met.records[kept]])

        records = self.records.select("part", "root", "tid", "cand", "pre", "weight")
        return self._walked(records, self._asked(concepts), out, "level int, node bigint, tid bigint")

    def lowest_rows(self, concepts: DataFrame, lowest: DataFrame, k: int) -> DataFrame:
        """``(level, node, row_id)``: the ``k`` lowest rows of the sets among ``concepts``, null first.

        ``lowest`` has the ``k`` lowest ``rows`` of each ``tid`` in order. In the order of these
        the lowest rows of a set are in the first ``k`` of its records.
        """
        kind = dict(lowest.dtypes)["rows"][len("array<") : -1]

        def out(part: int, own: pa.Table, asked: pa.Table, starts: np.ndarray, minsup: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            chosen = _marks(asked["nth"].to_numpy())
            lists = own["rows"].combine_chunks()
            sizes, rows = np.diff(lists.offsets.to_numpy()), lists.flatten()
            known, value = rows.is_valid().to_numpy(zero_copy_only=False), rows.fill_null(0).to_numpy()
            begin = _starts(sizes)
            order = np.lexsort((value[begin], known[begin], own["root"].to_numpy()))
            begin, sizes = begin[order], sizes[order]
            for met in walk(starts, *(m[order] for m in _masks(own)), minsup, least):
                at = np.flatnonzero(_of(chosen, met, -1) >= 0)
                many = np.minimum(met.sizes()[at], k)
                own_records = met.records[_ranges(met.starts[at], many)]
                of = np.repeat(np.repeat(at, many), sizes[own_records])
                row = _ranges(begin[own_records], sizes[own_records])
                sort = np.lexsort((value[row], known[row], of))
                of, row = of[sort], row[sort]
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                kept = np.arange(len(of)) - np.repeat(starts, np.diff(starts, append=len(of))) < k
                of, row = of[kept], row[kept]
                level = pa.array(np.full(len(of), IN_TASK, np.int32))
                yield pa.RecordBatch.from_arrays([level, pa.array(part + met.first + of), rows.take(pa.array(row))], names=["level", "node", "row_id"])

        records = self.records.select("part", "root", "tid", "cand", "pre", "weight").join(lowest, "tid").drop("tid")
        return self._walked(records, self._asked(concepts), out, f"level int, node bigint, row_id {kind}")

    def votes(self, voters: DataFrame) -> DataFrame:
        """``(tid, label, votes)``: how many of the sets among ``voters`` with a label each group is in, added up per part and root."""
        kind = dict(voters.dtypes)["label"]

        def out(part: int, own: pa.Table, asked: pa.Table, starts: np.ndarray, minsup: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            labels = asked["label"].combine_chunks().dictionary_encode()
            chosen = _marks(asked["nth"].to_numpy(), labels.indices.to_numpy())
            n_labels = len(labels.dictionary)
            votes = np.zeros(len(own) * n_labels, np.int64)
            kept, n_kept = [], 0
            for met in walk(starts, *_masks(own), minsup, least):
                label = _of(chosen, met, -1)[met.places()]
                has = label >= 0
                kept.append(met.records[has] * n_labels + label[has])
                n_kept += len(kept[-1])
                if n_kept > len(votes):
                    votes += np.bincount(np.concatenate(kept), minlength=len(votes))
                    kept, n_kept = [], 0
            if n_kept:
                votes += np.bincount(np.concatenate(kept), minlength=len(votes))
            at = np.flatnonzero(votes)
            tid = own["tid"].combine_chunks().take(pa.array(at // n_labels))
            label = labels.dictionary.take(pa.array(at % n_labels))
            yield pa.RecordBatch.from_arrays([tid, label, pa.array(votes[at])], names=["tid", "label", "votes"])

        records = self.records.select("part", "root", "tid", "cand", "pre", "weight")
        return self._walked(records, self._asked(voters, "label"), out, f"tid bigint, label {kind}, votes bigint")


def _masks(own: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return own["cand"].to_numpy().view(np.uint64), own["pre"].to_numpy().view(np.uint64), own["weight"].to_numpy()


def _marks(nth: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
    """By place in the walk, the value or 0 of the sets asked for, and -1 for others."""
    marks = np.full(int(nth.max()) + 1, -1, np.int64)
    marks[nth] = 0 if value is None else value
    return marks


def _of(marks: np.ndarray, met: Met, none: int) -> np.ndarray:
    own = marks[met.first : met.first + len(met.n)]
    return np.concatenate([own, np.full(len(met.n) - len(own), none, np.int64)])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from ``starts``, one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - _starts(lengths), lengths)


def _merging(column: pa.ChunkedArray, name: str) -> Callable[[Met], pa.Array]:
    """A function that merges a row set part of the records of each set met; nulls count for nothing."""
    how, none = {"row_min": (np.minimum, 2**63 - 1), "row_max": (np.maximum, -(2**63))}.get(name, (np.bitwise_xor, 0))
    column = column.combine_chunks()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    value = column.cast("int64").fill_null(none).to_numpy()
    odd = not known.all()

    def merge(met: Met) -> pa.Array:
        merged = how.reduceat(value[met.records], met.starts)
        mask = ~np.logical_or.reduceat(known[met.records], met.starts) if odd else None
        return pa.array(merged, mask=mask).cast(column.type)

    return merge


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same records in batches of :data:`OUT` at least, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= OUT:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
