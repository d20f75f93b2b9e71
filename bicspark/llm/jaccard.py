"""N-gram Jaccard join by a partitioned universe.

Two sets are alike if ``100 |R & S| >= percent |R | S|``. Then their symmetric difference is
at most ``H``, a share of their sizes. Sets are put into size bands so that like sets lie in
the same or in adjacent bands. Each band hashes the tokens into ``H + 1`` segments, so that
like sets agree in at least one segment, and the subset in a segment is a signature.

Allocation by cost: a sketch of how often signatures of a segment collide, over all sets,
tells which segments are crowded. A crowded one is left out against one-deletion
neighbourhoods in a quiet one, where sets then may differ by one token. Bands with very
many segments index the first ``INDEXED`` of them, whatever the sets hold: as tokens fall
at random, like sets agree in over a third of the segments, so that those all differ with
a chance far below that of a hash collision. Choosing them by cost would leave out just
the ones in which groups of copies agree. Small sets use prefixes of their tokens in hash
order.

Sets that share a signature are candidates. Of those with a signature, the anchor is the
one that shares most signatures with others, as the original of many copies does. First
every set is verified, exactly, against the anchor it meets most often, then, where a
signature still has several components, against its other anchors. Of components that are
then still apart, all candidates are verified. Before each round pairs go whose sizes and
sketches allow no link: a sketch has the parity of the tokens in each of its places, so two
of them differ in no more places than the sets differ in tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bicspark.llm import ids as token_ids
from bicspark.llm import shingles
from bicspark.llm.common import free_name, with_row_key
from bicspark.llm.components import components
from bicspark.llm.shingles import mix, sums_by_run
from bicspark.plans.stages import Stages

#: Most segments per set and band of which signatures are indexed.
INDEXED = 128
#: Up to so many segments a band works by prefixes, up to so many by several partitions.
PREFIX_SEGMENTS, REPEATED_SEGMENTS, REPEATS = 8, 32, 3
#: Signatures that one group of the index holds, about.
GROUP = 1 << 20
#: Bits of a set's sketch for each of its tokens, before rounding up to a power of two.
SKETCH = 8
#: Most bits of the filter of wanted sets that goes to all tasks: 8 MB at any number of them.
FILTER_BITS = 1 << 26
#: Members of a signature that are compared at a time.
BLOCK = 2048
#: Records of signatures that one task compares: the more, the fewer pairs come twice.
CELL = 1 << 18
#: Bytes of text that are hashed at a time.
TEXT = 1 << 20
_CLASS = np.uint64((1 << 48) - 1)
_SIGNS = 4


def band_limits(longest: int) -> np.ndarray:
    """The largest size of each band; each is at least 4/3 of the one before."""
    limits = [1]
    while limits[-1] < longest:
        limits.append(-(-limits[-1] * 4 // 3))
    return np.array([*limits, -(-limits[-1] * 4 // 3)], dtype=np.int64)


@dataclass(frozen=True)
class Plan:
    """Bands, and per band the segments left out and those with deletions."""

    percent: int
    limits: np.ndarray
    use: dict[int, np.ndarray] | None = None  # per band: -1, 0 or 1 of each eligible segment

    def segments(self, band: np.ndarray) -> np.ndarray:
        return 2 * self.limits[band] * (100 - self.percent) // (100 + self.percent) + 1

    def signatures(self, tokens: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(signature, set, band, segment, tokens of it) of all sets, by parts.

        ``tokens`` are sorted within each set. A set signs for its own band and the next.
        """
        owner = np.repeat(np.arange(len(counts)), counts)
        own_band = np.searchsorted(self.limits, counts, side="left")
        for higher in (0, 1):
            band = np.minimum(own_band + higher, len(self.limits) - 1)
            m = self.segments(band)
            small = (m <= PREFIX_SEGMENTS)[owner]
            if small.any():
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
                prefix = counts - -(-counts * self.percent // 100) + 1
                at = np.flatnonzero(small & (place < prefix[owner]))
                bands = band[owner[at]]
                yield mix(tokens[at] + _salt(bands, 9, np.zeros_like(bands))), owner[at], None, None, None
            for repeat in range(REPEATS):
                usable = (m > PREFIX_SEGMENTS) & ((repeat == 0) | (m <= REPEATED_SEGMENTS))
                at = np.flatnonzero(usable[owner])
                if not len(at):
                    continue
                own = owner[at]
                token = tokens[at] if repeat == 0 else mix(tokens[at] + np.uint64(repeat))
                if repeat:
                    order = np.lexsort((token, own))
                    token, own = token[order], own[order]
                # Segments rise with the hash, so each is a run of a set's tokens.
                segment = ((token >> np.uint64(32)) * m[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                near = segment < INDEXED
                token, own, segment = token[near], own[near], segment[near]
                if not len(token):
                    continue
                first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (segment[1:] != segment[:-1])))
                sizes = np.diff(np.append(first, len(token)))
                spread = mix(token ^ np.uint64(0x5851F42D4C957F2D))
                subset = sums_by_run(spread, sizes)
                who, where = own[first], segment[first]
                bands = band[who]
                salt = _salt(bands, repeat, where)
                allowed = self._allowed(bands, where)
                yield mix(subset + salt)[allowed >= 0], who[allowed >= 0], bands[allowed >= 0] * 4 + repeat, where[allowed >= 0], sizes[allowed >= 0]
                if (allowed > 0).any():
                    # One token less, where something is left.
                    more = np.repeat((allowed > 0) & (sizes > 1), sizes)
                    less = np.repeat(subset + salt, sizes)[more] - spread[more]
                    yield mix(less), own[more], None, None, None

    def _allowed(self, bands: np.ndarray, segments: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bands), dtype=np.int8)
        for band in np.unique(bands) if self.use else []:
            if (use := self.use.get(int(band))) is not None:
                own = bands == band
                out[own] = use[segments[own]]
        return out


def _salt(bands: np.ndarray, repeat: int, segments: np.ndarray) -> np.ndarray:
    return mix((bands * 16 + repeat).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + segments.astype(np.uint64))


def class_ids(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set by its elements: equal sets have the same."""
    return mix(sums_by_run(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), counts) + counts.astype(np.uint64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in token_ids.chunks(batches, limit=TEXT):
        tokens, counts = shingles.sets(batch.column("text"))
        yield batch, tokens, counts, class_ids(tokens, counts)


def _once(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the first of each distinct, not empty set of a part stands."""
    _, first = np.unique(ids, return_index=True)
    return np.sort(first[counts[first] > 0])


def _chosen(tokens: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.zeros(len(counts), dtype=bool)
    mask[at] = True
    return tokens[np.repeat(mask, counts)], counts[at]


def sketches(tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The parity of the tokens in each place, one binary value per set."""
    places = np.maximum(64, SKETCH * 2 ** np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(places)])
    odd = np.zeros(starts[-1], dtype=np.uint8)
    at = (tokens & np.repeat(places - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(starts[:-1], counts)
    np.add.at(odd, at, 1)
    data = np.packbits(odd & 1, bitorder="little")
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer((starts // 8).astype(np.int32)), pa.py_buffer(data)]
    )


def level(stored: list[bytes]) -> np.ndarray:
    """Sketches as rows of one length: the longer ones are folded, which keeps parities."""
    rows = [np.frombuffer(b, "<u8") for b in stored]
    shortest = min(map(len, rows))
    return np.stack([np.bitwise_xor.reduce(r.reshape(-1, shortest), axis=0) for r in rows])


def possible(size, sizes, sketch, others, percent) -> np.ndarray:
    """Whether links are possible: sketches differ in at most as many places as sets may."""
    least, most = np.minimum(size, sizes), np.maximum(size, sizes)
    apart = np.bitwise_count(others ^ sketch).sum(axis=1, dtype=np.int64)
    return (100 * least >= percent * most) & (apart * (100 + percent) <= (size + sizes) * (100 - percent))


def describe(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, class, sketch)`` of every row; class is null for empty sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, tokens, counts, ids in _texts(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array(ids.view(np.int64), mask=counts == 0),
                    sketches(tokens, counts),
                ],
                names=["doc_id", "n_shingles", "class", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, class long, sketch binary")


def crowding(docs: DataFrame, plan: Plan) -> DataFrame:
    """``(band, segment, sets, tokens, z1..z4)``: per segment how many signatures there are,
    and sums of random signs of them, whose squares estimate the pairs that collide.

    Only bands of which :func:`allocate` may leave segments out.
    """
    bands = np.arange(len(plan.limits))
    weighed = (plan.segments(bands) > REPEATED_SEGMENTS) & (plan.segments(bands) <= INDEXED)
    # A set signs for its own band and the next.
    signing = weighed | np.append(weighed[1:], False)

    def run(batches):
        for _, tokens, counts, ids in _texts(batches):
            at = _once(ids, counts)
            at = at[signing[np.searchsorted(plan.limits, counts[at], side="left")]]
            tokens, counts = _chosen(tokens, counts, at)
            for signature, _, band, segment, sizes in plan.signatures(tokens, counts):
                if band is None:
                    continue
                own = weighed[band // 4]
                signature, band, segment, sizes = (x[own] for x in (signature, band, segment, sizes))
                if not len(band):
                    continue
                keys, code = np.unique(band * INDEXED + segment, return_inverse=True)
                columns = [keys // INDEXED, keys % INDEXED, np.bincount(code), np.bincount(code, sizes).astype(np.int64)]
                for k in range(_SIGNS):
                    sign = 1.0 - 2.0 * ((signature >> np.uint64(k)) & np.uint64(1)).astype(float)
                    columns.append(np.bincount(code, sign).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["band", "segment", "sets", "tokens", *[f"z{k}" for k in range(_SIGNS)]]
    rows = docs.select("text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return rows.groupBy("band", "segment").agg(*[F.sum(n).alias(n) for n in names[2:]])


def allocate(rows: list, plan: Plan) -> Plan:
    """The plan with the segments of medium bands chosen by what they cost.

    ``rows`` is :func:`crowding`'s table: at most ``INDEXED`` records per band.
    """
    cost: dict[int, dict[int, list[float]]] = {}
    for r in rows:
        pairs = max(sum(r[f"z{k}"] ** 2 for k in range(_SIGNS)) / _SIGNS - 4 * r["sets"], 0) / 2
        own = cost.setdefault(r["band"] // 4, {}).setdefault(r["segment"], [0.0, 0.0])
        own[0] += pairs
        own[1] += r["tokens"]
    use = {}
    for band, segments in cost.items():
        n = int(plan.segments(np.array([band]))[0])
        pairs = np.array([segments.get(k, [0, 0])[0] for k in range(n)])
        tokens = np.array([segments.get(k, [0, 0])[1] for k in range(n)])
        order = np.lexsort((np.arange(n), pairs))
        out = np.zeros(n, dtype=np.int8)
        for quiet, crowded in zip(order[: n // 2], order[::-1]):
            # Leave one out if its pairs cost more than the other's deletions.
            if pairs[crowded] <= tokens[quiet] + pairs[quiet]:
                break
            out[crowded], out[quiet] = -1, 1
        use[band] = out
    return Plan(plan.percent, plan.limits, use)


def index(docs: DataFrame, plan: Plan, n_groups: int) -> DataFrame:
    """``(signature, class, members)`` of all signatures that more than one class has.

    Signatures travel as packed arrays, ten bytes each, by groups of about ``GROUP``. The
    class is its lower 48 bits here; ``members`` is the number of classes of a signature.
    """
    bits = max(n_groups - 1, 0).bit_length()

    def sign(batches):
        for _, tokens, counts, ids in _texts(batches):
            at = _once(ids, counts)
            tokens, counts = _chosen(tokens, counts, at)
            classes = ids[at] & _CLASS
            found = [(s, classes[who]) for s, who, *_ in plan.signatures(tokens, counts)]
            if not found:
                continue
            signature, owner = (np.concatenate(x) for x in zip(*found))
            group = (signature >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(signature), np.int64)
            order = np.argsort(group, kind="stable")
            signature, owner, group = signature[order], owner[order], group[order]
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            packed = np.empty((len(signature), 10), dtype=np.uint8)
            packed[:, :4] = (signature & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)
            packed[:, 4:] = owner.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            offsets = (np.append(cuts, len(signature)) * 10).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group[cuts]),
                    pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]),
                ],
                names=["group", "packed"],
            )

    def collide(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        packed = np.concatenate([np.frombuffer(b.as_py(), np.uint8) for b in table.column("packed")]).reshape(-1, 10)
        signature = np.ascontiguousarray(packed[:, :4]).view("<u4").ravel()
        order = np.argsort(signature, kind="stable")
        signature = signature[order]
        same = signature[1:] == signature[:-1]
        shared = np.append(False, same) | np.append(same, False)
        signature, order = signature[shared].astype(np.int64), order[shared]
        owner = np.zeros((len(order), 8), dtype=np.uint8)
        owner[:, :6] = packed[order, 4:]
        owner = owner.view("<i8").ravel()
        order = np.lexsort((owner, signature))
        signature, owner = signature[order], owner[order]
        fresh = np.append(True, (signature[1:] != signature[:-1]) | (owner[1:] != owner[:-1]))[: len(owner)]
        signature, owner = signature[fresh], owner[fresh]
        first = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))[: len(signature)]
        sizes = np.diff(np.append(first, len(signature)))
        keep = np.repeat(sizes > 1, sizes)
        members = np.repeat(sizes, sizes)[keep]
        return pa.table({"signature": (signature[keep] + (group << 32)), "class": owner[keep], "members": members})

    packed = docs.select("text").mapInArrow(sign, "group long, packed binary")
    return packed.groupBy("group").applyInArrow(collide, "signature long, class long, members long")


def _key_filter(keys: DataFrame, n_keys: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whether longs may be among ``keys (key)``; goes to all tasks, with two bits for each key."""
    bits = min(FILTER_BITS, 1 << max(10, (8 * n_keys).bit_length()))
    places = keys.select(F.explode(F.array(*[F.col("key") if not k else F.shiftright("key", k) for k in (0, 20)])).alias("at"))
    places = places.select(F.pmod("at", F.lit(bits)).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")
    ).toPandas()
    filled = np.zeros(bits // 64, dtype=np.int64)
    filled[words["word"].to_numpy(dtype=np.int64)] = words["mask"].to_numpy(dtype=np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    def may_be(longs: np.ndarray) -> np.ndarray:
        found = np.ones(len(longs), dtype=bool)
        for k in (0, 20):
            at = (longs >> k) % bits
            found &= (shared.value[at >> 6] >> (at & 63)) & 1 == 1
        return found

    return may_be


def wanted_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """``(key, class, set)`` of the distinct sets whose 48-bit key is in ``wanted (key)``.

    Texts are hashed again only of documents whose ``doc_id`` may be one that ``classes``
    names as a ``holder`` of a wanted set. What the filters let through too, the join takes out.
    """
    may_be = _key_filter(wanted, n_wanted)
    holders = classes.join(wanted, "key", "left_semi").select(F.col("holder").alias("key"))
    may_hold = _key_filter(holders, n_wanted)

    def held(batches):
        for batch in batches:
            found = may_hold(batch.column("holder").to_numpy())
            if found.any():
                yield batch.filter(pa.array(found))

    def run(batches):
        for _, tokens, counts, ids in _texts(held(batches)):
            at = _once(ids, counts)
            keys = (ids[at] & _CLASS).astype(np.int64)
            found = may_be(keys)
            at, keys = at[found], keys[found]
            tokens, sizes = _chosen(tokens, counts, at)
            offsets = np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(tokens))])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[at].view(np.int64)), data], names=["key", "class", "set"])

    rows = docs.select("text", F.xxhash64("doc_id").alias("holder")).mapInArrow(run, "key long, class long, set binary")
    return rows.join(wanted, "key", "left_semi").groupBy("key", "class").agg(F.first("set").alias("set"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links ``(a, b)`` by full class, of the candidate ``pairs (key, anchor)``.

    An anchor's partners are cut into groups of about 64, each with a copy of its set.
    """
    degree = pairs.groupBy("anchor").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts"))
    members = pairs.join(sets, "key").join(degree, "anchor").select(
        "anchor", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "class", "set"
    )
    anchors = degree.join(sets, degree["anchor"] == sets["key"]).select(
        "anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "class", "set"
    )

    def check(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        classes = table.column("class").to_numpy()
        data = [np.frombuffer(s.as_py(), "<u8") for s in table.column("set")]
        found = []
        for j in np.flatnonzero(role == 0):
            for i in np.flatnonzero(role == 1):
                if alike(data[i], data[j], percent):
                    found.append((classes[i], classes[j]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return members.unionByName(anchors).groupBy("anchor", "part").applyInArrow(check, "a long, b long")


def alike(r: np.ndarray, s: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    small, large = (r, s) if len(r) <= len(s) else (s, r)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(r) + len(s) - common)


def anchored(postings: DataFrame) -> DataFrame:
    """``(signature, class, anchor, members)``: the anchor is the signature's most shared class."""
    weights = postings.groupBy("class").agg(F.sum("members").alias("weight"))
    heads = postings.join(weights, "class").groupBy("signature").agg(
        F.max_by("class", F.struct("weight", "class")).alias("anchor")
    )
    return postings.join(heads, "signature").select("signature", "class", "anchor", "members")


def apart(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings with ``component`` and the anchor's, ``head``; ``groups`` has ``(key, component)``
    of the classes linked so far."""
    own = groups.select(F.col("key").alias("class"), "component")
    heads = groups.select(F.col("key").alias("anchor"), F.col("component").alias("head"))
    return postings.join(own, "class", "left").join(heads, "anchor", "left").select(
        "signature", "class", "anchor", "members",
        F.coalesce("component", "class").alias("component"), F.coalesce("head", "anchor").alias("head"),
    )


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs (key, anchor)`` whose sizes and sketches allow a link."""
    one = classes.select("key", F.col("n_shingles").alias("n1"), F.col("sketch").alias("s1"))
    two = classes.select(F.col("key").alias("anchor"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("s2"))

    def keep(batches):
        for batch in batches:
            found = []
            for n1, n2, s1, s2 in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "s1", "s2"))):
                both = level([s1, s2])
                found.append(bool(possible(n1, np.array([n2]), both[0], both[1:], percent)[0]))
            yield batch.select(["key", "anchor"]).filter(pa.array(found, pa.bool_()))

    both = pairs.join(one, "key").join(two, "anchor").select("key", "anchor", "n1", "n2", "s1", "s2")
    return both.mapInArrow(keep, "key long, anchor long").distinct()


def open_pairs(placed: DataFrame, n_placed: int, classes: DataFrame, percent: int) -> DataFrame:
    """``(key, anchor)``: pairs that share a signature, lie in different components and may
    be linked by their sizes and sketches. ``placed`` is :func:`apart`'s table."""
    mixed = placed.where("component != head").select("signature").distinct()
    # Blocks of a crowded signature meet pair by pair.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = placed.join(mixed, "signature", "left_semi").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("signature", "class", "component", "block", other).withColumn("low", F.least("block", "other"))
    rows = rows.withColumn("high", F.greatest("block", "other"))
    cell = F.pmod(F.xxhash64("signature", "low", "high"), F.lit(max(1, n_placed // CELL))).alias("cell")
    # A class brings its sketch once to each cell, with its places there.
    members = rows.groupBy(cell, "class").agg(
        F.first("component").alias("component"), F.collect_list(F.struct("signature", "low", "high", "block")).alias("places")
    )
    members = members.join(classes.select(F.col("key").alias("class"), "n_shingles", "sketch"), "class")

    def meet(table: pa.Table) -> pa.Table:
        names, component, size = (table.column(c).to_numpy() for c in ("class", "component", "n_shingles"))
        sketch = table.column("sketch").to_pylist()
        lists = table.column("places").combine_chunks()
        who = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
        signature, low, high, block = (lists.flatten().field(c).to_numpy() for c in ("signature", "low", "high", "block"))
        order = np.lexsort((block, high, low, signature))
        who, block = who[order], block[order]
        keys = np.stack([signature, low, high])[:, order]
        cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        found = []
        for first, last in zip(cuts, np.append(cuts[1:], len(order))):
            own = who[first:last]
            if (component[own] == component[own[0]]).all():
                continue
            inner, of = keys[1, first] == keys[2, first], block[first:last]
            rows = level([sketch[k] for k in own])
            for i in range(len(own) - 1 if inner else int((of == keys[1, first]).sum())):
                rest = np.arange(i + 1, len(own))
                apart_ = component[own[rest]] != component[own[i]]
                rest = rest[apart_ if inner else apart_ & (of[rest] != of[i])]
                if len(rest):
                    rest = rest[possible(size[own[i]], size[own[rest]], rows[i], rows[rest], percent)]
                    found += [(names[own[i]], names[own[j]]) for j in rest]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        if len(pairs):
            pairs = np.unique(np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1), axis=0)
        return pa.table({"key": pairs[:, 0], "anchor": pairs[:, 1]})

    return members.groupBy("cell").applyInArrow(meet, "key long, anchor long").distinct()


def join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row, linked at ``percent`` or more.

    Null and blank texts have no shingles and link with nothing: their ``component_id``
    is their own ``doc_id``. Repeated rows and equal texts are one set, linked with each
    other. A component's id is its smallest ``doc_id`` that is not null, or null if it
    has none. An empty table gives no rows.
    """
    stages = Stages(docs.sparkSession)
    described, seen = stages.observed_table(
        describe(docs), "described", longest=F.max("n_shingles"), total=F.sum(F.least("n_shingles", F.lit(2 * INDEXED)))
    )
    key = F.col("class").bitwiseAND(F.lit(int(_CLASS))).alias("key")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    if seen["longest"]:
        plan = Plan(percent, band_limits(seen["longest"]))
        plan = allocate(crowding(docs, plan).collect(), plan)  # bounded by bands
        n_groups = max(1, seen["total"] // GROUP)
        shared = stages.table(index(docs, plan, n_groups), "shared")
        postings = stages.table(anchored(shared), "postings")
        classes = stages.table(
            described.where(F.col("class").isNotNull()).groupBy(key, "class").agg(
                F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
                F.xxhash64(F.min("doc_id")).alias("holder"),
            ).join(shared.select(F.col("class").alias("key")).distinct(), "key", "left_semi"),
            "classes",
        )
        met = postings.where(F.col("class") != F.col("anchor")).groupBy("class", "anchor").agg(F.count("*").alias("n"))
        best = F.max_by("anchor", F.struct("n", -F.col("anchor"))).alias("anchor")
        pairs = met.groupBy("class").agg(best).select(F.col("class").alias("key"), "anchor")
        pairs = stages.table(plausible(pairs, classes, percent), "pairs-0")
        found = _verified(docs, classes, pairs, percent, stages, "round-0")
        for round_ in (1, 2):
            placed, n_placed = _placed(postings, found, stages, f"placed-{round_}")
            if round_ == 1:
                more = placed.where("component != head").select(F.col("class").alias("key"), "anchor").distinct()
                more = plausible(more.join(pairs, ["key", "anchor"], "left_anti"), classes, percent)
            else:
                known = pairs.unionByName(pairs.select(F.col("anchor").alias("key"), F.col("key").alias("anchor")))
                more = open_pairs(placed, n_placed, classes, percent).join(known, ["key", "anchor"], "left_anti")
            more = stages.table(more, f"pairs-{round_}")
            found = found.unionByName(_verified(docs, classes, more, percent, stages, f"round-{round_}"))
            pairs = pairs.unionByName(more)
            stages.drop(f"placed-{round_}")
        links = found
        stages.drop("shared", "postings")
    linked = stages.table(components(links, stages), "components")
    named = described.join(linked, described["class"] == linked["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class").alias("component")
    )
    smallest = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def _placed(postings: DataFrame, found: DataFrame, stages: Stages, name: str) -> tuple[DataFrame, int]:
    """:func:`apart` for the links found so far, of signatures with several components."""
    low = F.lit(int(_CLASS))
    joined = components(found, stages).select(
        F.col("id").bitwiseAND(low).alias("key"), F.col("component").bitwiseAND(low).alias("component")
    )
    every = stages.table(apart(postings, stages.table(joined, f"{name}-groups")), f"{name}-every")
    mixed = every.where("component != head").select("signature").distinct()
    placed, seen = stages.observed_table(every.join(mixed, "signature", "left_semi"), name, n=F.count("*"))
    stages.drop(f"{name}-every")
    return placed, seen["n"]


def _verified(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, stages: Stages, name: str
) -> DataFrame:
    """The links among the pairs, as a stage table."""
    wanted, seen = stages.observed_table(
        pairs.select("key").unionByName(pairs.select(F.col("anchor").alias("key"))).distinct(), f"{name}-wanted", n=F.count("*")
    )
    if not seen["n"]:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    sets = stages.table(wanted_sets(docs, classes, wanted, seen["n"]), f"{name}-sets")
    links = stages.table(verify(pairs, sets, percent), f"{name}-links")
    stages.drop(f"{name}-wanted", f"{name}-sets")
    return links


def representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents of which one per group stays: that with the group's smallest id.

    Rows are told apart by a key of their own, not by ``doc_id``: of a group of like texts
    one row stays, whatever ids they have, and unlike texts with one id all stay. An id that
    is null comes last. Texts without shingles stay, but of those with one ``doc_id`` one.
    """
    row = free_name("row", docs.columns)
    stages = Stages(docs.sparkSession)
    keyed = with_row_key(docs, row, stages)
    found = join(keyed.select(F.col(row).alias("doc_id"), "text"), percent).withColumnRenamed("doc_id", row)
    blank = F.col("n_shingles") == 0
    groups = [
        F.when(~blank, F.col("component_id")),
        F.when(blank, F.col("doc_id")),
        F.when(blank & F.col("doc_id").isNull(), F.col(row)),
    ]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
    kept = found.join(keyed.select(row, "doc_id"), row).groupBy(*[g.alias(f"group_{k}") for k, g in enumerate(groups)]).agg(first)
    kept = stages.table(kept.select(F.col(f"first.{row}").alias(row)), "kept")
    return keyed.join(kept, row, "left_semi").select(*docs.columns)
