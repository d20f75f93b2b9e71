"""Conversation structure repair: faults of the rows, and the cheapest edits that mend it.

Rows of a conversation are taken by turn. The order is made by a range partitioning, so a
conversation of any size is cut into fragments, one per partition, each a string of one
letter per row. Block tables (:mod:`bicspark.llm.blocktables`) turn a fragment into a map
from the costs after it to the costs before it; the maps of the fragments at the edges of
partitions, at most two per partition, give every fragment the costs at its right end.
Then all fragments are traced at the same time. Last, the texts stream past their
conversation's edits, in order: one after another only because a hash needs them so.

Only short columns travel until then: a row stands for its text by a digest, and equal
rows are one record with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bicspark.llm import blocktables
from bicspark.plans.stages import Stages

_WHITE = " \t\n\x0b\x0c\r"
#: Letters of rows by initial (system, user, assistant, other): whole, cut short, blank, duplicate.
WHOLE, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "bcde", "BCDE"
_SYMBOLS = str.maketrans(WHOLE + TRUNCATED + BLANK + DUPLICATE, "12345678" + "0" * 8)
_INITIALS = str.maketrans(TRUNCATED + BLANK + DUPLICATE, WHOLE * 3)
_LEGAL = {"su", "ua", "au"}
_ORDER = ["turn", "role", "digest"]
_FRAGMENT = (
    "turn long, role string, digest string, letters string, least_turn long, last_turn long, n_turns long, edge boolean, place int"
)


def rows_of(table: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, times)``: each row once, null roles and texts as one space."""
    return table.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("times"))


def damaged(table: DataFrame) -> DataFrame:
    """Like :func:`rows_of`, with some rows damaged by the crc32 of ``conv_id:turn``.

    Of 20 cases: 0 drops the row (``times`` 0), 1 empties its text, 2 removes its
    sentence ends, 3 repeats it (``times`` 2), 4 makes it the user's.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows_of(table).select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("times"),
    )


def _with_digest(rows: DataFrame) -> DataFrame:
    """Role and text in 128 bits; the length of the role keeps them apart."""
    return rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def lettered(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, letters)``: equal rows together, one letter for each.

    A row is blank, or else a duplicate if its role and text came earlier, or else cut
    short, or whole. The first of equal texts is found by an aggregate, and matched on
    the whole key of a record, so a text that fills a conversation is no hot key.
    """
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    kind = F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)
    records = (
        _with_digest(rows.where("times > 0"))
        .withColumns({"kind": kind, "initial": F.coalesce(F.nullif(F.instr(F.lit(blocktables.INITIALS), initial), F.lit(0)), F.lit(4))})
        .withColumn("initial", F.when(initial == "", 4).otherwise(F.col("initial")))
        .groupBy("conv_id", "turn", "role", "digest", "kind", "initial")
        .agg(F.sum("times").cast("int").alias("times"))
    )
    first = records.where("kind < 2").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("conv_id_"), F.col("first.turn").alias("turn_"), F.col("digest").alias("digest_"))
    match = (
        F.col("conv_id").eqNullSafe(F.col("conv_id_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("digest") == F.col("digest_"))
    )

    def letter(alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), F.col("initial"), F.lit(1))

    fine = F.when(F.col("kind") == 0, letter(WHOLE)).otherwise(letter(TRUNCATED))
    letters = (
        F.when(F.col("kind") == 2, F.repeat(letter(BLANK), F.col("times")))
        .when(F.col("digest_").isNull(), F.repeat(letter(DUPLICATE), F.col("times")))
        .otherwise(F.concat(fine, F.repeat(letter(DUPLICATE), F.col("times") - 1)))
    )
    return records.join(first, match, "left").select("conv_id", *_ORDER, letters.alias("letters"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per conversation of a sorted partition; the first and last are at its edges."""
    waiting: list | None = None  # a conversation that may go on in the next batch
    n = 0

    def record(c: list, last: bool) -> dict:
        nonlocal n
        n += 1
        return {
            "conv_id": c[0], "turn": c[1], "role": c[2], "digest": c[3], "letters": "".join(c[4]), "least_turn": c[5],
            "last_turn": c[6], "n_turns": c[7], "edge": last or n == 1, "place": n,
        }

    schema = None
    for batch in batches:
        schema = schema or pa.schema(
            [batch.schema.field("conv_id"), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("letters", pa.string()),
             ("least_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()), ("edge", pa.bool_()), ("place", pa.int32())]
        )
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", *_ORDER, "letters")]
        for conv, turn, role, digest, letters in zip(*columns):
            if waiting is None or waiting[0] != conv:
                if waiting is not None:
                    out.append(record(waiting, False))
                waiting = [conv, turn, role, digest, [], turn, turn, int(turn is not None)]
            waiting[4].append(letters)
            if turn is not None and turn != waiting[6]:
                waiting[5] = turn if waiting[5] is None else waiting[5]
                waiting[6] = turn
                waiting[7] += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if waiting is not None:
        yield pa.RecordBatch.from_pylist([record(waiting, True)], schema=schema)


def fragments(rows: DataFrame, stages: Stages) -> DataFrame:
    """The conversations' fragments in a written table, with the costs after each.

    ``after`` numbers the vector of costs-to-go at the fragment's right end; ``begins``
    and ``ends`` tell whether it is its conversation's first and last one.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    known = stages.new_table(lettered(rows), "letters")
    ordered = known.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    cut = stages.new_table(ordered.mapInArrow(_cut, f"conv_id {kind}, {_FRAGMENT}"), "cut")

    def turn_into_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocktables.transition(l.translate(_SYMBOLS))[0].tolist() for l in batch.column("letters").to_pylist()]
            kept = [batch.column(c) for c in ("conv_id", *_ORDER)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32()))], names=["conv_id", *_ORDER, "map"])

    edges = cut.where("edge").select("conv_id", *_ORDER, "letters")
    maps = edges.mapInArrow(turn_into_maps, f"conv_id {kind}, turn long, role string, digest string, map array<int>")
    # Per conversation at most one record of each partition. Those after a fragment, from the
    # last to the next one, lead from the end of the conversation to its right end.
    from_here = Window.partitionBy("conv_id").orderBy(*_ORDER).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("conv_id").orderBy(*_ORDER)
    led = F.aggregate(F.reverse(F.collect_list("map").over(from_here)), F.lit(0), lambda at, m: F.get(m, at))
    chained = maps.select(
        F.col("conv_id").alias("conv_id_"),
        F.col("turn").alias("turn_"),
        F.col("digest").alias("digest_"),
        led.alias("after"),
        (F.row_number().over(whole) == 1).alias("begins"),
        F.lead(F.lit(1)).over(whole).isNull().alias("ends"),
    )
    match = (
        F.col("conv_id").eqNullSafe(F.col("conv_id_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("digest") == F.col("digest_"))
    )
    # A fragment inside its partition is a whole conversation.
    inside = cut.where("not edge").withColumns({"after": F.lit(0), "begins": F.lit(True), "ends": F.lit(True)})
    return inside.unionByName(cut.where("edge").join(chained, match).drop("conv_id_", "turn_", "digest_"))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each fragment: from the start state, or from each state it may be entered in."""
    for batch in batches:
        out = {c: [] for c in ("edits", "exits", "costs", "counts", "initials")}
        for letters, after, begins, ends in zip(*[batch.column(c).to_pylist() for c in ("letters", "after", "begins", "ends")]):
            symbols = letters.translate(_SYMBOLS)
            found = [blocktables.trace(symbols, q, after, ends) for q in range(1 if begins else 4)]
            initials = letters.translate(_INITIALS)
            out["edits"].append([e for e, _, _ in found])
            out["exits"].append([q for _, q, _ in found])
            out["costs"].append([c for _, _, c in found])
            out["counts"].append(
                [sum(map(letters.count, BLANK)), sum(map(letters.count, DUPLICATE)), sum(map(letters.count, TRUNCATED)),
                 sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))]
            )
            out["initials"].append(initials[:1] + initials[-1:])
        arrays = [
            pa.array(out["edits"], pa.list_(pa.string())), pa.array(out["exits"], pa.list_(pa.int32())), pa.array(out["costs"], pa.list_(pa.int64())),
            pa.array(out["counts"], pa.list_(pa.int64())), pa.array(out["initials"], pa.string()),
        ]
        kept = ["conv_id", *_ORDER, "least_turn", "last_turn", "n_turns"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], names=[*kept, *out])


def _streams(rows: DataFrame, stages: Stages) -> DataFrame:
    """Fragments with their edits and rows with their texts, in order within a conversation.

    A fragment stands before its first row. Dropped rows come too, so that their
    conversations are known.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    edits = fragments(rows, stages).mapInArrow(
        _traced,
        f"conv_id {kind}, turn long, role string, digest string, least_turn long, last_turn long, n_turns long, "
        "edits array<string>, exits array<int>, costs array<long>, counts array<long>, initials string",
    )
    texts = _with_digest(rows).withColumn("text", F.when((F.col("times") > 0) & (F.rtrim("text", F.lit(_WHITE)) != ""), F.col("text")))
    both = edits.withColumn("row_", F.lit(0)).unionByName(texts.withColumn("row_", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER, "row_")


_STREAM = ["conv_id", "row_", "role", "text", "times", "least_turn", "last_turn", "n_turns", "edits", "exits", "costs", "counts", "initials"]
_ROLES = {blocktables.USER: "user", blocktables.ASSISTANT: "assistant"}


class _Conversation:
    """A conversation while its fragments and rows stream past."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.audit: list[str] = []
        self.counts = [0, 0, 0, 0]
        self.cost = self.n_turns = 0
        self.least_turn = self.last_turn = None
        self.last_initial = ""
        self.state = blocktables.START  # where the edits of the present fragment end
        self.edits, self.at, self.done = "", 0, blocktables.START

    def fragment(self, row: dict) -> None:
        self.edits, self.at = row["edits"][self.state], 0
        self.cost += row["costs"][self.state]
        self.audit.append(self.edits)
        self.state = row["exits"][self.state]
        self.counts = [a + b for a, b in zip(self.counts, row["counts"])]
        if self.last_initial:
            self.counts[3] += self.last_initial + row["initials"][0] not in _LEGAL
        self.last_initial = row["initials"][-1]
        if row["n_turns"]:
            self.n_turns += row["n_turns"] - (self.last_turn == row["least_turn"])
            self.least_turn = row["least_turn"] if self.least_turn is None else self.least_turn
            self.last_turn = row["last_turn"]

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self.done = blocktables._NEXT[self.done]
            yield "I", _ROLES[self.done], ""

    def row(self, role: str, text: str | None, times: int) -> Iterator[tuple[str, str, str]]:
        """The lines (letter, role, text) that a row's edits leave."""
        for _ in range(times):
            yield from self._inserted()
            letter = self.edits[self.at]
            self.at += 1
            if letter == "R":
                self.done = blocktables._NEXT[self.done]
                yield "R", _ROLES[self.done], text
            elif letter == "K":
                self.done = blocktables._KEPT[self.done, blocktables.INITIALS.index(role[0])]
                yield "K", role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, Iterator[tuple[str, str, str]] | None]]:
    """Each conversation with the lines of one row after another; None where it ends."""
    now: _Conversation | None = None
    for batch in batches:
        for values in zip(*[batch.column(c).to_pylist() for c in _STREAM]):
            row = dict(zip(_STREAM, values))
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    yield now, now.end()
                    yield now, None
                now = _Conversation(row["conv_id"])
            if row["row_"]:
                yield now, now.row(row["role"], row["text"], row["times"])
            else:
                now.fragment(row)
    if now is not None:
        yield now, now.end()
        yield now, None


#: Records of a batch that a task sends back.
_BATCH = 10_000


def audit(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.

    Takes :func:`rows_of` or :func:`damaged`. One record per ``conv_id``, null among them,
    also where no row is left: zeros, an empty audit and the hash of an empty text. Rows
    go by turn, nulls first; those of one turn by role and digest of role and text, so
    equal rows are adjacent. A role counts by its first character, and one that is empty
    or begins with another than ``s``, ``u`` or ``a`` can't be kept. Texts are read whole;
    other columns are not read.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        digest, empty, types = hashlib.sha256(), True, None

        def known(batches):
            nonlocal types
            for batch in batches:
                types = types or pa.schema(
                    [batch.schema.field("conv_id"), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())]
                )
                yield batch

        for conversation, lines in _followed(known(batches)):
            if lines is None:
                c = conversation
                gaps = c.last_turn - c.least_turn + 1 - c.n_turns if c.n_turns else 0
                out.append(
                    {"conv_id": c.conv_id, "gaps": gaps, **dict(zip(("blank", "duplicate", "truncated", "illegal"), c.counts)),
                     "cost": c.cost, "audit": "".join(c.audit), "repaired_sha256": digest.hexdigest()}
                )
                digest, empty = hashlib.sha256(), True
                if len(out) >= _BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=types)
                    out = []
                continue
            for _, role, text in lines:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return _streams(rows, Stages(rows.sparkSession)).select(*_STREAM).mapInArrow(summarise, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the lines of the repaired conversations.

    Takes :func:`rows_of` or :func:`damaged`; rows as in :func:`audit`. ``place`` counts
    from 0; ``edit`` is K for a row that is kept, R for one of another role, I for an
    inserted one. Conversations of which nothing is left have no line.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        place, types = 0, None

        def known(batches):
            nonlocal types
            for batch in batches:
                types = types or pa.schema(
                    [batch.schema.field("conv_id"), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
                )
                yield batch

        for conversation, lines in _followed(known(batches)):
            if lines is None:
                place = 0
                continue
            for edit, role, text in lines:
                out.append({"conv_id": conversation.conv_id, "place": place, "edit": edit, "role": role, "text": text})
                place += 1
            if len(out) >= _BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    streams = _streams(rows, Stages(rows.sparkSession)).select(*_STREAM)
    return streams.mapInArrow(spell, f"conv_id {kind}, place long, edit string, role string, text string")
