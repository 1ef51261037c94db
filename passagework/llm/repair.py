"""Faults of conversations and their cheapest repair, by the auction algorithm of `auction.py`.

Turns are dealt into ranges of (conversation, turn), so that a conversation of any length spreads over many tasks. What
the algorithm reads of a turn is one byte. A conversation that lies in one range, as nearly all do, is solved there; of
one that is cut, each piece tells what it costs to cross it from each state to each, the few costs of its pieces are
added up from the last to the first, and each piece is then solved with what follows it priced in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.auction import ASSISTANT, ENDS, KEPT, NEXT, START, STATES, cheapest, crossing
from passagework.llm.common import mapped
from passagework.session import materialise

BLANKS = " \t\n\x0b\x0c\r"
ROLE_OF = {2: "user", ASSISTANT: "assistant"}
#: Tasks that look for the first of many equal turns.
SALTS = 16


class Repair(NamedTuple):
    """Per conversation its faults, edits and cost; and the turns after the repair."""

    conversations: DataFrame  # conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  # conv_id, part, place, edit, role, text: in order of part and place


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it with the same turn, 4 makes its
    role user. Nulls count as one space, in the key as in role and text. Repeated rows are damaged alike.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), fault.alias("fault")).where("fault <> 0")
        .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
        .withColumn("again", F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("again", "fault")
    )


def conversation_key(column: str = "conv_id"):
    """A conv_id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def in_order(rows: DataFrame) -> DataFrame:
    """Stored (conv, conv_id, turn, role, text, id): `id` grows with conversation and turn; its high bits are the range."""
    named = rows.select(
        conversation_key().alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    order = ["conv", "turn", "role", "text", "spread"]  # the last lets even equal rows fall into several ranges
    dealt = named.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(dealt.withColumn("id", F.monotonically_increasing_id()).drop("spread"))


def coded(turns: DataFrame) -> DataFrame:
    """(conv, part, id, turn, initial, blank, duplicate, truncated, code) of stored turns, without their texts."""
    kept = F.rtrim("text", F.lit(BLANKS))
    seen = turns.select(
        "conv", F.shiftright("id", 33).alias("part"), "id", "turn", F.substring("role", 1, 1).alias("initial"),
        (kept == "").alias("blank"), (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat_ws("\x00", "conv", F.length("role").cast("string"), "role", "text"), 256).alias("said"),
    ).withColumn("salt", F.pmod("id", F.lit(SALTS)))
    # The first of equal turns has the least id; a turn that very many repeat is looked at by several tasks.
    some = seen.groupBy("said", "salt").agg(F.min("id").alias("first"))
    first = some.withColumn("first", F.min("first").over(Window.partitionBy("said")))
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return (
        seen.join(first, ["said", "salt"])
        .withColumn("duplicate", ~F.col("blank") & (F.col("id") > F.col("first")))
        .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
        .withColumn("code", F.when(F.col("blank") | F.col("duplicate"), role + 8).when(F.col("truncated"), role + 4).otherwise(role))
        .select("conv", "part", "id", "turn", "initial", "blank", "duplicate", "truncated", "code")
    )


def pieces_of(rows: DataFrame) -> DataFrame:
    """One row for each piece (conv, part): its codes in order and what it adds to the counts of its conversation."""
    line = Window.partitionBy("conv", "part").orderBy("id")
    pair = F.concat(F.lag("initial").over(line), F.col("initial"))
    near = rows.withColumn("illegal", (~pair.isin("su", "ua", "au")).cast("long")).withColumn("fresh", ~F.col("turn").eqNullSafe(F.lag("turn").over(line)))
    count = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    pieces = near.groupBy("conv", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]).alias("codes"),
        F.min("id").alias("first_id"), F.count("*").alias("n_turns"), *count, F.coalesce(F.sum("illegal"), F.lit(0)).alias("illegal"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum((F.col("fresh") & F.col("turn").isNotNull()).cast("long")).alias("numbers"),
        F.min_by("initial", "id").alias("opens"), F.max_by("initial", "id").alias("closes"),
    )
    # A conversation has one piece in each range at most.
    order, whole = Window.partitionBy("conv").orderBy("part"), Window.partitionBy("conv")
    joint = F.concat(F.lag("closes").over(order), F.col("opens"))
    return (
        pieces.withColumn("illegal", F.col("illegal") + F.coalesce((~joint.isin("su", "ua", "au")).cast("long"), F.lit(0)))
        .withColumn("numbers", F.col("numbers") - F.coalesce((F.lag("high").over(order) == F.col("low")).cast("long"), F.lit(0)))
        .withColumn("last", F.lead("part").over(order).isNull()).withColumn("alone", F.count("*").over(whole) == 1)
    )


WAYS = "conv string, part long, entry int, exit int, cost long, letters string"


def ways(pieces: DataFrame, states: tuple[int, ...]) -> DataFrame:
    """The cheapest way through each piece (conv, part, codes, last, exits) from each of `states`; no exits: the conversation's end."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, part, codes, last, exits in zip(*[b.column(c).to_pylist() for c in ("conv", "part", "codes", "last", "exits")], strict=True):
                found = cheapest(bytes(codes), ENDS if last else tuple(exits), last, states)
                out += [(conv, part, q, w[2], w[0], w[1]) for q, w in zip(states, found, strict=True) if w is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, SOLVED, strict=True)], ["conv", "part", "entry", "exit", "cost", "letters"]
            )

    return pieces.select("conv", "part", "codes", "last", "exits").transform(mapped, solve, WAYS)


SOLVED = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())


def cut_ways(pieces: DataFrame) -> DataFrame:
    """The ways (as `ways`, one row a piece) through conversations of several pieces."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [
                [c for row in crossing(bytes(codes), last) for c in row]
                for codes, last in zip(b.column("codes").to_pylist(), b.column("last").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), pa.array(made, pa.list_(pa.int64()))], ["conv", "part", "costs"])

    def price(group: pd.DataFrame) -> pd.DataFrame:
        # Sixteen costs a piece, as many pieces as the turns have ranges at most.
        group = group.sort_values("part")
        after: list[int | None] = [0] * STATES
        exits: list[list[int | None]] = []
        for k, costs in enumerate(reversed(group["costs"].tolist())):
            exits.append(list(after))
            paid = [None if c is None or c != c else int(c) for c in costs]
            if k == 0:  # the last piece's costs include the end
                after = [paid[q * STATES] for q in range(STATES)]
            else:
                sums = [[paid[q * STATES + t] + after[t] for t in range(STATES) if paid[q * STATES + t] is not None and after[t] is not None] for q in range(STATES)]
                after = [min(s, default=None) for s in sums]
        return pd.DataFrame({"conv": group["conv"], "part": group["part"], "exits": exits[::-1]})

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        # At most four rows a piece, none with letters.
        step = {(p, e): x for p, e, x in zip(group["part"], group["entry"], group["exit"], strict=True)}
        parts, state, taken = sorted(set(group["part"])), START, []
        for p in parts:
            taken.append(state)
            state = step[p, state]
        return pd.DataFrame({"conv": group["conv"].iloc[0], "part": parts, "entry": taken})

    costs = pieces.select("conv", "part", "codes", "last").transform(mapped, cross, "conv string, part long, costs array<long>")
    exits = costs.groupBy("conv").applyInPandas(price, "conv string, part long, exits array<long>")
    found = materialise(ways(pieces.drop("exits").join(exits, ["conv", "part"]), tuple(range(STATES))))
    chosen = found.select("conv", "part", "entry", "exit").groupBy("conv").applyInPandas(follow, "conv string, part long, entry int")
    return found.join(chosen, ["conv", "part", "entry"]).select("conv", "part", "entry", "exit", "cost", "letters")


def steps_of(solved: DataFrame) -> DataFrame:
    """(conv, part, place, edit, id, role) of each turn that stays or comes in: role only where it is set, id only of a given turn."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "part", "place", "edit", "id", "role"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            out: list[tuple] = []
            for conv, part, first, codes, state, letters in zip(
                *[b.column(c).to_pylist() for c in ("conv", "part", "first_id", "codes", "entry", "letters")], strict=True
            ):
                at = 0
                for place, letter in enumerate(letters):
                    if letter == "K":
                        state = KEPT[state][codes[at] & 3]
                        out.append((conv, part, place, letter, first + at, None))
                    elif letter != "D":
                        state = NEXT[state]
                        out.append((conv, part, place, letter, first + at if letter == "R" else None, ROLE_OF[state]))
                    at += letter != "I"
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types, strict=True)], names)

    return mapped(solved, walk, "conv string, part long, place long, edit string, id long, role string")


def repair_conversations(rows: DataFrame) -> Repair:
    """Faults and the cheapest repair of each conversation of `rows` (conv_id, turn, role, text).

    Turns are taken by turn (nulls first), then role and text. A turn is blank if nothing in its text is beyond
    blanks, else duplicate if an earlier turn has its role and text, else truncated if the text doesn't end with `.`, `!`
    or `?`. `gaps` counts the numbers missing between the first and last turn, `illegal` the neighbours whose
    roles don't begin with su, ua or au. The repair leaves nothing, or an optional system turn and then
    user and assistant turns by turns, at least cost; among equals the letters (Delete, Insert, Keep, Rerole) that sort first.
    Null roles and texts count as one space, a null conv_id is a conversation, repeated rows are duplicates. Empty
    tables give no rows; further columns are not read.
    """
    turns = in_order(rows)
    pieces = materialise(pieces_of(coded(turns)))
    plain = pieces.withColumn("exits", F.lit(None).cast("array<long>"))
    solved = ways(plain.where("alone"), (START,))
    cut = plain.where("not alone")
    if not cut.isEmpty():
        solved = solved.unionByName(cut_ways(cut))
    solved = materialise(solved.join(pieces.select("conv", "part", "first_id", "codes"), ["conv", "part"]))
    counts = pieces.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("n_turns", "blank", "duplicate", "truncated", "illegal")],
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("numbers"), F.lit(0)).alias("gaps"),
    )
    paid = solved.groupBy("conv").agg(
        F.min_by("cost", "part").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"]), "").alias("audit"),
    )
    names = turns.select("conv", "conv_id").distinct()
    conversations = counts.join(paid, "conv").join(names, "conv").drop("conv")
    steps = steps_of(solved.select("conv", "part", "first_id", "codes", "entry", "letters"))
    repaired = (
        steps.join(turns.select("id", F.col("role").alias("own"), "text"), "id", "left").join(names, "conv")
        .select("conv_id", "part", "place", "edit", F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    )
    return Repair(conversations, repaired)


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256): the digest of each conversation's lines `role:text`, joined by newlines.

    Lines are hashed as they stream by in order, so a conversation is never held whole; the sort that orders them spills.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, found = None, None, []
        for b in batches:
            for conv, role, text in zip(*[b.column(c).to_pylist() for c in ("conv", "role", "text")], strict=True):
                if conv != own or sha is None:
                    if sha is not None:
                        found.append((own, sha.hexdigest()))
                    own, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["conv", "sha256"])
            found = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv", "sha256"])

    placed = turns.withColumn("conv", conversation_key()).repartition("conv").sortWithinPartitions("conv", "part", "place")
    return placed.select("conv", "role", "text").transform(mapped, digest, "conv string, sha256 string")


def repair_digests(given: DataFrame, damaged: DataFrame) -> DataFrame:
    """The faults, cost, audit and digest of every conv_id of `given` after the repair of `damaged`; one without turns has none."""
    made = repair_conversations(damaged)
    told = made.conversations.withColumn("conv", conversation_key()).drop("conv_id")
    named = given.select("conv_id").distinct().withColumn("conv", conversation_key())
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.join(told, "conv", "left").join(turn_digests(made.turns), "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
