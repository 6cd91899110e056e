"""Conversation structure repair by a square-root checkpointed dynamic program.

The messages of a conversation, by turn, are brought to the role order
``(system? (user assistant)+)?`` by the cheapest edits: Keep (0), Rerole to
user or assistant (3), Delete (4; the only edit of blank and repeated
messages), Insert an empty message of user or assistant (3); a truncated
message that stays adds 3. Among equally cheap edit lists the one whose
initials are ASCII-least is taken.

* ``costs_before`` gives, for a message and the costs of all four states of
  the role order behind it, the costs before it. A backward pass keeps these
  vectors only at checkpoints, every sqrt(n) messages (``Walk``); a forward
  pass recomputes the vectors of one block at a time and emits, from the state
  it is in, the ASCII-least edit that stays tight.
* Rows are sorted by range partitions of (conversation, turn, role, start of
  the text). A conversation that lies inside one partition is repaired there.
  One that crosses a partition's edge, or has more than ``PIECE_ROWS`` rows or
  ``PIECE_BYTES`` of text, is cut into pieces and repaired by pieces: each
  piece gives the least costs from any state at its start to any at its end,
  these are folded from the last piece to the first (one short row a piece) and
  give every piece the cost vector behind it, its own checkpoint; each piece is
  then walked from all four states, and a fold over the pieces picks the walk
  that continues the one before. So a conversation of any length is spread over
  tasks; only its digest, which SHA-256 defines as a sequence, is streamed
  through one task, in batches.

Cases: null roles and texts count as one space (no role, a blank message); null
turns come first; null conv_ids are one conversation; empty and long texts are
messages like others; ties of turn are taken by role, then text, so repeated
rows stand together and all but the first are duplicates; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from navlens.llm.common import SPACE_CHARS, text_partitions, written

PIECE_ROWS = 4096
PIECE_BYTES = 16 << 20

# States of the role order: nothing yet, after system, after user, after assistant (or nothing: the end is allowed).
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEXT_STATE = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
NEVER = 1 << 40
#: Cost to finish from each state behind the last message.
AT_END = (0, 2 * INSERT, INSERT, 0)
FINE, CUT_OFF, MUST_GO = range(3)

Costs = tuple[int, int, int, int]


def code_of(initial: str, fault: int) -> int:
    """A message as one byte: its role's initial (s, u, a, other) and its fault."""
    return 3 * "sua".find(initial) + fault if initial and initial in "sua" else 9 + fault


def after_keep(state: int, initial: int) -> int | None:
    """The state behind a kept message."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


@lru_cache(maxsize=None)
def moves(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(initial, cost, next state) of the edits of a message, in the order of their initials."""
    initial, fault = divmod(code, 3)
    out = [("D", DELETE, state)]
    if fault != MUST_GO:
        more = TRUNCATED if fault == CUT_OFF else 0
        kept = after_keep(state, initial)
        if kept is not None:
            out.append(("K", KEEP + more, kept))
        out.append(("R", REROLE + more, NEXT_STATE[state]))
    return tuple(out)


def _scaled(costs: Iterable[int]) -> tuple[Costs, int]:
    """Costs above their least, and the least: few different vectors are left, so steps are remembered."""
    costs = tuple(costs)
    low = min(costs)
    return tuple(c - low if c < NEVER else NEVER for c in costs), low


@lru_cache(maxsize=200_000)
def costs_before(code: int, behind: Costs) -> tuple[Costs, int]:
    """Costs before a message from those behind it, scaled, and the amount that scaling took off."""
    own = [min(cost + behind[to] for _, cost, to in moves(code, q)) for q in range(4)]
    once = [min(own[q], INSERT + own[NEXT_STATE[q]]) for q in range(4)]
    return _scaled(min(once[q], INSERT + once[NEXT_STATE[q]]) for q in range(4))


def costs_at_start(codes: bytes, behind: Costs) -> tuple[Costs, int]:
    total = 0
    for code in reversed(codes):
        behind, low = costs_before(code, behind)
        total += low
    return behind, total


class Walk:
    """The cheapest edits of a list of messages before given costs: vectors are kept at every sqrt(n)-th place only."""

    def __init__(self, codes: bytes, behind: Costs):
        self.codes, self.block = codes, isqrt(len(codes)) + 1
        behind, self.cost = _scaled(behind)
        self.kept = {len(codes): behind}
        for i in range(len(codes) - 1, -1, -1):
            behind, low = costs_before(codes[i], behind)
            self.cost += low
            if i % self.block == 0:
                self.kept[i] = behind
        self.start = behind

    def edits(self, states: list[int]) -> tuple[list[str], list[int]]:
        """From each of the given states: the initials of the edits, and the state behind the last message."""
        out, states = [[] for _ in states], list(states)
        n = len(self.codes)
        for first in range(0, n, self.block):
            last = min(n, first + self.block)
            behind = [self.kept[last]]
            for i in range(last - 1, first, -1):
                behind.append(costs_before(self.codes[i], behind[-1])[0])
            for i in range(first, last):
                after = behind[last - 1 - i]
                before, low = costs_before(self.codes[i], after)
                for k, q in enumerate(states):
                    states[k] = self._edit(out[k], self.codes[i], q, before, low, after)
        return ["".join(o) for o in out], states

    @staticmethod
    def _edit(out: list[str], code: int, q: int, before: Costs, low: int, after: Costs) -> int:
        while True:
            want = before[q] + low
            choices = {letter: to for letter, cost, to in moves(code, q) if cost + after[to] == want}
            if "D" not in choices and INSERT + before[NEXT_STATE[q]] + low == want:
                out.append("I")
                q = NEXT_STATE[q]
                continue
            letter = min(choices)
            out.append(letter)
            return choices[letter]


def closing(state: int) -> str:
    return "I" * (AT_END[state] // INSERT)


def replay(audit: str, messages: Iterable[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of every message that the edits leave."""
    rows = iter(messages)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = after_keep(state, "sua".index(role[0]))
        else:
            role, state = NEXT_ROLE[state], NEXT_STATE[state]
        yield role, text


# --- facts of a list of messages ----------------------------------------------------------------------------------

_FACTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
_ALLOWED = {"su", "ua", "au"}


def facts(turns: list, roles: list[str], tails: list[str], repeated: list[bool]) -> tuple[bytes, dict]:
    """The messages as codes, and counts that can be joined to those of the messages behind (``joined_facts``)."""
    codes, counts, seen = bytearray(), [0, 0, 0], []
    for role, tail, again in zip(roles, tails, repeated):
        kind = 0 if tail == "" else 1 if again else 2 if tail not in ".!?" else None
        if kind is not None:
            counts[kind] += 1
        codes.append(code_of(role[:1], FINE if kind is None else CUT_OFF if kind == 2 else MUST_GO))
    for t in turns:
        if t is not None and (not seen or seen[-1] != t):
            seen.append(t)
    illegal = sum(a[:1] + b[:1] not in _ALLOWED for a, b in zip(roles, roles[1:]))
    return bytes(codes), dict(n=len(roles), blank=counts[0], duplicate=counts[1], truncated=counts[2], illegal=illegal,
                              turns=len(seen), low=seen[0] if seen else None, high=seen[-1] if seen else None,
                              first=roles[0][:1], last=roles[-1][:1])


def joined_facts(a: dict | None, b: dict) -> dict:
    """Facts of the messages of a followed by those of b, a's turns being lower or equal."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in _ALLOWED
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"] = a["low"] if a["low"] is not None else b["low"]
    out["high"] = b["high"] if b["high"] is not None else a["high"]
    return out | {"first": a["first"], "last": b["last"]}


def gaps(f: dict) -> int:
    return 0 if f["low"] is None else f["high"] - f["low"] + 1 - f["turns"]


# --- over all conversations ---------------------------------------------------------------------------------------

_LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_MESSAGE = "struct<role:string,text:string>"


def _id(value):
    """An id as pandas hands it over, with None for a missing one."""
    return None if value is None or value != value else value


def _none(values: Iterable) -> list:
    return [None if v is None or v != v else int(v) for v in values]


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, tail (last character that is no white space), in order over range partitions."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(" "))

    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"),
                                text("text").alias("text")).withColumn(
        "tail", F.right(F.rtrim("text", F.lit(SPACE_CHARS)), F.lit(1)))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    return (rows.repartitionByRange(text_partitions(rows), *order, F.substring("text", 1, 32).asc())
            .sortWithinPartitions(*order, F.col("text").asc()))


def _first_pass(conversations: DataFrame, with_messages: bool, piece_rows: int, piece_bytes: int) -> DataFrame:
    """A row for every conversation repaired in its partition, and the rows of the others with part, piece and idx."""
    ids = conversations.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {ids}, " + ", ".join(f"{c} long" for c in _LONGS) + ", audit string, repaired_sha256 string,"
              f" messages array<{_MESSAGE}>, part int, piece int, idx int, turn long, role string, text string, tail string")

    def whole(conv, rows: list) -> tuple:
        seen, again = set(), []
        for _, role, text, _ in rows:
            again.append((role, text) in seen)
            seen.add((role, text))
        codes, f = facts([r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows], again)
        walk = Walk(codes, AT_END)
        (audit,), (state,) = walk.edits([START])
        audit += closing(state)
        left = list(replay(audit, ((r[1], r[2]) for r in rows), START))
        digest = hashlib.sha256("\n".join([f"{r}:{t}" for r, t in left]).encode("utf-8")).hexdigest()
        return (conv, gaps(f), f["blank"], f["duplicate"], f["truncated"], f["illegal"], walk.cost + walk.start[START],
                audit, digest, [{"role": r, "text": t} for r, t in left] if with_messages else None, *[None] * 7)

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, none = TaskContext.get().partitionId(), (None,) * 9
        rows, size, piece, now, first = [], 0, 0, None, True
        columns = ["conv_id", *_LONGS, "audit", "repaired_sha256", "messages", "part", "piece", "idx", "turn", "role", "text",
                   "tail"]
        out: list[tuple] = []

        def cut() -> None:
            nonlocal rows, size, piece
            out.extend((now, *none, part, piece, i, *r) for i, r in enumerate(rows))
            rows, size, piece = [], 0, piece + 1

        for batch in batches:
            convs = batch["conv_id"].tolist()
            for conv, turn, role, text, tail in zip(convs, _none(batch["turn"]), batch["role"], batch["text"], batch["tail"]):
                conv = _id(conv)
                if (rows or piece) and conv != now:
                    if first or piece:
                        cut()
                    else:
                        out.append(whole(now, rows))
                    rows, size, piece, first = [], 0, 0, False
                elif len(rows) >= piece_rows or size >= piece_bytes:
                    cut()
                now = conv
                rows.append((turn, role, text, tail))
                size += len(text)
            if len(out) > 1000:
                yield _frame(out, columns)
                out.clear()
        if rows:
            cut()
        yield _frame(out, columns)

    return _sorted_rows(conversations).mapInPandas(of_partition, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})


def _piece_facts(rows: DataFrame) -> DataFrame:
    """One row a piece: its codes, facts, and least costs from each state at its start to each at its end."""
    keyed = rows.withColumn("key", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    at = F.struct("part", "piece", "idx")
    first = keyed.groupBy("conv_id", "key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("__c"), F.col("key").alias("__k"), "first")
    narrow = (keyed.select("conv_id", "part", "piece", "idx", "turn", F.substring("role", 1, 1).alias("role"), "tail", "key")
              .join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("key") == F.col("__k")), "left")
              .withColumn("again", F.col("first").isNotNull() & (F.col("first") != at))
              .drop("__c", "__k", "first", "key"))
    ids = rows.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {ids}, part int, piece int, codes binary, matrix array<array<long>>, n long, blank long,"
              " duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string")

    def of_piece(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        codes, f = facts(_none(rows["turn"]), list(rows["role"]), list(rows["tail"]), list(rows["again"]))
        matrix = []
        for to in range(4):
            costs, total = costs_at_start(codes, tuple(0 if q == to else NEVER for q in range(4)))
            matrix.append([c + total if c < NEVER else NEVER for c in costs])
        return _frame([(_id(rows["conv_id"].iloc[0]), rows["part"].iloc[0], rows["piece"].iloc[0], codes, matrix,
                        *[f[k] for k in _FACTS])], ["conv_id", "part", "piece", "codes", "matrix", *_FACTS])

    return narrow.groupBy("conv_id", "part", "piece").applyInPandas(of_piece, schema)


def _by_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that lie in several pieces: (facts and cost, one row a conversation; edits, one row a piece)."""
    ids = rows.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {ids}, part int, piece int"
    pieces = written(_piece_facts(rows), "conversation-pieces")

    def costs_behind(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "piece"])
        behind, out, f = AT_END, [], None
        for r in group.iloc[::-1].itertuples():
            out.append((r.part, r.piece, list(behind)))
            behind = tuple(min(min(r.matrix[to][q] + behind[to] for to in range(4)), NEVER) for q in range(4))
        for r in group.to_dict("records"):
            r = {k: None if v is None or v != v else v for k, v in r.items() if k in _FACTS}
            f = joined_facts(f, {k: v if k in ("first", "last") or v is None else int(v) for k, v in r.items()})
        conv = _id(group["conv_id"].iloc[0])
        totals = (gaps(f), f["blank"], f["duplicate"], f["truncated"], f["illegal"], behind[START])
        last = len(out) - 1  # the first piece carries the conversation's facts
        return _frame([(conv, *o, k == 0, *(totals if k == last else (None,) * 6)) for k, o in enumerate(out)],
                      ["conv_id", "part", "piece", "behind", "is_last", *_LONGS])

    vectors = written(pieces.drop("codes").groupBy("conv_id").applyInPandas(
        costs_behind, f"{key}, behind array<long>, is_last boolean, " + ", ".join(f"{c} long" for c in _LONGS)),
        "conversation-costs")

    @F.udf("array<struct<audit:string,state:int>>")
    def walks(codes: bytes, behind: list[int], is_last: bool):
        audits, states = Walk(bytes(codes), tuple(behind)).edits([START, SYSTEM, USER, ASSISTANT])
        return [(a + closing(s) if is_last else a, s) for a, s in zip(audits, states)]

    def picked(group: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        conv = _id(group["conv_id"].iloc[0])
        for r in group.sort_values(["part", "piece"]).itertuples():
            walk = r.walks[state]
            out.append((conv, r.part, r.piece, walk["audit"], state))
            state = walk["state"]
        return _frame(out, ["conv_id", "part", "piece", "audit", "state"])

    same = [pieces["conv_id"].eqNullSafe(vectors["conv_id"]), pieces["part"] == vectors["part"],
            pieces["piece"] == vectors["piece"]]
    walked = pieces.join(vectors, same).select(
        pieces["conv_id"], pieces["part"], pieces["piece"], walks("codes", "behind", "is_last").alias("walks"))
    edits = walked.groupBy("conv_id").applyInPandas(picked, f"{key}, audit string, state int")
    return vectors.where("cost is not null").select("conv_id", *_LONGS), written(edits, "conversation-edits")


def _piece_messages(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, part, piece and the messages that the edits leave, by piece (bounded groups)."""
    ids = rows.schema["conv_id"].dataType.simpleString()
    edits = edits.select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), F.col("piece").alias("__q"), "audit", "state")
    placed = rows.select("conv_id", "part", "piece", "idx", "role", "text").join(
        edits, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")) & (F.col("piece") == F.col("__q")))

    def of_piece(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        r = group.iloc[0]
        left = replay(r["audit"], zip(group["role"], group["text"]), int(r["state"]))
        return _frame([(_id(r["conv_id"]), r["part"], r["piece"], [{"role": a, "text": b} for a, b in left])],
                      ["conv_id", "part", "piece", "messages"])

    return placed.drop("__c", "__p", "__q").groupBy("conv_id", "part", "piece").applyInPandas(
        of_piece, f"conv_id {ids}, part int, piece int, messages array<{_MESSAGE}>")


def _line(message: Column) -> Column:
    return F.concat(message["role"], F.lit(":"), message["text"])


def _digests(messages: DataFrame) -> DataFrame:
    """SHA-256 of the messages of conversations in pieces: a stream in order, a batch in memory at a time."""
    ids = messages.schema["conv_id"].dataType.simpleString()
    lines = messages.select("conv_id", "part", "piece", F.posexplode_outer("messages").alias("idx", "m")).select(
        "conv_id", "part", "piece", "idx", _line(F.col("m")).alias("line"))

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, empty = None, None, True
        for batch in batches:
            done = []
            for conv, line in zip(batch["conv_id"].tolist(), batch["line"]):
                conv = _id(conv)
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, empty = conv, hashlib.sha256(), True
                if line is not None:  # null: a piece without messages
                    digest.update((line if empty else "\n" + line).encode("utf-8"))
                    empty = False
            yield _frame(done, ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield _frame([(now, digest.hexdigest())], ["conv_id", "repaired_sha256"])

    return (lines.repartition(text_partitions(lines), "conv_id").sortWithinPartitions("conv_id", "part", "piece", "idx")
            .mapInPandas(of_partition, f"conv_id {ids}, repaired_sha256 string"))


def repair_conversations(conversations: DataFrame, with_messages: bool = False, piece_rows: int = PIECE_ROWS,
                         piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``with_messages`` gives beside it the repaired messages: conv_id, part and piece (the order of a conversation's
    rows) and an array of (role, text).
    """
    first = written(_first_pass(conversations, with_messages, piece_rows, piece_bytes), "conversations")
    closed, rows = first.where("audit is not null"), first.where("audit is null")
    totals, edits = _by_pieces(rows)
    in_pieces = written(_piece_messages(rows, edits), "conversation-messages")
    audits = edits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "audit"))).alias("p")).select(
        F.col("conv_id").alias("__a"), F.array_join(F.transform("p", lambda p: p["audit"]), "").alias("audit"))
    digests = _digests(in_pieces).withColumnRenamed("conv_id", "__d")
    columns = ["conv_id", *_LONGS, "audit", "repaired_sha256"]
    opened = (totals.join(audits, F.col("conv_id").eqNullSafe(F.col("__a")))
              .join(digests, F.col("conv_id").eqNullSafe(F.col("__d"))).select(*columns))
    messages = closed.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("piece"), "messages").unionByName(in_pieces)
    return closed.select(*columns).unionByName(opened), messages if with_messages else None
