"""Conversation structure repair by integer weights.

A conversation is read in order as a path through a small automaton that accepts an optional system turn and then
user/assistant pairs, or nothing. Each step is an edit: keep, rerole, delete or insert. The weight of a path is one integer:
its high digits are the cost, its low digits, three bits for each edit in the order of the edits, are the letters of the
audit (1 to 4 in ASCII order; no edit is 0). The smaller integer is thus the cheaper path and, at equal cost, the smaller
audit, and an ordinary minimum decides everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from rulemill.functions.columns import column
from rulemill.llm.common import map_rows, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: Digits of the edits, in ASCII order of their letters; 0 pads.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
_BITS = 3
#: Rows after which the digits so far are put away and stand as one digit, their rank.
_BLOCK = 512

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SOLID = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?][\x20\x09-\x0D]*\z"

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if self.insert < 1 or min(self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("an insertion costs 1 at least, the other edits 0 at least")


def _after(state: int, initial: str) -> int | None:
    """The state after a kept turn."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _alternate(state: int) -> int:
    """The only state that a user or an assistant turn can lead to."""
    return ASSISTANT if state == USER else USER


def _simulation(costs: Costs) -> list[list[float]]:
    """[y][x]: what it costs at most to go on from y as anything goes on from x. A path that is dearer by more is on no cheapest path."""
    far = float("inf")
    out = [[0 if a == b else far for b in range(4)] for a in range(4)]
    for state in range(4):
        out[state][_alternate(state)] = costs.insert
    # what follows the system turn may follow the start and a finished pair; behind a pair a system turn is deleted instead
    out[START][SYSTEM] = out[ASSISTANT][SYSTEM] = 0
    out[ASSISTANT][START] = costs.delete
    for k in range(4):
        for a in range(4):
            for b in range(4):
                out[a][b] = min(out[a][b], out[a][k] + out[k][b])
    return out


def _pruned(paths: dict[tuple[int, int], int], simulation: list[list[float]]) -> dict[tuple[int, int], int]:
    least = [float("inf")] * 4
    for (state, n), w in paths.items():
        least[state] = min(least[state], w >> _BITS * n)
    bound = [min(least[y] + simulation[y][x] for y in range(4)) for x in range(4)]
    return {(state, n): w for (state, n), w in paths.items() if w >> _BITS * n <= bound[state]}


def _with_inserts(paths: dict[tuple[int, int], int], costs: Costs, simulation: list[list[float]]) -> dict[tuple[int, int], int]:
    paths, fresh = dict(paths), paths
    while fresh:
        offered = {(_alternate(state), n + 1): (w << _BITS) + (costs.insert << _BITS * (n + 1)) + INSERT for (state, n), w in fresh.items()}
        better = {key: w for key, w in offered.items() if w < paths.get(key, w + 1)}
        paths = _pruned(paths | better, simulation)
        fresh = {key: w for key, w in better.items() if key in paths}
    return paths


def cheapest(rows: Iterable[tuple[str, int]], costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of (role initial, fault) rows; the ASCII-least audit where several are cheapest.

    A node is (state, edits so far), at most a few for a row: paths dearer than a bound that is proven never to matter are left.
    Whenever all paths have equally many edits, their digits are put away and replaced by their rank, so that the integers stay
    short and a long conversation takes linear time.
    """
    simulation, put_away = _simulation(costs), []
    paths = {(START, 1): 0}  # the first digit is the rank
    for i, (initial, fault) in enumerate(rows):
        if i % _BLOCK == _BLOCK - 1 and len({n for _, n in paths}) == 1:
            paths, kept = _ranked(paths)
            put_away.append(kept)
        paths = _with_inserts(paths, costs, simulation)
        offered: dict[tuple[int, int], int] = {}
        for (state, n), w in paths.items():
            edits = [(state, costs.delete, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                extra = costs.truncated if fault == TRUNCATED else 0
                edits.append((_alternate(state), costs.rerole + extra, REROLE))
                if (kept_state := _after(state, initial)) is not None:
                    edits.append((kept_state, extra, KEEP))
            for to, cost, digit in edits:
                weight = (w << _BITS) + (cost << _BITS * (n + 1)) + digit
                if weight < offered.get((to, n + 1), weight + 1):
                    offered[to, n + 1] = weight
        paths = _pruned(offered, simulation)
    paths = _with_inserts(paths, costs, simulation)
    ends = [(n, w) for (state, n), w in paths.items() if state in (START, ASSISTANT)]
    width = max(n for n, _ in ends)
    n, best = min(ends, key=lambda end: end[1] << _BITS * (width - end[0]))
    rank, audit = _digits(best, n)
    for kept in reversed(put_away):
        rank, before = kept[rank]
        audit = before + audit
    return best >> _BITS * n, audit


def _digits(weight: int, n: int) -> tuple[int, str]:
    """The rank in front, and the letters behind it."""
    low = f"{weight & (1 << _BITS * n) - 1:0{n}o}"
    return int(low[0]), low[1:].translate({48 + i: c for i, c in enumerate(LETTERS)})


def _ranked(paths: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], int], list[tuple[int, str]]]:
    """Paths with their digits as one, and what the ranks stand for. There are no more than four, all with equally many edits."""
    by_digits = sorted(paths.items(), key=lambda item: item[1] & (1 << _BITS * item[0][1]) - 1)
    cost = {key: w >> _BITS * key[1] for key, w in by_digits}
    short = {(key[0], 1): (cost[key] << _BITS) + rank for rank, (key, _) in enumerate(by_digits)}
    return short, [_digits(w, key[1]) for key, w in by_digits]


def _conversations(rows: Iterator[tuple], costs: Costs) -> Iterator[tuple]:
    """Sorted (conversation, turn, initial, fault) -> one row for each conversation."""

    def finished() -> tuple:
        cost, audit = cheapest(zip(initials, faults), costs)
        gaps = highest - lowest + 1 - turns if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return current, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit

    current, initials = None, []
    for key, turn, initial, fault in rows:
        if key != current or not initials:
            if initials:
                yield finished()
            current, initials, faults, turns, lowest, highest, last = key, [], bytearray(), 0, None, None, None
        initials.append(initial)
        faults.append(fault)
        if turn is not None:
            if turn != last:
                turns += 1
            lowest, highest, last = turn if lowest is None else lowest, turn, turn
    if initials:
        yield finished()


def _rewritten(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, audit, turn, role, text), the audit first -> one row for each edit."""
    state = audit = seq = key = None

    def inserted() -> Iterator[tuple]:
        nonlocal state, seq
        while seq < len(audit) and audit[seq] == "I":
            state = _alternate(state)
            yield key, seq, "I", None, "user" if state == USER else "assistant", ""
            seq += 1

    for key_now, audit_now, turn, role, text in rows:
        if audit_now is not None:
            key, audit, seq, state = key_now, audit_now, 0, START
            yield from inserted()
            continue
        edit = audit[seq]
        if edit == "K":
            state = _after(state, role[:1])
        elif edit == "R":
            state = _alternate(state)
            role = "user" if state == USER else "assistant"
        yield key, seq, edit, turn, role, text
        seq += 1
        yield from inserted()


def _ordered(df: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """The rows with their faults, a conversation in one partition. Only the last of the faults, a text seen earlier, needs the others."""
    text, role = F.coalesce(column(text_column).cast("string"), F.lit(" ")), F.coalesce(column(role_column).cast("string"), F.lit(" "))
    rows = df.select(column(id_column).alias("conv_id"), column(turn_column).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"blank": ~F.col("text").rlike(SOLID), "closed": F.col("text").rlike(CLOSED)}).repartition(F.col("conv_id"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), BLANK).when(earlier, DUPLICATE).when(~F.col("closed"), TRUNCATED).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"))


def report(
    df: DataFrame, costs: Costs = Costs(), id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """One row for each conversation: `conv_id`, gaps between its turns, rows by their first fault, role initials that may not follow
    each other, and the cost and audit of its cheapest repair.

    The rows of a conversation count by turn (NULL first), then role, then text. A NULL role or text is one blank; rows without a
    conversation form one. Other columns are not read. An empty table gives no rows. A task sorts its conversations on disk and holds
    two bytes or so for each row of one of them, no texts.
    """
    ordered = _ordered(df, id_column, turn_column, role_column, text_column).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "fault"
    )
    kind = ordered.schema["conv_id"].dataType.simpleString()
    picked = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    return map_rows(picked, lambda rows: _conversations(rows, costs), f"conv_id {kind}, {REPORT}")


def repair(
    df: DataFrame, reports: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """All edits of all conversations in order: `conv_id`, `seq` (gapless from 0), `edit`, and the `turn`, `role` and `text` after it.
    What is left of a conversation are its rows with an edit other than D; an inserted row has no turn and an empty text.

    `reports` has conv_id and audit, as `report` gives them for the same rows. A conversation is one run of rows in its partition, with
    its audit in front: nothing but the audit is held.
    """
    rows = _ordered(df, id_column, turn_column, role_column, text_column).withColumn("audit", F.lit(None).cast("string"))
    audits = reports.select("conv_id", "audit").withColumns({"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "fault": F.lit(0)})
    both = rows.unionByName(audits).repartition(F.col("conv_id")).sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text", "fault"
    )
    kind = both.schema["conv_id"].dataType.simpleString()
    picked = both.select("conv_id", "audit", "turn", "role", "text")
    return map_rows(picked, _rewritten, f"conv_id {kind}, seq long, edit string, turn long, role string, text string", per_batch=512)


def digests(edits: DataFrame) -> DataFrame:
    """`conv_id` and `repaired_sha256`: SHA-256 of `role:text` of the rows that are left, joined by line feeds. Reads the rows of `repair`
    as they come, without a further shuffle, and holds no texts. The digest of one conversation cannot be computed in parts."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, digest, some = None, None, False
        for conv, seq, edit, role, text in rows:
            if seq == 0:
                if digest:
                    yield key, digest.hexdigest()
                key, digest, some = conv, hashlib.sha256(), False
            if edit != "D":
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
        if digest:
            yield key, digest.hexdigest()

    kind = edits.schema["conv_id"].dataType.simpleString()
    return map_rows(edits.select("conv_id", "seq", "edit", "role", "text"), run, f"conv_id {kind}, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults, drawn by the checksum of `conv_id:turn` modulo 20: 0 drops the row, 1
    empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. A NULL is one blank."""
    shown = lambda name: F.coalesce(column(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = df.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), draw.alias("draw")).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def repaired_reports(conversations: DataFrame, faulty: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for every conversation of `conversations`: the report and the digest of its rows in `faulty`; zeros, an empty audit and
    the digest of nothing where it has none there."""
    reports = written(report(faulty, costs), "conversation-reports")
    hashed = digests(repair(faulty, reports))
    every = conversations.select("conv_id").distinct()
    for other in (reports, hashed):
        other = other.withColumnRenamed("conv_id", "__other")
        every = every.join(other, F.col("conv_id").eqNullSafe(F.col("__other")), "left").drop("__other")
    numbers = [f.split()[0] for f in REPORT.split(", ")[:-1]]
    return every.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
