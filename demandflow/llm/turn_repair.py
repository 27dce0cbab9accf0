"""Repair of a conversation's structure by a survivor-coalescence Viterbi search.

The role initials of a sound conversation are `(s?(ua)+)?`. Four states say what a prefix may go on with; at
each row the cheapest edits that reach each state survive. Survivors are leaves of a tree of back-pointers: a
node without children left is pruned, and as soon as the root has one child, that child's edit is what
all survivors share, so it is emitted and forgotten. A survivor that costs more than another one together with
what it takes to do the same from there is none. Memory therefore holds the undecided rows only; it
grows with a conversation only where its first rows stay undecided (an `s` followed by deletions alone).

Ties go to the edits whose letters (D, I, K, R) come first. Inserts are taken together with the row after
them, so that every survivor ends in its row's letter; two survivors then differ inside their unresolved
suffixes, never by length alone, and the order of those whole suffixes can be carried along as a rank.

A conversation that spans several partitions is summed up part by part: cost and rank from each state to each
state. Chaining these gives the state at every border, and the parts are then repaired side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.llm.common import table
from demandflow.llm.ordered import PART, Fold, arrow_kind, crossing, dealt_in_order, folded, in_batches, rows_of, summaries

#: Fixed values of the contract: white space, ends of sentences, costs.
SPACE = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)  # the state after nothing, or after a row of that role
NEXT_ROLE = ("user", "user", "assistant", "user")  # what an insert or a new role puts after a state
AFTER = (USER, USER, ASSISTANT, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
SOUND, CUT, UNWANTED = range(3)  # rows without fault, truncated ones, those that must go


@lru_cache
def moves(initial: str, kind: int) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, letters) of all ways to take a row, with the inserts before it."""
    out = []
    extra = TRUNCATED if kind == CUT else 0
    for before in range(4):
        at = before
        for inserts in range(3):
            if inserts:
                at = AFTER[at]
                if at == before:
                    break
            cost, letters = INSERT * inserts, "I" * inserts
            out.append((before, at, cost + DELETE, letters + "D"))
            if kind != UNWANTED:
                if (at, initial) in KEPT:
                    out.append((before, KEPT[at, initial], cost + extra, letters + "K"))
                out.append((before, AFTER[at], cost + REROLE + extra, letters + "R"))
    return tuple(out)


#: Inserts that end a conversation in each state.
ENDINGS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

#: [t][s]: whatever a survivor in s goes on with, one in t can do for so much more: by inserts, or by deleting
#: the system row that only the start may keep. A survivor dearer than that by another one cannot win or tie.
MIMIC = (
    (0, 0, INSERT, 0),
    (2 * INSERT, 0, INSERT, 2 * INSERT),
    (INSERT + DELETE, INSERT, 0, INSERT),
    (DELETE, 0, INSERT, 0),
)

FIRST_OF = tuple(((s, 0, 0),) for s in range(4))


@lru_cache(maxsize=10_000)
def advance(live: tuple, initial: str, kind: int) -> tuple[int, tuple, tuple]:
    """(cost added to all, survivors, their last steps) after a row, for survivors (state, cost, rank).

    Costs are relative to the cheapest survivor. A last step is (state, state before, letters).
    """
    best: dict = {}
    known = {s: (cost, rank) for s, cost, rank in live}
    for before, after, cost, letters in moves(initial, kind):
        if before in known:
            found = (known[before][0] + cost, known[before][1], letters, before)
            if after not in best or found < best[after]:
                best[after] = found
    best = {s: v for s, v in best.items() if not any(best[t][0] + MIMIC[t][s] < v[0] for t in best)}
    order = sorted(best, key=lambda s: best[s][1:3])
    base = min(v[0] for v in best.values())
    return base, tuple((s, best[s][0] - base, rank) for rank, s in enumerate(order)), tuple((s, best[s][3], best[s][2]) for s in order)


def ending(live: tuple) -> int:
    """The state of the survivor that ends cheapest."""
    return min(live, key=lambda v: (v[1] + INSERT * ENDINGS[v[0]], v[2]))[0]


def matrix(rows: Iterator[tuple[str, int]]) -> list[int]:
    """Cost and rank from each state (row) to each state (column) over the rows (initial, kind); -1: no way worth taking."""
    starts, bases = list(FIRST_OF), [0] * 4
    for initial, kind in rows:
        for i, live in enumerate(starts):
            base, starts[i], _ = advance(live, initial, kind)
            bases[i] += base
    found = [{s: (base + cost, rank) for s, cost, rank in live} for base, live in zip(bases, starts)]
    return [x for live in found for s in range(4) for x in live.get(s, (-1, -1))]


def borders(parts: list[tuple[int, list[int]]]) -> dict[int, tuple[int, int, bool]]:
    """{part: (state before, state after, last)} of the cheapest way through all parts."""
    live, back = FIRST_OF[START], []
    for _, m in parts:
        best: dict = {}
        for s, cost, rank in live:
            for t in range(4):
                more, inner = m[8 * s + 2 * t : 8 * s + 2 * t + 2]
                if more >= 0:
                    found = (cost + more, rank, inner, s)
                    if t not in best or found < best[t]:
                        best[t] = found
        order = sorted(best, key=lambda t: best[t][1:3])
        live = tuple((t, best[t][0], rank) for rank, t in enumerate(order))
        back.append({t: best[t][3] for t in best})
    at, out = ending(live), {}
    for i in range(len(parts) - 1, -1, -1):
        out[parts[i][0]] = (back[i][at], at, i == len(parts) - 1)
        at = back[i][at]
    return out


class Node:
    """A survivor's last step; the number of its children is its reference count."""

    __slots__ = ("parent", "children", "row", "before", "letters")

    def __init__(self, parent, row=None, before=START, letters=""):
        self.parent, self.row, self.before, self.letters, self.children = parent, row, before, letters, []


def edits(rows: Iterator[tuple], start: int = START, end: int | None = None) -> Iterator[tuple]:
    """(letter, role, text, cost, row) in order for rows (..., initial, kind, role, text); row is None for an insert.

    The search starts in state `start` and ends in `end`, or where it ends cheapest, adding the inserts for it.
    """
    root = Node(None)
    live, leaves = FIRST_OF[start], {start: root}
    for row in rows:
        _, live, steps = advance(live, *row[-4:-2])
        fresh = {}
        for state, before, letters in steps:
            fresh[state] = Node(leaves[before], row, before, letters)
            leaves[before].children.append(fresh[state])
        for node in leaves.values():
            while not node.children and node is not root:
                node.parent.children.remove(node)
                node = node.parent
        leaves = fresh
        while len(root.children) == 1:
            root = root.children[0]
            root.parent = None
            yield from _emitted(root)
    last = ending(live) if end is None else end
    path, node = [], leaves[last]
    while node is not root:
        path.append(node)
        node = node.parent
    for node in reversed(path):
        yield from _emitted(node)
    if end is None:
        yield from _emitted(Node(None, None, last, "I" * ENDINGS[last]))


def _emitted(node: Node) -> Iterator[tuple]:
    at = node.before
    for letter in node.letters:
        if letter == "I":
            yield "I", NEXT_ROLE[at], "", INSERT, None
            at = AFTER[at]
            continue
        _, kind, role, text = node.row[-4:]
        extra = TRUNCATED if kind == CUT else 0
        if letter == "D":
            yield "D", None, None, DELETE, node.row
        else:
            yield letter, role if letter == "K" else NEXT_ROLE[at], text, extra + (REROLE if letter == "R" else 0), node.row


def _last_visible(text: Column) -> Column:
    """The last character that is not white space; empty for a blank text."""
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def judged_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, visible (last visible character), earlier (role and text were seen in an earlier turn).

    Only what occurs in several turns of a conversation is joined back; blank rows are no duplicates.
    """
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    d = rows.withColumn("visible", _last_visible(F.col("text"))).withColumn("_said", said)
    often = d.where("visible <> ''").groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_same")).agg(F.min(F.struct("turn")).alias("_first"), F.max(F.struct("turn")).alias("_last"))
    often = often.where(~F.col("_first.turn").eqNullSafe(F.col("_last.turn"))).select("_conv", "_same", "_first")
    same = (d["_said"] == often["_same"]) & d["conv_id"].eqNullSafe(often["_conv"])
    earlier = F.col("_first").isNotNull() & ~F.col("_first.turn").eqNullSafe(F.col("turn"))
    return d.join(often, same, "left").select("conv_id", "turn", "role", "text", "visible", earlier.alias("earlier"))


def _classed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(turn, fault, initial, kind, role, text) from (turn, role, visible, earlier, text); equal rows are neighbours."""
    before = None
    for turn, role, visible, earlier, text in rows:
        if not visible:
            fault, kind = "blank", UNWANTED
        elif earlier or before == (turn, role, text):
            fault, kind = "duplicate", UNWANTED
        elif visible not in SENTENCE_ENDS:
            fault, kind = "truncated", CUT
        else:
            fault, kind = "", SOUND
        before = turn, role, text
        yield turn, fault, role[:1], kind, role, text


EDITS = "turn long, edit string, fault string, was string, role string, text string, cost long"


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, frozenset]:
    """(edits, conversations that span several partitions).

    An edit is a row: conv_id, _part, turn (null for an insert), edit (K, R, D, I), fault (blank, duplicate,
    truncated or empty), was (the row's role), role and text after the edit (null for a deleted row), cost.
    Edits stand in order within partitions and partitions in order of `_part`.

    Null role and text count as one space. Rows go by turn, nulls first, then role, then text; rows that
    agree in all are duplicates of one another. A role that does not begin with s, u or a (an empty one
    too) is never kept. Null conv_id is a conversation of its own. An empty table gives no rows. Other columns are
    not looked at.
    """
    d = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    dealt = dealt_in_order(judged_rows(d), "conv_id", "turn", "role", "text")
    keys = crossing(dealt, "conv_id")
    columns = ["turn", "role", "visible", "earlier", "text"]
    summed = summaries(dealt, "conv_id", keys, columns, lambda rows: matrix(r[2:4] for r in _classed(rows)))
    ways = {(part, k): way for k, parts in summed.items() for part, way in borders(parts).items()}
    kind, arrow = dealt.schema["conv_id"].dataType.simpleString(), arrow_kind(dealt, "conv_id")
    names = ["conv_id", PART, *(c.split()[0] for c in EDITS.split(", "))]
    kinds = [arrow, pa.int32(), pa.int64(), *[pa.string()] * 5, pa.int64()]

    def run(batches):
        for (k, part), group in groupby(rows_of(batches, ["conv_id", PART, *columns], "text"), key=itemgetter(0, 1)):
            start, end, last = ways.get((part, k), (START, None, True))
            found = edits(_classed(r[2:] for r in group), start, end)
            for letter, to, said, cost, row in found:
                turn_, fault, was = (row[0], row[1], row[4]) if row else (None, "", None)
                yield k, part, turn_, letter, fault, was, to, said, cost
            if last and end is not None:
                for letter, to, said, cost, _ in _emitted(Node(None, None, end, "I" * ENDINGS[end])):
                    yield k, part, None, letter, "", None, to, said, cost

    schema = f"conv_id {kind}, {PART} int, {EDITS}"
    return dealt.mapInArrow(lambda b: in_batches(run(b), names, kinds, lambda r: len(r[7] or "")), schema), keys


#: Numbers of a conversation's part: rows, faults, pairs that are not legal, cost, turns, and what its ends look like.
ROWS, BLANK, DUPLICATE, TRUNC, ILLEGAL, COST, LOW, HIGH, TURNS, FIRST, LAST = range(11)


def _illegal(a: int, b: int) -> int:
    return int((chr(a) if a else "") + (chr(b) if b else "") not in LEGAL)


def _step(numbers: list, row: tuple) -> tuple[bytes, bytes]:
    turn, edit, fault, was, role, text, cost = row
    numbers[COST] += cost
    if was is not None:
        at = ord(was[0]) if was else 0
        if numbers[ROWS]:
            numbers[ILLEGAL] += _illegal(numbers[LAST], at)
        else:
            numbers[FIRST] = at
        numbers[ROWS] += 1
        numbers[LAST] = at
        if fault:
            numbers[{"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNC}[fault]] += 1
        if turn is not None:
            if numbers[TURNS] == 0:
                numbers[LOW] = turn
            if numbers[TURNS] == 0 or turn != numbers[HIGH]:
                numbers[TURNS] += 1
            numbers[HIGH] = turn
    # A newline goes before every line; the fold cuts the first one off.
    return edit.encode(), b"" if edit == "D" else f"\n{role}:{text}".encode()


def _join(a: list, b: list) -> list:
    if not b[ROWS]:
        return [*a[:COST], a[COST] + b[COST], *a[LOW:]]
    if not a[ROWS]:
        return [*b[:COST], a[COST] + b[COST], *b[LOW:]]
    out = [x + y for x, y in zip(a, b)]
    out[ILLEGAL] += _illegal(a[LAST], b[FIRST])
    out[FIRST], out[LAST] = a[FIRST], b[LAST]
    known = [n for n in (a, b) if n[TURNS]]
    out[LOW], out[HIGH] = (known[0][LOW], known[-1][HIGH]) if known else (0, 0)
    out[TURNS] = a[TURNS] + b[TURNS] - int(len(known) == 2 and a[HIGH] == b[LOW])
    return out


def audits(found: DataFrame, keys: frozenset) -> DataFrame:
    """One row a conversation that has rows: its counts, its audit and the digest of what it became."""
    fold = Fold(lambda: [0] * 11, _step, _join, (False, True), (0, 1))
    columns = [c.split()[0] for c in EDITS.split(", ")]
    out = folded(found, "conv_id", columns, fold, keys, "text")
    n = lambda i: F.col("numbers")[i]
    gaps = F.when(n(TURNS) > 0, n(HIGH) - n(LOW) + 1 - n(TURNS)).otherwise(F.lit(0))
    counts = {"gaps": gaps, "blank": n(BLANK), "duplicate": n(DUPLICATE), "truncated": n(TRUNC), "illegal": n(ILLEGAL), "cost": n(COST)}
    return out.select("conv_id", *[c.cast("long").alias(k) for k, c in counts.items()], F.col("ends")[0].alias("audit"), F.col("ends")[1].alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, chosen by crc32 of `conv_id:turn`; nulls are one space."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(words[3], SENTENCE_ENDS, "")).otherwise(words[3])
    role = F.when(kind == 4, "user").otherwise(words[2])
    d = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_times"), kind.alias("_kind"))
    return d.where("_kind <> 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy")).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = audits(*repair(damaged(conversations))).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    rest = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").select("conv_id", *counts, *rest)


QUERIES = {"op11_turn_repair": (query, None)}
