from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from demandflow.llm import ordered, turn_repair
from demandflow.llm.turn_repair import audits, damaged, edits, repair

SCHEMA = "conv_id long, turn long, role string, text string, visible int, _part string"
SOUND = re.compile(r"(s?(ua)+)?")
INSERTS = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows):
    """(cost, audit, repaired) by listing all edits: every choice a row, up to two inserts at every place."""
    ways = []
    for (role, text), fault in zip(rows, faults(rows)):
        mine = [("D", 3, [])]
        if fault not in ("blank", "duplicate"):
            extra = int(fault == "truncated")
            if role:
                mine.append(("K", extra, [(role, text)]))
            mine += [("R", 2 + extra, [(to, text)]) for to in ("user", "assistant")]
        ways.append([("I" * len(i) + a, 2 * len(i) + c, [*((r, "") for r in i), *said]) for i in INSERTS for a, c, said in mine])
    ways.append([("I" * len(i), 2 * len(i), [(r, "") for r in i]) for i in INSERTS])
    best = None
    # A prefix whose initials cannot be completed is dropped; nothing else is.
    partial = re.compile(r"s?(ua)*u?")
    live = {("", ()): 0}
    for options in ways:
        fresh = {}
        for (audit, said), cost in live.items():
            for a, c, more in options:
                key = audit + a, said + tuple(more)
                if partial.fullmatch("".join(r[0] for r, _ in key[1])):
                    fresh[key] = min(cost + c, fresh.get(key, 99))
        live = fresh
    for (audit, said), cost in live.items():
        if SOUND.fullmatch("".join(r[0] for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, said
    return best


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "c", "", " \n", "a.", "d? "])) for _ in range(n)]


def run_edits(rows, start=0, end=None):
    kinds = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
    return list(edits(((i, f, r[:1], kinds[f], r, t) for i, ((r, t), f) in enumerate(zip(rows, faults(rows)))), start, end))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_edits_equal_listing_all(n):
    rng = random.Random(n)
    for _ in range(150 if n < 3 else 60):
        rows = random_rows(rng, n)
        cost, audit, said = plain_repair(rows)
        got = run_edits(rows)
        assert ("".join(e[0] for e in got), sum(e[3] for e in got)) == (audit, cost), rows
        assert [(e[1], e[2]) for e in got if e[0] != "D"] == list(said), rows


def test_edits_are_emitted_early_and_memory_stays_small():
    """A long sound conversation with some faults: rows are emitted soon after they are read."""
    rng = random.Random(1)
    read = 0

    def rows():
        nonlocal read
        for i in range(20_000):
            read += 1
            role = ("user", "assistant")[i % 2] if rng.random() > 0.1 else "system"
            yield i, "", role[:1], 0, role, f"{i}."

    late = 0
    for e in edits(rows()):
        if e[4] is not None:
            late = max(late, read - e[4][0])
    assert late < 50


def conversation_rows(rng, count):
    out = []
    for conv in range(count):
        turns = rng.randint(0, 6)
        for t in range(turns):
            role, text = rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["Yes.", "No", "Why?", None, "", "Go on!"])
            out.append((conv if conv else None, rng.choice([t, t, t, None]), role, text, 5, "z"))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected(rows):
    """{conv_id: all columns} of damaged rows by a plain computation."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        turns = {r[1] for r in mine if r[1] is not None}
        said = [(r[2], r[3]) for r in mine]
        found = faults(said)
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        e = run_edits(said)
        repaired = "\n".join(f"{x[1]}:{x[2]}" for x in e if x[0] != "D")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, sum(x[3] for x in e), "".join(x[0] for x in e), hashlib.sha256(repaired.encode()).hexdigest())
    return out


def rows_by_conversation(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_query_equals_plain_computation(spark, tmp_path, partitions):
    rng = random.Random(7)
    rows = conversation_rows(rng, 120)
    rows += [(500, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", "x", "x."]), 1, "") for t in range(600)]
    rows += [(501, None, "user", "same.", 1, "")] * 30
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_by_conversation(turn_repair.query(spark, str(tmp_path)))
        _, keys = repair(damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = expected(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {r[0]: want.get(r[0], nothing) for r in rows}
    assert (500 in keys) == (partitions > 1)


def test_undecided_rows_over_many_parts(spark, monkeypatch):
    """An `s` whose fate the last row decides, and pieces of a few bytes."""
    monkeypatch.setattr(ordered, "PIECE_BYTES", 10)
    for tail, audit in (("user", "K" + "D" * 50 + "KI"), (None, "D" * 51)):
        rows = [(1, 0, "system", "Be good.", 0, "")] + [(1, t, "user", " ", 0, "") for t in range(1, 51)]
        if tail:
            rows.append((1, 60, tail, "Hello?", 0, ""))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = audits(*repair(spark.createDataFrame(rows, SCHEMA))).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want = expected([r[:4] for r in rows])
        assert [(r.audit, r.gaps) for r in found] == [(audit, want[1][0])]
        assert tuple(found[0])[1:] == want[1]


def test_empty_table(spark):
    assert audits(*repair(spark.createDataFrame([], SCHEMA))).count() == 0
