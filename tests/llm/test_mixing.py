from __future__ import annotations

import math
import random

import pytest

from demandflow.llm import mixing
from demandflow.llm.mixing import CIRCLE, GOLDEN, MixParams, mix_rows, mixed_documents, schedule, source_targets

SCHEMA = "doc_id long, text string, source string, size int, slot long, key string"


def made(seed=4, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 700])), rng.choice(["a", "a", "a", "b", "c", None, "d"]), -1, -2, "x") for i in range(n)]
    return rows + [(1000, None, "a", 0, 0, ""), (None, "one two", "b", 0, 0, ""), (1001, " \t", "e", 0, 0, ""), (1002, "same", "b", 0, 0, ""), (1002, "same", "b", 1, 1, "y")]


def words(text):
    return len((text or "").split())


def plain_targets(sizes, p):
    """Shares by weight, what is over a source's limit shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()) * p.total_share, set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > p.most_passes * sizes[s]]
        for s in over or list(open_):
            out[s] = p.most_passes * sizes[s] if over else level * weight[s]
            left -= out[s]
            open_.discard(s)
    return out


def plain_schedule(need, order):
    """(slot, source) by the golden-ratio points through cumulative shares."""
    total, edges, at = sum(need.values()), [], 0
    for s in order:
        edges.append((math.floor(at * (CIRCLE / total)), math.floor((at + need[s]) * (CIRCLE / total)), s))
        at += need[s]
    out, count = [], dict.fromkeys(order, 0)
    for i in range(total):
        u = i * GOLDEN % CIRCLE
        s = next(s for lo, hi, s in edges if lo <= u < hi)
        if count[s] < need[s]:
            out.append((i, s))
            count[s] += 1
    return out + [(total + r, s) for s in order for r in range(count[s], need[s])]


def test_targets_and_taken_words(spark):
    p, rows = MixParams(block_words=16, least_chunk=8), made()
    got = mix_rows(spark.createDataFrame(rows, SCHEMA).repartition(7), p).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    want = plain_targets(sizes, p)
    by_id = {r[0]: r[2] for r in rows}
    for r in got:
        s = by_id[r.doc_id]
        assert r.taken <= p.most_passes * r.size and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and (r.first_slot is None) == (r.copies == 0)
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1


def test_schedule_equals_a_plain_one_and_every_prefix_is_near_its_shares(spark):
    p = MixParams(block_words=8, least_chunk=16)
    sizes = {"a": 9000, "b": 2500, "c": 300, "d": 7, None: 4000}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    s = source_targets(sources, p).selectExpr("*", "cast(floor(target + 0.5) as long) as take").cache()
    info = {r.src: r for r in s.collect()}
    need = {k: r.take // r.source_size * -(-r.source_size // 8) + -(-(r.take % r.source_size) // 8) for k, r in info.items()}
    got = sorted((r.slot, r.src) for r in schedule(spark, s, p).collect())
    assert got == sorted(plain_schedule(need, sorted(need)))
    total, seen = sum(need.values()), dict.fromkeys(need, 0)
    for n, (_, src) in enumerate(got, 1):
        seen[src] += 1
        assert all(abs(seen[k] - n * need[k] / total) < 4 for k in need), n


def test_mixed_documents_come_in_slot_order(spark):
    p, rows = MixParams(block_words=16, least_chunk=8), made(5)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    placed = {}
    for r in mix_rows(docs, p).where("copies > 0").collect():
        placed.setdefault(r.doc_id, (r.first_slot, r.last_slot, r.copies))
    got = mixed_documents(docs, p)
    assert got.columns == docs.columns
    seen = {}
    order = [r.doc_id for r in got.collect()]
    for i, doc in enumerate(order):
        seen.setdefault(doc, []).append(i)
    single = [d for d in seen if d not in (None, 1002)]
    assert all(len(seen[d]) == placed[d][2] for d in single)
    firsts = sorted(single, key=lambda d: seen[d][0])
    assert [placed[d][0] for d in firsts] == sorted(placed[d][0] for d in firsts)
    assert [r.doc_id for r in mixed_documents(docs.repartition(3), p).collect()] == order


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_rows(empty).count() == 0 and mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 0, 0, ""), (2, " ", None, 0, 0, "")], SCHEMA)
    assert [(r.size, r.taken, r.first_slot) for r in mix_rows(blank).collect()] == [(0, 0, None)] * 2
    assert mixed_documents(blank).count() == 0


def test_reruns_agree(spark):
    docs = spark.createDataFrame(made(6), SCHEMA)
    runs = [sorted(map(tuple, mix_rows(docs.repartition(n)).collect()), key=str) for n in (1, 9)]
    assert runs[0] == runs[1]
    assert mixing.QUERIES["op7_source_mix"][1] is not None
