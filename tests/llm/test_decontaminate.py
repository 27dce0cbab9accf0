from __future__ import annotations

import hashlib
import random
import re

import pytest

from demandflow.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, window=dc.WINDOW):
    """Per document (n_words, hit places, item ids) by comparing every window at every place."""
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if (key := tuple(w[i : i + n])) in windows and len(key) == n:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out[doc] = (len(w), hit, found)
    return out


@pytest.mark.parametrize("shard_bytes,held_bytes", [(16_000_000, 64_000_000), (700, 64_000_000), (700, 2_200)])
def test_equals_plain_search(spark, shard_bytes, held_bytes):
    rng = random.Random(3)
    pick = lambda n: [rng.choice("abcdé") + rng.choice(["", "1", "x"]) for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([1, 3, 12, 13, 14, 30])) * rng.choice([1, 2]))) for i in range(60)]
    items += [(100, items[5][1]), (101, ""), (102, None), (103, "!!! ..."), (104, " ".join(items[8][1].split()[2:20]))]
    docs = [(0, None), (1, ""), (2, "...!"), (3, " ".join(pick(30_000)))]
    for i in range(4, 120):
        parts = pick(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1] or ""
            w = w.split()[rng.choice([0, 0, 1, 5]) :]
            parts += [x.upper() + rng.choice(["", ",", "--"]) for x in w] + pick(rng.randint(0, 9))
        docs.append((i, "\n".join(parts)))
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    p = dc.DecontaminateParams(shard_bytes=shard_bytes, held_bytes=held_bytes)
    want = plain(docs, items)
    rows = dc.contamination(d, b, p).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items) == (n, len(hit), len(found), sorted(found))
        assert {x for s in r.spans for x in range(s.start, s.end)} == hit
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= n)
    kept = {r.doc_id: r for r in dc.cleaned(d, b, p).collect()}
    assert set(kept) == {r.doc_id for r in rows if not r.contaminated} and all(kept[i].text == dict(docs)[i] for i in kept)
    cut = {r.doc_id: r.text for r in dc.cleaned(d, b, p, drop=False).collect()}
    for doc, text in docs:
        n, hit, _ = want[doc]
        assert WORD.findall(lower(cut[doc])) == [w for i, w in enumerate(WORD.findall(lower(text))) if i not in hit]


def test_short_random_windows(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))) for i in range(150)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, 4)
    for r in dc.contamination(d, b, dc.DecontaminateParams(window=4)).collect():
        n, hit, found = want[r.doc_id]
        assert (r.n_hit, r.items) == (len(hit), sorted(found))


def test_repetitive_items_take_linear_time():
    """Every state of one word said over and over links to the one a word shorter."""
    import time

    times = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        a = dc.Automaton.of([("x", [b"so"] * n)], 13)
        spans, found = a.search([b"so"] * n + [b"no"] + [b"so"] * 12)
        times.append(time.perf_counter() - start)
        assert (spans, found) == ([(0, n)], {"x"})
        assert len(a.items) == 1 and len(a.more) == 0
    assert times[1] < 12 * times[0]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in dc.contamination(d, b).collect()] == [(2, 0, 0, False)]
    assert dc.contamination(d.limit(0), b).collect() == [] and dc.cleaned(d, b).count() == 1


def test_query_digest(spark, tmp_path):
    docs, items = [(1, "the quick brown fox"), (2, "nothing")], [(9, "quick brown"), (10, "fox"), (11, "dog")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in dc.query(spark, str(tmp_path)).collect()}
    assert (rows[1].n_hit, rows[1].items_sha256) == (3, hashlib.sha256(b"10,9").hexdigest())
    assert (rows[2].n_hit, rows[2].items_sha256) == (0, hashlib.sha256(b"").hexdigest())
