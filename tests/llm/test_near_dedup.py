from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from demandflow.llm import common
from demandflow.llm import near_dedup as nd


def plain(docs, width, percent):
    """Components by comparing every pair that shares a shingle."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["the", "of", "a", "é"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    passage = pick(60)
    texts = [None, "", "  \n ", "one", "ONE", "one two", "One  Two", "é é é", "É é é"]
    for _ in range(25):
        texts.append(" ".join(pick(rng.randint(1, 90)) + passage * rng.randint(0, 1)))
    for base_size, copies, most in ((150, 60, 9), (40, 20, 2), (300, 40, 12), (12, 15, 1), (80, 40, 5)):
        base = pick(base_size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(len(w))] = rng.choice(words) + str(rng.randint(0, 3))
            texts.append(" ".join(w))
    chain = pick(100)
    for i in range(30):
        texts.append(" ".join(chain))
        chain[(7 * i) % 100] = f"new{i}"
        chain[(7 * i + 1) % 100] = f"more{i}"
    texts += [texts[40]] * 5 + [" ".join(passage + pick(6)) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "percent", "k"), [(1, 3, 85, 32), (2, 5, 80, 32), (3, 3, 85, None)])
def test_components_equal_plain_comparison(spark, seed, width, percent, k):
    docs = corpus(seed)
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, node string, n int")
    want = plain(docs, width, percent)
    rows = nd.near_duplicates(d, nd.NearParams(width=width, percent=percent, k=k)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r.doc_id


def test_repeated_and_missing_ids(spark):
    """Rows that share an id, and rows without one, link by their own texts."""
    docs = corpus(4)[:150]
    want = plain(docs, 3, 85)
    ids = {i: None if i % 3 == 0 else i % 5 for i, _ in docs}
    root, smallest = {i: want[i][1] for i, _ in docs}, {}
    for i, _ in docs:
        if ids[i] is not None:
            smallest[root[i]] = min(ids[i], smallest.get(root[i], 99))
    rows = [(ids[i], t, i) for i, t in docs]
    d = spark.createDataFrame(rows, "doc_id long, text string, place int")
    got = nd.near_duplicates(d, nd.NearParams(width=3, percent=85)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(((ids[i], want[i][0], smallest.get(root[i])) if want[i][0] else (ids[i], 0, ids[i]) for i, _ in docs), key=key)


def test_kept_documents(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "b"), (None, text, "c"), (5, None, "d"), (None, "other words here", "e"), (7, "", "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted((r.doc_id or 0, r.n) for r in nd.one_of_each(d).collect())
    assert got == [(0, "c"), (0, "e"), (1, "b"), (5, "d"), (7, "f")]
    assert nd.near_duplicates(d.limit(0)).count() == 0


def test_least_shared_is_a_tail_bound():
    p = nd.NearParams(width=3, percent=85)
    assert 10 <= p.least_shared <= 16 and nd.NearParams(percent=100).least_shared == p.k


def test_rows_that_are_not_listed_stay_in_place(spark):
    """Long rows are shuffled only where an id may be dropped or repeated, whatever Spark would broadcast."""
    docs = corpus(5)
    ids = [(7919 * i) % 100_003 for i, _ in docs]
    want = plain([(n, t) for n, (_, t) in zip(ids, docs)], 5, 80)
    d = spark.createDataFrame([(n, t) for n, (_, t) in zip(ids, docs)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [r.doc_id for r in nd.one_of_each(d).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = [n for n in ids if want[n][1] == n]
    assert sorted(got) == sorted(kept)
    place = {n: i for i, n in enumerate(ids)}
    first = [place[n] for n in got[: len(kept) * 4 // 5]]
    assert first == sorted(first)


@pytest.mark.parametrize(("n", "bitmaps"), [(0, 4096), (3000, 4096), (3000, 1)])
def test_likely_members_miss_no_key(spark, monkeypatch, n, bitmaps):
    monkeypatch.setattr(common, "MOST_BITMAPS", bitmaps)
    keys = spark.range(n).select((F.col("id") * 7).alias("k"))
    rows = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    got = common.likely_members(rows, F.xxhash64("id"), keys, F.xxhash64("k"))
    assert got.columns == ["id", "_likely"]
    likely = {r.id: r["_likely"] for r in got.collect()}
    assert len(likely) == 40_000 and all(likely[i] for i in range(7, 7 * n, 7))
    others = [v for i, v in likely.items() if i is None or i % 7 or i >= 7 * n]
    assert sum(others) <= len(others) * min(1, (2 * n / (32_768 * min(bitmaps, 2))))
