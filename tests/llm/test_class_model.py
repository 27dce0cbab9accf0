from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from demandflow.llm import class_model as cm

P = cm.ClassParams(clustered=40, classes=6, spellings=5, parts=3, sent_words=60)


def corpus(seed, n=200):
    """Texts in which words of four kinds follow one another in a cycle, among rare words."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(8)] for k in ("noun", "verb", "adj", "det")]
    texts = [None, "", " \n"]
    for _ in range(n):
        words = [rng.choice(kinds[i % 4]) if rng.random() < 0.9 else f"Rare{rng.randint(0, 300)}" for i in range(rng.randint(1, 40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int")


def tokens(text):
    return (text or "").encode().lower().split()


def test_scores_equal_plain_computation(spark):
    train, held = corpus(1) + ["noun1 verb2 adj3 " * 900], corpus(2, 60) + ["unseen words noun1 here", "noun1 " * 5000]
    model, counts, history = cm.train(frame(spark, train).select("text"), P)
    c = Counter(w for t in train for w in tokens(t))
    ends, n = len(train), sum(c.values()) + len(train)
    assert (model.tokens, model.vocabulary) == (n, len(c) + 1)
    assert history == sorted(history) and history[-1] > history[0]
    top = sorted(c, key=lambda w: (-c[w], w))
    sent = model.words
    assert len(sent) <= P.sent_words and all(sent[w][1] == c[w] for w in sent)
    assert set(sent) >= set(top[: P.clustered])
    cls = {w: at for w, (at, _) in sent.items()}
    k, end = model.clustered_classes, len(model.steps) - 1
    of = lambda w: cls[w] if w in cls else k + zlib.crc32(w[-2:]) % P.spellings
    class_n, class_v = Counter(), Counter()
    for w, x in c.items():
        class_n[of(w)] += x
        class_v[of(w)] += 1
    class_n[end], class_v[end] = ends, 1
    follow = Counter()
    for t in train:
        at = [end, *map(of, tokens(t)), end]
        follow.update(zip(at, at[1:]))
    before = Counter()
    for (a, _), x in follow.items():
        before[a] += x
    share = {x: (class_n[x] + 1) / (n + end + 1) for x in range(end + 1)}
    rows = {r.doc_id: r for r in cm.score(frame(spark, held * 2), model, counts).collect()}
    assert len(rows) == 2 * len(held)
    for i, r in rows.items():
        words = tokens((held * 2)[i])
        seq = [(w, of(w), c[w]) for w in words] + [(None, end, ends)]
        base = sum(math.log10((x + 1) / (n + 1 * (len(c) + 2))) for _, _, x in seq)
        score, last = 0.0, end
        for _, at, x in seq:
            score += math.log10((follow[last, at] + P.transition_weight * share[at]) / (before[last] + P.transition_weight))
            score += math.log10((x + 1) / (class_n[at] + class_v[at] + 1))
            last = at
        assert (r.n_tokens, r.n_known) == (len(words) + 1, sum(x > 0 for _, _, x in seq))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    known = [r for r in rows.values() if 5 < r.n_tokens < 100 and r.n_known == r.n_tokens]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_probabilities_sum_to_one(spark):
    model, counts, _ = cm.train(frame(spark, corpus(4)).select("text"), P)
    assert np.allclose((10**model.steps).sum(axis=1), 1)
    by_class, sent = Counter(), model.words
    for r in counts.collect():
        w = bytes(r.word)
        at = sent[w][0] if w in sent else model.clustered_classes + cm.spelling(w, P)
        by_class[at] += 10 ** model.emission(r.c, at)
    for at, x in by_class.items():
        assert x + 10 ** model.emission(0, at) == pytest.approx(1)


def test_moves_equal_plain_likelihood():
    rng = np.random.default_rng(3)
    units, k = 14, 4
    classes = np.concatenate([rng.integers(0, k, 10), k + np.arange(4)])
    pairs = np.array([(a, b, rng.integers(1, 9)) for a in range(units) for b in range(units) if rng.random() < 0.6])
    size = k + 4
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    value = lambda c: f(t := cm.class_table(pairs, c, size)) - f(t.sum(axis=0)) - f(t.sum(axis=1))
    follows = {w: (pairs[pairs[:, 0] == w, 1], pairs[pairs[:, 0] == w, 2].astype(float)) for w in range(10)}
    precedes = {w: (pairs[pairs[:, 1] == w, 0], pairs[pairs[:, 1] == w, 2].astype(float)) for w in range(10)}
    for w in range(10):
        options = []
        for to in range(k):
            new = classes.copy()
            new[w] = to
            options.append(value(new))
        got = dict(cm.moved([w], follows, precedes, classes, cm.class_table(pairs, classes, size), k, 1))
        best = int(np.argmax(options))
        if options[best] > options[classes[w]] + 1e-6:
            assert options[got[w]] == pytest.approx(options[best])
        else:
            assert got == {}


def value(t):
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))


@pytest.mark.parametrize("batch", [3, 1000])
def test_gains_equal_plain_likelihood(batch):
    """Neighbours are of other classes than those a word leaves or may join: then a move changes no cell twice."""
    rng = np.random.default_rng(8)
    k, size = 4, 9
    pairs = [(a, b) for a in range(size) for b in range(size) for _ in range(rng.integers(0, 30) + 200 * (a < k and b == k + a % 3))]
    words = {w: [(int(rng.integers(k, size - 2)), int(rng.integers(k, size - 2))) for _ in range(rng.integers(1, 9))] for w in range(30)}
    words |= {w: [(before, k + w % 3) for before, _ in words[w]] for w in range(0, 30, 2)}
    classes = np.full(30, size - 2)  # the class all leave; the last one is the end
    table = np.zeros((size, size))
    for a, b in pairs:
        table[a, b] += 1
    for ends in words.values():
        for before, after in ends:
            table[before, size - 2] += 1
            table[size - 2, after] += 1
    rows = Counter((w, code) for w, ends in words.items() for before, after in ends for code in (after, size + before))
    rows = np.array([(w, code, n) for (w, code), n in sorted(rows.items())])
    got = dict(cm.gains((rows[i : i + batch] for i in range(0, len(rows), batch)), classes, table, k))
    for w, ends in words.items():
        options = []
        for to in range(k):
            t = table.copy()
            for before, after in ends:
                t[size - 2, after] -= 1
                t[to, after] += 1
            for before, after in ends:
                t[before, size - 2] -= 1
                t[before, to] += 1
            options.append(t)
        values = [value(t) for t in options]
        best = int(np.argmax(values))
        assert got.get(w) == (best if values[best] > value(table) + 1e-6 else None)
    assert 0 < len(got) < 30


def test_placed_words_follow_their_neighbours(spark):
    """Words of one kind, too rare to be clustered, join the classes of the frequent words of that kind."""
    rng = random.Random(6)
    kinds = [([f"{k}{i}" for i in range(5)], [f"few-{k}-{i}" for i in range(12)]) for k in "abcd"]
    texts = [" ".join(rng.choice(kinds[i % 4][rng.random() < 0.1]) for i in range(40)) for _ in range(300)]
    p = cm.ClassParams(clustered=20, classes=4, spellings=5, parts=3, sent_words=200, sweeps=8)
    model, _, history = cm.train(frame(spark, texts).select("text"), p)
    plain, _, _ = cm.train(frame(spark, texts).select("text"), replace(p, placed=False))
    assert history == sorted(history)
    words = model.words
    for often, few in kinds:
        own = Counter(words[w.encode()][0] for w in often).most_common(1)[0][0]
        assert sum(words[w.encode()][0] == own for w in few) >= 10
    assert all(plain.words[w.encode()][0] >= plain.clustered_classes for _, few in kinds for w in few)
    held = frame(spark, [" ".join(rng.choice(kinds[i % 4][rng.random() < 0.1]) for i in range(40)) for _ in range(50)])
    total = lambda m, c: sum(r.score for r in cm.score(held, m, c).collect())
    _, counts, _ = cm.train(frame(spark, texts).select("text"), p)
    assert total(model, counts) > total(plain, counts)


def test_empty_tables(spark):
    model, counts, _ = cm.train(frame(spark, []).select("text"), P)
    r = cm.score(frame(spark, ["a b"]), model, counts).collect()[0]
    assert (r.n_tokens, r.n_known) == (3, 0) and r.base_score == pytest.approx(0) and math.isfinite(r.score)
    assert cm.score(frame(spark, []), model, counts).collect() == []
