from __future__ import annotations

import os
import random

import pytest

from demandflow.llm import token_counts as tc

pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(tc.CountParams.model_path), reason="no vocabulary file")


def plain(word, pieces, byte_score):
    """Best segmentation of one word, by trying every last piece."""
    text = tc.SPACE_MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * byte_score, best[end - 1][1] - size)]
        options += [(best[s][0] + pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in pieces]
        best.append(max(options))
    return -best[-1][1]


@pytest.mark.parametrize("nodes,depth", [(300_000, 256), (40, 256), (300_000, 1), (40, 7)])
def test_counts_equal_plain_segmentation(spark, nodes, depth):
    rng = random.Random(2)
    pieces, byte_score = tc.read_pieces(tc.CountParams.model_path)
    word = lambda: "".join(rng.choice(["the", "an", "tion", "er", "x", "é", "😀", "ñ", "Q", "9", ","]) for _ in range(rng.randint(1, 7)))
    texts = [None, "", " \n", "the", "y" * 3000] + [rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += texts[5:8]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = tc.count_tokens(d, tc.CountParams(nodes=nodes, depth=depth)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = (texts[r.doc_id] or "").split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(plain(w, pieces, byte_score) for w in words))
    assert tc.count_tokens(d.limit(0)).collect() == []


def test_memory_does_not_grow_with_a_word():
    import tracemalloc

    pieces, byte_score = tc.read_pieces(tc.CountParams.model_path)
    trie = tc.Trie(pieces, byte_score, 800_000, 256)
    rng = random.Random(5)
    word = "".join(rng.choice(["the", "an", "tion", "x", "é", "Q"]) for _ in range(150_000))
    raw = word.encode()
    tracemalloc.start()
    tokens = trie[raw]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(raw) > tokens > 0 and trie[word[:2000].encode()] == plain(word[:2000], pieces, byte_score)
    assert len(trie) == 0 and len(trie.score) <= 257
    assert peak < 6 * len(raw)  # the text itself and one copy
