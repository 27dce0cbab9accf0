from __future__ import annotations

import base64
import os
import random
from itertools import permutations

import numpy as np
import pytest

from demandflow.llm import packing

tiktoken = pytest.importorskip("tiktoken")
PATH = packing.PackParams.ranks_path
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
TEXTS = [
    None, "", " ", "plain words here", "don't  stop\n\n now,\tplease! x  y\x1cz \x85", "é😀 ñandú", "x" * 9000,
    " ".join(f"word{i}" for i in range(4000)), "a\n", "  lead", "tail  ", "\n\n\n", "1234567 89!?", "plain words here",
]


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_encode_as_whole_texts():
    encoder, whole = packing.Encoder(open(PATH, "rb").read(), 50), encoding()
    rng = random.Random(4)
    alphabet = "ab1'. \t\n     　\x1f\x85\xa0  é!st"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]:
        assert list(encoder.ids(text)) == whole.encode_ordinary(text)


def test_round_trip(spark):
    docs = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, "again", "z"), (None, "no id", "z")]
    p = packing.PackParams(row_tokens=128, group_tokens=3000)
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, ids string"), p).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    got = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 128 and r.cu_seqlens[-1] == r.n_tokens <= 128
        assert (ids[r.n_tokens :] == p.end_id).all() and (positions[r.n_tokens :] == 0).all()
        for doc, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            got.setdefault(doc, []).append((start, ids[a:b].tolist()))
    whole = encoding()
    for doc in {d[0] for d in docs}:
        texts = [t or "" for i, t, _ in docs if i == doc]
        ids = [x for _, piece in sorted(got[doc], key=lambda x: (x[0], len(x[1]))) for x in piece]
        assert any(ids == [x for t in order for x in [*whole.encode_ordinary(t), p.end_id]] for order in permutations(texts))
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), p).collect() == []


def test_best_fit_matches_plain_search():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.choice([7, 16, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        free = []
        for size in sorted(sizes, reverse=True):
            fitting = [f for f in free if f >= size]
            if fitting:
                free.remove(min(fitting))
                free.append(min(fitting) - size)
            else:
                free.append(capacity - size)
        assert sorted(capacity - sum(sizes[i] for i in r) for r in rows) == sorted(free)
