from __future__ import annotations

import base64
import os
import random

import numpy as np
import pytest

import corpus_pipeline
from demandflow.llm import packing
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_near_dedup import plain as plain_components

tiktoken = pytest.importorskip("tiktoken")
PATH = packing.PackParams.ranks_path
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EN, FR = ["the", "ing", "er", "sh", "wh", "tion", "and"], ["eau", "oux", "é", "ç", "que", "ment", "le"]


def words(rng, n, syllables):
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def corpus():
    """(documents, items): clean texts, exact and near copies, benchmark passages, texts of no language, empty ones."""
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 40, EN))) for i in range(5)]
    texts = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        w = words(rng, rng.randint(40, 120), EN if lang == "en" else FR)
        texts.append((" ".join(w), lang))
        if i % 10 == 0:
            texts += [(" ".join(w), lang), (" ".join([*w[:-1], "changed"]), lang)]
        if i % 12 == 5:
            texts.append((" ".join([*w, *items[i % 5][1].split()[3:30]]), lang))
    texts += [(None, "en"), ("", "fr"), ("12 34 ...", "en")]
    rng.shuffle(texts)
    docs = [(i, t, lang, f"s{i % 4}" if i % 9 else None, len(t or "")) for i, (t, lang) in enumerate(texts)]
    return docs, items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, each written and read again as the next one's documents."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, frame = {"documents": docs}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, folder).write.parquet(f"{folder}/out/{name}")
        frame = spark.read.parquet(f"{folder}/out/{name}")
        if name != "packing":
            assert frame.columns == COLUMNS
        out[name] = [tuple(r) for r in frame.collect()]
    return out, items, folder


def test_stages_against_plain_python(stages):
    out, items, _ = stages
    bad = {d[0] for d in out["documents"] if not d[1] or d[1].startswith("12 34")}
    assert sorted(out["language"]) == sorted(d for d in out["documents"] if d[0] not in bad)
    groups = plain_components([d[:2] for d in out["language"]], 5, 80)
    kept = [d for d in out["language"] if groups[d[0]][1] == d[0]]
    assert len(kept) < len(out["language"]) and sorted(out["near_duplicates"]) == sorted(kept)
    hits = plain_hits([d[:2] for d in kept], items)
    clean = [d for d in kept if not (hits[d[0]][1] and 20 * len(hits[d[0]][1]) >= hits[d[0]][0])]
    assert len(clean) < len(kept) and sorted(out["decontamination"]) == sorted(clean)
    assert set(out["mixing"]) <= set(clean)
    sizes = {d[0]: len(d[1].split()) for d in clean}
    names = sorted({d[3] for d in clean}, key=lambda s: (s is None, s or ""))
    size = {s: sum(sizes[d[0]] for d in clean if d[3] == s) for s in names}
    total, weight = 1.5 * sum(size.values()), dict(zip(names, [3, 1, 2] * len(names)))
    target, free = {}, set(names)
    while free:  # share by weight, stop what exceeds its limit, share the rest again
        left, by = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / by > 2 * size[s]}
        target |= {s: 2 * size[s] for s in over} if over else {s: left * weight[s] / by for s in free}
        free = free - over if over else set()
    longest = max(sizes.values())
    for s in names:
        taken = sum(sizes[d[0]] for d in out["mixing"] if d[3] == s)
        assert abs(taken - target[s]) <= longest
    assert max(out["mixing"].count(d) for d in clean) <= 2


def test_packed_ids(stages):
    out, _, _ = stages
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got: dict[int, list[int]] = {}
    for _, ids, _, ends, docs, starts, _ in out["packing"]:
        ids = np.frombuffer(ids, "<u2")
        for doc, start, a, b in zip(docs, starts, ends, ends[1:]):
            assert start == 0  # shorter than a row
            got.setdefault(doc, []).append(ids[a:b].tolist())
    texts = {d[0]: d[1] for d in out["mixing"]}
    for doc, text in texts.items():
        copies = sum(d[0] == doc for d in out["mixing"])
        assert got[doc] == [[*whole.encode_ordinary(text), packing.PackParams.end_id]] * copies
    assert set(got) == set(texts)


def test_run_equals_the_stages(spark, stages):
    out, _, folder = stages
    segments = lambda rows: sorted(d for r in rows for d in r[4])
    assert segments(corpus_pipeline.run(spark, folder).collect()) == segments(out["packing"])
