from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandflow.llm import language_id as li

SMALL = "/root/testdata/sf0.01"
EVIDENCE = "id long, declared string, suffix string, host string, domain string, text string, vote string"


def texts(rng, n, syllables):
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 40))) for _ in range(n)]


def model_of(spark, rng):
    en, fr = ["the", "ing", "er", "sh", "wh"], ["eau", "oux", "é", "ç", "que"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in texts(rng, 60, en)] + [(t, "fr") for t in texts(rng, 60, fr)])]
    docs = spark.createDataFrame([*rows, (None, None, None), (999, "", "en")], "doc_id long, text string, lang string")
    return li.fit_text_model(docs, li.LanguageParams(sample_docs=100)), en, fr


def test_trigram_buckets():
    a, b = li._buckets("The  END, of 12 it".encode(), 1 << 15), li._buckets("the end of it".encode(), 1 << 15)
    assert a.tolist() == b.tolist() and len(a) == len(" the end of it ") - 2
    assert len(li._buckets(b"", 64)) == 0 and ((0 <= a) & (a < 1 << 15)).all()


def test_evidence_is_fused(spark):
    rng = random.Random(3)
    model, en, fr = model_of(spark, rng)
    assert model.languages == ["en", "fr"] and np.allclose(np.exp(model.logs).sum(axis=0), 1)
    rows = [(i, "en", "net/en", "a.x.net", "x.net", t, "e") for i, t in enumerate(texts(rng, 30, en))]
    rows += [(100 + i, "fr", "net/fr", "b.x.net", "x.net", t, "f") for i, t in enumerate(texts(rng, 30, fr))]
    rows += [(200, "fr", "net/fr", "b.x.net", "x.net", texts(rng, 1, en)[0] * 3, "text tells against all else")]
    rows += [(201, "fr", "net/fr", "b.x.net", "x.net", "thque", "other evidence tells")]
    rows += [(202, "en", "net/en", "a.x.net", "x.net", "quethe", "other evidence tells")]
    rows += [(203, None, None, None, None, texts(rng, 1, fr)[0], "text only")]
    rows += [(204, "en", "net/en", "a.x.net", "x.net", t, "rejected") for t in (None, "", "12 ... !!", "zqxj vvkp jjqz kkwx qqzzj xvbk " * 9)]
    d = spark.createDataFrame(rows * 2, EVIDENCE.replace("vote", "n_note"))
    got = li.identify(d, model)
    assert got.count() == len(rows) * 2 and {"id", "host", "n_note", "language", "posterior", "accepted"} <= set(got.columns)
    for r in got.collect():
        if r.id == 204:
            assert not r.accepted
        else:
            want = {200: "en", 201: "fr", 202: "en", 203: "fr"}.get(r.id, "en" if r.id < 100 else "fr")
            assert (r.language, r.accepted) == (want, True), r
            assert 0.5 <= r.posterior <= 1
    assert li.identify(d.limit(0), model).collect() == []


def test_posterior_equals_plain_computation(spark):
    rng = random.Random(6)
    model, en, fr = model_of(spark, rng)
    p = li.LanguageParams()
    rows = [(i, rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), rng.choice(["h1", "h2", "h3"]), "d", texts(rng, 1, rng.choice([en, fr]))[0][: rng.randint(3, 30)], "") for i in range(40)]
    d = spark.createDataFrame(rows, EVIDENCE.replace("vote", "n_note"))
    logs, votes = {}, {}
    for r in rows:
        b = li._buckets(r[5].encode(), p.buckets)
        total = model.logs[b].sum(axis=0)
        logs[r[0]] = np.maximum(p.temper * (total - total.max()), -p.most_text)
        votes[r[0]] = int(total.argmax()) if total.max() / len(b) + np.log(p.buckets) > 0 else None
    for r in li.identify(d, model).collect():
        row = rows[r.id]
        others = [x for x in rows if x[0] != r.id and votes[x[0]] is not None]
        count = lambda keep, at: np.array([sum(votes[x[0]] == v and x[at] == keep for x in others) for v in (0, 1)], float)  # noqa: E731, B023
        top = np.array([sum(votes[x[0]] == v for x in others) for v in (0, 1)], float)  # noqa: B023
        prior = (top + p.pseudo) / (top.sum() + 2 * p.pseudo)
        for at in (4, 3):
            c = count(row[at], at)
            prior = (c + p.host_weight * prior) / (c.sum() + p.host_weight)
        score = logs[r.id] + np.log(prior)
        for at, size in ((1, len({x[1] for x in rows}) + 1), (2, 3)):
            score = score + np.log((count(row[at], at) + p.pseudo) / (top + size * p.pseudo))
        post = np.exp(score - score.max())
        assert r.posterior == pytest.approx(post.max() / post.sum(), rel=1e-9)
        assert r.language == model.languages[int(score.argmax())]


def test_page_evidence(spark):
    html = '<!DOCTYPE html><HTML class=a lang="FR-ca"><head><title>no</title></head><body><nav>no</nav><script>var no="</p>";</script><p>oui &amp; bien</p><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "https://Blog.Example.net/fr/1?x#y", html, "x"), (2, None, None, "x"), (3, "nothing", "plain", "x")], "page_id long, url string, html string, text string")
    a, b, c = li.page_evidence(pages).orderBy("page_id").collect()
    assert (a.declared, a.suffix, a.host, a.domain, a.text.split()) == ("fr", "net/fr", "blog.example.net", "example.net", ["oui", "bien"])
    assert tuple(b)[1:] == (None,) * 5 and tuple(c)[1:] == (None, None, None, None, "plain")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = li.fit_text_model(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").select("doc_id", "lang", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"), "text")
    right = [r.lang == r.language and r.accepted for r in li.identify(rows, model).collect()]
    assert np.mean(right) > 0.97
    assert li.accepted_documents(docs).count() >= 0.99 * docs.count()


def test_sample_is_bounded_and_no_label_is_left_out(spark):
    rng = random.Random(8)
    rows = [(i, f"the {i} thing", "en") for i in range(4000)] + [(None, "same", "de")] * 3000 + [(i, "au x", f"l{i:03d}") for i in range(300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit_text_model(docs, li.LanguageParams(sample_docs=200, buckets=1 << 8))
    assert len(model.languages) == 302
    # Totals of trigrams tell how many documents of a label were read: en's are 13 or so each.
    sums = lambda name: (np.exp(model.logs[:, model.languages.index(name)]).min() / 0.5) ** -1 - 128
    assert 120 * 10 < sums("en") < 290 * 20
    assert sums("de") < 10 and sums("l000") < 10


def test_documents_with_clashing_columns_and_none(spark):
    rng = random.Random(9)
    good = [(i, t, "en", "s", "k", 1) for i, t in enumerate(texts(rng, 60, ["the", "ing", "er", "sh", "wh"]))]
    rows = [*good, (100, "12 34", "en", "s", "k", 1), (101, None, None, None, None, 1), good[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _key string, n int")
    kept = li.accepted_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *range(60)])
    assert li.accepted_documents(docs.limit(0)).count() == 0
