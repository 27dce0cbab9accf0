"""Language of texts by Bayesian fusion of four kinds of evidence.

A multinomial model over hashed byte trigrams gives the text's likelihood under each language. The
declared markup language and the address suffix enter by how often each value goes with each language,
and the host by a prior that is smoothed towards its domain's and that towards the whole table's. These
tables come from grouped aggregation over all rows, with each row's text verdict as its label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from demandflow.llm.common import binary_texts, lower_ascii, slices
from demandflow.session import cut_lineage


@dataclass(frozen=True)
class LanguageParams:
    sample_docs: int = 2_000  # labelled documents a language that the text model is fitted on, about, or all if there are fewer
    buckets: int = 1 << 15  # of trigram hashes; the model has a number for each bucket and label
    smoothing: float = 0.5
    temper: float = 0.15  # weight of a trigram's log-likelihood: neighbours overlap, so they tell less than apart
    most_text: float = 60.0  # nats the text may speak against a language, so that other evidence is heard
    host_weight: float = 5.0  # rows a domain's shares count for in its hosts' priors, and the table's in its domains'
    pseudo: float = 1.0  # rows added to each (language, declared or suffix value)
    least_posterior: float = 0.5
    broadcast_rows: int = 500_000  # rejected rows that are sent to all tasks at most
    task_rows: int = 20_000  # rows a task judges, about: few bytes but long expressions


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    logs: np.ndarray  # buckets x languages
    temper: float
    most_text: float


def _buckets(raw: bytes, buckets: int) -> np.ndarray:
    """Hashed byte trigrams of a text, A-Z lower-cased, digits and punctuation as spaces, with a space at both ends."""
    b = np.frombuffer(b" " + raw.translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def fit_text_model(docs: DataFrame, p: LanguageParams = LanguageParams(), doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> TextModel:
    """Trigram shares of each label, from distinct documents whose hash is under the label's share.

    Every label is a language. A label of n documents is fitted on each of them with a chance of `sample_docs` / n by
    the hash of id and text, so on about `sample_docs` whatever n is; repeated rows count once. Labels
    x `buckets` counts come to the driver.
    """
    sizes = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_of")).agg(F.count("*").alias("n"))
    sizes = cut_lineage(sizes)
    labels = sorted(r[0] for r in sizes.select("_of").collect())
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 52))
    named = docs.select(F.col(label).alias("label"), place.alias("h"), F.col(text).alias("text")).join(F.broadcast(sizes), F.col("label") == F.col("_of"))
    chosen = named.where(F.col("h") < F.lit(float(1 << 52)) * p.sample_docs / F.col("n")).groupBy("label", "h").agg(F.first("text").alias("text"))
    buckets = p.buckets

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for name, raw in zip(batch.column("label").to_pylist(), binary_texts(batch.column("text")).to_pylist()):
                sums.setdefault(name, np.zeros(buckets, np.int64))
                sums[name] += np.bincount(_buckets(raw, buckets), minlength=buckets)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["label", "bucket", "n"])

    rows = chosen.select("label", "text").mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    sums = np.full((buckets, max(1, len(labels))), p.smoothing)
    at = {name: i for i, name in enumerate(labels)}
    for r in rows:
        sums[r.bucket, at[r.label]] += r.n
    return TextModel(labels, np.log(sums / sums.sum(axis=0)), p.temper, p.most_text)


def text_evidence(rows: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """Adds `text_logs` (a number a language, the best one 0), `trigrams` and `fit`, the best language's gain per
    trigram over the plain uniform share; both null for a text without letters. `text` goes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.drop(text)
    names = kept.columns
    added = [StructField("text_logs", ArrayType(DoubleType())), StructField("trigrams", LongType()), StructField("fit", DoubleType())]
    out = StructType([*kept.schema.fields, *added])

    def run(batches):
        m = shared.value
        buckets = len(m.logs)
        for batch in slices(batches, text):
            logs, sizes, fits = [], [], []
            for raw in binary_texts(batch.column(text)).to_pylist():
                found = _buckets(raw, buckets)
                total = np.bincount(found, minlength=buckets) @ m.logs if len(found) > 4 * buckets else m.logs[found].sum(axis=0)
                logs.append(np.maximum(m.temper * (total - total.max()), -m.most_text).tolist() if len(found) and m.languages else None)
                sizes.append(len(found))
                fits.append(float(total.max() / len(found) + math.log(buckets)) if len(found) and m.languages else None)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(logs, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(fits, pa.float64())], [*names, "text_logs", "trigrams", "fit"])

    return rows.select(*names, text).mapInArrow(run, out)


def _shares(rows: DataFrame, by: list[str], votes: int) -> DataFrame:
    """Number of votes for each language by group, as an array."""
    one = [F.sum((F.col("vote") == i).cast("double")) for i in range(votes)]
    return rows.where("vote is not null").groupBy(*by).agg(F.array(*one).alias("n"))


def identify(rows: DataFrame, model: TextModel, p: LanguageParams = LanguageParams()) -> DataFrame:
    """Adds language, posterior and accepted to rows (any columns, declared, suffix, host, domain, text); those six but host go.

    A row's own vote is taken out of the tables it meets. Text without letters speaks for no language; null evidence of
    a kind is a value of its own for markup and suffix, and the whole table's prior for the host. Not accepted: no
    letters, a text that fits the best language worse than chance, or a posterior under `least_posterior`. Without
    labelled documents there is no language, and nothing is accepted. Of languages with equal posteriors the first by
    code point is taken.
    """
    n = len(model.languages)
    e = text_evidence(rows, model)
    best = F.when(F.col("text_logs").isNotNull() & (F.col("fit") > 0), F.array_position("text_logs", F.lit(0.0)).cast("int") - 1)
    e = cut_lineage(e.withColumn("vote", best))  # the tables below need all rows' votes before any row is judged
    if n == 0:
        return e.drop("declared", "suffix", "domain", "text_logs", "vote", "trigrams", "fit").withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "accepted": F.lit(False)})
    zeros = F.array(*[F.lit(0.0)] * n)
    e = e.repartition(-(-max(1, e.count()) // p.task_rows))
    whole = _shares(e, [], n).withColumn("n", F.coalesce("n", zeros)).first()["n"]  # one number a language
    whole = [x or 0.0 for x in whole]
    own = F.transform(zeros, lambda _, i: F.when(F.col("vote") == i, 1.0).otherwise(0.0))
    less = lambda a: F.zip_with(F.coalesce(a, zeros), own, lambda x, o: F.greatest(F.lit(0.0), x - o))
    top = less(F.array(*[F.lit(x) for x in whole]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    root = F.transform(top, lambda x: (x + p.pseudo) / (total(top) + n * p.pseudo))

    def smoothed(counts: Column, above: Column) -> Column:
        return F.zip_with(counts, above, lambda x, a: (x + p.host_weight * a) / (total(counts) + p.host_weight))

    # Hosts and values are looked up by equi-joins; counts by group are far fewer than rows. Written first, so that Spark
    # knows which to ship before it would shuffle the rows by a key that most of them share.
    for key in ("declared", "suffix"):
        table = cut_lineage(_shares(e, [key], n)).withColumnsRenamed({"n": f"n_{key}", key: f"_{key}"})
        e = e.join(table, e[key].eqNullSafe(F.col(f"_{key}")), "left").drop(f"_{key}")
    values = {key: F.lit(float(e.select(key).distinct().count() + 1)) for key in ("declared", "suffix")}
    domains = cut_lineage(_shares(e.where("domain is not null"), ["domain"], n)).withColumnRenamed("n", "n_domain")
    hosts = cut_lineage(_shares(e.where("host is not null"), ["host"], n)).withColumnRenamed("n", "n_host")
    e = e.join(domains, "domain", "left").join(hosts, "host", "left")
    e = e.withColumn("prior", smoothed(less(F.col("n_domain")), root)).withColumn("prior", smoothed(less(F.col("n_host")), F.col("prior")))
    e = e.withColumn("top", top)
    e = e.withColumn("logs", F.zip_with(F.coalesce("text_logs", zeros), "prior", lambda t, x: t + F.ln(x)))
    def chance(key: str) -> Column:
        return F.zip_with(less(F.col(f"n_{key}")), "top", lambda x, a: (x + p.pseudo) / (a + values[key] * p.pseudo))

    for key in values:
        e = e.withColumn("logs", F.zip_with("logs", chance(key), lambda s, x: s + F.ln(x)))
    high = F.array_max("logs")
    e = e.withColumn("posterior", 1.0 / total(F.transform("logs", lambda x: F.exp(x - high))))
    names = F.array(*[F.lit(x) for x in model.languages])
    e = e.withColumn("language", F.element_at(names, F.array_position("logs", high).cast("int")))
    accepted = F.coalesce((F.col("fit") > 0) & (F.col("posterior") >= p.least_posterior), F.lit(False))
    return e.withColumn("accepted", accepted).drop("declared", "suffix", "domain", "text_logs", "trigrams", "fit", "vote", "prior", "top", "logs", "n_declared", "n_suffix", "n_domain", "n_host")


def page_evidence(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, declared, suffix, host, domain, text) of raw pages; null where the page does not tell."""
    some = lambda c: F.when(c != "", c)
    host = lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1))
    named = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[A-Za-z0-9#]+;", " ")
    directory = F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})/", 1)
    suffix = F.concat_ws("/", F.substring_index(host, ".", -1), lower_ascii(directory))
    return pages.select(F.col(page_id).alias("page_id"), some(lower_ascii(named)).alias("declared"), F.when(host != "", suffix).alias("suffix"), some(host).alias("host"), some(F.substring_index(host, ".", -2)).alias("domain"), text.alias("text"))


def accepted_documents(docs: DataFrame, p: LanguageParams = LanguageParams(), doc_id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """All columns of the documents whose language is accepted; the declared language and the source are the evidence beside the text."""
    model = fit_text_model(docs, p, doc_id, text, declared)
    key = F.xxhash64(F.col(doc_id), F.col(text), F.col(declared), F.col(host))
    rows = docs.select(key.alias("key"), F.col(declared).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col(host).alias("host"), F.lit(None).cast("string").alias("domain"), F.col(text).alias("text"))
    bad = cut_lineage(identify(rows, model, p).where("not accepted").select(F.col("key").alias("_key")).distinct())
    if bad.count() <= p.broadcast_rows:  # longs; more of them are joined by a shuffle
        bad = F.broadcast(bad)
    return docs.join(bad, key == bad["_key"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    judged = identify(page_evidence(pages), fit_text_model(docs))
    return judged.select("page_id", "host", "language", "posterior", "accepted")


QUERIES = {"op2_language_id": (query, None)}
