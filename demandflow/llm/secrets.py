"""Find secrets: three fixed patterns, and strings that a character Markov model finds random.

Two first-order Markov models over ASCII characters, one of random strings and one of ordinary
identifiers, are estimated from labelled strings of the corpus: values the patterns find, and other
long tokens of a bounded sample of documents. A token counts as random when the log-likelihood ratio
is above a threshold. All DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.session import cut_lineage

#: The patterns' kinds in their order, each with the group whose length is tested and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"  # runs of 18 and 16 characters at least; a run is taken whole
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")
#: Tokens the models look at: runs of these characters, long enough to judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
FIRST, STATES = 32, 96  # code of the first printable ASCII character, number of states


@dataclass(frozen=True)
class SecretParams:
    sample_strings: int = 20_000  # labelled strings of each kind that the models are fitted on, at most
    sample_docs: int = 5_000  # documents (of smallest hash) that ordinary identifiers are taken from
    ordinary_least: int = 6  # characters of an ordinary identifier used for fitting, at least
    smoothing: float = 0.5
    least_ratio: float = 12.0  # log-likelihood ratio (nats) from which a token counts as random
    least_strings: int = 20  # fewer labelled strings of either kind fit no model, and no span is added


def _found(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """Array of (start, kind_no, kind, end, value) of all matches, in code points.

    What is between the matches and the matches themselves, lengths added up in turn, give their
    places. Texts without a match, nearly all of them, are only searched once.
    """
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        value = F.regexp_extract(x["m"], pattern, value_group) if value_group else x["m"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Sorted array of the three patterns' spans in a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    assign = F.filter(_found(t, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, _found(t, ACCESS, "access"), _found(t, HEX, "hex")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def transition_logs(strings: DataFrame, smoothing: float) -> DataFrame:
    """Rows (label, a, b, n) of character pairs' counts in labelled strings (label, value)."""
    at = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = strings.where(F.length("value") > 1).select("label", "value", F.explode(at).alias("i"))
    code = lambda i: F.ascii(F.substring("value", i, 1)) - FIRST
    pairs = pairs.select("label", code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b"))
    return pairs.where(f"a between 0 and {STATES - 1} and b between 0 and {STATES - 1}").groupBy("label", "a", "b").count()


def fit_ratio(docs: DataFrame, spans: DataFrame, p: SecretParams) -> list[float] | None:
    """Log-likelihood ratios of the STATES x STATES character pairs, row by row; None without enough labels.

    `docs` (doc_id, text) and `spans` (text, spans): strings are chosen by smallest hash, the same ones in each run.
    At most STATES^2 numbers a class come to the driver.
    """
    random = spans.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).select(F.col("s.value").alias("value"))
    random = random.where(F.length("value") >= p.ordinary_least).distinct().orderBy(F.xxhash64("value"), "value").limit(p.sample_strings)
    place = F.xxhash64("doc_id")
    last = docs.select(place.alias("h")).orderBy("h").limit(p.sample_docs).agg(F.max("h")).first()[0]
    some = docs.where(place <= F.lit(last))
    rest = F.regexp_replace("text", rf"{ASSIGN}|{ACCESS}|{HEX}", " ")
    words = some.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{%d,}" % p.ordinary_least), F.lit(0))).alias("value")).distinct()
    words = words.orderBy(F.xxhash64("value"), "value").limit(p.sample_strings)
    strings = random.withColumn("label", F.lit(1)).unionByName(words.withColumn("label", F.lit(0)))
    strings = cut_lineage(strings)
    sizes = dict(strings.groupBy("label").count().collect())
    if min(sizes.get(0, 0), sizes.get(1, 0)) < p.least_strings:
        return None
    counts = {(r.label, r.a, r.b): r["count"] for r in transition_logs(strings, p.smoothing).collect()}
    out = []
    for a in range(STATES):
        rows = [[counts.get((label, a, b), 0) + p.smoothing for b in range(STATES)] for label in (1, 0)]
        sums = [sum(r) for r in rows]
        out += [math.log(x / sums[0]) - math.log(y / sums[1]) for x, y in zip(*rows)]
    return out


def _random_tokens(text: Column, ratios: list[float], p: SecretParams) -> Column:
    weights = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")
    code = lambda v, i: F.ascii(F.substring(v, i, 1)) - FIRST

    def score(s):
        v = s["value"]
        return F.aggregate(F.sequence(F.lit(1), F.length(v) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(weights, code(v, i) * STATES + code(v, i + F.lit(1)) + F.lit(1)))

    return F.filter(_found(F.coalesce(text, F.lit("")), TOKEN, "markov"), lambda s: score(s) >= p.least_ratio)


def find_secrets(docs: DataFrame, p: SecretParams = SecretParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and `found`, the sorted spans (start, kind_no, kind, end, value).

    Model spans that touch a pattern's span are left out; patterns' spans always stay. Null and empty
    texts have no spans, repeated rows give repeated rows, an empty table none.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Patterns' spans are small against the texts: kept once for fitting and for the result.
    ratios = fit_ratio(d, d.where(F.col("text").rlike(rf"{ASSIGN}|{ACCESS}|{HEX}")).select(base_spans(F.col("text")).alias("spans")), p)
    base = d.withColumn("base", base_spans(F.col("text")))
    if ratios is None:
        return base.select("doc_id", F.col("base").alias("found"))
    base = base.withColumn("more", _random_tokens(F.col("text"), ratios, p))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return base.select("doc_id", F.array_sort(F.concat("base", F.filter("more", apart))).alias("found"))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each span (merged where they overlap) replaced by a mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    return F.aggregate(found, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))


def query(spark, sf_dir: str) -> DataFrame:
    f = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "markov")
    return f.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


QUERIES = {"op4_secret_scan": (query, None)}
