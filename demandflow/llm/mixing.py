"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a stream of its documents in hash order, cut into blocks of `block_words` words.
Slot i of the schedule maps the golden-ratio point frac(i * phi) through the sources' cumulative
slot shares; the slots of a source are ranked, and rank r reads block r mod (number of blocks),
so a source is read in full passes, the last one cut at the source's target. All DataFrame
functions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandflow.llm.common import word_count
from demandflow.session import cut_lineage

#: Source weights in turn, the mix's size and a source's limit as multiples of words.
WEIGHTS, TOTAL_SHARE, MOST_PASSES = (3.0, 1.0, 2.0), 1.5, 2.0
#: 2^32 times the golden ratio's fraction, to the next integer: exact Weyl points in integers.
GOLDEN, CIRCLE, PERIOD = 2_654_435_769, 1 << 32, 1 << 31


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = WEIGHTS
    total_share: float = TOTAL_SHARE
    most_passes: float = MOST_PASSES
    block_words: int = 256
    least_chunk: int = 1024  # rows ranked together at least; more of them as the data grow
    seed: str = "mix"


def source_targets(sources: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Rows (source, source_size) with `target` words and the index `src` of the source.

    Water filling: no target exceeds `most_passes` times the source, what is over is shared again by
    weight. With r = limit/weight ascending, level k is what is left over the weights left; the
    first level at or under its own r holds for all. One row a source, so a single window will do.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in p.weights]), (F.col("src") % len(p.weights) + 1).cast("int"))
    s = sources.withColumn("src", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", weight)
    s = s.withColumn("most", F.col("source_size") * p.most_passes).withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", "src")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) * p.total_share - before) / left)
    fits = F.when(F.col("ratio") >= F.col("level"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return s.select("source", "src", "source_size", target.alias("target"))


def _running(df: DataFrame, group: str, chunk: str, order: list, value: Column) -> Column:
    """Sum of `value` over earlier rows of the chunk."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _chunk_starts(df: DataFrame, group: str, chunk: str, value: Column, name: str) -> DataFrame:
    """Sum of `value` over a group's earlier chunks; a group has about the square root of all rows as chunks."""
    sums = df.groupBy(group, chunk).agg(F.sum(value).alias("_v"))
    earlier = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, chunk, F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias(name))


def _chunk_rows(rows: int, least: int) -> int:
    return max(least, 1 << math.ceil(math.log2(max(rows, 1)) / 2))


def _laid_out(docs: DataFrame, sources: DataFrame, rows: int, p: MixParams) -> DataFrame:
    """Documents with the place `start` of their first word in their source's stream."""
    bits = max(0, math.ceil(math.log2(max(1, rows / _chunk_rows(rows, p.least_chunk)))))
    chunk = F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), 28 - min(bits, 28))
    d = docs.join(sources, docs["source"].eqNullSafe(sources["_source"])).drop("_source").withColumn("chunk", chunk)
    starts = _chunk_starts(d, "src", "chunk", F.col("size"), "chunk_start")
    placed = d.withColumn("within", _running(d, "src", "chunk", ["key", "doc_id"], F.col("size")))
    return placed.join(starts, ["src", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("within"))


def schedule(spark, sources: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Slots in reading order: (slot, src, pass, block, words), `words` from the block's front.

    A source needs a fixed number of slots. The points give it that many but for the sequence's
    small discrepancy: slots beyond the need are dropped, missing ones come after the others.
    """
    b = p.block_words
    s = sources.where(F.col("take") > 0).withColumn("blocks", F.ceil(F.col("source_size") / b))
    rest = F.expr("take % source_size")
    s = s.withColumn("need", F.expr("take div source_size") * F.col("blocks") + F.ceil(rest / b))
    up = Window.orderBy("src")
    s = s.withColumn("until", F.sum("need").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total, n_sources = s.agg(F.sum("need"), F.count("*")).first()
    total = int(total or 0)
    cells = 1 << max(10, min(24, math.ceil(math.log2(max(1, 2 * n_sources)))))
    width = CIRCLE // cells
    edge = lambda c: F.floor(c * (CIRCLE / max(total, 1))).cast("long")
    s = s.withColumn("lo", edge(F.col("until") - F.col("need"))).withColumn("hi", edge(F.col("until")))
    shares = s.where("hi > lo").select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"((id % {PERIOD}L) * {GOLDEN}L) % {CIRCLE}L").alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") / width)).withColumn("chunk", F.floor(F.col("slot") / _chunk_rows(total, p.least_chunk)))
    drawn = points.join(shares, "cell").where("lo <= u and u < hi").select("slot", "src", "chunk")
    starts = _chunk_starts(drawn, "src", "chunk", F.lit(1), "chunk_start")
    ranked = drawn.withColumn("within", _running(drawn, "src", "chunk", ["slot"], F.lit(1))).join(starts, ["src", "chunk"])
    ranked = ranked.select("slot", "src", (F.col("chunk_start") + F.col("within")).alias("rank"))
    got = drawn.groupBy("src").agg(F.count("*").alias("got"))
    short = s.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    late = short.select("src", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    every = ranked.unionByName(late.select((F.lit(total) + F.col("rank")).alias("slot"), "src", "rank"))
    every = every.join(s.select("src", "need", "blocks", "source_size", "take"), "src").where("rank < need")
    every = every.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    words = F.least(F.lit(b), F.col("source_size") - F.col("block") * b, F.col("take") - F.col("pass") * F.col("source_size") - F.col("block") * b)
    return every.select("slot", "src", "pass", "block", words.alias("words"))


def mix_rows(docs: DataFrame, p: MixParams = MixParams(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, key, size, source_size, target, taken, copies, first_slot, last_slot.

    `taken` counts the words that the scheduled blocks read from the document, `copies` how often its
    first word is read, `first_slot` and `last_slot` are the schedule's places where that happens first and
    last (null if it never does); reading documents by them gives the mix in order. Null text has no words and is never taken; a null source is a source of its
    own, the last. Equal (doc_id, text) rows are told apart only by their place in the stream. An
    empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(p.seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"))
    d = cut_lineage(d)  # sizes are needed for the targets first; the texts are read once
    sources = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).select("source", "source_size"), p)
    take = F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("source_size") * p.most_passes)).cast("long")
    sources = cut_lineage(sources.withColumn("take", take).coalesce(1))
    placed = _laid_out(d, sources.withColumnRenamed("source", "_source"), d.count(), p)
    b = p.block_words
    first, last = F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}")
    pieces = placed.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    at = F.col("block") * b
    pieces = pieces.withColumn("lo", F.greatest(F.col("start"), at) - at).withColumn("hi", F.least(F.col("start") + F.col("size") - at, F.lit(b)))
    slots = schedule(spark, sources, p).select("slot", "src", "block", "words")
    hit = pieces.join(slots, ["src", "block"], "left").fillna(0, ["words"])
    words = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("words")) - F.col("lo"))
    begun = (F.col("start") >= F.col("block") * b) & (F.col("words") > F.col("lo"))
    own = ["doc_id", "key", "size", "source_size", "target"]
    place = F.when(begun, F.col("slot"))
    found = [F.sum(words).alias("taken"), F.sum(begun.cast("long")).alias("copies"), F.min(place).alias("first_slot"), F.max(place).alias("last_slot")]
    done = hit.groupBy("src", "start", *own).agg(*found)
    nothing = {"taken": 0, "copies": 0, "first_slot": None, "last_slot": None}
    none = placed.where("size = 0").select(*own, *[F.lit(v).cast("long").alias(c) for c, v in nothing.items()])
    return done.select(*own, *nothing).unionByName(none)


def mixed_documents(docs: DataFrame, p: MixParams = MixParams(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as the mix reads them: whole, as often as their first word is read, in the schedule's order.

    Rows lie in ranges of slots: every partition, and every prefix of them, is near the target shares. All columns
    are kept. Rows equal in doc_id and text share their reads evenly, rounded, and spread over their slots.
    """
    ends = [F.min("first_slot").alias("first"), F.max("last_slot").alias("last")]
    counts = mix_rows(docs, p, doc_id, text, source).groupBy("key").agg(F.sum("copies").alias("c"), F.count("*").alias("m"), *ends)
    counts = counts.where("c > 0").select("key", F.round(F.col("c") / F.col("m")).cast("int").alias("n"), "first", "last")
    key = F.md5(F.concat_ws(":", F.lit(p.seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(key.alias("key"), F.struct("*").alias("row")).join(counts.where("n > 0"), "key")
    # The first read is at the first slot, the last one at the last; a source is read twice at most as a rule.
    share = F.when(F.col("n") > 1, (F.col("read") - 1) / (F.col("n") - 1)).otherwise(0.0)
    slot = F.col("first") + F.floor((F.col("last") - F.col("first")) * share)
    read = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("read")).select("row", "key", slot.alias("slot"))
    return read.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_rows(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM f) * weight, most)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT source, take // source_size * ((source_size + 255) // 256) + (take % source_size + 255) // 256 AS need
  FROM (SELECT source, source_size, CAST(floor(target + 0.5) AS BIGINT) AS take FROM t) WHERE take > 0),
e AS (SELECT source, need, CAST(sum(need) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS until, CAST(sum(need) OVER () AS BIGINT) AS total FROM n),
g AS (SELECT source, need, total, floor((until - need) * (4294967296.0::DOUBLE / total)) AS lo, floor(until * (4294967296.0::DOUBLE / total)) AS hi FROM e),
u AS (SELECT i AS slot, ((i % 2147483648) * 2654435769) % 4294967296 AS u FROM (SELECT unnest(range((SELECT any_value(total) FROM e))) AS i)),
w AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM u JOIN g ON u.u >= g.lo AND u.u < g.hi),
c AS (SELECT source, count(*) AS got FROM w GROUP BY source),
o AS (
  SELECT slot, source, rank FROM w
  UNION ALL SELECT total + late, source, late FROM (
    SELECT g.source, g.total, unnest(range(coalesce(c.got, 0), g.need)) AS late FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source))
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(CASE WHEN p.source_size = 0 THEN 0
            ELSE p.take // p.source_size * p.size + greatest(0, least(p.size, p.take % p.source_size - p.start)) END AS BIGINT) AS taken,
       CAST(CASE WHEN p.size > 0 AND p.start < p.take THEN o.slot END AS BIGINT) AS first_slot
FROM p LEFT JOIN o ON o.source IS NOT DISTINCT FROM p.source AND o.rank = p.start // 256
"""

QUERIES = {"op7_source_mix": (query, SQL)}
