"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch holds its k smallest shingle hashes. A pair as similar as the threshold shares,
but for a chance of `miss`, at least `least_shared` sketch values; so it is enough to list each
document under its rarest values, k - least_shared + 1 of them: boilerplate that many documents
share stays out of the inverted lists. Documents of equal shingle sets are one node from the start.

A list of sketch values is not expanded into pairs. The most typical member of each list is its pivot; every
other member is compared with it on full sets. Members the pivot does not link may still be linked with
one another or with members it does; for such a pair the differences from the pivot overlap, and
the same rarest-first listing on differences (exact, no sketch) finds it. What several thousand
near copies have in common cancels out this way. Within these second lists, pairs of members that are not yet
joined meet, and are told apart by their differences or sketches before any set is read.

`k=None` keeps whole sets in place of sketches: then no pair is missed by chance, at the cost of
listing as many values as the sets are long.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.llm.common import likely_members, slices
from demandflow.llm.shingles import shingle_sets
from demandflow.session import checkpoint, cut_lineage, temporary_cuts

#: Text hashed at a time: words, their hashes and joins take many times its bytes in a Python worker.
HASHED_BYTES = 1_000_000


@dataclass(frozen=True)
class NearParams:
    width: int = 5  # words of a shingle
    percent: int = 80  # linked: 100 * intersection >= percent * union
    k: int | None = 32  # sketch values; None: whole sets, exact
    miss: float = 1e-7  # chance that a pair at the threshold shares fewer sketch values than asked for
    part: int = 256  # members compared with one copy of their pivot
    carried: int = 256  # differences of up to so many hashes travel whole, and tell a pair's likeness exactly

    @property
    def similarity(self) -> float:
        return self.percent / 100

    @property
    def held(self) -> int:
        """Values a sketch holds at most."""
        return 1 << 40 if self.k is None else self.k

    @property
    def least_shared(self) -> int:
        """Largest m with P(Binomial(k, similarity) < m) <= miss; of no use where sets are whole."""
        if self.k is None:
            return 1
        t, total = self.similarity, 0.0
        for m in range(self.k):
            total += math.comb(self.k, m) * t**m * (1 - t) ** (self.k - m)
            if total > self.miss:
                return max(1, m)
        return self.k


def _sketches(docs: DataFrame, p: NearParams) -> DataFrame:
    """(doc_id, h, node, n, sketch): h is a hash of the text, node a digest of the shingle set, null for an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text", HASHED_BYTES):
            nodes, sizes, heads = [], [], []
            for s in shingle_sets(batch.column("text"), p.width):
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                heads.append(s[: p.k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "h", "node", "n", "sketch"])

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, h long, node binary, n long, sketch array<long>")


def _sets(docs: DataFrame, p: NearParams) -> DataFrame:
    """(node, s): sorted shingle sets of documents that carry the wanted node; others by the same id are left out."""

    def run(batches):
        for batch in slices(batches, "text", HASHED_BYTES):
            nodes, sets = [], []
            for want, s in zip(batch.column("want").to_pylist(), shingle_sets(batch.column("text"), p.width)):
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want:
                    nodes.append(want)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return docs.mapInArrow(run, "node binary, s array<long>")


def _rarest(entries: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Each owner's rarest `keep` values among those that another one has too.

    `entries`: (by..., node, v, keep, unshared places counted against it). Values seen once come
    first in the order of rarity; they fill places but need no list.
    """
    seen = entries.groupBy(*by, "v").agg(F.count("*").alias("df")).where("df > 1")
    common = entries.join(seen, [*by, "v"])
    owners = common.groupBy(*by, "node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"), F.first("size").alias("size"), F.first("keep").alias("keep"))
    left = (F.col("keep") - (F.col("size") - F.size("vs"))).cast("int")
    return owners.where(left > 0).select(*by, "node", F.explode(F.slice("vs", F.lit(1), left)).alias("e")).select(*by, "node", "e.v", "e.df")


def _compare(pairs: DataFrame, sets: DataFrame, p: NearParams, differences: bool) -> DataFrame:
    """(pivot, node, n, pn, linked, d) for pairs (pivot, node), on full sets; d: hashes in one set only.

    A pivot's members are dealt out in parts, each with a copy of the pivot's set, which comes first.
    """
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / p.part).cast("int").alias("parts"))
    members = pairs.join(sizes, "pivot").select("pivot", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    heads = sizes.select("pivot", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    rows = members.unionByName(heads).join(sets, "node").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    percent = p.percent

    def run(batches):
        head = None
        for batch in batches:
            # A batch of long sets is worked on in slices; offsets tell their sizes.
            out = [[] for _ in range(6)]
            held = 0
            for i in range(batch.num_rows):
                pivot, node, member = (batch.column(c)[i].as_py() for c in ("pivot", "node", "member"))
                s = batch.column("s")[i].values.to_numpy(zero_copy_only=False)
                if not member:
                    head = s
                    continue
                d = np.setxor1d(s, head, assume_unique=True)
                union = (len(s) + len(head) + len(d)) // 2
                both = union - len(d)
                for column, value in zip(out, (pivot, node, len(s), len(head), 100 * both >= percent * union, d if differences else None)):
                    column.append(value)
                held += len(d)
                if held > 500_000:
                    yield _batch(out)
                    out, held = [[] for _ in range(6)], 0
            yield _batch(out)

    def _batch(out):
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["pivot", "node", "n", "pn", "linked", "d"])

    return rows.select("pivot", "node", "member", "s").mapInArrow(run, "pivot binary, node binary, n long, pn long, linked boolean, d array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): the smallest node that can be reached.

    Each round takes the smallest root among neighbours, then the root's own root, until none changes.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("m"))
        better = roots.join(near, roots["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = better.select(F.col("node").alias("r"), F.col("root").alias("up"))
        new = cut_lineage(better.join(jump, better["root"] == jump["r"], "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        roots = new.select("node", "root")
        if not new.where("root <> old").take(1):
            return roots


def near_duplicates(docs: DataFrame, p: NearParams = NearParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept.

    Null, empty and blank texts have no shingles and are alone. Documents with null doc_id take part
    and get their component's smallest id, null if there is none. Rows that repeat a doc_id are
    documents of their own, each with that id. An empty table gives no rows; other columns are not
    looked at. With sketches, a pair just at the threshold is missed with a chance of `miss`; with `k=None` none is.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Tables with long arrays are checkpointed as rows: a parquet reader would hold thousands of them decoded at a time.
    sketched = (checkpoint if p.k is None else cut_lineage)(_sketches(d, p))
    # A node's name is its smallest id, null only if none of its documents has one; h is that document's text.
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("f")
    names = sketched.where("node is not null").groupBy("node").agg(first_of).select("node", F.col("f.doc_id").alias("doc"), F.col("f.h").alias("h"))
    heads = sketched.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # Rarest-first lists of sketch values. A short set is its own sketch; a partner may have lost a few of its values.
    t = p.similarity
    short = F.ceil(F.col("n") * t - 1e-9) - F.greatest(F.lit(0), F.floor(F.col("n") / t + 1e-9) - p.held)
    shared = F.when(F.col("n") < p.held, F.greatest(F.lit(1), short)).otherwise(F.lit(p.least_shared))
    size = F.least(F.col("n"), F.lit(p.held))
    entries = heads.select("node", F.explode("sketch").alias("v"), size.cast("int").alias("size"), (size - shared + 1).cast("int").alias("keep"))
    lists = cut_lineage(_rarest(entries, [], F.col("keep")))
    # The pivot: the member whose listed values are the commonest in all, the same one in each list of a group of copies.
    weight = lists.groupBy("node").agg(F.sum("df").alias("w"))
    weighted = lists.join(weight, "node")
    pivots = weighted.groupBy("v").agg(F.max(F.struct("w", "node")).alias("top"), F.count("*").alias("members")).where("members > 1").select("v", F.col("top.node").alias("pivot"), "members")
    pairs = lists.join(pivots, "v").where("node <> pivot").groupBy("pivot", "node").agg(F.max("members").alias("members"))
    pairs = cut_lineage(pairs)
    wanted = pairs.select("node").union(pairs.select("pivot")).distinct().join(names, "node").select(F.col("node").alias("want"), F.col("doc").alias("_doc"), F.col("h").alias("_h"))
    wanted = cut_lineage(wanted)
    # Texts in no pair stay where they are.
    paired = likely_members(d, F.xxhash64("doc_id", F.xxhash64("text")), wanted, F.xxhash64("_doc", "_h")).where("_likely").drop("_likely")
    # One document a node: by its id and text, and by its text alone where no copy has an id. So neither repeated ids nor missing ones meet all sets.
    same_text = F.xxhash64(paired["text"]) == F.col("_h")
    texts = paired.join(wanted.where("_doc is not null"), (paired["doc_id"] == F.col("_doc")) & same_text).select("want", "text")
    unnamed = paired.where("doc_id is null").join(wanted.where("_doc is null"), same_text).groupBy("want").agg(F.first("text").alias("text"))
    sets = checkpoint(_sets(texts.unionByName(unnamed), p))
    first = checkpoint(_compare(pairs.select("pivot", "node"), sets, p, differences=True))
    edges = [first.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))]
    # Pairs a pivot does not join: one of them unlinked. |x ^ y| <= tau (|x| + |y|) for a link, and x ^ y is what the differences differ in.
    rest = first.where("not linked").select("pivot").distinct()
    open_ = first.join(rest, "pivot").where(F.size("d") > 0)
    length = F.size("d")
    most = F.floor(length * ((1 + (1 - t) / (1 + t)) / 2) + 1e-9) + 1
    keep = F.when(F.col("linked"), F.least(length, most)).otherwise(F.least(length, F.floor(F.col("n") * (1 - t) / t + 1e-9) + 1))
    second = open_.select("pivot", "node", F.explode("d").alias("v"), length.alias("size"), keep.cast("int").alias("keep"))
    rare = cut_lineage(_rarest(second, ["pivot"], F.col("keep")))
    # Lists of the same members give the same pairs: one of them is enough. Lists of one give none.
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(1 << 40))).alias(f"s{salt}") for salt in (1, 2)]
    alike = rare.groupBy("pivot", "v").agg(F.count("*").alias("members"), *sums).where("members > 1").groupBy("pivot", "members", "s1", "s2").agg(F.min("v").alias("v"))
    # Differences that are few, or small against the sets, travel along and tell a pair's likeness exactly.
    small = F.when(length <= F.greatest(F.lit(p.carried), 0.4 * F.least("n", "pn")), F.col("d")).alias("d")
    listed = rare.join(alike, ["pivot", "v"]).join(first.select("pivot", "node", "n", small), ["pivot", "node"]).join(heads.select("node", "sketch"), "node")
    # What the pivots already join needs no second link: only pairs of different roots are looked at.
    listed = listed.join(components(edges[0]), "node", "left").withColumn("root", F.coalesce("root", "node"))
    listed = checkpoint(listed.select("pivot", "v", "node", "n", "root", "d", "sketch"))
    x = listed.toDF("pivot", "v", "xn", "x_n", "x_root", "xd", "xs")
    y = listed.toDF("pivot", "v", "yn", "y_n", "y_root", "yd", "ys")
    fits = (F.col("xn") < F.col("yn")) & (F.col("x_root") != F.col("y_root")) & (100 * F.least("x_n", "y_n") >= p.percent * F.greatest("x_n", "y_n"))
    apart = F.size("xd") + F.size("yd") - 2 * F.size(F.array_intersect("xd", "yd"))
    exact = 100 * (F.col("x_n") + F.col("y_n") - apart) >= p.percent * (F.col("x_n") + F.col("y_n") + apart)
    both = F.array_intersect("xs", "ys")
    union_head = F.slice(F.array_sort(F.array_union("xs", "ys")), 1, min(p.held, (1 << 31) - 1))
    near = (F.size(both) >= p.least_shared) & (F.size(F.array_intersect(union_head, both)) >= p.least_shared)
    # A sketch of a set of at most k is the set; of a longer one it lacks n - k, which a shorter set may share.
    most_shared = F.size(both) + F.greatest(F.lit(0), F.greatest("x_n", "y_n") - p.held)
    whole = (100 + p.percent) * most_shared >= p.percent * (F.col("x_n") + F.col("y_n"))
    by_sketch = F.when(F.least("x_n", "y_n") <= p.held, whole).otherwise(near)
    fits = fits & F.when(F.col("xd").isNotNull() & F.col("yd").isNotNull(), exact).otherwise(by_sketch)
    again = x.join(y, ["pivot", "v"]).where(fits).select(F.col("xn").alias("pivot"), F.col("yn").alias("node")).distinct()
    again = cut_lineage(again.join(pairs, ["pivot", "node"], "left_anti").join(pairs.select(F.col("pivot").alias("node"), F.col("node").alias("pivot")), ["pivot", "node"], "left_anti"))
    edges.append(_compare(again, sets, p, differences=False).where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    roots = components(reduce(DataFrame.union, edges))
    named = names.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    ids = named.join(low, "root").select("node", "component_id")
    out = sketched.select("doc_id", "node", "n").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, p: NearParams = NearParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents, one document of each component: the one of smallest id.

    Rows without id cannot be named by the decision and stay. Rows of equal id and text are copies, of
    which one stays; rows that share an id but not the text stay or go together.
    """
    with temporary_cuts() as keep:
        judged = near_duplicates(docs, p, doc_id, text).where("doc_id is not null")
        # An id of which one row is kept is not listed; it is the usual case.
        listed = keep(judged.groupBy(F.col("doc_id").alias("_id")).agg(F.count_if("kept").alias("_n")).where("_n <> 1"))
    marked = likely_members(docs, F.xxhash64(docs[doc_id]), listed, F.xxhash64("_id"))
    looked_up = marked.where("_likely").drop("_likely")
    find = lambda ids, how: looked_up.join(ids, looked_up[doc_id] == ids["_id"], how)
    out = marked.where("not _likely").drop("_likely").unionByName(find(listed, "left_anti"))
    repeated = listed.where("_n > 1")
    if repeated.take(1):
        out = out.unionByName(find(repeated, "left_semi").dropDuplicates([doc_id, text]))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), NearParams(width=3, percent=85))


QUERIES = {"op9_near_dedup": (query, None)}
