"""Ordered groups of any size, read in order by tasks of even size.

Rows are dealt by ranges of (group, order), so a group that holds a third of all rows is spread over as many
partitions as it needs. What a task must know of a group's earlier parts is found first: each part of a
group that crosses partitions is summed up on its own, and as at most two groups of a partition cross its
borders, their summaries are bounded by the number of partitions. The last step joins the pieces of such
groups in order, as a stream; groups inside one partition end in their own task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from demandflow.llm.common import slices
from demandflow.session import checkpoint, cut_lineage

PART = "_part"
#: Bytes that a piece of a group's stream holds before it leaves its task.
PIECE_BYTES = 1_000_000
#: Rows of a batch that leaves a task.
BATCH_ROWS = 1000


def dealt_in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows sorted by key and order (nulls first) within ranges; `_part` numbers the ranges in order.

    Rows that agree in all of these columns are in one range. Checkpointed, since several passes must see
    the same ranges.
    """
    return checkpoint(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn(PART, F.spark_partition_id()))


def crossing(dealt: DataFrame, key: str) -> frozenset:
    """Keys with rows in several partitions: those at the ends of two at least."""
    ends = dealt.groupBy(PART).agg(F.min(F.struct(key)).alias("first"), F.max(F.struct(key)).alias("last")).collect()
    return frozenset(k for k, n in Counter(k for r in ends for k in {r["first"][0], r["last"][0]}).items() if n > 1)


def rows_of(batches: Iterator[pa.RecordBatch], columns: Sequence[str], text: str | None = None) -> Iterator[tuple]:
    """Tuples of the columns, a bounded number of bytes of `text` at a time."""
    for batch in slices(batches, text) if text else batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def in_batches(rows: Iterator[tuple], names: Sequence[str], kinds: Sequence[pa.DataType], size: Callable[[tuple], int] = lambda r: 0) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= BATCH_ROWS or weight > 4 * PIECE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def summaries(dealt: DataFrame, key: str, keys: frozenset, columns: Sequence[str], summed: Callable[[Iterator[tuple]], list[int]]) -> dict:
    """{key: [(part, summed(rows of the key in that part)), ...] in order} for the keys that cross."""
    if not keys:
        return {}
    kind, arrow = dealt.schema[key].dataType.simpleString(), arrow_kind(dealt, key)
    wanted = dealt.sparkSession.createDataFrame([(k,) for k in keys], f"_wanted {kind}")
    # At most two keys a partition cross its borders, so this side is small whatever the rows.
    rows = dealt.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_wanted")), "left_semi").select(key, PART, *columns)

    def run(batches):
        for (k, part), group in groupby(rows_of(batches, [key, PART, *columns]), key=itemgetter(0, 1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], arrow), pa.array([part], pa.int32()), pa.array([summed(r[2:] for r in group)], pa.list_(pa.int64()))], [key, PART, "s"])

    out: dict = {}
    for k, part, s in rows.mapInArrow(run, f"{key} {kind}, {PART} int, s array<long>").collect():
        out.setdefault(k, []).append((part, s))
    return {k: sorted(parts) for k, parts in out.items()}


def arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


@dataclass(frozen=True)
class Fold:
    """How a group's rows become numbers and byte streams.

    `zero()` gives a part's numbers, `step(numbers, row)` changes them and returns the bytes that the row
    adds to each stream, `join(left, right)` gives the numbers of two neighbouring parts. A stream loses its
    first `cut` bytes (a separator before every item) and ends as its SHA-256 where `hashed`, else as text.
    """

    zero: Callable[[], list]
    step: Callable[[list, tuple], tuple[bytes, ...]]
    join: Callable[[list, list], list]
    hashed: tuple[bool, ...]
    cut: tuple[int, ...]

    def sinks(self) -> list[Sink]:
        return [Sink(h, c) for h, c in zip(self.hashed, self.cut)]


class Sink:
    def __init__(self, hashed: bool, cut: int):
        self.hashed, self.cut, self.held = hashed, cut, hashlib.sha256() if hashed else bytearray()

    def take(self, data: bytes) -> None:
        if self.cut:
            self.cut, data = max(0, self.cut - len(data)), data[self.cut :]
        if self.hashed:
            self.held.update(data)
        else:
            self.held += data

    def end(self) -> str:
        return self.held.hexdigest() if self.hashed else self.held.decode()


def folded(rows: DataFrame, key: str, columns: Sequence[str], fold: Fold, keys: frozenset, text: str) -> DataFrame:
    """One row a group: key, numbers array<long>, ends array<string> (of the streams).

    `rows` keep the partitions and the order of `dealt_in_order`; `keys` are the groups that cross. A
    SHA-256 has to see its bytes in order, so the pieces of a crossing group meet in one task, which reads
    them as a stream and holds one piece at a time.
    """
    kind, arrow = rows.schema[key].dataType.simpleString(), arrow_kind(rows, key)
    names = [key, PART, "seq", "numbers", "data", "ends"]
    kinds = [arrow, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.string())]
    schema = f"{key} {kind}, {PART} int, seq long, numbers array<long>, data array<binary>, ends array<string>"

    def pieces(batches) -> Iterator[tuple]:
        for (k, part), group in groupby(rows_of(batches, [key, PART, *columns], text), key=itemgetter(0, 1)):
            numbers, seq = fold.zero(), 0
            whole = k not in keys
            if whole:
                sinks = fold.sinks()
                for row in group:
                    for sink, data in zip(sinks, fold.step(numbers, row[2:])):
                        sink.take(data)
                yield k, part, 0, numbers, None, [s.end() for s in sinks]
                continue
            held = [bytearray() for _ in fold.hashed]
            for row in group:
                for stream, data in zip(held, fold.step(numbers, row[2:])):
                    stream += data
                if sum(map(len, held)) > PIECE_BYTES:
                    yield k, part, seq, None, [bytes(s) for s in held], None
                    held, seq = [bytearray() for _ in fold.hashed], seq + 1
            yield k, part, seq, numbers, [bytes(s) for s in held], None

    def joined(batches) -> Iterator[tuple]:
        for k, group in groupby(rows_of(batches, [key, "numbers", "data"]), key=itemgetter(0)):
            numbers, sinks = None, fold.sinks()
            for _, more, data in group:
                for sink, piece in zip(sinks, data):
                    sink.take(piece)
                if more is not None:
                    numbers = more if numbers is None else fold.join(numbers, more)
            yield k, 0, 0, numbers, None, [s.end() for s in sinks]

    size = lambda r: sum(map(len, r[4] or r[5]))
    out = rows.mapInArrow(lambda b: in_batches(pieces(b), names, kinds, size), schema)
    if keys:
        out = cut_lineage(out)
        rest = out.where("ends is null").repartition(key).sortWithinPartitions(key, PART, "seq")
        out = out.where("ends is not null").union(rest.mapInArrow(lambda b: in_batches(joined(b), names, kinds, size), schema))
    return out.select(key, "numbers", "ends")
