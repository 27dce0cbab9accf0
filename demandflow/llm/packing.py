"""Token ids of documents, packed into fixed-length rows.

Each task cuts its documents into pieces of at most a row, gathers pieces up to a bounded number of
tokens, packs those by best-fit decreasing (a segment tree over free capacities finds the fullest
row that still fits), and goes on. Nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import binary_texts, slices

#: The pattern of the rank files, and Unicode's white space as it means it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces of text that the pattern never joins; each is encoded alone, and once while it is remembered.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@dataclass(frozen=True)
class PackParams:
    ranks_path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # read by the driver, sent to the tasks
    row_tokens: int = 2048
    end_id: int = 50256  # ends each document; also fills a row's rest
    group_tokens: int = 2_000_000  # tokens packed together
    remembered: int = 150_000  # chunks whose ids a task remembers at most


class Encoder(dict):
    """Ids by chunk of text, remembered up to a number."""

    def __init__(self, ranks: bytes, remembered: int):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self._remembered = remembered

    def __missing__(self, chunk: str) -> list[int]:
        ids = self._encoding.encode_ordinary(chunk)
        if len(self) >= self._remembered:
            self.clear()
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> Iterable[int]:
        return chain.from_iterable(map(self.__getitem__, CHUNK.findall(text)))


class Capacities:
    """Open rows by free capacity; a segment tree finds the smallest capacity of at least a size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        at = capacity + self.leaves
        while at:
            self.filled[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row that holds `size`, no longer open; None if no row does."""
        at = size + self.leaves
        while not self.filled[at]:  # up to the first subtree to the right with an open row
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at + (not self.filled[2 * at])
        capacity, up = at - self.leaves, at
        while up:
            self.filled[up] -= 1
            up >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is in one row, no row exceeds the capacity."""
    free, rows = Capacities(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if (found := free.take(sizes[piece])) is None:
            rows.append([])
            found = capacity, len(rows) - 1
        rows[found[1]].append(piece)
        if left := found[0] - sizes[piece]:
            free.add(left, found[1])
    return rows


SCHEMA = "pack_id long, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{0}>, piece_starts array<int>, n_tokens int"


def _id_type(p: PackParams, vocabulary: int) -> str:
    return "<u2" if max(p.end_id, vocabulary) < 1 << 16 else "<u4"


def pack(docs: DataFrame, p: PackParams = PackParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `row_tokens` ids: pack_id, ids and positions (little-endian, 2 or 4 bytes an id), cu_seqlens,
    doc_ids and piece_starts (first token's place in its document) by segment, n_tokens without the fill.

    Positions start at 0 in each segment. A document ends with `end_id`; one longer than a row is cut
    into several segments, so all ids come back in order of piece_starts. Null and empty texts are the
    end id alone; repeated rows are packed repeatedly; an empty table gives no rows; other columns are
    not looked at. How documents share rows depends on how the input is split into partitions.
    """
    spark: SparkSession = docs.sparkSession
    with open(p.ranks_path, "rb") as file:
        ranks = file.read()
    if not ranks:
        raise ValueError(f"no ranks in {p.ranks_path}")
    shared = spark.sparkContext.broadcast(ranks)
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    unit = np.dtype(_id_type(p, ranks.count(b"\n")))
    width = p.row_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, p.remembered)
        number = TaskContext.get().partitionId() << 40
        pieces, held = [], 0
        id_type = None
        for batch in slices(batches, "text"):
            id_type = batch.schema.field("doc_id").type
            names = batch.column("doc_id").to_pylist()
            for name, raw in zip(names, binary_texts(batch.column("text")).to_pylist()):
                ids = np.fromiter(chain(encoder.ids(raw.decode("utf-8", "replace")), (p.end_id,)), unit)
                for start in range(0, len(ids), width):
                    pieces.append((name, start, ids[start : start + width]))
                held += len(ids)
                if held >= p.group_tokens:
                    yield from packed(pieces, number, id_type)
                    number, pieces, held = number + (1 << 20), [], 0
        if pieces:
            yield from packed(pieces, number, id_type)

    def packed(pieces, number, id_type):
        rows = best_fit_decreasing([len(x[2]) for x in pieces], width)
        for first in range(0, len(rows), 256):
            out = [[] for _ in range(7)]
            for at, row in enumerate(rows[first : first + 256], first):
                ids, positions = np.full(width, p.end_id, unit), np.zeros(width, unit if width < 1 << 16 else "<u4")
                ends = [0]
                for piece in row:
                    part = pieces[piece][2]
                    ids[ends[-1] : ends[-1] + len(part)] = part
                    positions[ends[-1] : ends[-1] + len(part)] = np.arange(len(part))
                    ends.append(ends[-1] + len(part))
                values = (number + at, ids.tobytes(), positions.tobytes(), ends, [pieces[i][0] for i in row], [pieces[i][1] for i in row], ends[-1])
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["pack_id", "ids", "positions", "cu_seqlens", "doc_ids", "piece_starts", "n_tokens"])

    return d.mapInArrow(run, SCHEMA.format(kind))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_token_packing": (query, None)}
