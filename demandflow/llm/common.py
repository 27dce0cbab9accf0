"""Helpers shared by the text operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs outside these white-space characters; A-Z are lower-cased, no other letter.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of text a Python step works on at a time, beyond a single text; bounds its memory.
SLICE_BYTES = 4_000_000
#: Bits of a filter for each of its keys, bits of one of its bitmaps (Spark's fixed size), bitmaps at most: 16 MB in all.
KEY_BITS, BITMAP_BITS, MOST_BITMAPS = 16, 32_768, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def binary_texts(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a text column; null becomes empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column` (a single longer text alone)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        first, held = 0, 0
        for row, length in enumerate(lengths):
            if row > first and held + length > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += length
        if first < len(lengths):
            yield batch.slice(first)


def likely_members(rows: DataFrame, of: Column, keys: DataFrame, key: Column) -> DataFrame:
    """The rows with a boolean `_likely`, false only where no row of `keys` has the hash `of` as its `key`.

    One bit a hash, in bitmaps that are broadcast: rows marked false need no join and stay where they are, so long
    texts are shuffled for the others alone. About one row in KEY_BITS is marked true without a key, more
    of them once the bitmaps are at their bound, so an exact join has to follow. `keys` are read twice.
    """
    wanted = math.ceil(KEY_BITS * keys.count() / BITMAP_BITS)
    bits = BITMAP_BITS * min(MOST_BITMAPS, 1 << max(0, wanted - 1).bit_length())
    bitmap = lambda place: F.shiftright(place, 15)
    bit = lambda place: place.bitwiseAND(F.lit(BITMAP_BITS - 1))
    places = keys.select(F.pmod(key, F.lit(bits)).alias("_place")).select(bitmap(F.col("_place")).alias("_bitmap"), bit(F.col("_place")).alias("_bit"))
    maps = places.repartition("_bitmap").groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = F.pmod(of, F.lit(bits))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit(at), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit(at).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(maps), bitmap(at) == F.col("_bitmap"), "left").withColumn("_likely", found).drop("_bitmap", "_bits")
