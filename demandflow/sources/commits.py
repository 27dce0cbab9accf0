"""Tables on disk that change by whole commits.

A table is a folder with `data/<run>/_bucket=<n>` folders of parquet files and `commits/<number>.json`
manifests, each naming the folders that make up one version. A merge reads and rewrites only the buckets
that the new rows touch, stages them under the name of its run, and then adds one manifest: readers see
either the old version or the new one, whatever fails in between. A run that was committed is not repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
#: Runs that a manifest remembers, so that repeating one of them does nothing.
REMEMBERED_RUNS = 1000


class CommitConflict(RuntimeError):
    """Another run has committed since this one began; nothing was changed, run it again."""


def _files(spark: SparkSession, path: str):
    """(file system, function that makes its paths)."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark._jsc.hadoopConfiguration()), new


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest, with its `number`."""
    fs, new = _files(spark, path)
    folder = new(f"{path}/commits")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    if not numbers:
        return None
    stream = fs.open(new(f"{path}/commits/{max(numbers):08d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {**json.loads(text), "number": max(numbers)}


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Add manifest `number` in one step: written beside under a name of its own, then renamed to a name not taken."""
    fs, new = _files(spark, path)
    staged, final = new(f"{path}/commits/_{manifest['run']}.staged"), new(f"{path}/commits/{number:08d}.json")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(staged, final, never)
    except Exception as error:
        if fs.exists(final):
            raise CommitConflict(f"version {number} is taken") from error
        raise


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
    """Rows of a version (of some buckets), with null for columns that a bucket does not have."""
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    folders = [f for b, f in sorted(manifest["folders"].items()) if buckets is None or b in buckets]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, or None where nothing was ever committed."""
    manifest = _manifest(spark, path)
    return None if manifest is None else _read(spark, path, manifest)


def merge_table(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    key: str,
    run: str,
    buckets: int = 64,
) -> bool:
    """Commit `merge(rows of the touched buckets, new)`; False if `run` was committed before.

    `merge` must keep rows of one `key` apart from those of others: buckets are by that column's hash, and
    their number is fixed by the first commit. The touched buckets, at most that many numbers, come to the
    driver; data never does. A failure before the last step leaves staged folders that no version names, and
    running it again writes them anew.
    """
    before = _manifest(spark, path)
    if before is not None and run in before["runs"]:
        return False
    count = buckets if before is None else before["buckets"]
    here = bucket_of(key, count)
    touched = [str(r[0]) for r in new.select(here.alias("b")).distinct().collect()]
    if before is None:
        target = spark.createDataFrame([], new.schema)
    else:
        target = _read(spark, path, before, touched)
    merged = merge(target, new)
    staged = f"data/{run}"
    placed = merged.withColumn(BUCKET, here)
    placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{staged}")
    fs, path_of = _files(spark, path)
    # A touched bucket that has no rows any more has no folder.
    folders = {b: f for b, f in (before["folders"] if before else {}).items() if b not in touched}
    folders |= {b: f"{staged}/{BUCKET}={b}" for b in touched if fs.exists(path_of(f"{path}/{staged}/{BUCKET}={b}"))}
    fields = {f.name: f for f in ([] if before is None else StructType.fromJson(json.loads(before["schema"])).fields)}
    fields |= {f.name: f for f in merged.schema.fields}
    manifest = {
        "run": run,
        "runs": [*(before["runs"] if before else []), run][-REMEMBERED_RUNS:],
        "buckets": count,
        "schema": StructType(list(fields.values())).json(),
        "folders": folders,
    }
    _commit(spark, path, before["number"] + 1 if before else 1, manifest)
    return True
