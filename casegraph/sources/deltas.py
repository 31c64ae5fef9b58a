"""A cumulative store that costs what changes: buckets of a key, each a base and later changes.

A change adds a file of its rows to the buckets that it touches; a bucket with many changes
is folded into a new base while it is written to anyway.  What a version consists of stands
in one small list of folders, published by a rename that only one writer can win, so a
killed writer leaves the version before it in place, and two writers do not lose each
other's rows: the loser reads the new version and tries again.  Batches are known by id
and count once.

Rows are told to the store by ``combine``, which turns rows of one schema into a row for
each key and does not care how they were grouped before: sums, extremes, unions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.operators.graph import settled

Combine = Callable[[DataFrame], DataFrame]
#: Changes that a bucket holds before it is folded, and tries of a writer that loses.
MOST_CHANGES, TRIES = 4, 20


@dataclass
class Version:
    """What the store consists of: for each bucket its folders, the base first."""

    number: int
    buckets: int
    schema: str
    folders: dict[str, list[str]] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)
    rows_written: int = 0


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest version, None where there is no store yet."""
    folder, fs = _files(spark, f"{path}/versions")
    if not fs.exists(folder):
        return None
    numbers = [int(name[:-5]) for x in fs.listStatus(folder) if (name := x.getPath().getName()).endswith(".json") and name[0] != "."]
    if not numbers:
        return None
    text = spark.read.text(f"{path}/versions/{max(numbers):09d}.json", wholetext=True).first()[0]
    return Version(**json.loads(text))


def _published(spark: SparkSession, path: str, version: Version) -> bool:
    """Whether this version is now the newest: false if another writer was faster."""
    waiting, fs = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    final, _ = _files(spark, f"{path}/versions/{version.number:09d}.json")
    out = fs.create(waiting, False)
    out.write(bytearray(json.dumps(version.__dict__).encode()))
    out.close()
    if not fs.exists(final) and fs.rename(waiting, final):
        return True
    fs.delete(waiting, False)
    return False


def _rows(spark: SparkSession, path: str, version: Version, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(version.schema))
    paths = [f"{path}/data/{f}/bucket={b}" for b, folders in sorted(version.folders.items()) if buckets is None or b in buckets for f in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stored(spark: SparkSession, path: str, combine: Combine) -> DataFrame:
    """The rows of the store, one for each key."""
    version = current(spark, path)
    if version is None:
        raise ValueError(f"no store at {path}")
    return combine(_rows(spark, path, version))


def merge(path: str, new: DataFrame, combine: Combine, key: str, batch: str, *, buckets: int = 64, most_changes: int = MOST_CHANGES) -> Version:
    """The store after ``new`` rows; a batch that is in it already changes nothing.

    ``buckets`` counts when the store is made.  Keys are not null.
    """
    spark = new.sparkSession
    change = None
    for _ in range(TRIES):
        version = current(spark, path) or Version(0, buckets, new.schema.json())
        if batch in version.batches:
            return version
        if change is None:
            change = settled(combine(new).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(version.buckets)).cast("int")))
        touched = [str(r[0]) for r in change.select("bucket").distinct().collect()]  # buckets at most
        full = [b for b in touched if len(version.folders.get(b, ())) > most_changes]
        rows = change
        if full:
            inside = F.col("bucket").cast("string").isin(full)
            old = _rows(spark, path, version, full)
            folded = combine(old.unionByName(change.filter(inside).drop("bucket"))).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(version.buckets)).cast("int"))
            rows = change.filter(~inside).unionByName(folded)
        folder = uuid.uuid4().hex
        target = f"{path}/data/{folder}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(target)
        written = spark.read.parquet(target).count() if touched else 0
        folders = version.folders | {b: [folder] if b in full else [*version.folders.get(b, ()), folder] for b in touched}
        after = Version(version.number + 1, version.buckets, version.schema, folders, [*version.batches, batch], written)
        if _published(spark, path, after):
            return after
        done, fs = _files(spark, target)
        fs.delete(done, True)
    raise RuntimeError(f"{TRIES} other writers were faster at {path}")


def swept(spark: SparkSession, path: str) -> int:
    """Delete the folders that the newest version does not hold, such as killed writers leave.

    Readers of older versions and writers at work must be done.  Returns how many went.
    """
    version = current(spark, path)
    held = {f for folders in version.folders.values() for f in folders} if version else set()
    folder, fs = _files(spark, f"{path}/data")
    gone = [x.getPath() for x in (fs.listStatus(folder) if fs.exists(folder) else ()) if x.getPath().getName() not in held]
    for x in gone:
        fs.delete(x, True)
    return len(gone)


def keep(stream: DataFrame, path: str, combine: Combine, key: str, checkpoint: str, name: str = "stream", **options):
    """Merge a stream's micro-batches into the store, each once, whatever is run again."""

    def step(batch: DataFrame, number: int) -> None:
        merge(path, batch, combine, key, f"{name}-{number}", **options)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
