"""Results of micro-batches kept as files that add up, in few folders.

Every micro-batch writes the rows it reduces to into ``batch=<id>``. Every so many batches all rows are merged
into one folder ``upto=<id>``, which stands for all batches up to that one. A reader takes the newest complete
``upto`` folder and the batches after it, so it never sees a batch twice. What is merged stays until the next
merge, for readers that began before.

A restart cannot break this: folders count only when their writer has marked them complete, a repeated batch
or merge replaces its own folder, and a repeated batch that is merged already is not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

MERGE_EVERY = 20

Reduce = Callable[[DataFrame], DataFrame]


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The numbers of the complete folders, ascending, by kind (``batch`` and ``upto``)."""
    files, folder = _file_system(spark, path)
    found: dict[str, list[int]] = {"batch": [], "upto": []}
    if files.exists(folder):
        for status in files.listStatus(folder):
            kind, _, number = status.getPath().getName().partition("=")
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if kind in found and files.exists(done):
                found[kind].append(int(number))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def _current(spark: SparkSession, path: str) -> list[str]:
    found = folders(spark, path)
    merged = found["upto"][-1:]
    after = merged[0] if merged else -1
    return [f"{path}/upto={n}" for n in merged] + [f"{path}/batch={n}" for n in found["batch"] if n > after]


def read_store(spark: SparkSession, path: str, merge: Reduce, schema=None) -> DataFrame:
    """All rows stored so far, merged. ``schema`` serves a store without any batch."""
    paths = _current(spark, path)
    if paths:
        return merge(spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths))
    if schema is None:
        raise ValueError(f"nothing is stored in {path}")
    return merge(spark.createDataFrame([], schema))


def merge_folders(spark: SparkSession, path: str, number: int, merge: Reduce) -> None:
    """Merge what is stored into ``upto=<number>`` and remove what the merge before that replaced."""
    before = folders(spark, path)["upto"]
    if number in before:
        return
    read_store(spark, path, merge).write.mode("overwrite").parquet(f"{path}/upto={number}")
    files, _ = _file_system(spark, path)
    replaced = before[-1] if before else -1
    for kind, numbers in folders(spark, path).items():
        for n in numbers:
            if n < replaced or (kind == "batch" and n == replaced):
                files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)


def write_merged(path: str, reduce: Reduce, merge: Reduce, every: int = MERGE_EVERY) -> Callable[[DataFrame, int], None]:
    """Stores each micro-batch, reduced, and merges after every so many.

    ``merge`` takes rows of any batches, merged ones included, to one row per key. It may also leave out
    rows that are of no use any more; they are gone with the next merge.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id % every == every - 1:
            merge_folders(batch.sparkSession, path, batch_id, merge)

    return write


def store_merged(
    df: DataFrame, path: str, checkpoint: str, reduce: Reduce, merge: Reduce, every: int = MERGE_EVERY, **kwargs
) -> StreamingQuery:
    """Run a stream into a store. The stream itself keeps no state."""
    from tidewire.streaming.runs import for_each_batch

    return for_each_batch(df, write_merged(path, reduce, merge, every), checkpoint, **kwargs)
