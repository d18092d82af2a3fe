"""Session settings that every entry point needs, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results; they can be set on a running session.
RESULT_SETTINGS = {
    # message times are epoch milliseconds in UTC
    "spark.sql.session.timeZone": "UTC",
    # a later tag or field overwrites an earlier one with the same key
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on; resources and partition counts stay as the session has them."""
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tidewire", **conf: str) -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in (RESULT_SETTINGS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_settings(spark)


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewire-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``.

    Only a session in local mode may go without one; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, used by one run only."""
    return f"{shared_folder(spark)}/tidewire/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For a result that several branches of a plan use: the input is scanned once, lineage ends at
    files that survive the loss of executors, and the reader knows the real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
