"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

LOOKUP_ROWS = 50_000
_scratch: list[str] = []


def local_session(cores: str = "*", partitions: int = 8, name: str = "stayscope") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.unix.domain.socket.enabled", "true")  # passes of a few milliseconds wait 50 on TCP
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary folder of this machine stands in only where the setting is absent and the
    session is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="stayscope-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete this process's intermediate tables, once no result that reads them is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        path = hadoop.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    The result has no lineage beyond the files, so a lost executor re-reads a file instead of
    replaying shuffles, and the columnar files keep pruning and pushdown for later passes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_table(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` as a join side: broadcast if it has at most ``limit`` rows, else written to files.

    The size is measured, not assumed. Beyond the limit the join is left to the optimiser, which
    then knows the size of the files and splits skewed partitions at run time.
    """
    head = df.limit(limit + 1).collect()
    if len(head) <= limit:
        return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))
    return materialise(df, "lookup")
