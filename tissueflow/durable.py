"""Tables between the jobs of one operator: written to the folder that the whole cluster shares, and deleted when done."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting by which Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the whole cluster sees.

    Only where that setting is absent and the session runs on one machine (tests) is a local folder chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = _own[0]
    return f"{root.rstrip('/')}/saved-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    The shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete what :func:`saved` wrote for these frames; nothing that is still to run may read them."""
    for t in tables:
        jvm = t.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if "/saved-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
                path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
