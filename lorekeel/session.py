"""Session creation and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "lorekeel", memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and the master is local (tests, a laptop) a temporary folder of this machine is made
    and kept for the life of the session; on a cluster its executors would not share it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_lorekeel_scratch", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="lorekeel-")
            spark._lorekeel_scratch = root
    return root.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def persist_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    This cuts the lineage in a way that survives the loss of executors: the rows are files in the
    shared folder, not blocks of an executor. The files are removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lorekeel/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> int:
    """Remove every scratch table written so far; results that still read them become invalid."""
    n = 0
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            n += 1
        except Exception:
            pass
    return n


atexit.register(drop_scratch)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a file or a folder of parts)."""
    return spark.read.parquet(table_path(sf_dir, name))


def task_count(df: DataFrame, least: int = 1) -> int:
    """The number of shuffle partitions of the session, the unit in which bucket counts are chosen."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
