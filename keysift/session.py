"""Session and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("keysift")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, as the session names it.

    Only a local-mode session without ``spark.checkpoint.dir`` gets a temporary
    folder of its own; on a cluster such a folder would vanish with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="keysift-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/keysift/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Paths handed out, by application.
_STAGED: dict[str, list[str]] = {}


def stage(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps do not recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    paths = list(paths)
    own = _STAGED.get(spark.sparkContext.applicationId, [])
    own[:] = [path for path in own if path not in paths]
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete every path :func:`scratch_path` has handed out to this application, once no result needs them any more."""
    delete_paths(spark, _STAGED.pop(spark.sparkContext.applicationId, []))


def estimated_bytes(df: DataFrame) -> int | None:
    """The size of a table as its plan estimates it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no estimate available
        return None


def spread(df, *keys: str, small: int = 64 << 20):
    """Repartition an input that is too small to occupy the cores by itself.

    A large input already arrives in enough splits and is left alone: moving it
    would cost more than it gains.  Only an input whose estimated size is below
    ``small`` bytes per core is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if size is None:  # leave the splits as they are
        return df
    return df.repartition(cores, *keys) if size < small * cores else df
