"""Session settings that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own (tests); a cluster is an error,
    as what its executors write on their own disks is lost to the others."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not known and not current and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if known and not current:
        spark.sparkContext.setCheckpointDir(known)
    elif not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="landloom-"))
    return known or spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more, through whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint in the shared folder, so that a lost executor costs a read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: both sides are dealt by the key. Sizes are guessed by the files, which for rows that are made of their keys are far too small, and a broadcast would lead the whole side through the driver."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt to all tasks: a small file of rows that take long work is one split, and so would be one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; spark's reader takes any path scheme."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it from anywhere."""
    context = spark.sparkContext
    if getattr(context, "_landloom_sent", False):
        return
    context._landloom_sent = True
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="landloom-")) / "landloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")) + sorted(root.rglob("*.yaml")):
            z.write(f, str(Path("landloom") / f.relative_to(root)))
    context.addPyFile(str(path))
