"""Session factory and the two things every job asks of a session: shared storage and shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillspar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; only where it is unset and all tasks run on this machine, a folder of our own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
        folder = Path(tempfile.mkdtemp(prefix="quillspar-")).as_uri()
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """Tables that a job writes and reads again, in a folder of their own under spark.checkpoint.dir.

    Writing cuts the lineage: a lost executor costs the running stage, not the
    stages before it, and nothing that was written is computed a second time.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{_checkpoint_dir(spark)}/quillspar-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None, **options) -> DataFrame:
        writer = df.write.options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.place(name))
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def place(self, name: str) -> str:
        """The path of a table of this workspace; all are deleted when the application ends, for results may read them until then."""
        path, system = self._at("")
        system.deleteOnExit(path)
        return f"{self.path}/{name}"

    def drop(self, name: str) -> None:
        """Removes a table that nothing reads any more."""
        path, system = self._at(name)
        system.delete(path, True)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="quillspar-code-"), "quillspar_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as to:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".yaml"):
                to.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
