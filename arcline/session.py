"""Session helpers: a local session for tests, and the checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "arcline", cores: str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a scratch one only where unset in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return named or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops recomputation of the input."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Kept:
    """Tables written once to the shared folder, in packed columns, and deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """``df`` as a table of its own; the tables ``done`` are deleted after it is written."""
        path = f"{shared_folder(self.spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        self.drop(*done)
        return out

    def drop(self, *done: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in done:
            at = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def only(self, *stay: DataFrame) -> None:
        """Delete all but ``stay``."""
        self.drop(*[t for t, _ in list(self.paths.values()) if not any(t is s for s in stay)])

    def tidy(self) -> None:
        """Spark deletes the shuffle files of finished steps when the driver collects its garbage.

        The last query's plan is held until another one has ended, so a query without rows goes first.
        """
        self.spark.range(0).count()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions started where they can't import it."""
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
