"""Session construction, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of this library needs; sizes are left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "lodestrand", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    settings = REQUIRED | {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Where none is named, a folder of our own in local mode, where
    executors share the machine; on a cluster that is an error, since results would be lost with an executor."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        sc.setCheckpointDir(named)
    return named


class Workspace:
    """Written tables in the shared folder: they cut lineage, survive lost executors, and are deleted when the
    driver's process ends or `drop` says so."""

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/lodestrand-{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root, quiet=True)

    def _remove(self, path: str, quiet: bool = False) -> None:
        try:
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            if not quiet:
                raise

    def cut(self, df: DataFrame, name: str | None = None, **options: str) -> DataFrame:
        """`df` written once and read back. The shuffles it came from can be freed from then on."""
        path = f"{self.root}/{name or uuid.uuid4().hex}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Frees the shuffle files of finished work now: they go when the driver's JVM collects their handles."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        self._remove(f"{self.root}/{name}")
