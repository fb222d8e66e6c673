"""Written tables in the shared folder, which end a lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: written tables need a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="overstrata-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made[base] = spark
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """A folder that goes with the session."""
    _made[path] = spark


class Table:
    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/overstrata-{name}-{uuid.uuid4().hex[:12]}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        _made[self.path] = self.spark
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Call once nothing reads the table any more."""
        delete(self.spark, self.path)
        _made.pop(self.path, None)
