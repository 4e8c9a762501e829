"""Tables that cut lineage, written to the folder that the whole cluster shares.

`spark.checkpoint.dir` names that folder.  It is read from the session; only where
it is unset (local runs, tests) is a folder of this machine used instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from keylode.runtime import ship

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="keylode-")
    return _LOCAL["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Work:
    """A folder of intermediate Parquet tables of one operator call.

    Tables that the returned DataFrame still reads stay until the application ends;
    others are dropped as soon as the operator is through with them.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            _delete(self.spark, self.root)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
