"""The latest state of every key, kept by a stream of log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_latest(spark: SparkSession, schema: T.StructType, path: str, key: str, order: Sequence[str], values: Sequence[str], out: str) -> str:
    """Read what a folder or file of Parquet holds as a stream and write the last row of
    each key, tombstones included, to a table: a version for each batch that ran.
    State is one row for each key.  Returns the folder of the last version; without any
    file to read, that of an empty one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row")).select(key, *(f"_row.{c}" for c in values))
    last: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        target = f"{out}/batch-{number}"
        batch.write.mode("overwrite").parquet(target)
        last[:] = [target]

    query = best.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        shape = T.StructType([schema[c] for c in dict.fromkeys([key, *values])])
        write(spark.createDataFrame([], shape), 0)
    return last[0]

