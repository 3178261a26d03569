"""Sketches and bottom-k samples that grow with a stream.

Both states are small, mergeable and indifferent to order (a maximum per register; the smallest finalizers with their counts), so each
micro-batch is aggregated like a batch and merged into the state kept as a table, one folder per batch. A batch that
is run again overwrites its own folder from its predecessor's, which makes the merge exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import bits
from ..operators import abundance, sketch


class _State:
    """Versions of a small table, one per batch, below a folder that driver and executors share."""

    def __init__(self, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.folder, self.schema, self._merge = folder.rstrip("/"), schema, merge

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}"

    def _exists(self, spark, version: int) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self._path(version) + "/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def at(self, spark, version: int) -> DataFrame:
        """The state after a batch; before the first, no rows."""
        if version < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._path(version))

    def latest(self, spark) -> DataFrame:
        version = -1
        while self._exists(spark, version + 1):
            version += 1
        return self.at(spark, version)

    def update(self, batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        self._merge(self.at(spark, version - 1).unionByName(batch)).write.mode("overwrite").parquet(self._path(version))


class RegisterStream:
    """Registers of a stream of BIGINT keys, in groups ``by``."""

    def __init__(self, folder: str, key: str, by: list[str] = (), p: int = sketch.DEFAULT_P, by_schema: str = ""):
        self.key, self.by, self.p = key, list(by), p
        schema = (by_schema + ", " if by_schema else "") + "idx int, rho int"
        self.state = _State(folder, schema, lambda rows: sketch.merged(rows, self.by))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.state.update(sketch.registers(batch, self.key, self.by, self.p), batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class BottomKStream:
    """The ``size`` keys of a stream with the smallest finalizers, with their exact counts.

    A key among the smallest overall is among the smallest of every part that has it, so nothing that is dropped between
    batches could come back with a count.
    """

    def __init__(self, folder: str, key: str, size: int, cap: int | None = None):
        self.key, self.size, self.cap = key, size, cap
        self.state = _State(folder, "key bigint, n bigint", self._smallest)

    def _smallest(self, rows: DataFrame) -> DataFrame:
        n = F.sum("n")
        summed = rows.groupBy("key").agg((n if self.cap is None else F.least(n, F.lit(self.cap).cast("bigint"))).alias("n"))
        return summed.orderBy(bits.flip(bits.finalize("key"))).limit(self.size)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        own = abundance.counts(batch.select(F.col(self.key).cast("bigint").alias("key")), "key").where("key is not null")
        self.state.update(self._smallest(own), batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
