"""What the operators of this subpackage share: the shared folder, staged tables, raw files."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder of its own (as in tests); on a
    cluster that would lose data, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="strandweave-")
    atexit.register(shutil.rmtree, base, True)
    spark.sparkContext.setCheckpointDir(base)
    return "file://" + base


#: Rows of an Arrow batch in staged work, where the session leaves Spark's default of 10,000: texts are long, and a batch is held
#: several times over (by Spark, by Arrow, as words) in each Python worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Shuffle files of a query go with it, not whenever the driver happens to collect its garbage: what was staged is in the shared folder.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, batch_bytes: int | None = None):
    """The session's settings while a table is staged, with Arrow batches of at most ``batch_bytes``; the caller's own come back."""
    own = {_CLEAN: "true"}
    if batch_bytes:
        most = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
        own[_BYTES] = str(min(batch_bytes, most) if most > 0 else batch_bytes)
    if int(spark.conf.get(_BATCH, "10000")) == 10_000:
        own[_BATCH] = str(BATCH_ROWS)
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files, and a
    lost executor costs only the tasks that it was running."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    with settings(spark, batch_bytes):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_staged_at"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` gave: nothing that is still to be run may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.__dict__["_staged_at"])
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def raw_fs(uri: str):
    """(filesystem, path) for raw files below the shared folder, on whichever store it lies."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[len("file:") :].replace("///", "/", 1).replace("//", "/", 1)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_raw(uri: str, parts) -> None:
    """Write bytes to ``uri`` so that readers see all of them or nothing: tasks may run twice."""
    filesystem, path = raw_fs(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    if filesystem.get_file_info(path).is_file:  # another run of the task was first; its bytes are the same
        filesystem.delete_file(own)
    else:
        filesystem.move(own, path)


def empty_dir(uri: str) -> bool:
    """Whether nothing is at ``uri``."""
    from pyarrow import fs

    filesystem, path = raw_fs(uri)
    return not filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))


def read_raw(uri: str) -> bytes:
    filesystem, path = raw_fs(uri)
    with filesystem.open_input_file(path) as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes that the plan reads; no job runs. 0 where Spark knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def text_key(text: str | Column = "text") -> Column:
    """64 bits of the whole text; null and empty alike."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no label may be learned from."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5) == 0
