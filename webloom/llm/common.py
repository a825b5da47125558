"""Session helpers shared by the corpus operators: scratch tables, shipping the package, file access."""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a session on this machine alone (as in tests) gets a temporary one; on a cluster it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
        atexit.register(_remove, where)
    return where.rstrip("/")


def _remove(where: str) -> None:
    import shutil

    shutil.rmtree(where.removeprefix("file://"), ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark)
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if f.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix="webloom-ship-"), f"{top}-{app}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(base, f)
                    z.write(p, os.path.join(top, os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri:
        if uri.startswith("file:"):
            uri = "file://" + uri[5:]
        else:
            return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, chunks) -> int:
    """Write byte chunks under a private name, then move into place: a retried task replaces its own file whole."""
    filesystem, path = open_fs(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    n = 0
    with filesystem.open_output_stream(part, compression=None) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    filesystem.move(part, path)
    return n


def read_all(uri: str) -> bytes:
    filesystem, path = open_fs(uri)
    with filesystem.open_input_stream(path, compression=None) as f:
        return f.read()


def open_input(uri: str) -> io.RawIOBase:
    filesystem, path = open_fs(uri)
    return filesystem.open_input_file(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_bounded(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than one row beyond them."""
    return df.limit(rows + 1).count() <= rows
