"""Session helpers: table access and the folder that all executors share."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is missing and Spark runs in a single JVM, a fresh
    temporary folder is made and remembered for the session; elsewhere that is an error,
    as a machine-local folder would lose data with its machine.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sievework-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/sievework/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(written)] = (written, path)
    return written


#: Tables written by materialise that can still be discarded.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def discard(written: DataFrame) -> None:
    """Delete what materialise wrote, once all that reads it has been written itself."""
    known = _WRITTEN.pop(id(written), None)
    if known:
        jvm = written.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(known[1])
        p.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_tables() -> Iterator[None]:
    """Within it a query is made and its result written or collected; tables that materialise wrote on the way are then deleted."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for name in set(_WRITTEN) - before:
            discard(_WRITTEN[name][0])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below a path; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def put_file(spark: SparkSession, label: str, data: bytes) -> str:
    """Write a file to the shared folder and have Spark hand it to all executors, also to those that start later; its name."""
    path = f"{shared_dir(spark)}/sievework/{label}-{uuid.uuid4().hex}.bin"
    write_file(spark, path, data)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on all executors, once for each application, wherever it was imported from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark)}/sievework/package-{uuid.uuid4().hex}.zip"
    write_file(spark, path, data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file in any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
