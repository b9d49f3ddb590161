"""Session settings, the shared folder and staged tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_staged_paths: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """All times mean UTC; Python workers exchange Arrow batches."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables; a Parquet file or a folder of part files."""
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is set, but only on a local master: on a
    cluster a machine's own folder would be lost with the machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="fleetloom-")
    atexit.register(_forget, made)
    context.setCheckpointDir(made)
    return made


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _staged_paths.append(path)
    return path


def staged(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read any more; ``df`` is what ``staged`` returned."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in _staged_paths if folder.endswith(p.split("://", 1)[-1].lstrip("/"))]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _staged_paths.remove(path)


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all: written aside, then renamed.

    Raises FileExistsError if the path is taken (on a shared file system the rename itself decides between two writers).
    """
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    aside, target = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (f".{name}.{uuid.uuid4().hex}", name))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    stream = fs.create(aside, False)
    stream.write(text.encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(target):
            raise FileExistsError(path) from e
        raise


def read_file(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (taken as UTC)."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def forget_staged(spark: SparkSession) -> int:
    """Delete the tables that this application staged; how many. Results that still read them must be written first."""
    jvm, n = spark.sparkContext._jvm, 0
    while _staged_paths:
        path = jvm.org.apache.hadoop.fs.Path(_staged_paths.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n
