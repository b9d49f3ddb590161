"""Stored tables: versions of Parquet files with an atomic switch, and JDBC."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators import tables as ops
from fleetloom.session import create_file, read_file


def jdbc_table(spark: SparkSession, url: str, table: str, timeout_s: int = 30, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table over JDBC; with ``column`` and ``bounds`` read in ``parts`` ranges at once. The driver must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("queryTimeout", timeout_s).option("pushDownAggregate", "true")
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


class StoredTable:
    """A table whose versions are folders of Parquet files; a log entry per version names the folders that are in it.

    A writer makes the next log entry appear at once, which fails if another took it: that is the switch. Readers see the
    newest entry. Appends add a folder, rewrites replace all. A writer that dies leaves a folder that no entry names, for
    ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _entries(self) -> list[int]:
        fs, p = self._fs("_log")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split(".")[0]) for n in names if not n.startswith("."))  # what is still being written begins with a dot

    def _entry(self) -> tuple[int, dict]:
        known = self._entries()
        if not known:
            return 0, {"folders": [], "batches": {}}
        return known[-1], json.loads(read_file(self.spark, f"{self.path}/_log/{known[-1]:020d}.json"))

    def read(self) -> DataFrame:
        folders = self._entry()[1]["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, df: DataFrame, keep: bool, batch: tuple[str, int] | None) -> bool:
        version, entry = self._entry()
        if batch and entry["batches"].get(batch[0], -1) >= batch[1]:
            return False  # this micro-batch is in already
        folder = f"data-{uuid.uuid4().hex}"
        types = self.spark.createDataFrame([], self.schema).schema
        df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in types]).write.parquet(f"{self.path}/{folder}")
        batches = entry["batches"] | ({batch[0]: batch[1]} if batch else {})
        entry = {"folders": [*(entry["folders"] if keep else []), folder], "batches": batches}
        create_file(self.spark, f"{self.path}/_log/{version + 1:020d}.json", json.dumps(entry))
        return True

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add rows. ``batch`` names a query and its micro-batch: one that is repeated after a failure does nothing."""
        return self._write(df, True, batch)

    def replace(self, df: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        return self._write(df, False, batch)

    def insert_new(self, rows: DataFrame, key: str, batch: tuple[str, int] | None = None) -> bool:
        """Add the rows whose key isn't held: a repeated event does nothing."""
        return self.append(ops.insert_new(self.read(), rows, key), batch)

    def vacuum(self) -> int:
        """Delete folders that the newest version doesn't name; how many."""
        fs, p = self._fs("")
        held = set(self._entry()[1]["folders"])
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in held]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


class KeyedTable:
    """A table with one row for each key. A change appends the new row; readers see the newest of each key, ``compact`` keeps only these.

    A batch of changes costs as much as it touches, not as the table holds. Rows with a null key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.table, self.key = StoredTable(spark, path, f"{schema}, _version bigint"), key

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in (self.key, "_version")]
        best = F.max_by(F.struct(*names), "_version")
        return rows.groupBy(self.key).agg(best.alias("_r")).select(*[F.col(c) if c == self.key else F.col(f"_r.{c}").alias(c) for c in rows.columns if c != "_version"])

    def read(self) -> DataFrame:
        return self._newest(self.table.read())

    def held(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; ``keys`` has the key column."""
        return self._newest(self.table.read().join(keys.select(self.key).distinct(), self.key, "left_semi"))

    def put(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Rows of new keys and changed rows, whole; one row for each key."""
        version = self.table._entry()[0] + 1
        columns = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in self.read().columns]
        return self.table.append(rows.where(F.col(self.key).isNotNull()).select(*columns, F.lit(version).cast("bigint").alias("_version")), batch)

    def compact(self) -> None:
        self.table.replace(self.read().withColumn("_version", F.lit(0).cast("bigint")))


# The zones that a new installation starts with: name, type, west, south, east, north, factor.
FIRST_ZONES = (
    ("Vondelpark Construction", "CONSTRUCTION", 4.8650, 52.3580, 4.8750, 52.3620, "0.40"),
    ("Central Station Traffic", "TRAFFIC", 4.8950, 52.3770, 4.9050, 52.3810, "0.50"),
    ("De Pijp School Zone", "SCHOOL", 4.8900, 52.3500, 4.8980, 52.3540, "0.60"),
    ("Jordaan Narrow Streets", "TRAFFIC", 4.8780, 52.3700, 4.8870, 52.3740, "0.55"),
)


def first_zones(spark: SparkSession) -> DataFrame:
    """The zones of a new installation, as a table."""
    from fleetloom.schemas import GEOFENCE_ZONES

    box = lambda w, s, e, n: f"POLYGON(({w} {s}, {e} {s}, {e} {n}, {w} {n}, {w} {s}))"
    rows = [(f"zone-{k}", name, kind, box(w, s, e, n), factor) for k, (name, kind, w, s, e, n, factor) in enumerate(FIRST_ZONES)]
    df = spark.createDataFrame(rows, "id string, name string, zone_type string, geometry string, factor string")
    names = [c.split(" ")[0] for c in GEOFENCE_ZONES.split(", ")]
    full = df.withColumn("speed_factor", F.col("factor").cast("decimal(3,2)")).withColumn("active", F.lit(True)).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    return full.select(names)


def seed_zones(table: StoredTable) -> bool:
    """Put the first zones in, those of a name that is there already left out."""
    return table.append(ops.insert_new(table.read(), first_zones(table.spark), "name"))
