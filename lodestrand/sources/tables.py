"""Tables in a folder: idempotent appends, a small key-value table, and markers of finished stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Parquet tables below ``root``, which any Spark file system may hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def append_if_absent(self, name: str, rows: DataFrame, key: str = "id") -> dict[str, int]:
        """Append rows whose key is not there yet; how many were created and how many skipped. Repeating it adds nothing."""
        staged = self._path(f"_staging/{name}-{uuid.uuid4().hex}")
        rows.dropDuplicates([key]).write.parquet(staged)  # the plan above runs once
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        total = rows.count()
        new = rows.join(self.read(name).select(key), key, "left_anti") if self.exists(name) else rows
        created = new.count() if self.exists(name) else total
        if created or not self.exists(name):
            new.write.mode("append").parquet(self._path(name))
        self._delete(staged)
        return {"created": created, "skipped": total - created}

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def put(self, key: str, value: str) -> None:
        """Set one key of the table ``meta``. Versions are appended; the latest counts."""
        version = (self._meta().agg(F.max("version")).first()[0] or 0) + 1 if self.exists("meta") else 1
        self.spark.createDataFrame([(key, value, version, uuid.uuid4().hex)], "key string, value string, version long, write string").coalesce(1).write.mode("append").parquet(self._path("meta"))

    def _meta(self) -> DataFrame:
        return self.spark.read.schema("key string, value string, version long, write string").parquet(self._path("meta"))

    def get(self, key: str) -> str | None:
        if not self.exists("meta"):
            return None
        row = self._meta().where(F.col("key") == key).orderBy(F.desc("version"), "write").first()
        return row["value"] if row else None


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
