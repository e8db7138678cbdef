"""Shared storage: the folder that driver and executors share, and sets of tables that are published together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder below the warehouse where it is unset and the master is a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_scratch"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Published:
    """Versions of a set of tables under one path; readers see all tables of one version.

    A version is written whole before its number is claimed by creating one small file, which either exists or doesn't;
    so a failure midway leaves the version before, and of two writers that started from one version the second fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """Number of the current version; 0: none yet."""
        files, at = self._fs(f"{self.path}/_versions")
        return max([int(f.getPath().getName()) for f in files.listStatus(at)], default=0) if files.exists(at) else 0

    def read(self, name: str, version: int | None = None) -> DataFrame:
        number = version or self.version()
        if not number:
            raise LookupError(f"nothing is published under {self.path}")
        files, at = self._fs(f"{self.path}/_versions/{number:09d}")
        stream = files.open(at)
        try:
            folder = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.path}/{folder}/{name}")

    def publish(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes the tables as the version after base (the current one) and gives its number."""
        number, folder = (self.version() if base is None else base) + 1, f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        files, at = self._fs(f"{self.path}/_versions/{number:09d}")
        try:
            stream = files.create(at, False)
        except Exception as e:
            if not files.exists(at):
                raise
            raise RuntimeError(f"version {number} of {self.path} was published by another writer") from e
        stream.write(folder.encode())
        stream.close()
        return number
