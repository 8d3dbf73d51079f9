"""Artifacts as Parquet under a revision folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import shared_folder


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str, revision: str):
        self.spark, self.path, self._cached = spark, f"{root.rstrip('/')}/{revision}", {}

    @classmethod
    def temporary(cls, spark: SparkSession) -> ArtifactStore:
        """In the folder all machines share; a local one only where the cluster names none."""
        return cls(spark, shared_folder(spark), f"artifacts-{uuid.uuid4().hex}")

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.forget(name)

    def read(self, name: str) -> DataFrame:
        """Columns added later come as null in older files."""
        if name not in self._cached:
            self._cached[name] = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}")
        return self._cached[name]

    def write_json(self, name: str, df: DataFrame) -> None:
        """Records as JSON lines, one file for each task."""
        df.write.mode("overwrite").json(f"{self.path}/{name}.json")

    def read_json(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.path}/{name}.json")

    def write_raster(self, name: str, cells: DataFrame, res: float, crs: str) -> None:
        """Cells (rw, cl, value; null is no data) and a header row beside them."""
        self.write(f"raster-{name}", cells)
        self.write_json(f"raster-{name}-header", self.spark.createDataFrame([(res, crs)], "res double, crs string"))

    def read_raster(self, name: str) -> tuple[DataFrame, DataFrame]:
        return self.read(f"raster-{name}"), self.read_json(f"raster-{name}-header", "res double, crs string")

    def forget(self, name: str) -> None:
        if name in self._cached:
            self._cached.pop(name).unpersist()
