"""Named data sets and results: Parquet with a JSON sidecar, below one folder."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Store(ABC):
    """Where data sets and results are kept by key; an engine takes any of these."""

    @abstractmethod
    def put(self, key: str, df: DataFrame, info: dict[str, Any] | None = None) -> DataFrame:
        """Keep df, and return what was kept: what follows starts from there."""

    @abstractmethod
    def get(self, key: str) -> DataFrame:
        """The kept rows; KeyError without any."""

    @abstractmethod
    def put_info(self, key: str, info: dict[str, Any]) -> None:
        """Keep what is to be known about a key."""

    @abstractmethod
    def info(self, key: str) -> dict[str, Any]:
        """What put_info() kept; KeyError without any."""

    @abstractmethod
    def __contains__(self, key: str) -> bool:
        """Whether anything is kept under the key."""


class DatasetStore(Store):
    """root: any folder that Spark's writers reach. Types survive; putting a key again replaces it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        if not key or any(c in key for c in "/\\:*?") or key.startswith("."):
            raise ValueError(f"not a key: {key!r}")
        return f"{self.root}/{key}"

    def put(self, key: str, df: DataFrame, info: dict[str, Any] | None = None) -> DataFrame:
        """Write df and read it back: what follows starts from the stored rows."""
        df.write.mode("overwrite").parquet(f"{self._path(key)}/data")
        self.put_info(key, info or {})
        return self.get(key)

    def get(self, key: str) -> DataFrame:
        if not self._exists(f"{self._path(key)}/data"):
            raise KeyError(key)
        return self.spark.read.parquet(f"{self._path(key)}/data")

    def put_info(self, key: str, info: dict[str, Any]) -> None:
        row = self.spark.createDataFrame([(json.dumps(info, default=str),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self._path(key)}/info")

    def info(self, key: str) -> dict[str, Any]:
        if not self._exists(f"{self._path(key)}/info"):
            raise KeyError(key)
        return json.loads(self.spark.read.text(f"{self._path(key)}/info").first().value)

    def __contains__(self, key: str) -> bool:
        return self._exists(f"{self._path(key)}/info")

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
