"""Versioned scene tables: all tables of a scene set change together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SceneStore:
    """Parquet tables under `<base>/v=<n>/<table>`; the newest committed version counts.

    A version becomes visible only by the row appended to the commit log after all its
    tables are written, so readers never see a half-moved scene. Earlier versions stay
    readable, which is the backup of an overwritten result.
    """

    # Tables large enough to be laid out by frame.
    PARTITIONED = ("points",)

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _log(self) -> str:
        return f"{self.base}/commits"

    def version(self) -> int:
        """Newest committed version, 0 when there is none."""
        try:
            log = self.spark.read.schema("version bigint, tables array<string>").json(self._log())
        except AnalysisException:
            return 0
        return log.agg(F.max("version")).first()[0] or 0

    def tables(self, version: int | None = None) -> dict[str, int]:
        """Version in which each table was last written, as of `version`."""
        wanted = self.version() if version is None else version
        if wanted == 0:
            return {}
        log = self.spark.read.schema("version bigint, tables array<string>").json(self._log())
        newest = log.where(F.col("version") <= wanted).select("version", F.explode("tables").alias("t"))
        return {r["t"]: r["v"] for r in newest.groupBy("t").agg(F.max("version").alias("v")).collect()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        written = self.tables(version)
        if table not in written:
            raise FileNotFoundError(f"no table {table} in {self.base}")
        return self.spark.read.parquet(f"{self.base}/v={written[table]}/{table}")

    def write(self, tables: Mapping[str, DataFrame]) -> int:
        """Write a new version holding `tables`; the others stay as they were."""
        version = self.version() + 1
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            if name in self.PARTITIONED:
                # Sorted files let row-group statistics skip frames nobody asked for.
                writer = df.repartitionByRange("room", "frame_idx").sortWithinPartitions("room", "frame_idx").write.mode("overwrite")
            writer.parquet(f"{self.base}/v={version}/{name}")
        done = self.spark.createDataFrame([(version, sorted(tables))], "version bigint, tables array<string>")
        done.coalesce(1).write.mode("append").json(self._log())
        return version
