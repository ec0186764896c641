"""Intermediate tables of a query in the shared folder: they cut lineage, survive lost executors and go when replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undertow.session import shared_dir


class Tables:
    """Parquet tables under names of their own; a table written again under its name takes the place of the last one.

    The last one is deleted after the new one is complete, so a table may be derived from what it replaces. Whoever
    writes a name again must have written everything else that still reads the old rows.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}-{spark.sql('SELECT uuid()').first()[0]}"
        self.turn: dict[str, int] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        turn = self.turn.get(name, -1) + 1
        path = f"{self.base}/{name}-{turn}"
        df.write.parquet(path)
        if turn:
            self._delete(f"{self.base}/{name}-{turn - 1}")
        self.turn[name] = turn
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            if name in self.turn:
                self._delete(f"{self.base}/{name}-{self.turn[name]}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
