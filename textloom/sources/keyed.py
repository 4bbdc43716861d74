"""A table that is looked up by key: sorted files, the range of keys of each, and bloom filters inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: what finding one key reads at most.
ROW_GROUP = 8 << 20


class Keyed:
    """Rows, sorted by key, and the range ``(file, least, most)`` of each file. Finding a few keys opens the files whose
    range may hold one, and in them the row groups that ranges and bloom filters leave, however
    many files there are. Null keys are stored and never found."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", rows: str = "rows"):
        self.spark, self.path, self.key, self.name = spark, path.rstrip("/"), key, rows

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str = "document_id", made: dict[str, Column] | None = None) -> Keyed:
        """Store rows by key. ``made`` are columns that are added once rows are sorted: finding the
        ranges takes a pass over df, which would make them too."""
        store = cls(df.sparkSession, path, key)
        sorted_ = df.repartitionByRange(key).sortWithinPartitions(key).withColumns(made or {})
        sorted_.write.option("parquet.block.size", ROW_GROUP).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{store.path}/rows")
        return store.measure()

    def measure(self) -> Keyed:
        """Write the ranges of rows that lie there by key already."""
        named = self.rows().select(F.input_file_name().alias("file"), self.key)
        ranges = named.groupBy("file").agg(F.min(self.key).alias("least"), F.max(self.key).alias("most"))
        ranges.repartitionByRange("least").sortWithinPartitions("least").write.parquet(f"{self.path}/{self.name}-ranges")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.name}")

    def files(self, keys: list) -> list[str]:
        """The files that may hold one of the keys."""
        keys = [k for k in keys if k is not None]
        if not keys:
            return []
        ranges = self.spark.read.parquet(f"{self.path}/{self.name}-ranges")
        inside = F.exists(F.array(*map(F.lit, keys)), lambda k: k.between(F.col("least"), F.col("most")))
        near = (F.col("least") <= F.lit(max(keys))) & (F.col("most") >= F.lit(min(keys)))  # pushed down
        return [r["file"] for r in ranges.where(near & inside).select("file").collect()]

    def find(self, keys: list) -> DataFrame:
        """The rows of a few keys."""
        rows, files = self.rows(), self.files(keys)
        if not files:
            return rows.limit(0)
        return self.spark.read.schema(rows.schema).parquet(*files).where(F.col(self.key).isin(*(k for k in keys if k is not None)))
