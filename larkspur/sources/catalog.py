"""A database as an immutable mapping of table names to DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

from ..schemas import DDL, schema


@dataclass(frozen=True)
class Database:
    """Commands return a new one; nothing is changed in place."""

    spark: SparkSession
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.spark.createDataFrame([], schema(name))

    def replaced(self, **tables: DataFrame) -> Database:
        return Database(self.spark, MappingProxyType({**self.tables, **tables}))

    def views(self, prefix: str = "") -> None:
        """Registers every table as a temporary view."""
        for name in DDL:
            self[name].createOrReplaceTempView(prefix + name)

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows: list[tuple]) -> Database:
        return cls(spark, MappingProxyType({name: spark.createDataFrame(values, schema(name)) for name, values in rows.items()}))

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, kind: str = "parquet", names: tuple[str, ...] = tuple(DDL), **options) -> Database:
        """Tables stored one folder each, with the fixed schema (nothing is inferred). kind: parquet, orc, csv or json."""
        return cls(spark, MappingProxyType({name: spark.read.format(kind).options(**options).schema(schema(name)).load(f"{folder}/{name}") for name in names}))

    def save(self, folder: str, kind: str = "parquet", mode: str = "error", **options) -> None:
        for name, df in self.tables.items():
            df.write.format(kind).options(**options).mode(mode).save(f"{folder}/{name}")
