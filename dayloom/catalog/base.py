"""A named query and the rounding that both of its forms share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()     # columns rounded on both sides before comparing
    digits: int = 6

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        new = {c: F.round(c, self.digits) + F.lit(0.0) for c in self.doubles}
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
                new[f.name] = F.col(f.name).cast("long")
        return df.withColumns(new) if new else df

    def oracle(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        rounded = ", ".join(f"round({c}, {self.digits}) + 0.0::DOUBLE AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql}) AS q"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
