"""Ad-hoc questions in SQL, over views of the graph; the pattern language is in ``pattern``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .graph import SymGraph

def register_views(g: SymGraph, prefix: str = "") -> list[str]:
    for name, table in g.tables().items():
        table.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in g.tables()]


def sql(spark: SparkSession, g: SymGraph, text: str, **parameters) -> DataFrame:
    """Spark SQL over the graph's tables, with named parameters ``:x``."""
    register_views(g)
    return spark.sql(text, args=parameters)
