"""The graph as a set of tables. Facts hold raw references; edges are derived from them, so a change can leave no stale edge."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


@dataclass(frozen=True)
class SymGraph:
    files: DataFrame
    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame
    heritage: DataFrame
    documents: DataFrame | None = None
    sections: DataFrame | None = None
    rules: DataFrame | None = None
    documents_edges: DataFrame | None = None
    tests_for: DataFrame | None = None
    governs: DataFrame | None = None
    contract_entities: DataFrame | None = None
    contract_fields: DataFrame | None = None
    storage_containers: DataFrame | None = None
    storage_attributes: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> SymGraph:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}


def empty_facts(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], ddl) for name, ddl in schemas.TABLES.items()}


def build(facts: dict[str, DataFrame]) -> SymGraph:
    """Facts (the tables of ``schemas.TABLES``) to a graph with all edges resolved and linked."""
    from ..operators import ingest, link

    g = SymGraph(
        files=facts["files"], symbols=facts["symbols"],
        calls=ingest.resolve_calls(facts["raw_calls"], facts["symbols"]),
        imports=ingest.resolve_imports(facts["raw_imports"], facts["files"]),
        heritage=ingest.resolve_heritage(facts["raw_heritage"], facts["symbols"]),
        documents=facts["documents"], sections=facts["sections"], rules=facts["rules"],
        contract_entities=facts["contract_entities"], contract_fields=facts["contract_fields"], storage_containers=facts["storage_containers"], storage_attributes=facts["storage_attributes"],
    )
    return link.link_all(g)


def name_or_qname(symbols: DataFrame, wanted: str) -> F.Column:
    return (F.col("name") == wanted) | (F.col("qname") == wanted)
