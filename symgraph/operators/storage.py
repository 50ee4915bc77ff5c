"""Contracts and storage: which attribute holds which field, and what a change of an attribute breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import compatibility, match_confidence, match_rule, normalize_identifier, type_status
from ..plans.graph import SymGraph
from .impact import affected_tests

#: Removed from a container's name before it is compared: only the last of these is bound to the end (fixed value).
_CONTAINER_SUFFIX = "_request|_response|_model|_schema|_dto$"


def find_entity(entities: DataFrame, wanted: str) -> DataFrame:
    return entities.where(F.col("name").contains(wanted)).orderBy(F.col("name") != wanted, "name", "id").limit(1)


def find_container(g: SymGraph, entity: DataFrame, target: str | None, engine: str | None, engine_binds_contains_only: bool = False) -> DataFrame:
    """By name, then by part of it; without a target by the entity's normalised name; else any container of the engine."""
    c, is_engine = g.storage_containers, F.lit(True) if engine is None else F.col("engine") == engine
    if target is not None:
        equal = F.col("name") == target
        part = F.col("name").contains(target) & is_engine
        first = c.where(equal | part if engine_binds_contains_only else (equal & is_engine) | part).withColumn("_r", (~equal).cast("int"))
    else:
        stem = lambda x: F.regexp_replace(normalize_identifier(x), _CONTAINER_SUFFIX, "")
        e = entity.select(stem(F.col("name")).alias("_e"))
        s = normalize_identifier(F.col("name"))
        first = c.where(is_engine).crossJoin(e).where(s.contains(F.col("_e")) | F.col("_e").contains(s)).drop("_e").withColumn("_r", F.lit(0))  # one entity
    any_ = c.where(is_engine).withColumn("_r", F.lit(9))
    return first.unionByName(any_).orderBy("_r", "name", "id").limit(1).drop("_r")


def best_matches(fields: DataFrame, attributes: DataFrame) -> DataFrame:
    """Of each field the attribute of the greatest confidence, at least 0.7; ties go to the first attribute by id.

    ``fields(entity_id, field_id, field, raw_type)`` and ``attributes(entity_id, attribute_id, attribute, data_type, attribute_role, engine)``
    are those of one entity and the container it maps to, so the pairs compared are an entity's fields times a container's attributes.
    """
    scored = fields.join(attributes, "entity_id").withColumn("confidence", match_confidence(F.col("field"), F.col("attribute"))).where("confidence >= 0.7")
    w = Window.partitionBy("entity_id", "field_id").orderBy(F.desc("confidence"), "attribute_id")
    best = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.withColumn("rule", match_rule(F.col("confidence"))).withColumn("type_status", type_status(F.col("engine"), F.col("attribute"), F.col("attribute_role"), F.col("raw_type"), F.col("data_type")))


def contract_storage_mapping(g: SymGraph, contract: str, target: str | None = None, engine: str | None = None) -> dict[str, DataFrame]:
    entity = find_entity(g.contract_entities, contract)
    container = find_container(g, entity, target, engine)
    e = entity.select(F.col("id").alias("_e"))
    fields = g.contract_fields.join(e, F.col("entity_id") == F.col("_e"), "left_semi").select("entity_id", F.col("id").alias("field_id"), F.col("name").alias("field"), "raw_type")
    c = container.select(F.col("id").alias("_c"), "engine").crossJoin(e)  # one row each
    attributes = g.storage_attributes.join(c, F.col("container_id") == F.col("_c")).select(F.col("_e").alias("entity_id"), F.col("id").alias("attribute_id"), F.col("name").alias("attribute"), "data_type", "attribute_role", "engine")
    mapped = best_matches(fields, attributes)
    total = fields.agg(F.count("*").alias("fields")).crossJoin(mapped.agg(F.count("*").alias("mapped")))
    ratio = F.when(F.col("fields") > 0, F.col("mapped") / F.col("fields")).otherwise(F.lit(0.0))
    return {
        "entity": entity, "container": container, "mappings": mapped,
        "unmapped_fields": fields.join(mapped.select("field_id"), "field_id", "left_anti"),
        "unmapped_attributes": attributes.join(mapped.select("attribute_id"), "attribute_id", "left_anti"),
        "summary": total.withColumn("compatibility", compatibility(ratio)),
    }


def migration_risk(contracts, symbols, action: str):
    return F.when((contracts > 2) | F.lit(action == "drop"), "critical").when(contracts > 0, "high").when(symbols > 3, "medium").otherwise("low")


#: Advice by action (fixed values).
ADVICE = {
    "drop": ["Stop writing the attribute and deploy before it is dropped.", "Remove or default the contract fields first.", "Keep a backup of the column."],
    "rename": ["Add the new name, write to both, backfill, then remove the old one.", "Keep contract names and map them to the new attribute."],
    "type_change": ["Check ranges and precision of the stored values.", "Convert into a new attribute and swap."],
}


def storage_migration_impact(g: SymGraph, container: str, attribute: str, action: str = "drop", limit: int | None = 20, scoped: bool = False) -> dict[str, DataFrame]:
    """``contracts``: fields whose normalised name equals, holds or is held by the attribute's; ``symbols``: whose name or signature holds it; ``tests``; ``risk``: one row.

    With ``scoped`` only fields of entities that map to the container count.
    """
    a = normalize_identifier(F.lit(attribute))
    f = normalize_identifier(F.col("name"))
    fields = g.contract_fields.where(f.contains(a) | a.contains(f))
    owners = g.contract_entities.select(F.col("id").alias("_e"), F.col("name").alias("entity"), F.col("file").alias("entity_file"))
    contracts = fields.join(owners, F.col("entity_id") == F.col("_e")).select("entity", "entity_file", F.col("name").alias("field"), "raw_type")
    if scoped:
        contracts = contracts.where(normalize_identifier(F.col("entity")).contains(normalize_identifier(F.lit(container)).substr(F.lit(1), F.length(F.lit(container)) - 1)))
    symbols = g.symbols.where(F.col("name").contains(attribute) | F.coalesce(F.col("signature").contains(attribute), F.lit(False))).select("id", "name", "kind", "file", "start_line")
    symbols = symbols if limit is None else symbols.orderBy("file", "start_line", "id").limit(limit)
    tests = affected_tests(g, symbols.select("file")).select("test_path").distinct()
    counts = contracts.agg(F.count("*").alias("contracts")).crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(tests.agg(F.count("*").alias("tests")))
    risk = counts.withColumn("level", migration_risk(F.col("contracts"), F.col("symbols"), action))
    advice = g.symbols.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ADVICE.get(action, ["Review the listed contracts and symbols by hand."]))], "position int, advice string")
    return {"contracts": contracts, "symbols": symbols, "tests": tests, "risk": risk, "advice": advice}
