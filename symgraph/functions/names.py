"""Identifier normalisation and the matching of contract fields with storage attributes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_identifier(c: Column) -> Column:
    """camelCase, kebab-case and spaces to snake_case."""
    snake = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(snake, r"[-\s]", "_"))


def match_confidence(field: Column, attribute: Column) -> Column:
    """1.0 equal, 0.95 equal when normalised, 0.9 id conventions, 0.7 one holds the other, else 0."""
    a, b = normalize_identifier(field), normalize_identifier(attribute)
    ids = ((a == "id") & b.endswith("_id")) | ((b == "id") & a.endswith("_id")) | ((b == "_id") & a.endswith("id"))
    return F.when(field == attribute, 1.0).when(a == b, 0.95).when(ids, 0.9).when(a.contains(b) | b.contains(a), 0.7).otherwise(0.0)


def match_rule(confidence: Column) -> Column:
    return F.when(confidence == 1.0, "exact_name").when(confidence == 0.95, "case_normalized").when(confidence == 0.9, "identifier_convention").when(confidence == 0.7, "substring_heuristic").otherwise("none")


def type_status(engine: Column, attribute: Column, role: Column, field_type: Column, data_type: Column) -> Column:
    c, s = F.lower(field_type), F.lower(data_type)
    dense = c.contains("float") | c.contains("array") | c.contains("vector")
    return (
        F.when((engine == "mongodb") & (attribute == "_id"), "conversion_required")
        .when((engine == "vector") | F.coalesce(role == "vector", F.lit(False)), F.when(dense, "compatible").otherwise("conversion_required"))
        .when(c.contains("int") & s.contains("bigint"), "compatible")
        .when(c.contains("int") & s.contains("smallint"), "discrepancy")
        .otherwise("compatible")
    )


def compatibility(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "high").when(ratio >= 0.5, "medium").otherwise("low")
